"""Sharding by best-fit-decreasing bin packing.

Documents with equal texts are an indivisible group. Groups sorted by size enter the shard with
the tightest room that still holds them, found in a balanced tree of the rooms; if none holds
one, it enters the shard with the most room. Only sizes decide, so the packing runs over the table
of distinct sizes and their counts, largest first: the shard that took a group stays the tightest
for the next of the same size, so a run of equal sizes is placed in a step for each shard that it fills.
One task streams that table, which for a sum of S bytes has fewer than sqrt(2 S) rows, and holds
the tree; the groups themselves are spread, and find their shard by their rank among those of
their size. The result is that of placing all groups one by one, at every size of the input.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterable, Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ripplet.llm.common import cut_lineage, split_join


class Rooms:
    """A treap, balanced by random priorities, of ``(room, shard)``."""

    def __init__(self, rooms: list[tuple[int, int]]):
        self.random, self.root = random.Random(0), None
        for x in rooms:
            self.add(x)

    def add(self, key: tuple[int, int]) -> None:
        low, high = self._split(self.root, key)
        self.root = self._merge(self._merge(low, [key, self.random.random(), None, None]), high)

    def take(self, size: int) -> tuple[int, int]:
        """Remove and return the tightest room that holds ``size``, else the largest room."""
        low, high = self._split(self.root, (size, -1))
        if high is None:
            low, high = None, low
            node = high
            while node[3]:
                node = node[3]
        else:
            node = high
            while node[2]:
                node = node[2]
        key = node[0]
        below, rest = self._split(high, key)
        _, above = self._split(rest, (key[0], key[1] + 1))
        self.root = self._merge(self._merge(low, below), above)
        return key

    def _split(self, node, key):
        """Trees of what is below ``key`` and of the rest."""
        if node is None:
            return None, None
        if node[0] < key:
            low, high = self._split(node[3], key)
            return [node[0], node[1], node[2], low], high
        low, high = self._split(node[2], key)
        return low, [node[0], node[1], high, node[3]]

    def _merge(self, a, b):
        if a is None or b is None:
            return a or b
        if a[1] < b[1]:
            return [a[0], a[1], a[2], self._merge(a[3], b)]
        return [b[0], b[1], self._merge(a, b[2]), b[3]]


def best_fit(runs: Iterable[tuple[int, int]], rooms: list[int]) -> Iterator[list[tuple[int, int]]]:
    """For each ``(size, count)``, sizes in falling order: the shards of its groups as ``(shard, how many)``, in order."""
    tree = Rooms([(room, i) for i, room in enumerate(rooms)])
    for size, count in runs:
        taken = []
        while count:
            room, shard = tree.take(size)
            n = min(count, max(1, room // size))
            tree.add((room - n * size, shard))
            taken.append((shard, n))
            count -= n
        yield taken


def place_sizes(groups: DataFrame, n_shards: int) -> DataFrame:
    """``(bytes, n, shards, until)`` for ``groups(bytes, ...)``: for each size its groups, and the shards of the ranks below ``until``.

    A size has at most a shard's entry twice, so its row is bounded by ``n_shards``.
    """
    total = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    fair, left = total, n_shards  # groups above a fair part fill a shard of their own
    for r in groups.select("bytes").orderBy(F.desc("bytes")).limit(n_shards - 1).collect():
        if r.bytes * left > fair:
            fair, left = fair - r.bytes, left - 1
    rooms = [math.ceil(fair / left)] * n_shards

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pending: list[pd.DataFrame] = []

        def runs() -> Iterator[tuple[int, int]]:
            for batch in batches:
                if len(batch):
                    pending.append(batch)
                    yield from zip(batch.bytes.tolist(), batch.n.tolist(), strict=True)

        placed = best_fit(runs(), rooms)
        first = next(placed, None)
        while first is not None:
            batch = pending.pop()
            taken = [first, *(next(placed) for _ in range(len(batch) - 1))]
            until = [list(accumulate(n for _, n in t)) for t in taken]
            yield batch.assign(shards=[[s for s, _ in t] for t in taken], until=until)
            first = next(placed, None)

    sizes = groups.groupBy("bytes").agg(F.count("*").alias("n"))
    return sizes.repartition(1).sortWithinPartitions(F.desc("bytes")).mapInPandas(place, "bytes long, n long, shards array<int>, until array<long>")


def pack_groups(groups: DataFrame, n_shards: int, chunk_rows: int = 20_000) -> DataFrame:
    """``(g1, g2, g3, shard)`` for ``groups(g1, g2, g3, bytes)``, each group once.

    Groups of one size are ranked in chunks of about ``chunk_rows``, which do not change the loads of shards.
    """
    sizes = cut_lineage(place_sizes(groups, n_shards))
    dealt = split_join(groups.select("g1", "g2", "g3", "bytes"), sizes, "bytes").withColumn("chunk", F.pmod("g1", F.floor(F.col("n") / chunk_rows) + 1))
    dealt = cut_lineage(dealt.select("g1", "g2", "g3", "bytes", "chunk", "shards", "until"))
    counts = dealt.groupBy("bytes", "chunk").agg(F.count("*").alias("rows"))
    before = Window.partitionBy("bytes").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("bytes", "chunk", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("bytes", "chunk").orderBy("g1", "g2", "g3")
    ranked = dealt.withColumn("k", F.row_number().over(within)).join(starts, ["bytes", "chunk"]).withColumn("k", F.col("first") + F.col("k") - 1)
    passed = F.size(F.filter("until", lambda u: u <= F.col("k")))
    return ranked.select("g1", "g2", "g3", F.element_at("shards", passed + 1).alias("shard"))


def shard(docs: DataFrame, n_shards: int = 24, chunk_rows: int = 20_000) -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)`` for each row of ``docs(doc_id, text, ...)``.

    The law is ``bytes``: shards have near-equal sums of ``size``, the text's UTF-8 bytes and 8.
    Rows with equal texts share a shard; a group that is larger than a shard's fair part makes its
    shard that much larger, as it cannot be split. A null text counts as an empty one. Slots are
    gapless from 0 in a shard, in chunks of doc_ids' hashes and by doc_id there. Repeated rows each
    get a slot, null ids too; an empty table gives no rows. Other columns are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = cut_lineage(docs.select(
        F.col("doc_id").cast("long"), (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("g1")))
    groups = cut_lineage(rows.groupBy("g1", F.col("text_crc32").alias("g2"), F.col("size").alias("g3")).agg((F.count("*") * F.col("size")).alias("bytes"), F.count("*").alias("n")))
    n = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    dealt = pack_groups(groups, n_shards, chunk_rows).select("g1", F.col("g2").alias("text_crc32"), F.col("g3").alias("size"), "shard")
    keys = ["g1", "text_crc32", "size"]
    placed = cut_lineage(split_join(rows, dealt, keys).withColumn("chunk", F.pmod(F.hash("doc_id", "g1"), F.lit(n // chunk_rows + 1))))
    counts = placed.groupBy("shard", "chunk").agg(F.count("*").alias("rows"))
    before = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "chunk", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("shard", "chunk").orderBy("doc_id", "text_crc32", "size")
    return placed.withColumn("k", F.row_number().over(within)).join(starts, ["shard", "chunk"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("first") + F.col("k") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
