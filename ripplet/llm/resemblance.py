"""Documents whose sets of word shingles have a given Jaccard similarity at least.

Equal sets are one node. A set's signature has least hashes, each under another multiplier, in
bands; sets that agree in a whole band share its bucket. How many bands of how many hashes follows from
the similarity: of pairs just as similar, one in 2500 shares no bucket. As with lines, every set of a
bucket is checked against one of them first, then pairs whose sets are still in different components.
Sizes and bitmaps, which differ in no more bits than the sets in shingles, rule out pairs for certain;
what is left is checked by exact Jaccard similarity.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplet.llm.common import components, cut_lineage, map_batches, sifted, split_join

#: Least hashes of a signature at most, 64-bit words of a bitmap, and the share of pairs at the similarity that may be in no bucket together.
HASHES, WORDS, MISSED = 100, 8, 1 / 2500
FACTORS = np.random.default_rng(1).integers(0, 1 << 63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Shingles whose hashes are multiplied at once.
BLOCK = 1 << 11
SIGNED = "sid long, size long, keys array<long>, " + ", ".join(f"s{w} long" for w in range(WORDS))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * MIX
    return x ^ x >> np.uint64(29)


def banding(similarity: float) -> tuple[int, int]:
    """``(bands, rows)``: the longest bands with which no more than ``MISSED`` of pairs of this similarity share none."""
    for rows in range(8, 0, -1):
        bands = 1 if similarity >= 1 else math.ceil(math.log(MISSED) / math.log1p(-(similarity**rows))) if similarity > 0 else HASHES + 1
        if bands * rows <= HASHES:
            return bands, rows
    raise ValueError(f"similarity: {similarity} needs more than {HASHES} hashes")


def signature(hashes: np.ndarray, similarity: float = 0.8) -> tuple:
    """``SIGNED`` of a set of shingle hashes, sorted and distinct; all null for the empty set."""
    if not len(hashes):
        return (None,) * (3 + WORDS)
    bands, rows = banding(similarity)
    factors = FACTORS[: bands * rows]
    least = np.full(len(factors), ~np.uint64(0))
    for k in range(0, len(hashes), BLOCK):
        least = np.minimum(least, (hashes[k : k + BLOCK, None] * factors).min(0))
    keys = _mix((least.reshape(bands, rows) * FACTORS[:rows]).sum(1, dtype=np.uint64) + np.arange(bands, dtype=np.uint64) * MIX)
    odd = np.bincount((_mix(hashes) >> np.uint64(20)).astype(np.int64) & 64 * WORDS - 1, minlength=64 * WORDS) & 1
    bits = np.packbits(odd.astype(bool), bitorder="little").view("<i8")
    place = _mix(np.arange(len(hashes), dtype=np.uint64) + MIX)
    sid = _mix((_mix(hashes ^ place)).sum(dtype=np.uint64, keepdims=True))
    return int(sid.view(np.int64)[0]), len(hashes), keys.view(np.int64).tolist(), *bits.tolist()


def _near(a: str, b: str, similarity: float) -> Column:
    """Whether sizes and bitmaps allow the similarity."""
    off = F.lit(0)
    for w in range(WORDS):
        off = off + F.bit_count(F.col(f"{a}.s{w}").bitwiseXOR(F.col(f"{b}.s{w}")))
    sizes = F.least(f"{a}.size", f"{b}.size") >= F.greatest(f"{a}.size", f"{b}.size") * (similarity - 1e-9)
    return sizes & (off <= (F.col(f"{a}.size") + F.col(f"{b}.size")) * ((1 - similarity) / (1 + similarity) + 1e-9))


def _verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame, shingles, similarity: float) -> DataFrame:
    """The pairs ``(a, b)`` whose sets have this Jaccard similarity at least."""
    pairs = cut_lineage(pairs)
    ids = pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).distinct()
    wanted, text = cut_lineage(sets.join(ids, "sid", "left_semi").select("th", "sid")), F.col("text").cast("string")
    rows, _ = sifted(docs.select(F.xxhash64(text).alias("th"), text.cast("binary").alias("text")), wanted, ["th"])
    texts = rows.dropDuplicates(["th"]).join(wanted, "th")  # copies of a text go before the join; a set has one ``th``

    def hashed(batch: pa.RecordBatch) -> pa.RecordBatch:
        held = [shingles(t).tobytes() for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(held, pa.binary())], ["sid", "held"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[i].as_py(), np.uint64) for c in (2, 3))
                common = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(common >= similarity * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    held = cut_lineage(map_batches(texts.select("sid", "text"), hashed, "sid long, held binary"))
    both = split_join(pairs, held.withColumnsRenamed({"sid": "b", "held": "y"}), "b")
    both = split_join(both, held.withColumnsRenamed({"sid": "a", "held": "x"}), "a")  # last: what many pairs have in common is not shuffled with each
    return cut_lineage(both.select("a", "b", "x", "y").mapInArrow(check, "a long, b long"))


def groups(own: DataFrame, docs: DataFrame, shingles, similarity: float = 0.8) -> DataFrame:
    """``(sid, root)``: for each set of ``own(th, *SIGNED)`` that has a similar one the least set of its component.

    ``th`` is the hash of a text of ``docs``, ``shingles`` the function from a text to its sorted hashes.
    """
    sets = own.where("sid is not null").groupBy("sid").agg(F.min("th").alias("th"), *[F.first(c).alias(c) for c in ("size", "keys", *(f"s{w}" for w in range(WORDS)))])
    sets = cut_lineage(sets)
    marks, buckets = sets.select("sid", "size", *(f"s{w}" for w in range(WORDS))), sets.select(F.explode("keys").alias("key"), "sid")
    stars = buckets.groupBy("key").agg(F.count("*").alias("k"), F.min("sid").alias("star")).where("k > 1").drop("k")
    shared = cut_lineage(split_join(buckets, stars, "key"))
    rays = shared.where("sid != star").select(F.col("star").alias("a"), F.col("sid").alias("b")).distinct()
    rays = split_join(rays, marks.select(F.col("sid").alias("a"), F.struct(*marks.columns).alias("x")), "a")
    rays = split_join(rays, marks.select(F.col("sid").alias("b"), F.struct(*marks.columns).alias("y")), "b").where(_near("x", "y", similarity)).select("a", "b")
    first = _verified(rays, sets, docs, shingles, similarity)
    rooted = split_join(shared.select("key", "sid"), components(first).withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    rooted = cut_lineage(rooted)
    mixed = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
    marked = cut_lineage(split_join(split_join(rooted, mixed, "key"), marks, "sid"))
    x, y = marked.alias("x"), marked.alias("y")
    pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.root") < F.col("y.root")) & _near("x", "y", similarity))
    pairs = pairs.select(F.least("x.sid", "y.sid").alias("a"), F.greatest("x.sid", "y.sid").alias("b")).distinct()
    second = _verified(pairs, sets, docs, shingles, similarity)
    return components(first.unionByName(second)).withColumnRenamed("node", "sid")
