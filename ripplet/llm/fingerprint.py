"""Document fingerprints: SimHash over weighted terms, searched in permuted block tables.

A text's terms are its words and pairs of neighbouring words. Each term's 128-bit hash votes on
every bit, for it where the hash has a one and against it elsewhere, with the term's weight: a
damped count times 1 for a word and 2 for a pair, as pairs tell texts apart better.
The search for all fingerprints within ``radius`` bits cuts them into blocks. Two fingerprints
within the radius agree in at least ``blocks - radius`` of them, so the tables, one for each choice
of so many blocks that go first and make its key, hold every such pair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ripplet.llm.common import cut_lineage, split_join

BITS = 128
#: Terms whose bits are weighed at once, and words whose hashes a task remembers.
BLOCK, CACHE = 1 << 14, 300_000
#: Odd multipliers that mix word hashes into those of pairs.
MIX = np.array([[0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], [0xBF58476D1CE4E5B9, 0x94D049BB133111EB]], np.uint64)


class SimHash:
    """Fingerprints of UTF-8 texts as two unsigned halves."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def words(self, text: bytes) -> np.ndarray:
        parts, known = text.lower().split(), self.known
        if missing := set(parts).difference(known):
            if len(known) > CACHE:
                known.clear()
                missing = set(parts)
            for word in missing:
                known[word] = xxhash.xxh64_intdigest(word)
        return np.fromiter(map(known.__getitem__, parts), np.uint64, len(parts))

    def __call__(self, text: bytes | None) -> tuple[int, int]:
        words = self.words(text or b"")
        votes = np.zeros(BITS)
        pairs = _mix(words[:-1] * MIX[0, 0] + words[1:] * MIX[0, 1]) if len(words) > 1 else words[:0]
        for terms, weight in ((words, 1.0), (pairs, 2.0)):
            terms, counts = np.unique(terms, return_counts=True)
            weights = (weight * (1 + np.log(counts))).astype(np.float32)
            for k in range(0, len(terms), BLOCK):
                part = terms[k : k + BLOCK]
                hashes = np.stack([_mix(part), _mix(part + MIX[1, 1])], 1)
                bits = np.unpackbits(hashes.view(np.uint8), axis=1, bitorder="little")
                votes += weights[k : k + BLOCK] @ bits.astype(np.float32) * 2 - weights[k : k + BLOCK].sum()
        low, high = np.packbits(votes > 0, bitorder="little").view("<u8").tolist()
        return low, high


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX[1, 0]
    x = (x ^ (x >> np.uint64(27))) * MIX[1, 1]
    return x ^ (x >> np.uint64(31))


EDITED = "kind int, part int, doc_id long, text string, n_chars long, edited_sha256 string, low long, high long, edited_low long, edited_high long, next_low long, next_high long"


def edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, its edited text and the next document's, in the columns of ``EDITED``.

    The documents are in falling order of doc_id, nulls last, ties by the text's hash; after the
    last comes the first. The edited text has the last third of its code points replaced by the
    first as many of the next document's text. The texts are shuffled once, by ranges of doc_id. A
    task knows the next document of all rows but its last; those few and the first text of each
    range are joined afterwards.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]
    ranged = docs.select(F.col("doc_id").cast("long"), text.alias("text")).repartitionByRange(*order).sortWithinPartitions(*order)
    done = cut_lineage(ranged.mapInArrow(_in_order, EDITED))
    first, last = done.where("kind = 1").select("part", F.col("text").alias("next_text")), done.where("kind = 2")
    parts = first.select("part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy())).alias("next"))  # a number for each task
    pairs = last.join(parts, "part").drop("text").join(last.select("part", "text"), "part").join(first.withColumnRenamed("part", "next"), "next").select("doc_id", "text", "next_text")
    return done.where("kind = 0").unionByName(pairs.mapInArrow(_pairs, EDITED)).drop("kind", "part", "text")


def _row(doc: int | None, text: str, own: tuple, following: str, next_own: tuple, simhash: SimHash) -> tuple:
    keep = len(text) - len(text) // 3
    new = (text[:keep] + following[: len(text) - keep]).encode()
    return (0, 0, doc, None, len(text), hashlib.sha256(new).hexdigest(), *own, *simhash(new), *next_own)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    fields = [(n, {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}[t]) for n, t in (f.split() for f in EDITED.split(", "))]
    columns = [[x - (1 << 64) if i > 5 and x is not None and x >> 63 else x for x in c] for i, c in enumerate(zip(*rows, strict=True))]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    simhash, part, before = SimHash(), TaskContext.get().partitionId(), None
    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            rows = []
            for doc, text in zip(*(batch.column(i)[k : k + 256].to_pylist() for i in (0, 1)), strict=True):
                own = simhash(text.encode())
                rows.append(_row(*before, text, own, simhash) if before else (1, part, None, text, *[None] * 8))
                before = doc, text, own
            yield _batch(rows)
    if before:
        yield _batch([(2, part, before[0], before[1], *[None] * 8)])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    simhash = SimHash()
    for batch in batches:
        if batch.num_rows:
            rows = zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)
            yield _batch([_row(doc, text, simhash(text.encode()), after, simhash(after.encode()), simhash) for doc, text, after in rows])


def hamming(a: str, b: str) -> Column:
    """Differing bits between the fingerprints in columns ``{a}low, {a}high`` and ``{b}low, {b}high``."""
    return F.bit_count(F.col(f"{a}low").bitwiseXOR(F.col(f"{b}low"))) + F.bit_count(F.col(f"{a}high").bitwiseXOR(F.col(f"{b}high")))


def _tables(radius: int, blocks: int) -> Column:
    """The keys of a fingerprint ``low, high`` in each block table; blocks lie within one half each."""
    if blocks % 2 or blocks <= radius:
        raise ValueError("blocks: an even number above the radius")
    n = blocks // 2
    cuts = [round(64 * i / n) for i in range(n + 1)]
    parts = [F.shiftrightunsigned(half, a).bitwiseAND(F.lit((1 << (b - a)) - 1 if b - a < 64 else -1)) for half in ("low", "high") for a, b in zip(cuts, cuts[1:], strict=False)]
    return F.array(*[F.xxhash64(F.lit(t), *chosen) for t, chosen in enumerate(combinations(parts, blocks - radius))])


def search(queries: DataFrame, fps: DataFrame, radius: int = 3, blocks: int = 4) -> DataFrame:
    """``(q_low, q_high, low, high, n)``: for each distinct query all fingerprints of ``fps(low, high, n)``, each once, within ``radius`` bits."""
    asked = queries.select("low", "high").distinct().withColumn("key", F.explode(_tables(radius, blocks))).select("key", F.col("low").alias("q_low"), F.col("high").alias("q_high"))
    held = fps.select("low", "high", "n", F.explode(_tables(radius, blocks)).alias("key"))
    return asked.join(held, "key").where(hamming("q_", "") <= radius).drop("key").distinct()


def text_of(low: str, high: str) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(high), 16, "0"), F.lpad(F.hex(low), 16, "0")))


def fingerprint_edits(docs: DataFrame, radius: int = 3, every: int = 50) -> DataFrame:
    """For each row of ``docs(doc_id, text, ...)`` its fingerprint, that of its edited text, and likenesses.

    ``near_edited`` and ``near_next`` are the shares of equal bits with the edited text's and the
    next document's fingerprint. ``within`` counts the other rows whose fingerprint is within
    ``radius`` bits, for the query set, the rows with an id divisible by ``every``; else it is null.
    A null text counts as empty and has fingerprint zero; an only row is its own next document;
    repeated rows follow each other; an empty table gives no rows. Other columns are not read.
    """
    rows = cut_lineage(edited(docs))
    fps = rows.groupBy("low", "high").agg(F.count("*").alias("n"))
    asked = F.col("doc_id") % every == 0
    found = search(rows.where(asked), fps, radius).groupBy(F.struct(F.col("q_low").alias("low"), F.col("q_high").alias("high")).alias("own")).agg((F.sum("n") - 1).alias("within"))
    near = split_join(rows.where(asked).withColumn("own", F.struct("low", "high")), found, "own").drop("own").unionByName(rows.where(~asked | asked.isNull()), allowMissingColumns=True)
    return near.select(
        "doc_id", "n_chars", "edited_sha256", text_of("low", "high").alias("fingerprint"), text_of("edited_low", "edited_high").alias("edited_fingerprint"),
        (1 - hamming("", "edited_") / BITS).alias("near_edited"), (1 - hamming("", "next_") / BITS).alias("near_next"), "within")
