"""SimHash near-duplicate documents with pigeonring filtering.

A fingerprint has 64 bits. Two fingerprints link if they differ in at most ``radius`` bits.
The bits lie on a ring of ``m = max(3, radius + 1)`` segments. By the pigeonring principle a linked
pair has a start segment from which every chain of ``l`` consecutive segments differs in at
most ``floor(l * radius / m)`` bits: none in the first, one in the first two, and so on. The
first two budgets make the join key (start segment equal, next one equal or one bit off);
the longer chains prune what shares a key before the full Hamming check. Keys that very many
fingerprints share are refined by further bits, so that unlike rows of a hot key spread over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplet.llm import resemblance
from ripplet.llm.common import components, cut_lineage, map_batches, sifted, split_join

BITS = 64
#: Shingles whose bits are counted at once.
BLOCK = 1 << 15
#: Rows with one key that are compared pair by pair; more are searched pivot by pivot.
SMALL_RUN = 24
#: Rows with one key that a task holds and searches; more are dealt again by further bits.
LONG_RUN = 1 << 13


def fingerprint(text: bytes | None, words: int = 4, seed: int = 42) -> int:
    """SimHash of the word shingles of a UTF-8 text; 0 if it has no word or is null."""
    votes, n = np.zeros(BITS, np.int64), 0
    for hashes in _shingle_hashes(text, words, seed):
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += np.add.reduce(bits, axis=0, dtype=np.int32)
        n += len(hashes)
    return int(np.packbits(votes * 2 > n, bitorder="little").view("<u8")[0])


def _shingle_hashes(text: bytes | None, words: int, seed: int) -> Iterator[np.ndarray]:
    """Hashes of all word shingles in order, ``BLOCK`` at most at once; a text of fewer words is one shingle, none without words."""
    parts = (text or b"").lower().split()  # bytes: only A-Z change, only ASCII white space separates
    if not parts:
        return
    joined, n = b" ".join(parts), len(parts)
    lengths = np.fromiter(map(len, parts), np.int64, n)
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: max(1, n - words + 1)].tolist()
    ends = ends[min(words, n) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    for k in range(0, len(starts), BLOCK):
        yield np.array([digest(joined[i:j], seed) for i, j in zip(starts[k : k + BLOCK], ends[k : k + BLOCK], strict=True)], "<u8")


def fingerprints(docs: DataFrame, words: int = 4, seed: int = 42) -> DataFrame:
    """``(doc_id, fp)`` for each row of ``docs(doc_id, text, ...)``; fp is the fingerprint as a signed long."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t, words, seed) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["doc_id", "fp"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")), each, "doc_id long, fp long")


def ring(radius: int) -> list[tuple[int, int]]:
    """(first bit, length) of each segment of the ring; three segments at least, so that two fit into a key."""
    m = max(3, radius + 1)
    cuts = [round(BITS * i / m) for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _keys(fp: Column, radius: int) -> Column:
    """All join keys of a fingerprint: per start segment its own and one for each bit of the next segment."""
    segments, keys = ring(radius), []
    for i, (at, n) in enumerate(segments):
        at2, n2 = segments[(i + 1) % len(segments)]
        first = F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << n) - 1))
        second = F.shiftrightunsigned(fp, at2).bitwiseAND(F.lit((1 << n2) - 1))
        own = first + F.shiftleft(second, n) + F.lit(i << 58)
        keys += [own, *(own.bitwiseXOR(F.lit(1 << (n + t))) for t in range(n2))]
    return F.array(*keys)


def _chains(radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For each start segment the masks of its growing chains, and the budget of each length."""
    segments = ring(radius)
    m = len(segments)
    masks = np.zeros((m, m), np.uint64)
    for i in range(m):
        mask = 0
        for l in range(m):
            at, n = segments[(i + l) % m]
            mask |= ((1 << n) - 1) << at
            masks[i, l] = mask
    return masks, np.array([(l + 1) * radius // m for l in range(m)], np.uint8)


def _within(x: np.ndarray, start: np.ndarray, masks: np.ndarray, budgets: np.ndarray) -> np.ndarray:
    """Whether each difference ``x`` keeps all chain budgets from its start; the last one is the Hamming check."""
    left = np.arange(len(x))
    for l, most in enumerate(budgets):
        left = left[np.bitwise_count(x[left] & masks[start[left], l]) <= most]
    ok = np.zeros(len(x), bool)
    ok[left] = True
    return ok


def _pairs(key: np.ndarray, fp: np.ndarray, masks: np.ndarray, budgets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows with equal keys (sorted). Long runs give a spanning forest of their links, never all pairs."""
    edges = np.flatnonzero(np.diff(key)) + 1
    begin, size = np.r_[0, edges], np.diff(np.r_[0, edges, len(key)])
    out = [(fp[:0], fp[:0])]
    for s in np.unique(size[(size > 1) & (size <= SMALL_RUN)]):
        rows = begin[size == s][:, None] + np.arange(s)
        for p in range(s - 1):
            a, b = fp[rows[:, p, None].repeat(s - 1 - p, 1)].ravel(), fp[rows[:, p + 1 :]].ravel()
            ok = _within(a ^ b, (key[rows[:, p]] >> 58).astype(np.int64).repeat(s - 1 - p), masks, budgets)
            out.append((a[ok], b[ok]))
    for at, s in zip(begin[size > SMALL_RUN], size[size > SMALL_RUN], strict=True):
        rest, i = np.unique(fp[at : at + s]), int(key[at] >> 58)
        while len(rest):
            front, rest = [rest[0]], rest[1:]
            while front and len(rest):
                pivot = front.pop()
                ok = _within(rest ^ pivot, np.full(len(rest), i), masks, budgets)
                hit, rest = rest[ok], rest[~ok]
                out.append((np.full(len(hit), pivot), hit))
                front.extend(hit)
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def _parts(known: int, radius: int) -> list[int]:
    """Masks of ``radius + 1`` parts of the bits that are not ``known``; a linked pair is equal in one. None if the parts
    are so short that comparing within all of them costs no less than comparing at once."""
    free = [b for b in range(BITS) if not known >> b & 1]
    if 4 ** (len(free) // (radius + 1)) <= radius + 1:
        return []
    return [sum(1 << int(b) for b in part) for part in np.array_split(free, radius + 1)]


def _dealt(key: np.ndarray, fp: np.ndarray, known: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows of long runs once for each part: the start segment and a hash of the old key and the part as their key."""
    out = [(key[:0], fp[:0], known[:0])]
    for mask in np.unique(known):
        at = known == mask
        for part in np.array(_parts(int(mask), radius), np.uint64):
            x = (key[at].view(np.uint64) + part) * np.uint64(0x9E3779B97F4A7C15) ^ (fp[at] & part)
            x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
            x = (x ^ x >> np.uint64(32)) & np.uint64((1 << 58) - 1)
            out.append((x.view(np.int64) | key[at] >> 58 << 58, fp[at], known[at] | part))
    key, fp, known = (np.concatenate(c) for c in zip(*out, strict=True))
    return key, fp, known


def links(fps: DataFrame, radius: int = 4) -> DataFrame:
    """Links ``(a, b)`` among the distinct fingerprints ``fps(fp)``: enough of them to join all that is within
    ``radius`` bits, and none beyond. One narrow shuffle of ``m + 64`` rows for each distinct fingerprint.

    A run of more than ``LONG_RUN`` rows with one key is not searched in its task but passed on, as it is read, to a next
    round under keys of further bits: of ``radius + 1`` parts of the bits that the key leaves open, a linked pair
    is equal in one. The rounds end when no run is passed on. Runs whose first rows show that this would save no
    comparisons (large families of near copies, which pivots use up fast, or parts too short
    to tell rows apart) are searched where they are, 24 bytes a row.
    """
    if not 0 <= radius < 32:
        raise ValueError("radius: 0 to 31")
    masks, budgets = _chains(radius)
    long_run = LONG_RUN

    def deals(fp: np.ndarray, known: int) -> bool:
        """Whether a long run, judged by its first rows, takes less than half as many comparisons within all parts."""
        first = fp[:long_run]
        counts = [np.unique(first & np.uint64(p), return_counts=True)[1] / len(first) for p in _parts(known, radius)]
        return bool(counts) and sum((c * c).sum() for c in counts) < 0.5

    def search(key: np.ndarray, fp: np.ndarray, known: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Links of the runs; the rows of those that are to be dealt under their next keys."""
        edges = np.flatnonzero(np.diff(key)) + 1
        begin, size = np.r_[0, edges], np.diff(np.r_[0, edges, len(key)])
        far = np.zeros(len(key), bool)
        for at, n in zip(begin[size > long_run], size[size > long_run], strict=True):
            far[at : at + n] = deals(fp[at : at + n], int(known[at]))
        if far.any():
            yield passed(key[far], fp[far], known[far])
        a, b = _pairs(key[~far], fp[~far], masks, budgets)
        none = pa.nulls(len(a), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), none, none], ["a", "b", "key", "known"])

    def passed(key: np.ndarray, fp: np.ndarray, known: np.ndarray) -> pa.RecordBatch:
        key, fp, known = _dealt(key, fp, known, radius)
        columns = [pa.array(fp.view(np.int64)), pa.nulls(len(fp), pa.int64()), pa.array(key), pa.array(known.view(np.int64))]
        return pa.RecordBatch.from_arrays(columns, ["a", "b", "key", "known"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []  # parts of the last run, which may go on in the next batch
        long, whole = None, False  # the key whose rows are passed on as they come; whether the held run is not
        for batch in batches:
            if not batch.num_rows:
                continue
            key, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            known = batch.column(2).to_numpy().view(np.uint64) if batch.num_columns > 2 else masks[key >> 58, 1]
            if long is not None:
                n = int(np.searchsorted(key, long, "right"))
                yield passed(key[:n], fp[:n], known[:n])
                key, fp, known = key[n:], fp[n:], known[n:]
                if not len(key):
                    continue
                long = None
            held.append((key, fp, known))
            if held[0][0][0] != key[-1]:
                rows = [np.concatenate(c) for c in zip(*held, strict=True)]
                cut = int(np.searchsorted(rows[0], key[-1]))
                yield from search(*(c[:cut] for c in rows))
                held, whole = [tuple(c[cut:] for c in rows)], False
            if not whole and sum(len(h[0]) for h in held) > long_run:
                rows = [np.concatenate(c) for c in zip(*held, strict=True)]
                whole = not deals(rows[1], int(rows[2][0]))
                if not whole:
                    yield passed(*rows)
                    held, long = [], key[-1]
        if held:
            yield from search(*(np.concatenate(c) for c in zip(*held, strict=True)))

    rows, found = fps.select(F.explode(_keys(F.col("fp"), radius)).alias("key"), "fp"), []
    while not found or not rows.isEmpty():
        out = cut_lineage(rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long, key long, known long"))
        found.append(out.where("key is null").select("a", "b"))
        rows = out.where("key is not null").select("key", F.col("a").alias("fp"), "known")
    return reduce(DataFrame.unionByName, found)


def _roots(fps: DataFrame, radius: int) -> DataFrame:
    """``(fp, root)``: the least fingerprint that links reach, for each of the distinct ``fps(fp)`` that has a link."""
    return components(links(fps, radius)).withColumnRenamed("node", "fp")


def _component_ids(own: DataFrame, radius: int) -> DataFrame:
    """``(fp, component_id)``: the least doc_id that links reach from each fingerprint of ``own(doc_id, fp)``."""
    distinct = cut_lineage(own.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    rooted = distinct.join(_roots(distinct.select("fp"), radius), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    return split_join(rooted.select("fp", "root"), least, "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4, seed: int = 42) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for each row of ``docs(doc_id, text, ...)``.

    ``component_id`` is the least doc_id that links reach, the row's own included. Null, empty
    and blank texts have fingerprint zero and link like any other. Repeated rows come out as
    often as they came in; rows with a null doc_id get the component of their fingerprint, null
    if no row there has an id. An empty table gives no rows; other columns are not read.
    """
    own = cut_lineage(fingerprints(docs, words, seed))
    found = _component_ids(own, radius)
    return split_join(own, found, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_set(text: bytes | None, words: int = 4, seed: int = 42) -> np.ndarray:
    """The distinct hashes of a text's word shingles, sorted."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *_shingle_hashes(text, words, seed)]))


def keep_one(docs: DataFrame, words: int = 4, radius: int = 4, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the row with the least doc_id.

    Documents link if their fingerprints are within ``radius`` bits or their sets of word shingles
    have a Jaccard similarity of ``similarity`` at least. A document is an id and a text: unlike
    texts with one doc_id are documents of their own, alike ones go by the hash of the text, and of
    rows with equal id and text one stays. Null, empty and blank texts have fingerprint zero and
    count as alike. Rows with a null doc_id stay, as nothing tells them apart. All columns are
    returned, whatever their names; an empty table gives no rows.
    """

    resemblance.banding(similarity)  # an error here if it is too low

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(2).to_pylist()
        fps = np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64)
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), *[pa.int64()] * resemblance.WORDS]
        signed = zip(*[resemblance.signature(shingle_set(t, words), similarity) for t in texts], strict=True)
        columns = [pa.array(c, k) for c, k in zip(signed, kinds, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps), *columns], ["doc_id", "th", "fp", *(f.split()[0] for f in resemblance.SIGNED.split(", "))])

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("th"), text.cast("binary").alias("text"))
    own = cut_lineage(map_batches(rows, each, f"doc_id long, th long, fp long, {resemblance.SIGNED}"))
    alike = resemblance.groups(own, docs, lambda t: shingle_set(t, words), similarity)
    root = _roots(own.select("fp").distinct(), radius).withColumnRenamed("root", "near")
    both = split_join(own.select("doc_id", "th", "fp", "sid"), root, "fp", "left").withColumn("near", F.coalesce("near", "fp"))
    both = split_join(both, alike, "sid", "left").select("doc_id", "th", "near", F.coalesce("root", "sid").alias("set"))
    both = cut_lineage(both)
    # components of both kinds: those by fingerprints, linked where they have documents of one set's component
    edges = split_join(both.where("set is not null").select("near", "set"), both.where("set is not null").groupBy("set").agg(F.min("near").alias("least")), "set")
    root = components(edges.select(F.col("near").alias("a"), F.col("least").alias("b"))).withColumnRenamed("node", "near")
    member = split_join(both.where("doc_id is not null"), root, "near", "left").select(F.struct("doc_id", "th").alias("me"), F.coalesce("root", "near").alias("root"))
    member = cut_lineage(member)
    keep = member.groupBy("root").agg(F.min("me").alias("keep"))
    seen = split_join(member, keep, "root").groupBy("me").agg(F.max(F.col("me") != F.col("keep")).alias("lost"), F.count("*").alias("n"))
    # only rows that go or repeat are shuffled with their texts; all others stay where they are
    touched = cut_lineage(seen.where("lost or n > 1").select(F.col("me.doc_id").alias("id"), F.col("me.th").alias("th"), "lost"))
    held = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("th"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    maybe, stay = sifted(held.where("id is not null"), touched, ["id", "th"])
    first = maybe.dropDuplicates(["id", "th"]).join(touched, ["id", "th"], "left").where("lost is null or not lost").select(*held.columns)
    return stay.unionByName(first).unionByName(held.where("id is null")).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
