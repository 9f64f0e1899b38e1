import random
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from ripplet.llm import simhash


def slow_fingerprint(text):
    words = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def slow_components(rows, fps, radius):
    """Every pair, union-find."""
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                up[find(i)] = find(j)
    least = {}
    for i, doc in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return [least.get(find(i)) for i in range(len(rows))]


def test_against_all_pairs(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    rng = random.Random(1)
    rows = [(d.doc_id, d.text) for d in docs]
    for d in docs[:60]:  # near copies
        words = d.text.split(" ")
        words[rng.randrange(len(words))] = "zz"
        rows.append((d.doc_id + 1000, " ".join(words)))
    rows += [(5000, None), (5001, ""), (5002, " \n"), (None, docs[0].text), (None, "one only"), (3, docs[3].text), (6000, "word " * 70000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash")).withColumn("key", F.lit(None).cast("int"))
    fps = [slow_fingerprint(t) if (t or "")[:5] != "word " else simhash.fingerprint(t.encode()) for _, t in rows]
    for radius in (0, 1, 4, 7):
        got = simhash.near_duplicates(df, radius=radius).collect()
        want = zip([d for d, _ in rows], (f"{f:016x}" for f in fps), slow_components([d for d, _ in rows], fps, radius), strict=True)
        assert Counter(map(tuple, got)) == Counter(want)


def test_hot_keys_are_dealt_again_by_further_bits(spark, monkeypatch):
    """A run far beyond what a task searches: unlinked rows, pairs that differ in all ways, and a family of near copies."""
    rng = random.Random(5)
    low = rng.getrandbits(26)
    fps = {low | rng.getrandbits(38) << 26 for _ in range(2500)}
    for f in list(fps)[:400]:
        for _ in range(rng.randrange(1, 5)):
            f ^= 1 << rng.randrange(64)
        fps.add(f)
    for centre in (low | rng.getrandbits(38) << 26, rng.getrandbits(64)):
        fps |= {centre ^ 1 << i ^ 1 << j for i in range(0, 64, 2) for j in range(i)}
    fps = sorted(fps)
    want = slow_groups(fps, 4)
    rounds = []
    dealt = simhash.cut_lineage
    monkeypatch.setattr(simhash, "LONG_RUN", 100)
    monkeypatch.setattr(simhash, "cut_lineage", lambda df: rounds.append(1) or dealt(df))
    pairs = simhash.links(spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long"), 4).distinct().collect()
    assert len(rounds) > 1
    at = {f: k for k, f in enumerate(fps)}
    pairs = [(p.a & 2**64 - 1, p.b & 2**64 - 1) for p in pairs]
    assert all((a ^ b).bit_count() <= 4 for a, b in pairs)
    assert merged(len(fps), [(at[a], at[b]) for a, b in pairs]) == want


def test_short_parts_are_searched_whole():
    known = int(simhash._chains(4)[0][0, 1])
    parts = simhash._parts(known, 4)
    assert len(parts) == 5 and sum(parts) == 2**64 - 1 - known
    assert simhash._parts(2**64 - 1 - 0b11111, 4) == [] and simhash._parts(int(simhash._chains(31)[0][0, 1]), 31) == []


def merged(n, pairs):
    """The least member of each one's component."""
    up = list(range(n))

    def find(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i, j in pairs:
        i, j = find(i), find(j)
        up[max(i, j)] = min(i, j)
    return [find(i) for i in range(n)]


def slow_groups(fps, radius):
    """Components over all pairs."""
    all_fps = np.array(fps, np.uint64)
    return merged(len(fps), [(i, int(j)) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(all_fps[:i] ^ all_fps[i]) <= radius)])


def test_long_runs_lose_no_link(spark):
    rng = random.Random(2)
    base = rng.getrandbits(64)
    fps = {base}
    while len(fps) < 3000:  # chains of small steps from one centre: large runs of keys
        f = rng.choice(list(fps)) if len(fps) < 50 else base
        for _ in range(rng.randrange(1, 5)):
            f ^= 1 << rng.randrange(64)
        fps.add(f)
    fps |= {rng.getrandbits(64) for _ in range(500)}
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    pairs = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), 4).distinct().collect()
    assert all(((p.a ^ p.b) & (2**64 - 1)).bit_count() <= 4 for p in pairs)
    assert len(pairs) < 69 * len(fps)
    up = {f: f for f in signed}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for p in pairs:
        up[find(p.a)] = find(p.b)
    got = [find(f) for f in signed]
    want = slow_components(list(range(len(fps))), fps, 4)
    assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))


def test_keep_one_and_empty(spark):
    df = spark.createDataFrame([(2, "a b c d e", "x"), (1, "a b c d e", None), (1, "a b c d e", None), (None, "a b c d e", "n"), (7, "other words are here now", "x")], "doc_id long, text string, lang string")
    assert sorted(map(str, simhash.keep_one(df).collect())) == sorted(map(str, [df.collect()[i] for i in (1, 3, 4)]))
    assert simhash.keep_one(df.limit(0)).count() == 0 and simhash.near_duplicates(df.limit(0)).count() == 0


def test_keep_one_keeps_unlike_texts_of_one_id(spark):
    """An id with two texts is two documents; columns may have dots and clash with those used inside."""
    rows = [(1, "a b c d e f g", 5), (1, "quite another text with words of its own", 6), (2, "a b c d e f g", 7), (2, "a b c d e f g", 7), (3, None, 8), (4, "", 9), (5, " ", 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `meta.src` int").withColumn("fp", F.lit(0)).withColumn("root", F.lit("r")).withColumn("row", F.lit(None).cast("int"))
    out = simhash.keep_one(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id, r["meta.src"]) for r in out.collect()) == [(1, 5), (1, 6), (3, 8)]


def test_keep_one_against_all_jaccards(spark):
    """The pipeline's stage drops every copy with a Jaccard similarity of five-word shingles from 0.8."""
    rng, docs = random.Random(4), [(0, None), (1, ""), (2, " "), (None, "one row without an id")]
    for k in range(40):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice((8, 60, 300)))]
        for i, edits in enumerate((0, 0, 1, 2, 4, len(words) // 60, len(words) // 40)):
            new = list(words)
            for _ in range(edits):
                new[rng.randrange(len(new))] = "x"
            docs.append((100 + 10 * k + i, " ".join(new)))
    sets = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").split()) else set() for d, t in docs if d is not None}
    ids, up = sorted(sets), {d: d for d in sets}

    def find(d):
        while up[d] != d:
            d = up[d]
        return d

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            fps = [simhash.fingerprint((t or "").encode(), 5) for t in (dict(docs)[a], dict(docs)[b])] if a // 10 == b // 10 else None
            if x and y and len(x & y) >= 0.8 * len(x | y) or fps and (fps[0] ^ fps[1]).bit_count() <= 4:
                up[max(find(a), find(b))] = min(find(a), find(b))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = {d for d in ids if find(d) == d} | {None}
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, "").collect()} == want and len(want) < len(ids) - 40


def test_runs_over_many_batches(spark):
    near = [(1 << 40) ^ (1 << i) ^ (1 << j) for i in range(12) for j in range(i)]  # most share keys
    fps = spark.createDataFrame([(x,) for x in [*near, 7 << 50, -5]], "fp long")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    whole = {tuple(r) for r in simhash._roots(fps, 4).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert {tuple(r) for r in simhash._roots(fps, 4).collect()} == whole == {(x, min(near)) for x in near if x != min(near)}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
