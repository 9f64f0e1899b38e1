import hashlib
import math
import random
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from ripplet.llm import fingerprint

ALL = 2**64 - 1


def mix(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & ALL
    x = (x ^ x >> 27) * 0x94D049BB133111EB & ALL
    return x ^ x >> 31


def slow(text):
    words = [xxhash.xxh64_intdigest(w) for w in text.encode().lower().split()]
    terms = [(words, 1), ([mix((a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F) & ALL) for a, b in zip(words, words[1:])], 2)]
    votes = [0.0] * 128
    for found, weight in terms:
        for t, n in Counter(found).items():
            h = mix(t) | mix((t + 0x94D049BB133111EB) & ALL) << 64
            for b in range(128):
                votes[b] += weight * (1 + math.log(n)) * (1 if h >> b & 1 else -1)
    return votes


def bits(votes):
    return sum((v > 0) << b for b, v in enumerate(votes))


def test_whole_table(spark, sf):
    docs = [(d.doc_id, d.text) for d in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    docs += [(9000, None), (9001, ""), (9002, "é" * 7), (9050, docs[5][1]), (9051, "w " * 50000), (-5, "last one in order")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("low", F.lit("x")).withColumn("part", F.lit(1)).repartition(5)
    rows = {r.doc_id: r for r in fingerprint.fingerprint_edits(df).collect()}
    docs = [(d, t or "") for d, t in sorted(docs, reverse=True)]
    assert sorted(rows) == sorted(d for d, _ in docs)
    prints = {d: int(rows[d].fingerprint, 16) for d, _ in docs}
    wins = 0
    for (d, text), (_, after) in zip(docs, docs[1:] + docs[:1]):
        k, r = len(text) // 3, rows[d]
        new = text[: len(text) - k] + after[:k]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        assert len(r.fingerprint) == len(r.edited_fingerprint) == 32
        for t, got in ((text, r.fingerprint), (new, r.edited_fingerprint)):
            votes = slow(t)
            assert not any(abs(v) > 1e-3 * len(t) / 100 and b for v, b in zip(votes, bin(bits(votes) ^ int(got, 16) | 1 << 128)[:2:-1]) if b == "1")
        near = lambda a, b: 1 - (int(a, 16) ^ int(b, 16)).bit_count() / 128
        assert r.near_edited == near(r.fingerprint, r.edited_fingerprint)
        wins += r.near_edited > r.near_next
    nxt = {d: e for (d, _), (e, _) in zip(docs, docs[1:] + docs[:1])}
    for d, _ in docs:
        assert rows[d].near_next == 1 - (prints[d] ^ prints[nxt[d]]).bit_count() / 128
        near = sum((prints[d] ^ f).bit_count() <= 3 for f in prints.values()) - 1
        assert rows[d].within == (near if d % 50 == 0 else None)
    assert wins >= 0.97 * len(docs)


def test_odd_tables(spark):
    df = spark.createDataFrame([(1, "only one")], "doc_id long, text string")
    (r,) = fingerprint.fingerprint_edits(df).collect()
    assert r.edited_sha256 == hashlib.sha256(b"only oon").hexdigest() and r.near_next == 1
    assert fingerprint.fingerprint_edits(df.limit(0)).count() == 0
    rows = fingerprint.fingerprint_edits(spark.createDataFrame([(None, "a"), (None, None), (3, "x"), (3, "x")], df.schema)).collect()
    assert len(rows) == 4


def test_search_finds_all_within(spark):
    rng = random.Random(3)
    fps = {rng.getrandbits(128) for _ in range(40)}
    for f in list(fps):
        for _ in range(12):
            for _ in range(rng.randrange(6)):
                f ^= 1 << rng.randrange(128)
            fps.add(f)
    half = lambda x: np.uint64(x & ALL).astype(np.int64).item()
    df = spark.createDataFrame([(half(f), half(f >> 64), 1) for f in fps], "low long, high long, n long")
    for radius, blocks in ((3, 4), (5, 8), (0, 2)):
        got = {(r.q_low, r.q_high, r.low, r.high) for r in fingerprint.search(df, df, radius, blocks).collect()}
        want = {(half(a), half(a >> 64), half(b), half(b >> 64)) for a in fps for b in fps if (a ^ b).bit_count() <= radius}
        assert got == want
