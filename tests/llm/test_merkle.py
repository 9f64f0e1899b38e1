import hashlib
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from ripplet.llm import merkle, oracle, queries
from tests.compare import duck_rows, spark_rows

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(r, text):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], r[4], text)))


def climb(level):
    """For each place of a list of digests its siblings by level as (before, after), and the root."""
    paths, at = [[] for _ in level], list(range(len(level)))
    while len(level) > 1:
        for i, k in enumerate(at):
            run = level[k // 16 * 16 : k // 16 * 16 + 16]
            paths[i].append((run[: k % 16], run[k % 16 + 1 :]))
        level = [digest(*level[k : k + 16]) for k in range(0, len(level), 16)]
        at = [k // 16 for k in at]
    return paths, level[0]


def slow(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[3]].append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        groups[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r, r[1])))
        trees[name] = climb([leaf_of(r, r[1]) for r in groups[name]])
    above, root = climb([trees[n][1] for n in names])
    out = []
    for name, up in zip(names, above, strict=True):
        for r, own in zip(groups[name], trees[name][0], strict=True):
            hit = r[0] is not None and r[1] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            text = r[1].translate({c: c + 32 for c in range(65, 91)}) if hit else r[1]
            h = leaf_of(r, text)
            for before, after in own + up:
                h = digest(*before, h, *after)
            proof = digest(*(s for before, after in own + up for s in before + after))
            out.append((r[0], leaf_of(r, r[1]), trees[name][1], root, proof, h, h == root))
    return sorted(out, key=str)


def run(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"g": F.lit("x"), "n": F.lit(1), "h": F.lit("y"), "s0": F.lit(0)})
    return sorted((tuple(r) for r in merkle.manifest(docs, merkle.tampered(docs)).collect()), key=str)


def test_against_plain_trees(spark):
    rows = [(k, f"Text {k} \x00 é", "en", "hot", k) for k in range(300)]
    rows += [(k, "Next", "de", s, 4) for k, s in enumerate(["a", "B", "é", "", "ß"] + [f"s{i}" for i in range(20)])]
    rows += [(7, "A", None, "rep", None), (7, "A", None, "rep", None), (7, "B", None, "rep", 1), (None, "C", "x", "rep", 1), (None, None, None, None, None)]
    rows += [(10**6 + k, None, "en", None, 0) for k in range(16)] + [(k, "Seventeen", "en", "17", 0) for k in range(17)] + [(5, "", "en", "odd", 0), (6, "Z" * 300_000, "en", "odd", 0)]
    assert run(spark, rows) == slow(rows)


def test_few_rows(spark):
    for rows in ([], [(5, "One", "en", "a", 3)], [(5, "One", "en", "a", 3), (6, "Two", "en", "b", 3)], [(k, "One", "en", None, 3) for k in range(16)]):
        assert run(spark, rows) == (slow(rows) if rows else [])


def test_a_change_is_found(spark):
    docs = spark.createDataFrame([(k, "Some Text", "en", "a", 9) for k in range(40)], SCHEMA)
    one = merkle.manifest(docs, F.when(F.col("doc_id") == 17, F.lit("Some text"))).collect()
    assert {r.doc_id for r in one if not r.verified} == {17} and all(r.verified for r in merkle.manifest(docs).collect())


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    df = queries.op12_slot_merkle_manifest(spark, sf)
    assert sorted((tuple(r) for r in df.collect()), key=str) == slow(rows)
    names, _, want = duck_rows(oracle.SQL["op12_slot_merkle_manifest"], sf)
    assert spark_rows(df) == (names, want)
