import corpus_pipeline
from pyspark.sql import functions as F
from tests.llm.test_decontam import slow as leaks
from tests.llm.test_linededup import slow as repeated
from tests.llm.test_simhash import slow_components

from ripplet.llm import simhash

SF = "/root/testdata/sf0.001"


def test_stages_against_plain_versions(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("extra", F.lit("kept"))
    odd = [(9001, None, "en", "s", 0, "kept"), (9002, "", "en", "s", 0, "kept"), (9003, "12345 !!", None, None, None, "kept"), (None, "the words of a row that has no id at all", "en", "s", 1, "kept")]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "lines", "near_duplicates", "benchmark_leaks", "sequences"]
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if name != "sequences":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        before, docs = [(r.doc_id, r.text) for r in docs.collect()], spark.read.parquet(str(tmp_path / name))
        kept[name] = (before, docs.collect())
    before, after = kept["language"]
    assert {d for d, _ in before} - {r.doc_id for r in after} == {9001, 9002, 9003}
    before, after = kept["lines"]
    gone, left = repeated(before), {}
    for d, text in before:
        key = 2**63 if d is None else d
        lines = [x for i, x in enumerate(text.split("\n")) if (key, text, i) not in gone]
        if len(lines) == text.count("\n") + 1 or "".join(lines).strip():
            left[d] = "\n".join(lines)
    same = sum(left.get(r.doc_id) == r.text for r in after)
    assert same >= 0.99 * len(left) and abs(len(after) - len(left)) <= 2 and all(r.extra == "kept" for r in after)
    before, after = kept["near_duplicates"]
    ids = [d for d, _ in before]
    parts = slow_components(ids, [simhash.fingerprint(t.encode(), 5) for _, t in before], 4)
    assert {r.doc_id for r in after} == {d for d, c in zip(ids, parts, strict=True) if d is None or d == c}
    before, after = kept["benchmark_leaks"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert {d for d, _ in before} - {r.doc_id for r in after} == {d for d, _ in leaks(before, items, 0.5)}
    before, after = kept["sequences"]
    assert {r.doc_id for r in after} == {d for d, _ in before} and sum(r.length for r in after) == sum({r.doc_id: r.doc_tokens for r in after}.values())


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_lines_leave_nothing_persisted(spark):
    spark.catalog.clearCache()
    docs = spark.createDataFrame([(i, f"the same long line stands at the head of all\nand a line of number {i * 7919} only here") for i in range(6)], "doc_id long, text string")
    kept = corpus_pipeline.lines(spark, docs, "")
    assert not [x for x in spark.sparkContext._jsc.sc().getRDDStorageInfo() if x.isCached()]
    assert sum(r.text.count("same long line") for r in kept.collect()) == 1
