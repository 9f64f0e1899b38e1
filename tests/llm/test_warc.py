import base64
import gzip
import hashlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ripplet.llm import oracle, queries, warc
from tests.compare import duck_rows, spark_rows

SCHEMA = "page_id long, url string, html string"
ROWS = (
    [(k, f"http://h{k % 7}.Example.org/p/{k}?q=é#top", f"<p>{k}</p>") for k in range(40)]
    + [(100 + k, "https://same.example.com/", "<p>copy</p>") for k in range(30)]
    + [(200, None, None), (201, "no host\tat\nall", ""), (202, "//user@x.y:8080/a\r\nb", "<p>copy</p>"), (None, "http://x.y/", "<p>copy</p>"), (203, "http://x.y/", "é" * 200_000)]
    + [(300, "http://x.y/", "<p>twice</p>"), (300, "http://x.y/", "<p>twice</p>"), (299, "http://x.y/", "<p>twice</p>"), (299, "http://x.y/", "<p>twice</p>")]
)


def slow(rows):
    owner = {}
    for page, _, html in rows:
        owner[html or ""] = max(owner.get(html or "", -(2**63)), -(2**63) if page is None else page)
    out = []
    for page, _, html in rows:
        data, own = (html or "").encode(), owner[html or ""]
        same = own == (-(2**63) if page is None else page)
        out.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if same else "revisit", None if same else own))
    return sorted(out, key=str)


def pages(spark, rows=ROWS):
    return spark.createDataFrame(rows, SCHEMA).withColumns({"key": F.lit(1), "file": F.lit("x"), "payload": F.lit("y")})


def digests(records):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in records), key=str)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    to = str(tmp_path_factory.mktemp("warc"))
    old, warc.BLOCK = warc.BLOCK, 8
    warc.write_index(warc.write_archives(pages(spark), to), to)
    warc.BLOCK = old
    return to


def test_round_trip(spark, tmp_path):
    assert digests(warc.archive(pages(spark), f"file:{tmp_path}/a").collect()) == slow(ROWS)
    assert warc.archive(pages(spark, []), str(tmp_path / "b")).count() == 0


def test_archives_are_plain_warc(spark, folder):
    members = [gzip.decompress(p.read_bytes()) for p in Path(folder, "archives").iterdir()]
    assert sum(m.count(b"WARC-Type: re") for m in members) == len(ROWS) and all(m.startswith(b"WARC/1.1\r\n") for m in members)
    payloads = {r.page_id: bytes(r.payload) for r in warc.read_records(spark.read.parquet(f"{folder}/captures"), folder, payload=True).collect() if r.record_type == "response"}
    assert payloads[203].decode() == "é" * 200_000 and payloads[5] == b"<p>5</p>" and payloads[201] == b""


def test_lookup(spark, folder):
    urls = spark.createDataFrame([("https://same.example.com/",), ("http://same.example.com/#x",), ("http://h3.example.org/p/3?q=é",), ("http://nowhere/",), ("",), (None,), ("no host\tat\nall",)], "url string")
    found = warc.lookup(urls.select(warc.url_key(F.col("url")).alias("key")).unionByName(urls.select(F.lit(None).cast("string").alias("key"))), folder)
    got = warc.read_records(found, folder).collect()
    assert sorted(r.page_id for r in got) == [3, *range(100, 130), 200, 201]
    assert {r.url for r in got if r.page_id == 201} == {"no host\tat%0Aall"}


def test_a_search_reads_only_what_it_needs(spark, folder):
    captures = spark.read.parquet(f"{folder}/captures")
    firsts, places = zip(*(warc._directory(*warc._folder(f"{folder}/index/{p.name}")) for p in sorted(Path(folder, "index").iterdir())), strict=True)
    assert sum(map(len, places)) >= captures.count() / 8 and all(list(f) == sorted(f, key=str.encode) for f in firsts)


def test_keys(spark):
    urls = [("https://A.example.ORG/x?y#z", "org,example,a)/x?y"), ("http://u:p@b.c:81/", "c,b:81)/"), ("//c", "c)"), ("mailto:x", "mailto:x"), (None, ""), ("http:///p", ")/p")]
    df = spark.createDataFrame([u for u in urls], "url string, want string")
    assert df.where(warc.url_key(F.col("url")) != F.col("want")).count() == 0


def test_broken_records():
    good = warc._record(5, "http://x/", b"abc", base64.b32encode(hashlib.sha1(b"abc").digest()).decode(), 3, None, "1970-01-01T00:00:00Z")
    assert warc.parse_record(good)[:2] == (5, "http://x/") and warc.parse_record(good)[-1] == b"abc"
    for bad in (good.replace(b"abc", b"abd"), good[:-1], b"", good.replace(b"WARC/1.1", b"HTTP/1.1")):
        with pytest.raises(ValueError):
            warc.parse_record(bad)


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    df = queries.op13_two_level_warc(spark, sf)
    assert digests(df.collect()) == slow(rows)
    names, _, want = duck_rows(oracle.SQL["op13_two_level_warc"], sf)
    assert spark_rows(df) == (names, want)
