import zlib
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ripplet.llm import sharding


@given(st.lists(st.integers(1, 99), max_size=80), st.lists(st.integers(1, 300), min_size=1, max_size=9))
@settings(max_examples=80, deadline=None)
def test_best_fit_by_scan(sizes, rooms):
    sizes.sort(reverse=True)
    runs = [(size, sizes.count(size)) for size in sorted(set(sizes), reverse=True)]
    got = [shard for taken in sharding.best_fit(runs, rooms) for shard, n in taken for _ in range(n)]
    left = [(r, i) for i, r in enumerate(rooms)]
    for size, shard in zip(sizes, got, strict=True):
        room, i = min((x for x in left if x[0] >= size), default=max(left))
        assert shard == i
        left[i] = (room - size, i)


def check(rows, docs, n, slack):
    want = sorted((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in docs if d is not None)
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in rows if r.doc_id is not None) == want
    slots, loads, home = defaultdict(list), [0] * n, {}
    for r in rows:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < n
        slots[r.shard].append(r.slot)
        loads[r.shard] += r.size
        assert home.setdefault((r.size, r.text_crc32), r.shard) == r.shard
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(loads) - min(loads) <= slack
    return loads


def groups(docs):
    """``(size, rows)`` of each group of equal texts."""
    return [(len(t.encode()) + 8, n) for t, n in Counter(t or "" for _, t in docs).items()]


def plain_loads(sizes, n):
    """Loads of shards when all groups, in falling order, are placed one by one."""
    rooms = [-(-sum(sizes) // n)] * n
    first = rooms[0]
    for size in sizes:
        room, i = min(((r, i) for i, r in enumerate(rooms) if r >= size), default=max((r, i) for i, r in enumerate(rooms)))
        rooms[i] = room - size
    return [first - r for r in rooms]


def test_hot_sizes(spark):
    """A third of all groups have one size, others few: the loads are those of one by one, and chunks do not matter."""
    docs = [(i, f"{i:09d}" if i % 3 else "w" * (i % 700) + f"{i:05d}") for i in range(6000)] + [(i, "again and again") for i in range(2500)]
    sizes = sorted((size * n for size, n in groups(docs)), reverse=True)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    for chunk in (20_000, 100):
        assert sorted(check(sharding.shard(df, 5, chunk).collect(), docs, 5, 20)) == sorted(plain_loads(sizes, 5))


def test_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    docs = [(d.doc_id, d.text) for d in df.collect()]
    sizes = sorted(((size * n) for size, n in groups(docs)), reverse=True)
    for chunk in (20_000, 50):
        loads = check(sharding.shard(df, 24, chunk).collect(), docs, 24, 300)  # of about 1,060,000 a shard
        assert sorted(loads) == sorted(plain_loads(sizes, 24))


def test_odd_rows(spark):
    docs = [(i % 50, "same text") for i in range(300)] + [(i, "t" * i) for i in range(200)] + [(1, None), (2, ""), (None, "x"), (None, "x"), (9, "y" * 100_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("shard", F.lit("clash")).withColumn("g1", F.lit(1))
    rows = sharding.shard(df, 4).collect()
    assert len(rows) == len(docs)
    loads = check(rows, docs, 4, 200_000)
    assert sorted(loads)[-2] - min(loads) < 6000
    assert sharding.shard(df.limit(0)).count() == 0
