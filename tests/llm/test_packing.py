import tracemalloc
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ripplet.llm import packing


@given(st.lists(st.integers(1, 3000), max_size=60), st.booleans())
@settings(max_examples=60, deadline=None)
def test_cells(sizes, cut):
    windows = packing.pack_cell(sizes, 256, cut)
    spans = defaultdict(list)
    for w in windows:
        assert 0 < sum(n for _, _, n in w) <= 256
        for d, at, n in w:
            spans[d].append((at, n))
    for d, size in enumerate(sizes):
        at = 0
        for start, n in sorted(spans[d]):
            assert start == at and n > 0
            at += n
        assert at == size
    if cut:
        assert all((s := sum(n for _, _, n in w)) & (s - 1) == 0 for w in windows)


def slow_difference(sizes, k):
    """Plain Karmarkar-Karp: k windows for each partial partition."""
    parts = [(size, i, [(size, [i])] + [(0, [])] * (k - 1)) for i, size in enumerate(sizes)]
    age = len(sizes)
    while len(parts) > 1:
        parts.sort(key=lambda p: (-p[0], p[1]))
        (_, _, a), (_, _, b), *parts = parts
        both = sorted(((x + y, s + t) for (x, s), (y, t) in zip(a, reversed(b), strict=True)), key=lambda w: -w[0])
        least, age = both[-1][0], age + 1
        parts.append((both[0][0] - least, age, [(x - least, s) for x, s in both]))
    return [s for _, s in parts[0][2]] if parts else [[] for _ in range(k)]


@given(st.lists(st.integers(1, 50), max_size=50), st.integers(1, 12))
@settings(max_examples=200, deadline=None)
def test_differencing(sizes, k):
    windows = packing.difference(sizes, k)
    assert sorted(i for w in windows for i in w) == list(range(len(sizes))) and len(windows) == k
    sums = sorted(sum(sizes[i] for i in w) for w in windows)
    assert sums == sorted(sum(sizes[i] for i in w) for w in slow_difference(sizes, k))


@pytest.mark.parametrize("sizes", [[1025] * 1023, [1100] * 953, [700] * 500 + [690] * 401, list(range(1, 2047, 7)) * 3])
def test_few_differencings_find_the_window_count(sizes, monkeypatch):
    tried, plain = [], packing.difference
    monkeypatch.setattr(packing, "difference", lambda sizes, k: tried.append(k) or plain(sizes, k))
    windows = packing.pack_cell(sizes, 2048, cut=False)
    assert len(tried) < 20 and all(sum(n for _, _, n in w) <= 2048 for w in windows)
    assert len(windows) <= 1.07 * max(-(-sum(sizes) // 2048), sum(n > 1024 for n in sizes), -(-len(sizes) // max(1, 2048 // min(sizes)))) + 1


def test_the_window_count_rises():
    """Three items of 0.6 windows need three windows, not two; cut, they fill one and the rest is powers of two."""
    assert sorted(len(w) for w in packing.pack_cell([60, 60, 60], 100, cut=False)) == [1, 1, 1]
    assert sorted(sum(n for _, _, n in w) for w in packing.pack_cell([60, 60, 60], 100)) == [16, 64, 100]


def test_a_cell_of_single_tokens_is_small():
    tracemalloc.start()
    windows = packing.pack_cell([1] * packing.CELL_DOCS, 2048)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [len(w) for w in windows] == [2048] * (packing.CELL_DOCS // 2048) and most < 100 << 20


@pytest.mark.parametrize("cell", [5_000, 1 << 20])
def test_whole_table(spark, sf, cell):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    odd = ["", None, " \n", "é a b  x <|endoftext|> \x1c it's 12", "x" * 30000]
    rows = [(d.doc_id, d.text) for d in docs] + [(9000 + i, t) for i, t in enumerate(odd)] + [(None, "null id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as length", "'x' as ids").repartition(3)
    pieces = packing.digest(packing.pack(df, cell_tokens=cell)).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {d: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for d, t in rows}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    assert by_doc.keys() == ids.keys()
    for d, parts in by_doc.items():
        at = 0
        for p in sorted(parts, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids[d]) and p.ids_crc32 == zlib.crc32(ids[d][at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids[d])
    for parts in by_sequence.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048 and at & (at - 1) == 0
    assert packing.pack(df.limit(0)).count() == 0


def test_whole_items(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    pieces = packing.pack(docs, cut=False).toPandas()
    loads = pieces.groupby("sequence_id").length.sum()
    assert loads.max() <= 2048 and loads.sum() / (2048 * len(loads)) > 0.7


def test_cells_of_empty_documents_are_bounded(spark):
    """A cell ends before it has more than ``CELL_DOCS`` documents, even if it has few tokens."""
    n = 110_000
    docs = spark.range(n).selectExpr("id as doc_id", "cast(null as string) as text").coalesce(1)
    rows = packing.pack(docs).select("doc_id", "sequence_id", "length").collect()
    assert sorted(r.doc_id for r in rows) == list(range(n)) and all(r.length == 1 for r in rows)
    windows, cells = sorted({r.sequence_id for r in rows}), []
    for w in windows:
        if not cells or w > cells[-1][-1] + 1:
            cells.append([])
        cells[-1].append(w)
    assert [sum(r.sequence_id in set(c) for r in rows) for c in cells] == [packing.CELL_DOCS, n - packing.CELL_DOCS]


def test_a_worker_learns_a_word_once(spark):
    """The tasks of one worker process share what they know of words: in one process, no task learns a word anew."""
    learned = spark.sparkContext.accumulator(0)
    known = spark.sparkContext.parallelize(range(4), 1)
    path = public_tokenizers.path("word_bpe_49k.json")

    def task(_):
        ids_of = packing.word_ids(path)
        first = ids_of([b"a word that tasks share"], 1)
        plain, ids_of._learn = ids_of._learn, lambda missing: learned.add(len(missing)) or plain(missing)
        assert packing.word_ids(path)([b"a word that tasks share"], 1) == first
        ids_of._learn = plain
        yield first[0]

    assert len(known.mapPartitions(task).collect()) == 1 and learned.value == 0
