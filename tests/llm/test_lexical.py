import math
import re
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ripplet.llm import lexical, oracle, queries
from tests.compare import duck_rows, spark_rows

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def split(text):
    return TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def slow(docs, items, k=10):
    held = [(d, c) for d, t in docs if (c := Counter(split(t)))]
    big_n, big_l, df = len(held), sum(c.total() for _, c in held), Counter(t for _, c in held for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        scores = []
        for d, c in held:
            m, score = 25 + 75 * c.total() * big_n // big_l, 0
            for t in split(text):
                if t in c:
                    score += math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
            if score > 0:
                scores.append((-score, d is None, d))
        out += [(item, r + 1, d, -s) for r, (s, _, d) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=str)


def run(spark, docs, items, k=10):
    docs = spark.createDataFrame(docs, DOCS).withColumns({"n": F.lit("x"), "terms": F.lit("y"), "item_id": F.lit(0)})
    items = spark.createDataFrame(items, ITEMS).withColumns({"rank": F.lit("x"), "doc_id": F.lit(0)})
    return sorted((tuple(r) for r in lexical.rank(docs, items, k).collect()), key=str)


ODD = [(1, "A-b_c A b"), (2, "a b c"), (2, "a b c"), (3, None), (4, ""), (5, "--- !!"), (None, "a b c"), (None, "é É 9x"), (6, "É é-é 9X\x00b"), (7, "a " * 50_000 + "rare"), (8, "c " * 7), (9, "b a c rare")]
ASKED = [(1, "a b"), (1, "a b"), (1, "RARE"), (2, None), (3, "?"), (None, "É é 9X"), (4, "unknown"), (5, "c c c a")]


def test_against_all_documents(spark):
    assert run(spark, ODD, ASKED) == slow(ODD, ASKED)
    assert run(spark, ODD, ASKED, 2) == slow(ODD, ASKED, 2)
    assert run(spark, [], ASKED) == run(spark, ODD, []) == []


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(lexical, "QUERY_BYTES", 8)
    assert run(spark, ODD, ASKED) == slow(ODD, ASKED)


@given(st.integers(0, 10**6), st.integers(1, 12))
@settings(max_examples=25, deadline=None)
def test_cells_lose_nothing(seed, k):
    """Skewed terms, many ties: the best of cells searched in turn are those of all documents."""
    rng = np.random.default_rng(seed)
    n_terms, n_docs = int(rng.integers(3, 40)), int(rng.integers(1, 400))
    weights = np.sort(rng.integers(1, 9000, n_terms))[::-1]
    counts = rng.random((n_docs, n_terms)) < rng.random(n_terms) ** 3
    impacts = np.where(counts, rng.integers(1, 6, (n_docs, n_terms)), 0)
    asked = [np.sort(rng.choice(n_terms, int(rng.integers(1, n_terms + 1)), replace=False)) for _ in range(4)]
    found = [lexical.Query(p, weights[p], k) for p in asked]
    for begin in range(0, n_docs, 150):
        part = impacts[begin : begin + 150]
        docs, places = np.nonzero(part)
        if len(docs):
            batch = lexical.build_cell(0, np.arange(begin, begin + len(part)), docs, places, part[docs, places], weights)
            (cell,) = lexical._cells(iter([batch]))
            for q in found:
                cell.search(q, np.zeros(n_terms, np.int64))
    for p, q in zip(asked, found, strict=True):
        scores = impacts[:, p] @ weights[p]
        best = [i for i in np.lexsort((np.arange(n_docs), -scores)) if scores[i] > 0][:k]
        assert q.ids.tolist() == best and q.scores.tolist() == scores[best].tolist()


def test_blocks_are_skipped():
    rng = np.random.default_rng(5)
    weights = np.array([9000, 4000, 100, 50])
    impacts = (rng.random((1000, 4)) < [0.02, 0.3, 0.9, 0.95]) * rng.integers(1, 1000, (1000, 4))
    docs, places = np.nonzero(impacts)
    (cell,) = lexical._cells(iter([lexical.build_cell(0, np.arange(1000), docs, places, impacts[docs, places], weights)]))
    query = lexical.Query(np.arange(4), weights, 10)
    cell.search(query, np.zeros(4, np.int64))
    assert query.scored < 200 and query.scores.tolist() == sorted(impacts @ weights)[:-11:-1]


def test_summaries_are_maxima():
    rng = np.random.default_rng(1)
    impacts = (rng.random((300, 30)) < rng.random(30)) * rng.integers(1, 99, (300, 30))
    docs, places = np.nonzero(impacts)
    rows = lexical.build_cell(0, np.arange(300), docs, places, impacts[docs, places], np.arange(30, 0, -1)).to_pylist()
    got = defaultdict(set)
    for r in rows[1:]:
        got[r["term"]] = set(r["docs"])
        for b, (lo, hi) in enumerate(zip(r["cuts"], [*r["cuts"][1:], len(r["coords"])], strict=False)):
            block = impacts[r["docs"][b * lexical.BLOCK : (b + 1) * lexical.BLOCK], r["term"] :].max(0)
            assert dict(zip(r["coords"][lo:hi], r["most"][lo:hi], strict=True)) == {r["term"] + c: v for c, v in enumerate(block.tolist()) if v}
    assert got == {t: set(np.flatnonzero(impacts[:, t]).tolist()) for t in range(30)}


def test_query(spark, sf):
    docs, items = ([tuple(r) for r in spark.read.parquet(f"{sf}/{t}.parquet").select(c, "text").collect()] for t, c in (("documents", "doc_id"), ("benchmark", "item_id")))
    df = queries.op11_geometric_block_search(spark, sf)
    assert sorted((tuple(r) for r in df.collect()), key=str) == slow(docs, items)
    names, _, want = duck_rows(oracle.SQL["op11_geometric_block_search"], sf)
    assert spark_rows(df) == (names, want)
