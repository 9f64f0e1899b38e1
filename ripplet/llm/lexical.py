"""Ranked lexical search with per-term geometric blocking.

Documents become sparse vectors of the terms that queries can ask for; an index cell holds up to
``CELL`` of them. In a cell each term has its posting list. A list is clustered by the similarity of its
documents, by sketches of their vectors around pivots taken from the list, and cut into blocks of
``BLOCK``. A block's summary is the coordinatewise maximum of its documents' vectors.

All terms are in one order, the weightiest first. A query goes through its terms' lists in that order, so
that in a term's list only documents without an earlier term are new to it; therefore a summary
has only the coordinates from its own term on. A block is skipped if the query's product with its summary,
which no document of the block can exceed, is below the lowest of the best scores so far; else all
its documents are scored. The rest of the lists is skipped when the product with the lists' own maxima is
below it. So results are exact.

Impacts are integers: a coordinate is ``(10**9 * tf) div (1000 * tf + 8 * m)`` of a term's ``tf``
occurrences in a document with length norm ``m``, and the term's weight is a factor of the query.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ripplet.functions.schemas import to_arrow
from ripplet.llm.common import written

#: Documents and postings of a cell at most, documents of a block; shorter lists have no summary, as scoring them costs less.
CELL, POSTINGS, BLOCK, SHORT = 1024, 1 << 19, 32, 8
#: Bytes of query text that are searched for at once, and what their vocabulary grows with.
QUERY_BYTES = 1 << 18
#: Dimensions of a sketch.
SKETCH = 16
#: Stands for a null id, and comes last.
NO_ID = (1 << 63) - 1
#: Term bytes as they are, A-Z in lower case, all else a space.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
VECTOR = "doc_id long, n long, terms array<int>, tfs array<int>"
#: A row for each list of a cell, in the order of the terms; the first, with the term -1, has the documents' ids.
INDEX = "cell long, term int, ids array<long>, docs array<int>, impacts array<int>, cuts array<int>, coords array<int>, most array<int>"


def terms(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text: maximal runs of ASCII letters, digits and all that is not ASCII; A-Z in lower case."""
    return text.translate(TERM_BYTES).split()


def vectors(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """``VECTOR`` of each row of ``docs(doc_id, text, …)`` that has a term: its number of terms, and its counts of those in the vocabulary."""
    schema = to_arrow(VECTOR)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for number, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = terms(text)
                if words:
                    found = Counter(map(vocabulary.get, words))
                    found.pop(None, None)
                    rows.append((number, len(words), list(found), list(found.values())))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    number = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    return docs.where("text is not null").select(number.alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(run, VECTOR)


class Statistics:
    """Counts over all documents: how many have a term, their terms, and how many hold each term of the vocabulary."""

    def __init__(self, found: DataFrame, n_vocabulary: int):
        row = found.agg(F.count("*"), F.sum("n")).first()
        self.n_docs, self.n_terms = row[0], row[1] or 0
        self.df = np.zeros(n_vocabulary, np.int64)
        for term, df in found.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # no more than the vocabulary
            self.df[term] = df
        self.weights = np.array([math.floor(1000 * math.log((2 * self.n_docs + 2) / (2 * int(df) + 1))) for df in self.df], np.int64)

    def norms(self, n: np.ndarray) -> np.ndarray:
        return 100 - 75 + 75 * n * self.n_docs // self.n_terms

    def order(self) -> np.ndarray:
        """The place of each term, the weightiest first; -1 for terms that add nothing."""
        use = np.flatnonzero((self.weights > 0) & (self.df > 0))
        place = np.full(len(self.df), -1)
        place[use[np.lexsort((use, -self.weights[use]))]] = np.arange(len(use))
        return place


def _signs(places: np.ndarray) -> np.ndarray:
    """A direction of the sketch space for each term, the same everywhere."""
    x = (places.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x[:, None] >> np.arange(20, 20 + SKETCH, dtype=np.uint64)) & np.uint64(1)).astype(np.float32) * 2 - 1


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values) if values else [], kind))


def _dense(docs: np.ndarray, columns: np.ndarray, impacts: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    out = np.zeros(shape, np.int32)
    out[docs, columns] = impacts
    return out


def build_cell(cell: int, ids: np.ndarray, docs: np.ndarray, places: np.ndarray, impacts: np.ndarray, weights: np.ndarray) -> pa.RecordBatch:
    """``INDEX`` of a cell of postings (document's number in the cell, term's place, impact); ``weights`` by place."""
    held, columns = np.unique(places, return_inverse=True)
    dense = _dense(docs, columns, impacts, (len(ids), len(held)))
    sketch = np.zeros((len(ids), SKETCH), np.float32)
    np.add.at(sketch, docs, _signs(places) * (impacts * weights[places]).astype(np.float32)[:, None])
    sketch /= np.linalg.norm(sketch, axis=1, keepdims=True) + np.float32(1e-9)
    by_term = np.argsort(columns, kind="stable")
    starts = np.searchsorted(columns[by_term], np.arange(len(held) + 1))
    none, rows = np.zeros(0, np.int32), [(np.asarray(ids, np.int64), *[np.zeros(0, np.int32)] * 5)]
    for k in range(len(held)):
        at = by_term[starts[k] : starts[k + 1]]
        if len(at) < SHORT:
            rows.append((none, docs[at], impacts[at], none, none, none))
            continue
        if len(at) > BLOCK:
            pivots = sketch[docs[at[:: BLOCK]]]
            pivots = pivots[np.argsort(pivots[:, 0])]
            at = at[np.argsort((sketch[docs[at]] @ pivots.T).argmax(1), kind="stable")]
        most = np.maximum.reduceat(dense[docs[at], k:], np.arange(0, len(at), BLOCK))
        block, coord = np.nonzero(most)
        cuts = np.searchsorted(block, np.arange(len(most)))
        rows.append((none, docs[at], impacts[at], cuts, held[coord + k], most[block, coord]))
    kinds = [pa.int64(), *[pa.int32()] * 5]
    columns = [_lists([np.asarray(r[c], np.int64 if not c else np.int32) for r in rows], kind) for c, kind in enumerate(kinds)]
    numbers = [pa.array(np.full(len(rows), cell, np.int64)), pa.array(np.r_[-1, held].astype(np.int32))]
    return pa.RecordBatch.from_arrays([*numbers, *columns], [field.split()[0] for field in INDEX.split(", ")])


def index(found: DataFrame, statistics: Statistics) -> DataFrame:
    """The index of ``found`` in the columns of ``INDEX``, a cell's rows one after another; nothing is shuffled."""
    place, norms = statistics.order(), statistics.norms
    weights = np.sort(statistics.weights[place >= 0])[::-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, count = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            ids, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            flat, ends = batch.column(2).flatten().to_numpy(), np.cumsum(batch.column(2).value_lengths().to_numpy(zero_copy_only=False))
            tf, doc = batch.column(3).flatten().to_numpy().astype(np.int64), np.repeat(np.arange(len(ids)), np.diff(np.r_[0, ends]))
            at = place[flat]
            doc, at, tf = doc[at >= 0], at[at >= 0], tf[at >= 0]
            impacts = (10**9 * tf // (1000 * tf + 8 * norms(n)[doc])).astype(np.int32)
            ends, begin = np.searchsorted(doc, np.arange(1, len(ids) + 1)), 0
            while begin < len(ids):
                low = ends[begin - 1] if begin else 0
                end = min(begin + CELL, max(begin + 1, int(np.searchsorted(ends, low + POSTINGS, "right"))), len(ids))
                part = slice(low, ends[end - 1])
                if part.stop > part.start:
                    yield build_cell(first + count, ids[begin:end], doc[part] - begin, at[part], impacts[part], weights)
                    count += 1
                begin = end

    return found.mapInArrow(run, INDEX)


class Query:
    """A query's terms by place, their weights times their occurrences, and the best documents so far."""

    def __init__(self, places: np.ndarray, weights: np.ndarray, k: int):
        self.places, self.weights, self.k = places, weights, k
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.scored = self.skipped = 0

    def least(self) -> int:
        """The score below which nothing can enter."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def take(self, scores: np.ndarray, ids: np.ndarray) -> None:
        self.scored += len(scores)
        good = scores >= self.least()
        if good.any():
            scores, ids = np.r_[self.scores, scores[good]], np.r_[self.ids, ids[good]]
            best = np.lexsort((ids, -scores))[: self.k]
            self.scores, self.ids = scores[best], ids[best]


class Cell:
    """A cell of the index, as read."""

    def __init__(self, ids: np.ndarray, rows: list[tuple]):
        self.ids, self.rows = ids, rows
        self.held = np.array([r[0] for r in rows])
        sizes = [len(r[1]) for r in rows]
        docs, self.impacts = (np.concatenate([r[k] for r in rows]) for k in (1, 2))
        self.dense = _dense(docs, np.repeat(np.arange(len(rows)), sizes), self.impacts, (len(ids), len(rows)))
        self.most = np.maximum.reduceat(self.impacts, np.cumsum([0, *sizes[:-1]])).astype(np.int64)

    def search(self, query: Query, wanted: np.ndarray) -> None:
        """Offer the query all documents that may be among its best; ``wanted`` is a vector of zeros as long as the vocabulary."""
        at = np.searchsorted(self.held, query.places)
        at[at == len(self.held)] = 0
        here = self.held[at] == query.places
        columns, weights = at[here], query.weights[here]
        if not len(columns):
            return
        wanted[query.places] = query.weights
        left = np.cumsum((weights * self.most[columns])[::-1])[::-1]  # what lists from here on can give
        seen = np.zeros(len(self.ids), bool)
        for k, column in enumerate(columns):
            least = query.least()
            if left[k] < least:
                break
            _, docs, _, cuts, coords, most = self.rows[column]
            if len(cuts):
                bounds = np.add.reduceat(wanted[coords] * most, cuts)
                query.skipped += int((bounds < least).sum())
                docs = docs[np.repeat(bounds >= least, BLOCK)[: len(docs)]]
            docs = docs[~seen[docs]]
            if len(docs):
                seen[docs] = True
                query.take(self.dense[docs][:, columns] @ weights, self.ids[docs])
        wanted[query.places] = 0


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[Cell]:
    ids, rows = None, []
    for batch in batches:
        term, columns = batch.column(1).to_numpy(), []
        for c in range(2, 8):
            lists = batch.column(c)
            columns.append((lists.flatten().to_numpy(), np.r_[0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]))
        for i, t in enumerate(term):
            part = [flat[ends[i] : ends[i + 1]].copy() for flat, ends in columns]
            if t < 0:
                if rows:
                    yield Cell(ids, rows)
                ids, rows = part[0], []
            else:
                rows.append((int(t), *part[1:]))
    if rows:
        yield Cell(ids, rows)


def search(rows: DataFrame, queries: list[tuple[int | None, np.ndarray, np.ndarray]], k: int) -> DataFrame:
    """``(item, item_id, doc_id, score)``: for each of ``queries`` (id, places, weights) the ``k`` best documents of each task of an index."""
    kind = "item int, item_id long, doc_id long, score long"
    schema, size = to_arrow(kind), max([0, *(int(p.max()) + 1 for _, p, _ in queries if len(p))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, wanted = [Query(places, weights, k) for _, places, weights in queries], np.zeros(size, np.int64)
        for cell in _cells(batches):
            for query in best:
                cell.search(query, wanted)
        for item, query in enumerate(best):
            n = len(query.ids)
            if n:
                name = pa.array([queries[item][0]] * n, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, item, np.int32)), name, pa.array(query.ids), pa.array(query.scores)], schema=schema)

    return rows.mapInArrow(run, kind)


def rank(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` best documents of ``docs(doc_id, text, …)`` with a score above 0 for each of ``items(item_id, text, …)``.

    Rows of ``items`` with equal id and text are one item; unlike texts of one id are ranked each on
    its own. Null texts, and those without a term, have no terms and no rows. Each row of ``docs`` is a
    document, repeated rows too; equal scores go by doc_id, null last. Empty tables give no rows.
    Items are searched in blocks of about ``QUERY_BYTES`` of text, each against all documents.
    """
    asked = items.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    blocks = 1 + (asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // QUERY_BYTES
    out = None
    for b in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        block = _rank_block(docs, [(r.item_id, Counter(terms(r.text.encode()))) for r in part], k)
        out = block if out is None else out.unionByName(block)
    return out


def _rank_block(docs: DataFrame, asked: list[tuple[int | None, Counter]], k: int) -> DataFrame:
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*(c for _, c in asked))))}
    found = written(vectors(docs, vocabulary), "vectors")
    statistics = Statistics(found, len(vocabulary))
    place, queries = statistics.order(), []
    for name, counts in asked:
        terms_of = np.array([vocabulary[t] for t in counts], np.int64)
        weights = statistics.weights[terms_of] * np.array(list(counts.values()), np.int64) if len(counts) else terms_of
        kept = place[terms_of] >= 0 if len(counts) else terms_of.astype(bool)
        order = np.argsort(place[terms_of[kept]])
        queries.append((name, place[terms_of[kept]][order], weights[kept][order]))
    best = search(index(found, statistics), queries, k)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc_id"))).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "score")
