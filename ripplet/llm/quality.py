"""Quality classifier: supervised subword embeddings.

A document is the average of learned vectors of its words, their character n-grams and its word
pairs, all hashed into one table; a softmax over the average gives the classes. Training is plain
stochastic gradient descent in numpy. As the softmax is linear in the average, a two-class score
needs only each feature's share of the logit, so a word's features are summed up once.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplet.llm.common import crc_of_id, map_batches

BUCKETS, DIM, GRAMS = 1 << 16, 16, (3, 4, 5)
#: Words that a task remembers.
CACHE = 400_000
FOLDS = 5


class Features:
    """Hashed features of words: the word itself and its character n-grams, in UTF-8 with word marks."""

    def __init__(self):
        self.known: dict[bytes, np.ndarray] = {}

    def of_word(self, word: bytes) -> np.ndarray:
        found = self.known.get(word)
        if found is None:
            marked = b"<" + word + b">"
            parts = [marked[i : i + n] for n in GRAMS for i in range(len(marked) - n + 1)]
            found = np.array([zlib.crc32(p) % BUCKETS for p in [word, *parts]], np.int32)
            if len(self.known) > CACHE:
                self.known.clear()
            self.known[word] = found
        return found


def tokens(text: bytes | None) -> list[bytes]:
    return (text or b"").split()


def pair_ids(words: np.ndarray) -> np.ndarray:
    """Buckets of neighbouring words, from the words' checksums; a word and itself is one feature for all words."""
    first, second = words[:-1], words[1:]
    ids = (first * np.uint64(0x9E3779B1) ^ second * np.uint64(0x85EBCA77)) >> np.uint64(16)
    return np.where(first == second, np.uint64(0), ids % np.uint64(BUCKETS))


def document_features(text: bytes | None, features: Features) -> tuple[np.ndarray, np.ndarray]:
    """The distinct features of a text and their shares of all its features."""
    words = tokens(text)
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    sums = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    ids = np.concatenate([*map(features.of_word, words), pair_ids(sums).astype(np.int32)])
    ids, counts = np.unique(ids, return_counts=True)
    return ids, (counts / counts.sum()).astype(np.float32)


@dataclass
class Model:
    """Each feature's share of the log odds of class 1, and the bias."""

    share: np.ndarray
    bias: float

    def scores(self, texts: list[bytes | None], known: dict[bytes, tuple[float, int, int]], features: Features) -> np.ndarray:
        """The probability of class 1 for each text; a text without words has the bias alone."""
        logits = np.full(len(texts), self.bias)
        for i, text in enumerate(texts):
            words = tokens(text)
            if not words:
                continue
            if missing := set(words).difference(known):
                if len(known) > CACHE:
                    known.clear()
                    missing = set(words)
                for w in missing:
                    ids = features.of_word(w)
                    known[w] = (float(self.share[ids].sum()), len(ids), zlib.crc32(w))
                features.known.clear()
            found = np.array(list(map(known.__getitem__, words)))
            pairs = pair_ids(found[:, 2].astype(np.uint64))
            total = found[:, 0].sum() + self.share[pairs].sum()
            logits[i] += total / (found[:, 1].sum() + len(pairs))
        return 1 / (1 + np.exp(-np.clip(logits, -30, 30)))


def train(texts: list[bytes | None], labels: list[int], epochs: int = 4, rate: float = 0.5, seed: int = 0) -> Model:
    """Stochastic gradient descent, a document a step, with a rate that falls to zero. Without labels: 0.5 for all."""
    rng, features = np.random.default_rng(seed), Features()
    table = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    docs = [document_features(t, features) for t in texts]
    step, steps = 0, max(1, epochs * len(docs))
    for _ in range(epochs):
        for i in rng.permutation(len(docs)):
            ids, share = docs[i]
            mean = share @ table[ids]
            logits = mean @ out + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[labels[i]] -= 1  # now the gradient of the logits
            lr = rate * (1 - step / steps)
            back = out @ p
            out -= lr * np.outer(mean, p)
            bias -= 0.1 * lr * p
            table[ids] -= (lr * 50) * share[:, None] * back
            step += 1
    return Model((table @ (out[:, 1] - out[:, 0])).astype(np.float64), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = 6000) -> Model:
    """Train on at most ``sample`` labelled documents outside the held-out fold, those with the least id hashes.

    Of rows with one doc_id only one comes to the driver, that with the least hash of its text.
    """
    chosen = (
        labels.where(crc_of_id() % FOLDS != 0).where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id")).limit(sample)
    )
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.max("label").alias("label"), F.min_by("text", F.xxhash64("text")).alias("text")).collect()
    rows.sort(key=lambda r: (r.doc_id, r.text or b""))
    return train([None if r.text is None else bytes(r.text) for r in rows], [r.label for r in rows])


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for each row of ``docs(doc_id, text, ...)``.

    A null or blank text gets the score of the bias alone. Repeated rows and null ids are rows
    like others; an empty table gives no rows. Other columns are not read.
    """
    share = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: BUCKETS numbers
    state: list = []

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not state:
            state.extend(({}, Features()))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(share.value.scores(batch.column(1).to_pylist(), *state))], ["doc_id", "score"])

    scored = map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")), each, "doc_id long, score double")
    return scored.select("doc_id", (crc_of_id() % FOLDS == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
