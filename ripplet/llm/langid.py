"""Language identification by a byte convolutional network.

A text's UTF-8 bytes are cut into windows of fixed length, the last one padded with zeros. Filters
of several widths run over the one-hot bytes of a window; each filter's maximum, if positive, is a
feature, and a softmax over the features gives the languages. A text's prediction is the mean of
its windows' log probabilities, weighted by their bytes. Trained in numpy by gradient steps with
Adagrad rates; applied to batches of windows, with each filter as sums over tables of byte pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplet.llm.common import crc_of_id

WINDOW, WIDTHS, FILTERS = 128, (2, 3, 4), 8
#: Windows that are looked at together.
BATCH = 256
FOLDS, HELD_OUT = 4, 2
LETTER = re.compile(r"[^\W\d_]")
UNKNOWN = "und"


def windows(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The windows of a text, and how many of its bytes each has."""
    n = -(-len(text) // WINDOW)
    cut = np.frombuffer(text.ljust(n * WINDOW, b"\0"), np.uint8).reshape(n, WINDOW)
    sizes = np.full(n, WINDOW)
    if n:
        sizes[-1] = len(text) - (n - 1) * WINDOW
    return cut, sizes


@dataclass
class Model:
    """``filters[w]`` has for each place of a filter of width w and each byte the weights of all filters."""

    langs: list[str]
    filters: dict[int, np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def __post_init__(self) -> None:
        # sums of weights over pairs of bytes, (65536, filters): two tables for width 3 (bytes 0-1, byte 2 under pair 1-2) and for 4
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, -1).astype(np.float32)
        zero = np.zeros((256, FILTERS))
        f = self.filters
        self.tables = [(pair(f[2][0], f[2][1]), None, 0), (pair(f[3][0], f[3][1]), pair(zero, f[3][2]), 1), (pair(f[4][0], f[4][1]), pair(f[4][2], f[4][3]), 2)]

    def log_probs(self, x: np.ndarray) -> np.ndarray:
        """For each window the log probability of each language."""
        pairs = x[:, :-1].astype(np.uint16) << 8 | x[:, 1:]
        pooled = []
        for first, second, shift in self.tables:
            found = first[pairs if not shift else pairs[:, :-shift]]
            if second is not None:
                found += second[pairs[:, shift:]]
            pooled.append(found.max(axis=1))
        z = np.maximum(np.concatenate(pooled, 1) + self.bias, 0) @ self.out + self.out_bias
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and probability of each text; ``und`` and 0 for a text that is null or without a letter."""
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        held: list[tuple[int, np.ndarray, np.ndarray]] = []
        sums = np.zeros((len(texts), len(self.langs)))
        known = [i for i, t in enumerate(texts) if t and self.langs and LETTER.search(t)]

        def flush() -> None:
            x, sizes = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
            owner = np.repeat([h[0] for h in held], [len(h[2]) for h in held])
            for k in range(0, len(x), BATCH):
                np.add.at(sums, owner[k : k + BATCH], self.log_probs(x[k : k + BATCH]) * sizes[k : k + BATCH, None])
            held.clear()

        for i in known:
            x, sizes = windows(texts[i].encode())
            held.append((i, x, sizes / sizes.sum()))
            if sum(len(h[2]) for h in held[-64:]) >= BATCH:
                flush()
        if held:
            flush()
        for i in known:
            p = np.exp(sums[i] - sums[i].max())
            best = int(p.argmax())
            langs[i], scores[i] = self.langs[best], float(p[best] / p.sum())
        return langs, scores


def train(texts: list[str], labels: list[str], per_text: int = 16, epochs: int = 3, rate: float = 0.1, seed: int = 0) -> Model:
    """Fit on at most ``per_text`` windows of each text, drawn anew each epoch."""
    rng, langs = np.random.default_rng(seed), sorted(set(labels))
    n = FILTERS * len(WIDTHS)
    params = [rng.normal(0, 0.1, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
    params += [np.zeros(n, np.float32), rng.normal(0, 0.1, (n, len(langs))).astype(np.float32), np.zeros(len(langs), np.float32)]
    squares = [np.full_like(p, 1e-6) for p in params]
    cut = [windows(t.encode())[0] for t in texts]
    for _ in range(epochs):
        rows = [x[rng.permutation(len(x))[:per_text]] for x in cut]
        y = np.repeat([langs.index(l) for l in labels], [len(r) for r in rows]) if rows else np.zeros(0, int)
        x = np.concatenate(rows) if rows else np.zeros((0, WINDOW), np.uint8)
        order = rng.permutation(len(x))
        for k in range(0, len(x), 64):
            for p, s, g in zip(params, squares, _gradients(params, x[order[k : k + 64]], y[order[k : k + 64]]), strict=True):
                s += g * g
                p -= rate * g / np.sqrt(s)
    return Model(langs, dict(zip(WIDTHS, params, strict=False)), *params[len(WIDTHS) :])


def _gradients(params: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    filters, (bias, out, out_bias) = params[: len(WIDTHS)], params[len(WIDTHS) :]
    places, pooled = [], []
    for w, f in zip(WIDTHS, filters, strict=True):
        found = sum(f[j][x[:, j : WINDOW - w + 1 + j]] for j in range(w))
        places.append(found.argmax(axis=1))
        pooled.append(found.max(axis=1))
    z = np.concatenate(pooled, 1) + bias
    h = np.maximum(z, 0)
    p = h @ out + out_bias
    p = np.exp(p - p.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    p[np.arange(len(y)), y] -= 1
    p /= len(y)
    back = (p @ out.T) * (z > 0)
    grads, rows = [], np.arange(len(x))[:, None]
    for i, (w, f) in enumerate(zip(WIDTHS, filters, strict=True)):
        g, own = np.zeros_like(f), back[:, i * FILTERS : (i + 1) * FILTERS]
        for j in range(w):
            np.add.at(g[j], (x[rows, places[i] + j], np.arange(FILTERS)[None, :]), own)
        grads.append(g)
    return [*grads, back.sum(axis=0), h.T @ p, p.sum(axis=0)]


def fit(docs: DataFrame, sample: int = 3000) -> Model:
    """Train on at most ``sample`` documents with a language and outside the held-out fold, those with the least text hashes."""
    chosen = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_of_id() % FOLDS != HELD_OUT)).select("text", "lang")
    near = chosen.withColumn("h", F.xxhash64("text", "lang"))
    least = near.select("h").distinct().orderBy("h").limit(sample).agg(F.max("h")).first()[0]  # one number; at most ``sample`` texts are below it
    rows = near.where(F.col("h") <= F.lit(least)).dropDuplicates(["h"]).collect() if least is not None else []
    rows = sorted((r.h, r.text, r.lang) for r in rows if LETTER.search(r.text))
    return train([t for _, t, _ in rows], [l for _, _, l in rows])


def predicted(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    """A column ``struct<lang_pred, score>``; the model is broadcast, its size is fixed by the languages' number."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def each(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            langs, scores = shared.value.predict([t if isinstance(t, str) else None for t in texts])
            yield pd.DataFrame({"lang_pred": langs, "score": scores})

    return each(F.col(text_col).cast("string"))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` for each row of ``docs(doc_id, text, ...)``.

    A null text or one without a letter gets ``und`` with score 0, as does every text if the model
    saw no language. Repeated rows and null ids are rows like others; an empty table gives no rows.
    """
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_of_id() % FOLDS == HELD_OUT).alias("held_out"), predicted(docs, model).alias("p"))
    return found.select("doc_id", "held_out", "p.lang_pred", "p.score")


def keep_identified(docs: DataFrame, model: Model, least: float = 0.3) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text has a language with at least the score ``least``."""
    p = predicted(docs, model)
    return docs.where((p["lang_pred"] != UNKNOWN) & (p["score"] >= least))
