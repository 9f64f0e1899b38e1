import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ripplet.llm import langid, quality
from ripplet.llm.queries import op2_subword_quality, op4_byte_cnn_language

SF = "/root/testdata/sf0.1"


def crc(doc):
    return zlib.crc32(str(doc).encode())


def test_quality_on_the_held_out_fold(spark):
    rows = {r.doc_id: r for r in op2_subword_quality(spark, SF).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (crc(r.doc_id) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows.values())
    held = [(rows[d].predicted, rows[d].score, q) for d, q in labels.items() if rows[d].held_out]
    assert np.mean([p == q for p, _, q in held]) > 0.97
    good, bad = np.array([s for _, s, q in held if q]), np.array([s for _, s, q in held if not q])
    assert np.mean(good[:, None] > bad[None, :]) > 0.97


def test_quality_scores_like_the_network():
    """The folded score is the softmax over averaged vectors."""
    texts, labels = [b"good words here", b"junk!! junk!! x", b"more good words", b"x!! junk!!"], [1, 0, 1, 0]
    model = quality.train(texts, labels, epochs=20)
    for text, label in zip(texts, labels, strict=True):
        ids, share = quality.document_features(text, quality.Features())
        want = 1 / (1 + np.exp(-(model.bias + (model.share[ids] * share).sum())))
        (got,) = model.scores([text], {}, quality.Features())
        assert got == pytest.approx(want, rel=1e-5) and (got >= 0.5) == label


def odd(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (None, "a b c"), (4, "word " * 60000), (4, "word " * 60000), (5, "123 !!"), (6, "é")]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("lang", F.lit(None).cast("string"))


def test_quality_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (4, 1), (None, 1), (6, None), (4, 1)], "doc_id long, quality int")
    df = odd(spark)
    for model in (quality.fit(df, labels), quality.fit(df, labels.limit(0))):
        rows = quality.score(df, model).collect()
        assert len(rows) == 8 and all(0 <= r.score <= 1 for r in rows)
        blank = [r.score for r in rows if r.doc_id in (1, 2, 3)]
        assert len(set(blank)) == 1
    assert quality.score(df.limit(0), model).count() == 0


def test_language_on_the_held_out_fold(spark):
    rows = {r.doc_id: r for r in op4_byte_cnn_language(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()
    assert all(rows[d.doc_id].held_out == (crc(d.doc_id) % 4 == 2) and 0 <= rows[d.doc_id].score <= 1 for d in docs)
    assert np.mean([rows[d.doc_id].lang_pred == d.lang for d in docs if rows[d.doc_id].held_out]) > 0.98


def test_tables_of_pairs_are_the_convolution():
    rng = np.random.default_rng(1)
    model = langid.train(["ab cd" * 40, "xy zw" * 40], ["a", "b"], epochs=1)
    x = rng.integers(0, 256, (7, langid.WINDOW)).astype(np.uint8)
    pooled = []
    for w in langid.WIDTHS:
        places = [sum(model.filters[w][j][x[:, i + j]] for j in range(w)) for i in range(langid.WINDOW - w + 1)]
        pooled.append(np.max(places, axis=0))
    z = np.maximum(np.concatenate(pooled, 1) + model.bias, 0) @ model.out + model.out_bias
    assert np.allclose(model.log_probs(x), z - np.log(np.exp(z).sum(1, keepdims=True)), atol=1e-4)


def test_language_odd_rows(spark):
    train = spark.createDataFrame([(i, t * 30, l) for i, (t, l) in enumerate([("the cat ", "en"), ("la élan ", "fr")] * 20)], "doc_id long, text string, lang string")
    df = odd(spark)
    none = langid.fit(df)
    assert {r.lang_pred for r in langid.identify(df, none).collect()} == {"und"}
    rows = langid.identify(df, langid.fit(train)).collect()
    assert len(rows) == 8
    for r in rows:
        assert (r.lang_pred == "und") == (r.doc_id in (1, 2, 3, 5)) and 0 <= r.score <= 1
    kept = langid.keep_identified(df, langid.fit(train), 0.0)
    assert kept.columns == df.columns and kept.count() == 4
    assert langid.identify(df.limit(0), none).count() == 0


def test_quality_takes_one_row_for_each_chosen_id(spark, monkeypatch):
    """A hot doc_id does not bring all its rows to the driver."""
    got = []
    monkeypatch.setattr(quality, "train", lambda texts, labels: got.extend(zip(texts, labels, strict=True)))
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(300)] + [(i, f"own {i}") for i in range(2, 40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 40)], "doc_id long, quality int")
    quality.fit(docs, labels)
    ids = [i for i in range(1, 40) if crc(i) % 5]
    assert 1 in ids and len(got) == len(ids) and [y for _, y in got] == [i % 2 for i in ids]
