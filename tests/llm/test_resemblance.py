import numpy as np
import pytest

from ripplet.llm import resemblance, simhash


def jaccard(a, b):
    a, b = ({tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for t in (a, b))
    return len(a & b) / len(a | b)


def pairs(similarity, n, seed):
    """Texts, two and two alike: the second has a block of words replaced so that the similarity is a little above."""
    rng, out = np.random.default_rng(seed), []
    for k in range(n):
        words = [f"w{k}x{i}" for i in range(int(rng.integers(60, 200)))]
        shingles = len(words) - 4
        changed = max(0, int(shingles * (1 - similarity) / (1 + similarity)) - 5)  # shingles that differ on each side
        other = words[: len(words) - changed] + [f"n{k}x{i}" for i in range(changed)]
        out += [" ".join(words), " ".join(other)]
    return out


@pytest.mark.parametrize("similarity", [0.5, 0.7, 0.8])
def test_recall_against_all_pairs(spark, similarity):
    texts = pairs(similarity, 80, int(10 * similarity))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in simhash.keep_one(docs, words=5, radius=0, similarity=similarity).collect()}
    want = {2 * k for k in range(80)} | {2 * k + 1 for k in range(80) if jaccard(texts[2 * k], texts[2 * k + 1]) < similarity}
    assert all(jaccard(texts[2 * k], texts[2 * k + 1]) >= similarity for k in range(80))
    assert kept == want


def test_bitmaps_lose_nothing(spark):
    """Of pairs at all similarities those at 0.8 and more pass sizes and bitmaps."""
    rng, rows = np.random.default_rng(3), []
    for k in range(300):
        x = np.unique(rng.integers(0, 1 << 63, int(rng.integers(5, 2000)), np.uint64))
        y = np.unique(np.r_[x[: int(len(x) * rng.random())], rng.integers(0, 1 << 63, int(rng.integers(0, 400)), np.uint64)])
        if len(y):
            true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
            rows.append((true, *[(s[1], *s[3:]) for s in (resemblance.signature(x), resemblance.signature(y))]))
    fields = "size long, " + ", ".join(f"s{w} long" for w in range(resemblance.WORDS))
    df = spark.createDataFrame(rows, f"true double, a struct<{fields.replace(' ', ':').replace(',:', ',')}>, b struct<{fields.replace(' ', ':').replace(',:', ',')}>")
    got = df.select("true", resemblance._near("a", "b", 0.8).alias("near")).collect()
    assert all(r.near for r in got if r.true >= 0.8) and any(r.true >= 0.8 for r in got) and sum(not r.near for r in got) > 100


def test_bands_follow_the_similarity():
    for similarity in (0.1, 0.3, 0.5, 0.8, 0.95, 1.0):
        bands, rows = resemblance.banding(similarity)
        assert bands * rows <= 100 and (1 - similarity**rows) ** bands <= resemblance.MISSED
    assert resemblance.banding(0.8) == (20, 5)
    with pytest.raises(ValueError):
        resemblance.banding(0.01)
    assert resemblance.signature(np.zeros(0, np.uint64))[0] is None
