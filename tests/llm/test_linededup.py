import random

from pyspark.sql import functions as F

from ripplet.llm import linededup
from ripplet.llm.queries import op9_fuzzy_lines


def shingles(line):
    data = line.encode()
    return {data[i : i + 8] for i in range(len(data) - 7)}


def slow(docs, similarity=0.8):
    """Every pair of lines, those under 20 bytes only with equal ones; the set of dropped (document, line number)."""
    lines = {}
    for d, text in docs:
        for i, line in enumerate((text or "").split("\n")):
            if line.strip():
                lines.setdefault(line, []).append((2**63 if d is None else d, text, i))
    names = list(lines)
    sets, up = [shingles(x) if len(x.encode()) >= 20 else set() for x in names], list(range(len(names)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(names)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and min(len(a), len(b)) >= similarity * max(len(a), len(b)) and len(a & b) >= similarity * len(a | b):
                up[find(i)] = find(j)
    groups = {}
    for i, name in enumerate(names):
        groups.setdefault(find(i), []).extend(lines[name])
    return {x for g in groups.values() for x in g if x[::2] != min(g, key=lambda y: y[::2])[::2]}


def noisy(rng, text, rate):
    return "".join(rng.choice("abc ") if rng.random() < rate and c != "\n" else c for c in text)


def test_against_all_pairs(spark, sf):
    rng = random.Random(5)
    docs = [(d.doc_id, d.text) for d in spark.read.parquet(f"{sf}/documents.parquet").limit(90).collect()]
    base = "a line that many documents have in common but for a few letters here and there, long enough to count"
    docs += [(1000 + i, noisy(rng, docs[i][1], 0.004)) for i in range(40)]
    docs += [(2000 + i, noisy(rng, base, 0.012) + "\nown " + noisy(rng, base[::-1], 0.5)) for i in range(60)]
    docs += [(3000, None), (3001, ""), (3002, "\n\n"), (3003, "short\nshort"), (3004, base + "\n" + base), (None, base), (3005, "xy" * 50_000 + "\n" + base)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("ord", F.lit("x")).withColumn("n_chars", F.char_length("text")).withColumn("row", F.lit(1))
    want = slow(docs)
    got = {}
    rows = linededup.report(df).collect()
    assert len(rows) == len(docs)
    for r in rows:
        dropped = [int(x) for x in r.dropped.split(",") if x]
        assert len(dropped) == r.n_dropped and dropped == sorted(dropped)
        got[2**63 if r.doc_id is None else r.doc_id] = (r.n_lines, set(dropped))
    for d, text in docs:
        n, dropped = got[2**63 if d is None else d]
        assert n == (0 if text is None else text.count("\n") + 1)
    found = {(d, i) for d, (_, dropped) in got.items() for i in dropped}
    assert found <= {(d, i) for d, _, i in want} and len(found) >= 0.995 * len(want)
    kept = {2**63 if r.doc_id is None else r.doc_id: r for r in linededup.deduplicated(df).collect()}
    for d, text in docs:
        key = 2**63 if d is None else d
        left = None if text is None else "\n".join(x for i, x in enumerate(text.split("\n")) if i not in got[key][1])
        if got[key][1] and not left.strip():
            assert key not in kept
        else:
            assert kept[key].text == left and kept[key].n_chars == (None if left is None else len(left)) and kept[key].ord == "x"


def test_repeated_rows_and_empty(spark):
    line = "one line that is long enough to be looked at"
    df = spark.createDataFrame([(1, line), (1, line), (2, line), (2, line + "\nother words which stand in no other row")], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_dropped, r.dropped) for r in linededup.report(df).collect()) == [(1, 0, ""), (1, 0, ""), (2, 1, "0"), (2, 1, "0")]
    assert linededup.report(df.limit(0)).count() == 0 and linededup.deduplicated(df.limit(0)).count() == 0


def test_whole_table(spark, sf):
    docs = [(d.doc_id, d.text) for d in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = {(d, i) for d, _, i in slow(docs)}
    got = {(r.doc_id, int(i)) for r in op9_fuzzy_lines(spark, sf).collect() for i in r.dropped.split(",") if i}
    assert got <= want and len(got) >= 0.995 * len(want) and want


def test_repeat_counts_do_not_matter(spark):
    """Lines with equal shingle sets link, however often their shingles repeat."""
    rng, docs = random.Random(8), []
    for k in range(20):
        word, passage = "".join(rng.choices("abcdefgh", k=6)) + " ", "".join(rng.choices("ijklmnopqrst ", k=600))
        docs += [(6 * k + i, text) for i, text in enumerate([word * 1000, word * 900, chr(192 + k) * 300, chr(192 + k) * 400, passage * 10, passage * 2])]
    rows = linededup.report(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id for r in rows if r.n_dropped} == {d for d, _ in docs if d % 2}


def test_short_and_blank_lines(spark):
    """Equal lines count as one at every length, but blank ones stay."""
    df = spark.createDataFrame([(1, "Yes.\n\n \nYes."), (2, "Yes\n\n \nYes."), (3, "\u00e9"), (4, "\u00e9"), (5, None)], "doc_id long, text string")
    assert {r.doc_id: r.dropped for r in linededup.report(df).collect()} == {1: "3", 2: "3", 3: "", 4: "0", 5: ""}


def test_a_bucket_of_many_unlike_lines(spark):
    """Large families whose members differ too much from the most frequent line are still put together."""
    rng, docs = random.Random(3), []
    base = "".join(rng.choices("abcdefghijklm ", k=240))
    for k in range(120):
        at = (k % 6) * 40
        variant = base[:at] + "".join(rng.choices("nopqrstu", k=20)) + base[at + 20 :]
        docs += [(3 * k, variant), (3 * k + 1, variant[:-3] + "xyz"), (3 * k + 2, base)]
    want = slow(docs)
    got = {(r.doc_id, int(i)) for r in linededup.report(spark.createDataFrame(docs, "doc_id long, text string")).collect() for i in r.dropped.split(",") if i}
    assert got == {(d, i) for d, _, i in want} and want


def test_a_shingle_is_hashed_once(spark):
    """Short lines keep all hashes, so a filter below the hash would make each of them twice."""
    lines = spark.createDataFrame([(1, "a line that is long enough to be signed")], "id long, line string")
    plan = linededup._signed(lines, F.octet_length("line") * F.lit(2.0**40))._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.split("\n") if "Filter" in x and "xxhash64" in x]


def test_buckets_of_one_two_and_more_lines(spark):
    rng = random.Random(2)
    rows = [(key, rng.randrange(10**6)) for key in range(300) for _ in range(1 + key % 4)] + [(1000, i) for i in range(5000)] + [(1001, 7), (1001, 7), (None, 1)]
    want = sorted((k, i) for k, i in rows if k is not None and len({x for y, x in rows if y == k}) > 1)
    got = linededup._shared(spark.createDataFrame(rows, "key long, id long")).collect()
    assert sorted((r.key, r.id) for r in got) == want


def test_bitmaps_rule_out_no_pair_of_the_similarity(spark):
    """With folded bitmaps too, stars' pairs below about half the similarity are ruled out before their texts are joined."""
    rng = random.Random(9)
    lines = []
    for k in range(60):
        line = noisy(rng, "".join(rng.choices("abcdefgh ", k=rng.randrange(30, 900))), 0) * rng.choice([1, 1, 2])
        lines += [line, noisy(rng, line, 0.004), noisy(rng, line, 0.01), noisy(rng, line, 0.3)]
    bitmaps = linededup._bitmaps(spark.createDataFrame(list(enumerate(lines)), "id long, line string"))
    assert all(r.size == len(shingles(lines[r.id])) for r in bitmaps.collect())
    for maps, words in ((bitmaps, linededup.WORDS), (linededup._folded(bitmaps), linededup.FOLDED)):
        x, y = maps.alias("x"), maps.alias("y")
        may = {(r.a, r.b) for r in x.join(y, (F.col("x.id") < F.col("y.id")) & linededup._may("x", "y", 0.8, words)).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).collect()}
        sets = [shingles(x) for x in lines]
        near = {(a, b) for a in range(len(lines)) for b in range(a + 1, len(lines)) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
        assert near and near <= may and len(may) < 3 * len(near)


def test_shingles_are_made_once_and_not_inside_an_explode(spark):
    """An explode that holds them computes them, and each of its rows, without generated code; a filter moved below makes them twice."""
    lines = spark.createDataFrame([(1, "a line that is long enough to be signed"), (2, "a line that is long enough to be seen")], "id long, line string")
    pairs = spark.createDataFrame([(1, 2, 62)], "a long, b long, sizes long")
    made = [linededup._verified(pairs, lines, 0.6), linededup._distinct(lines).select("id", F.explode("set").alias("h"))]
    for df, what in zip(made, ("array_intersect", "array_distinct"), strict=True):
        plan = [x for x in df._jdf.queryExecution().optimizedPlan().toString().split("\n") if what in x]
        assert len(plan) == 1 and "Generate" not in plan[0]
    assert [tuple(r) for r in made[0].collect()] == [(1, 2)] and made[1].count() == len(shingles("a line that is long enough to be signed")) + len(shingles("a line that is long enough to be seen"))


def test_few_lines_are_signed_twice(spark):
    """Long lines a third of whose shingles repeat, too, are nearly all signed by their first hashes, with no division for a shingle."""
    rng = random.Random(11)
    passages = ["".join(rng.choices("abcdefghijklmnop ", k=800)) for _ in range(400)]
    lines = spark.createDataFrame([(k, p + p[:400]) for k, p in enumerate(passages)], "id long, line string")
    signed = linededup._signed(lines, F.lit(linededup.EXPECTED * 2.0**56) / (F.octet_length("line") - 7))
    assert signed.where("whole").count() >= 0.96 * len(passages) and {len(r["keys"]) for r in signed.where("whole").select("keys").collect()} == {linededup.BANDS}
    plan = signed._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.split("\n") if "pmod(h" in x or " div " in x]
    whole = {r.id: r["keys"] for r in linededup._signed(lines, F.lit(2**56)).collect()}
    assert all(whole[r.id] == r["keys"] for r in signed.where("whole").collect())


def test_larger_tables_are_read_by_columns(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, None, 6)], "id long, line string, n long")
    kept = linededup._kept(df)
    assert sorted(tuple(r) for r in kept.collect()) == [(1, "a", 5), (2, None, 6)]
    assert "ReadSchema: struct<n:bigint>" in kept.select("n")._jdf.queryExecution().executedPlan().toString()


def test_persisted_tables_take_no_memory_and_go(spark, monkeypatch):
    stored = lambda: [x for x in spark.sparkContext._jsc.sc().getRDDStorageInfo() if x.isCached()]
    spark.catalog.clearCache()
    seen = []

    def looked(f):
        def run(*args):
            seen.extend((x.memSize(), x.diskSize() > 0) for x in stored())
            return f(*args)

        return run

    for name in ("_signatures", "_shared", "_bitmaps"):  # after the lines, the signatures and the lines that share a bucket
        monkeypatch.setattr(linededup, name, looked(getattr(linededup, name)))
    docs = spark.createDataFrame([(i, f"a line that says what {i // 2 * 7919} is worth to all who {'read' if i % 2 else 'reads'} it") for i in range(40)], "doc_id long, text string")
    assert linededup.duplicates(docs).count() == 20
    assert seen == [(0, True)] * 3
    assert not stored()
