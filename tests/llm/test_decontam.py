import string
from collections import defaultdict

from pyspark.sql import functions as F

from ripplet.llm import decontam
from ripplet.llm.queries import op3_template_decontamination


def template(text):
    """Tokens ``(placeholder or literal, value)`` word by word."""
    out, after = [], True
    for word in (text or "").split():
        bare = word.strip(string.punctuation)
        low = bare.lower()
        if bare:
            last = out[-1][0] if out else ""
            if decontam.NUMERIC.match(bare) or low in decontam.NUMBER_WORDS:
                out.append(("<number>", (low,)))
            elif low in decontam.UNITS and last == "<number>":
                out.append(("<unit>", (low,)))
            elif bare[0].isupper() and not bare.isupper() and not after and low not in decontam.UNITS:
                if last == "<name>":
                    out[-1] = ("<name>", (*out[-1][1], low))
                else:
                    out.append(("<name>", (low,)))
            else:
                out.append((low, None))
        after = word[-1] in ".!?"
    return out


def grams(text, n):
    tokens = template(text)
    for i in range(len(tokens) - n + 1):
        part = tokens[i : i + n]
        slots = tuple(tuple(sorted(v)) for _, v in part if v is not None)
        yield i, (tuple(t for t, _ in part), slots if n < 4 or n == len(slots) else None), slots


def slow(docs, items, coverage):
    held, total = defaultdict(list), {}
    for item, text in items:
        n = min(8, len(template(text)))
        found = list(grams(text, n)) if n else []
        total[item] = len(found)
        for at, key, slots in found:
            held[key].append((item, at, slots))
    out = {}
    for d, text in docs:
        lanes = defaultdict(list)
        for n in {len(k) for k, _ in held}:
            for at, key, slots in grams(text, n):
                for item, i, own in held[key]:
                    lanes[item, at - i].append((i, own, slots))
        hit, same = defaultdict(set), defaultdict(lambda: True)
        for (item, _), rows in lanes.items():
            values = defaultdict(set)
            for _, own, slots in rows:
                for a, b in zip(own, slots, strict=True):
                    values[a].add(b)
            torn = any(len(v) > 1 for v in values.values())
            if counted := {i for i, own, _ in rows if not torn or not own}:
                hit[item] |= counted
                same[item] &= all(v == {a} for a, v in values.items())
        for item, s in hit.items():
            if len(s) >= coverage * total[item]:
                out[d, item] = (len(s), total[item], same[item])
    return out


QUESTION = "A train leaves the station at 9 hours and travels 120 km before Anna Smith boards it with 3 bags. How many bags does Anna Smith carry after 120 km?"
OTHER = QUESTION.replace("120", "75").replace("Anna Smith", "Bob").replace("3 bags", "eleven bags").replace("9 hours", "14 minutes")
MIXED = OTHER.replace("75", "88", 1)

TWICE = "In this shop one pays 40 dollars for the shoes that lie in the window to the left of the door and for the belt that hangs on the wall behind them while one pays 40 dollars for a hat."


def test_questions(spark):
    lead = "Some words come first and say nothing of it, then "
    docs = {1: QUESTION, 2: lead + QUESTION + " And more follows here.", 3: OTHER, 4: MIXED, 5: lead * 9, 6: None, 7: "", 8: " | ".join(QUESTION.split()), 9: QUESTION[: len(QUESTION) // 4] + lead,
            10: "filler words " * 40_000 + QUESTION, 11: "short item of five words",
            12: "First compute 12 + 7 - 3 * 4 and then stop.", 13: "First compute 12 + 9 - 3 * 4 and then stop.", 14: TWICE.replace("40", "41", 1),
            15: "Now 9 8 7 6 5 and so on.", 16: "See chapter 4.", 17: "See chapter 3."}
    items = {0: QUESTION, 1: "short item of five words", 2: None, 3: "", 4: "7 8 9 10 11", 5: "Compute 12 + 7 - 3 * 4", 6: TWICE, 7: "Chapter 3"}
    rows = [*docs.items(), (None, QUESTION), (1, QUESTION), (2, "the same id, another text")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h", F.lit("x")).withColumn("item_id", F.lit(1))
    bench = spark.createDataFrame([*items.items(), (None, "an item without any id of its own at all")], "item_id long, text string").withColumn("th", F.lit(0))
    got = decontam.matches(df, bench)
    found = {(r.doc_id, r.item_id): (r.n_windows, r.item_windows, r.same_slots) for r in got.collect()}
    want = slow([*docs.items(), (None, QUESTION)], items.items(), 0.5)
    assert found == want
    assert {d for d, i in found if i == 0} == {1, 2, 3, 8, 10, None} and (11, 1) in found and not found[3, 0][2] and found[1, 0][2]
    assert (12, 5) in found and (13, 5) in found and not found[13, 5][2] and (17, 7) in found and (16, 7) not in found and not any(i == 4 for _, i in found) and found[14, 6][0] < found[14, 6][1] and not found[14, 6][2]
    left = decontam.decontaminated(df, bench)
    assert left.columns == df.columns and sorted(str(r.doc_id) for r in left.collect()) == sorted(map(str, [4, 5, 6, 7, 9, 2, 15, 16]))
    for a, b in ((df.limit(0), bench), (df, bench.limit(0))):
        assert decontam.matches(a, b).count() == 0
        assert decontam.decontaminated(a, b).count() == a.count()


def test_few_literals(spark):
    """Questions of numbers and names but few other words, with all values changed: found where the values agree with each other."""
    items = {0: "Compute 12 + 7 - 3 * 4 and 9 then 5", 1: "Compute 12 + 7 - 12 * 4 and 9 then 12", 2: "12 + 7 - 3 * 4 - 9 + 5 + 8 + 6",
             3: "Wie weit laufen Anna und Bob in drei Stunden wenn Anna 4 km läuft"}
    docs = {0: "Some text. Compute 20 + 81 - 6 * 11 and 2 then 30 or so", 1: "Compute 20 + 8 - 20 * 5 and 3 then 20", 2: "Compute 20 + 8 - 21 * 5 and 3 then 22",
            3: "20 + 8 - 21 * 5 - 3 + 22 + 1 + 2", 4: "x 12 + 7 - 3 * 4 - 9 + 5 + 8 + 6", 5: "Wie weit laufen Eva und Uwe in 5 Minuten wenn Eva 9 km läuft",
            6: "Wie weit laufen Eva und Uwe in 5 Minuten wenn Uwe 9 km läuft"}
    df, bench = spark.createDataFrame([*docs.items()], "doc_id long, text string"), spark.createDataFrame([*items.items()], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_windows, r.item_windows, r.same_slots) for r in decontam.matches(df, bench).collect()}
    assert got == slow(docs.items(), items.items(), 0.5)
    assert {(0, 0), (1, 0), (2, 0), (1, 1), (4, 2), (5, 3)} == got.keys()


def test_hot_template(spark):
    """One template that all items and most documents share: the links are those of brute force."""
    text = "A crate holds {} apples and {} pears of the farm so how many fruits are in {} crates"
    items = [(i, text.format(3 + i, 40 + i, 70)) for i in range(25)]
    docs = [(i, text.format(100 + i, 7, 9) if i % 4 else f"clean words number {i} and no more of them at all") for i in range(400)]
    got = decontam.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id): (r.n_windows, r.item_windows, r.same_slots) for r in got.collect()} == slow(docs, items, 0.5)


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id): (r.n_windows, r.item_windows, r.same_slots) for r in op3_template_decontamination(spark, sf).collect()}
    assert got == slow(docs, items, 0.5) and got
    plain = {(d, i) for d, t in docs for i, x in items if x in t}
    assert plain <= got.keys()


def test_equals_sql(spark):
    from ripplet.llm.oracle import SQL
    from tests.compare import duck_rows, spark_rows

    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        names, _, want = duck_rows(SQL["op3_template_decontamination"], sf)
        assert spark_rows(op3_template_decontamination(spark, sf)) == (names, want) and want
