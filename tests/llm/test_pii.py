import time
import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ripplet.llm import pii
from ripplet.llm.queries import op6_pii_deobfuscation


def luhn(s):
    total = 0
    for i, c in enumerate(s[::-1]):
        d = int(c) * (1 + i % 2)
        total += d // 10 + d % 10
    return total % 10 == 0


def plain(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    rules = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m[0].split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    }
    return [(k, *m.span()) for k, (p, ok) in rules.items() for m in re.finditer(p, text) if ok(m)]


PIECES = ["a", "b.c", "@", "@@", ".", "x-y", "com", " ", "-", "1", "25", "256", "007", "4539 1488 0343 6467", "+", "+1 (168) 555-5254", "(", ")", "é", "ß@", "٣", "10.0.0.1", "\n", "378282246310005"]


@given(st.lists(st.sampled_from(PIECES), max_size=30).map("".join))
@settings(max_examples=600, deadline=None)
def test_detect(text):
    assert pii.detect(text) == plain(text)


def test_disguises(spark):
    cases = {
        1: ("write bob.lee [at] mail7 [dot] example (dot) com now", ["email:6:48"]),
        2: ("write bob at example dot com now", ["email:6:28"]),
        3: ("meet at noon, a dot or two, at home", []),
        4: ("call plus one two one two five five five zero one nine nine ok", ["phone:5:59"]),
        5: ("bоb@exаmple.com with Cyrillic о", ["email:0:15"]),
        6: ("ip １９２.168.0.1!", ["ip:3:14"]),
        7: ("bob@exam​ple.com", ["email:0:16"]),
        8: ("four five three nine one four eight eight zero three four three six four six seven", ["card:0:82"]),
        9: ("plain bob@example.com and [at] alone", ["email:6:21"]),
        10: (None, []),
        11: ("", []),
        12: ("é" * 120_000 + " bob [at] example.com", ["email:120001:120021"]),
        13: ("one two three four", []),
        14: ("Привет от Ивана", []),
    }
    df = spark.createDataFrame([(k, t) for k, (t, _) in cases.items()] + [(None, cases[1][0]), (1, cases[1][0])], "doc_id long, text string").withColumn("base", F.lit(1)).withColumn("hidden", F.lit("x"))
    rows = pii.scan(df).collect()
    assert len(rows) == len(cases) + 2
    for r in rows:
        text, want = cases[r.doc_id or 1]
        assert (r.spans.split(",") if r.spans else []) == want, text
        assert r.hidden == len(want) - len(plain(text or "")) and r.base == pii.joined(plain(text or ""))
    assert pii.scan(df.limit(0)).count() == 0


def test_long_runs_are_linear():
    for text in ("1" * 300_000, "1." * 150_000, "a" * 300_000 + "@", "+1" + "(" * 300_000, "1 " * 150_000, "a.b" * 100_000 + "@c", "zero " * 60_000):
        pii.hidden(text, pii.detect(text))


def test_whole_table(spark, sf):
    docs = {d.doc_id: d.text for d in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op6_pii_deobfuscation(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        base = plain(docs[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, _, _ in base) for kind in pii.KINDS]
        listed = sorted(base, key=lambda s: (pii.KINDS.index(s[0]), s[1]))
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in listed).encode()).hexdigest()
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(r.spans.split(","))
    assert sum(r.n_email for r in rows) and sum(r.n_phone for r in rows)


def test_mixed_disguises():
    for text, kind, found in [("write jane at example [dot] com now", "email", "jane at example [dot] com"), ("host 192 dot 168 dot 10 dot 7 is up", "ip", "192 dot 168 dot 10 dot 7")]:
        assert [(k, text[a:b]) for k, a, b in pii.hidden(text, pii.detect(text))] == [(kind, found)]


PARTS = st.sampled_from(["jane", "bob.lee", "x7", "mail-er"])
HOSTS = st.sampled_from(["ejemplo", "beispiel", "a1b"])
ATS = st.sampled_from([" at ", " arroba ", " arobase ", " ät ", " [at] ", "(ät)", " {arroba} ", " <@> "])
DOTS = st.sampled_from([" dot ", " punkt ", " point ", " punto ", "[dot]", " (punkt) ", "."])
ZEROS = st.sampled_from("٠०๐𝟎０۰")
LEAD, TAIL = st.sampled_from(["", "Sí, ", "ß|", "12 x; "]), st.sampled_from(["", ", y más", "; fin"])


@given(LEAD, PARTS, ATS, HOSTS, DOTS, st.sampled_from(["com", "org", "de"]), TAIL)
@settings(max_examples=300, deadline=None)
def test_planted_addresses(lead, name, at, host, dot, top, tail):
    """A disguised address is found at its own place, and nothing else is."""
    text = lead + name + at + host + dot + top + tail
    assert pii.hidden(text, pii.detect(text)) == [("email", len(lead), len(text) - len(tail))]


@given(LEAD, st.text("0123456789", min_size=9, max_size=15), ZEROS, TAIL)
@settings(max_examples=200, deadline=None)
def test_planted_digits_of_scripts(lead, digits, zero, tail):
    text = lead + "+" + "".join(chr(ord(zero) + int(d)) for d in digits) + tail
    got = [s for s in pii.hidden(text, pii.detect(text)) if s[0] == "phone"]
    assert got == [("phone", len(lead), len(text) - len(tail))]


@given(st.sampled_from(pii.DIGIT_NAMES), st.text("0123456789", min_size=9, max_size=15), st.sampled_from([" ", "-", ", "]))
@settings(max_examples=200, deadline=None)
def test_planted_spelled_digits(names, digits, gap):
    said = "plus " + gap.join(names.split()[int(d)] for d in digits)
    text = f"ñ {said} / x"
    assert ("phone", 2, 2 + len(said)) in pii.hidden(text, pii.detect(text))


def test_words_of_prose_stay():
    for text in ("le point final est mis, un point de vue", "Der Punkt ist gemacht punkt um zehn", "en este punto final", "un dos tres cuatro cinco seis siete", "nos vemos at casa"):
        assert pii.hidden(text, pii.detect(text)) == []


def test_many_hidden_spans_take_linear_time():
    text = "a.b@c.de and jane (at) example (dot) org, " * 20_000
    began = time.process_time()
    assert len(pii.hidden(text, pii.detect(text))) == 20_000 and time.process_time() - began < 30
