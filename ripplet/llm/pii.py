"""Personal data, found in the text as it is and behind disguises.

Two transducers rewrite a text and keep for each character of their output the source span it
came from. The first maps look-alike letters and digits to ASCII and deletes invisible characters.
The second turns bracketed ``at`` and ``dot`` into ``@`` and ``.``, and then runs of spelled digits
into digits and ``at`` and ``dot`` between the parts of an address into the same. Words are those of
English, German, French and Spanish, digits those of every script. The detectors run on the source and on the rewritten text; what they find in rewritten
places is mapped back to source characters and added unless a span of its kind lies there already.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplet.llm.common import map_batches

KINDS = ("email", "ip", "card", "phone")
LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
#: Possessive repeats and the look-behind change no match; they keep failing runs linear.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Cyrillic and Greek letters that look like Latin ones, the digits' names from 0 in four languages, words for at and dot.
LOOK_ALIKE = dict(zip("АВЕКМНОРСТХаеорсухіјѕԁԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧαορυν", "ABEKMHOPCTXaeopcyxijsdqwABEZHIKMNOPTYXaopuv", strict=True))
DIGIT_NAMES = (
    "zero one two three four five six seven eight nine",
    "null eins zwei drei vier fünf sechs sieben acht neun",
    "zéro un deux trois quatre cinq six sept huit neuf",
    "cero uno dos tres cuatro cinco seis siete ocho nueve",
)
DIGITS = {name: str(d) for names in DIGIT_NAMES for d, name in enumerate(names.split())} | {"oh": "0"}
AT_WORDS, DOT_WORDS = "at|ät|arobase|arroba", "dot|punkt|point|punto"
INVISIBLE = "­​‌‍⁠﻿"

NAME = "|".join(sorted(DIGITS, key=len, reverse=True))
#: Digits of other scripts are found by their decimal property, look-alikes by the table, full-width and mathematical letters by their blocks.
STRANGE = re.compile(rf"[{''.join(LOOK_ALIKE)}{INVISIBLE}＋-～\U0001d400-\U0001d7ff①-⑨]|[^\D0-9]")
SPELLED = re.compile(rf"\b(?:plus[\x20-]+)?(?:{NAME}|[0-9])(?:[\x20,.-]+(?:{NAME}|[0-9])\b){{6,}}", re.I)
DIGIT = re.compile(rf"plus[\x20-]+|(?:{NAME}|[0-9])[\x20,.-]*", re.I)
AT = re.compile(rf"\s?[\[({{<]\s?(?:{AT_WORDS}|@)\s?[\])}}>]\s?", re.I)
DOT = re.compile(rf"\s?[\[({{<]\s?(?:{DOT_WORDS}|\.)\s?[\])}}>]\s?", re.I)
#: A bracketed word may stand between spaces after the first pass, so plain dots and signs are there already.
SAID = re.compile(rf"(?<=[A-Za-z0-9._%+-])(\s(?:{AT_WORDS})\s)(?=[A-Za-z0-9-]{{2,64}}(?:\.|\s(?:{DOT_WORDS})\s)[A-Za-z])", re.I)
SAID_DOT = re.compile(rf"(?<=[A-Za-z0-9-])\s(?:{DOT_WORDS})\s(?=[A-Za-z]{{2}}|[0-9]{{1,3}}(?![0-9]))", re.I)
#: What a text must hold, in lower case, for the two to be tried.
SAYS = re.compile(rf"\s(?:{AT_WORDS}|{DOT_WORDS})\s")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def detect(text: str) -> list[Span]:
    """Leftmost, non-overlapping spans of each kind; failing matches are dropped without a retry."""
    out, end = [], 0
    at = text.find("@")
    while at >= 0:  # a match begins with the whole run of local characters before an @
        begin = at
        while begin > end and (c := text[begin - 1]) != "@" and (c.isascii() and c.isalnum() or c in "._%+-"):
            begin -= 1
        if begin < at and (m := DOMAIN.match(text, at)):
            out.append(("email", begin, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() < 40 and 13 <= len(digits := re.sub("[ -]", "", m[0])) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", *m.span()))
    return out


class Rewritten:
    """A text with, for each of its characters, the source span; ``changed`` marks rewritten ones."""

    def __init__(self, text: str):
        self.text, self.start, self.end, self.changed = text, range(len(text)), range(1, len(text) + 1), bytes(len(text))

    def replace(self, edits: list[tuple[int, int, str]]) -> Rewritten:
        """Apply edits ``(start, end, new)`` in order; a deletion leaves the characters around it as they are."""
        out, at, texts, start, end, changed = Rewritten(""), 0, [], [], [], bytearray()
        for a, b, new in [*edits, (len(self.text), len(self.text), "")]:
            texts += (self.text[at:a], new)
            start += self.start[at:a]
            end += self.end[at:a]
            changed += self.changed[at:a]
            start += [self.start[a]] * len(new) if new else []
            end += [self.end[b - 1]] * len(new) if new else []
            changed += b"\1" * len(new)
            if not new and changed and a < b:
                changed[-1] = 1
            at = b
        out.text, out.start, out.end, out.changed = "".join(texts), start, end, bytes(changed)
        return out


def _plain(c: str) -> str:
    if c in INVISIBLE:
        return ""
    plain = LOOK_ALIKE.get(c) or unicodedata.normalize("NFKC", c)
    if len(plain) == 1 and not plain.isascii() and plain.isdecimal():
        plain = str(unicodedata.decimal(plain))
    return plain


def _non_overlapping(edits: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    out = []
    for e in sorted(edits):
        if not out or e[0] >= out[-1][1]:
            out.append(e)
    return out


def hidden(text: str, base: list[Span]) -> list[Span]:
    """Spans that only the rewritten text shows, in source characters."""
    view = Rewritten(text)
    if not text.isascii() and (odd := [(m.start(), m.end(), _plain(m[0])) for m in STRANGE.finditer(text)]):
        view = view.replace(odd)
    if any(c in view.text for c in "([{<") and (edits := [(*m.span(), "@") for m in AT.finditer(view.text)] + [(*m.span(), ".") for m in DOT.finditer(view.text)]):
        view = view.replace(_non_overlapping(edits))
    edits = []
    for run in SPELLED.finditer(view.text):
        if re.search("[A-Za-z]", run[0]):
            for d in DIGIT.finditer(run[0]):
                word = d[0].rstrip(" ,.-").lower()
                last = d.end() == len(run[0])
                edits.append((run.start() + d.start(), run.start() + (d.start() + len(word) if last else d.end()), "+" if word == "plus" else DIGITS.get(word, word)))
    if SAYS.search(view.text.lower()):
        edits += [(*m.span(), "@") for m in SAID.finditer(view.text)] + [(*m.span(), ".") for m in SAID_DOT.finditer(view.text)]
    if edits:
        view = view.replace(_non_overlapping(edits))
    if not any(view.changed):
        return []
    held = {kind: sorted((a, b) for k, a, b in base if k == kind) for kind in KINDS}  # of one kind: no overlaps
    out = []
    for kind, a, b in detect(view.text):
        if any(view.changed[a:b]):
            a, b = view.start[a], view.end[b - 1]
            before = bisect_left(held[kind], (b,)) - 1
            if before < 0 or held[kind][before][1] <= a:
                out.append((kind, a, b))
    return out


def joined(spans: list[Span]) -> str:
    """``kind:start:end`` by kind as listed, then start, comma-joined."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), *s[1:])))


def scan(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, base, hidden, spans)`` for each row of ``docs(doc_id, text, ...)``.

    Counts and ``base`` are of the text as it is, ``hidden`` counts what deobfuscation adds and
    ``spans`` lists all; offsets are code points of the source, ends exclusive. A null text counts
    as empty; repeated rows and null ids are rows like others; an empty table gives no rows. Other
    columns are not read.
    """

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text in batch.column(1).to_pylist():
            base = detect(text or "")
            more = hidden(text or "", base)
            rows.append((*(sum(k == kind for k, _, _ in base) for kind in KINDS), joined(base), len(more), joined(base + more)))
        kinds = [*[pa.int64()] * 4, pa.string(), pa.int64(), pa.string()]
        columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base", "hidden", "spans"])

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, hidden long, spans string"
    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), each, schema)
