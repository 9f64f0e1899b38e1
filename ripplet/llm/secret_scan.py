"""Secret scan with linking of multipart credentials.

Every text gives strong spans (an assignment to a secret's name, an access key id, a long hex
string) and weak candidates: names of users or clients, tokens that look random, short
assignments, endpoints. A weak candidate alone is noise. It is reported only if a part that
completes it lies in its scope: a secret for an identifier or an endpoint, an identifier or an
endpoint for a secret. The scope is ``SCOPE`` code points and ``LINES`` lines around a part; the
candidates meet the parts in an interval join on buckets of code points.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplet.llm.common import cut_lineage, map_batches

SCOPE, LINES = 200, 3
#: Kinds in the order in which spans with one start are listed, with the role of each in a credential.
KINDS = {"assign": "secret", "access": "identifier", "hex": "secret", "ident": "identifier", "token": "secret", "endpoint": "endpoint"}
BASE = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # greedy: the same as all of AKIA[A-Z0-9]+ with 20 characters or more
HEX = re.compile(r"[0-9a-f]{24,}")  # likewise
IDENT = re.compile(r"""\b(?:user(?:name)?|login|account|client_?id|key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{3,}""", re.I | re.A)
SHORT = re.compile(r"""\b(?:pwd|pass|passphrase|private_?key|credentials?|signature)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{4,}""", re.I | re.A)
URL = re.compile(r"https?://[A-Za-z0-9.-]+(?::[0-9]+)?(?:/[^\s\"'<>]*)?", re.A)
HOST = re.compile(r"""\b(?:host(?:name)?|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.:-]{4,}""", re.I | re.A)
LONG, RANDOM = re.compile(r"(?<!\S)\S{16,}"), re.compile(r"[A-Za-z0-9+/_=-]{16,}")

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Strong spans, kind by kind, leftmost and non-overlapping within a kind."""
    out = []
    if ":" in text or "=" in text:
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text)]
    return out + [("hex", *m.span()) for m in HEX.finditer(text)]


def weak_spans(text: str, base: list[Span]) -> list[Span]:
    """Candidates that count only with a complement; none overlaps a strong span or an earlier candidate."""
    found: list[list[Span]] = []  # by pattern, each in order and without overlaps
    if ":" in text or "=" in text:
        found.append([("ident", *m.span()) for m in IDENT.finditer(text)])
        found.append([("token", *m.span()) for m in SHORT.finditer(text)])
        found.append([("endpoint", *m.span()) for m in URL.finditer(text)] if "://" in text else [])
        found.append([("endpoint", *m.span()) for m in HOST.finditer(text)])
    random = []
    for word in LONG.finditer(text):
        for m in RANDOM.finditer(word[0]):
            s = m[0]
            if any("0" <= c <= "9" for c in s) and s != s.lower() and s != s.upper():
                random.append(("token", word.start() + m.start(), word.start() + m.end()))
    taken, out = sorted((a, b) for _, a, b in base), []
    for spans in (*found, random):
        free = _free(spans, taken)
        taken = sorted(taken + [s[1:] for s in free])
        out += free
    return out


def _free(spans: list[Span], taken: list[tuple[int, int]]) -> list[Span]:
    """Those of the ordered spans that overlap nothing taken, in one pass over both."""
    out, i, reach = [], 0, 0
    for span in spans:
        while i < len(taken) and taken[i][0] < span[2]:
            reach = max(reach, taken[i][1])
            i += 1
        if reach <= span[1]:
            out.append(span)
    return out


def _lines(text: str, spans: list[Span]) -> list[tuple[str, int, int, int]]:
    """The spans in order, each with the number of the line in which it starts."""
    out, at, line = [], 0, 0
    for kind, a, b in sorted(spans, key=lambda s: s[1]):
        line += text.count("\n", at, a)
        at = a
        out.append((kind, a, b, line))
    return out


def joined(spans: list[Span]) -> str:
    """``kind:start:end`` by start, then kind as listed, comma-joined."""
    order = list(KINDS)
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], order.index(s[0]), s[2])))


PART = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("line", pa.int64())])


def scan(docs: DataFrame, scope: int = SCOPE, lines: int = LINES) -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, base, linked, spans)`` for each row of ``docs(doc_id, text, ...)``.

    ``base`` and ``spans`` are texts of strong and of all spans, in code points with the end
    exclusive; ``linked`` counts the weak ones. A null text counts as empty; repeated rows and
    null ids are rows like others; an empty table gives no rows. Other columns are not read.
    """

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, strong, parts = [], [], []
        for text in batch.column(1).to_pylist():
            text = text or ""
            base = base_spans(text)
            weak = weak_spans(text, base)
            counts.append([sum(k == kind for k, _, _ in base) for kind in BASE])
            strong.append(joined(base))
            parts.append(_lines(text, base + weak) if weak else [])
        columns = [pa.array(c, pa.int64()) for c in zip(*counts, strict=True)]
        parts = pa.array([[dict(zip(("kind", "start", "end", "line"), p, strict=True)) for p in ps] for ps in parts], pa.list_(PART))
        return pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(strong, pa.string()), parts], ["doc_id", "n_assign", "n_access", "n_hex", "base", "parts"])

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base string, parts array<struct<kind: string, start: long, end: long, line: long>>"
    found = map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), each, schema)
    found = cut_lineage(found.withColumn("row", F.monotonically_increasing_id()))
    parts = found.where(F.size("parts") > 0).select("row", F.inline("parts"))
    role = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    bucket = lambda wide: F.explode(F.sequence(F.floor((F.col("start") - wide) / scope), F.floor((F.col("end") + wide) / scope)))
    weak = parts.where(~F.col("kind").isin(*BASE)).withColumn("role", role[F.col("kind")]).withColumn("bucket", bucket(0)).alias("w")
    near = parts.withColumn("role", role[F.col("kind")]).withColumn("bucket", bucket(scope)).alias("p")
    meets = (
        (F.col("w.row") == F.col("p.row")) & (F.col("w.bucket") == F.col("p.bucket"))
        & (F.col("w.start") <= F.col("p.end") + scope) & (F.col("p.start") <= F.col("w.end") + scope)
        & (F.abs(F.col("w.line") - F.col("p.line")) <= lines)
        & ((F.col("w.role") == "secret") != (F.col("p.role") == "secret"))
    )
    linked = weak.join(near, meets, "left_semi").select("row", "kind", "start", "end").distinct()
    linked = linked.groupBy("row").agg(F.collect_list(F.concat_ws(":", "kind", "start", "end")).alias("weak"))
    all_spans = F.filter(F.concat(F.split("base", ","), F.coalesce("weak", F.array())), lambda s: s != "")
    order = F.array(*map(F.lit, KINDS))
    keyed = F.transform(all_spans, lambda s: F.struct(F.split(s, ":")[1].cast("long").alias("a"), F.array_position(order, F.split(s, ":")[0]).alias("k"), s.alias("s")))
    return found.join(linked, "row", "left").select(
        "doc_id", "n_assign", "n_access", "n_hex", "base", F.coalesce(F.size("weak"), F.lit(0)).cast("long").alias("linked"),
        F.array_join(F.transform(F.array_sort(keyed), lambda x: x.s), ",").alias("spans"))
