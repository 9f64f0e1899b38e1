"""Benchmark decontamination by template canonicalisation.

Words become template tokens: numbers, names (capitalised words inside a sentence; a run of them
is one) and units after a number turn into typed placeholders, all else into lower-case literals
without marks. Windows of template tokens of documents and items meet in a hash join. Where they
match, the placeholders' values are paired up; along one alignment every value of the item must
stand for one value of the document, or only windows without values count. So a question with other numbers
or names is caught, and windows that share a template by chance with mixed-up values are not
counted. A template without literals, or of under four tokens, says nothing by itself and matches
only with equal values. A document is contaminated by an item if it holds at least ``coverage`` of
the item's windows.

Documents' windows are joined only if a bitmap of fixed size, built from the items, may hold them.
"""

from __future__ import annotations

import re
import string

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplet.llm.common import cut_lineage, map_batches

#: Tokens of a window; the least tokens and literals with which it matches with other values too.
WINDOW, LEAST, LITERALS = 8, 4, 1
#: Bits of the bitmap, a power of two; words that a task remembers.
BITS, CACHE = 1 << 26, 600_000
LITERAL, NUMBER, NAME, UNIT, NOTHING = range(5)
SIGNS = np.array([0, 0x9AE16A3B2F90404F, 0xC949C7DEFC1B9D5F, 0xB492B66FBE98F273, 0], np.uint64)
FACTORS = np.array([pow(0x9E3779B97F4A7C15, j + 1, 1 << 64) for j in range(WINDOW)], np.uint64)
NUMERIC = re.compile(r"[+-]?[0-9][0-9.,:/]*[A-Za-z%]{0,2}\Z")
# Number words and common units in English, German, French and Spanish; words that are also articles are left out.
NUMBER_WORDS = frozenset("""
    zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen
    twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion
    null eins zwei drei vier fünf sechs sieben acht neun zehn elf zwölf dreizehn vierzehn fünfzehn sechzehn siebzehn achtzehn neunzehn
    zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig hundert tausend
    zéro deux trois quatre cinq sept huit neuf dix onze douze treize quatorze quinze seize vingt trente quarante cinquante soixante cent mille
    cero dos tres cuatro cinco seis siete ocho nueve diez doce trece catorce quince veinte treinta cuarenta cincuenta sesenta setenta ochenta noventa cien ciento mil
""".split())
UNITS = frozenset("""
    mm cm m km inch inches foot feet yard yards mile miles mg g kg ton tons pound pounds ounce ounces ml l liter liters litre litres
    second seconds minute minutes hour hours day days week weeks month months year years percent degree degrees
    dollar dollars euro euros cent cents mph kmh meter meters metre metres kilometers kilograms grams
    sekunde sekunden minuten stunde stunden tag tage tagen woche wochen monat monate jahr jahre jahren prozent grad gramm kilogramm kilometer
    seconde secondes heure heures jour jours semaine semaines mois an ans degré degrés mètre mètres kilomètre kilomètres gramme grammes
    segundo segundos minuto minutos hora horas día días semana semanas mes meses año años grado grados metro metros kilómetros litro litros gramo gramos kilo kilos
""".split())


class Templates:
    """Template tokens of texts."""

    def __init__(self):
        self.known: dict[str, int] = {}
        self.kind, self.ends = np.zeros(CACHE, np.int8), np.zeros(CACHE, bool)
        self.value = np.zeros(CACHE, np.uint64)

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Kind, template hash and value of each token."""
        words, known = text.split(), self.known
        if missing := set(words).difference(known):
            if len(known) + len(missing) > len(self.value):
                known.clear()
                missing = set(words)
                if len(missing) > len(self.value):  # one text has more distinct words than are held
                    self.kind, self.ends, self.value = np.zeros(len(missing), np.int8), np.zeros(len(missing), bool), np.zeros(len(missing), np.uint64)
            for word in sorted(missing):
                self._learn(word)
        at = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        kind, ends, value = self.kind[at], self.ends[at], self.value[at]
        after = np.r_[True, ends[:-1]]
        keep = kind != NOTHING
        kind, after, value = kind[keep], after[keep], value[keep]
        before = np.r_[NOTHING, kind[:-1]] if len(kind) else kind
        kind = np.where((kind == NAME) & after | (kind == UNIT) & (before != NUMBER), LITERAL, kind)
        run = (kind == NAME) & (np.r_[NOTHING, kind[:-1]] == NAME) if len(kind) else np.zeros(0, bool)
        if run.any():
            starts = np.flatnonzero(~run)
            value, kind = np.add.reduceat(value, starts), kind[starts]
        return kind, np.where(kind == LITERAL, value, SIGNS[kind]), value

    def _learn(self, word: str) -> None:
        bare, at = word.strip(string.punctuation), len(self.known)
        low = bare.lower()
        if not bare:
            kind = NOTHING
        elif NUMERIC.match(bare) or low in NUMBER_WORDS:
            kind = NUMBER
        elif low in UNITS:
            kind = UNIT
        elif bare[0].isupper() and not bare.isupper():
            kind = NAME
        else:
            kind = LITERAL
        self.known[word] = at
        self.kind[at], self.ends[at], self.value[at] = kind, word[-1] in ".!?", xxhash.xxh64_intdigest(low.encode())


def windows(kind: np.ndarray, template: np.ndarray, value: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all windows of one length, in order; the values count in those that say too little as templates."""
    n = len(kind) - length + 1
    if n <= 0 or not length:
        return np.zeros(0, np.uint64)
    count = np.cumsum(np.r_[0, kind == LITERAL])
    few = np.flatnonzero(count[length:] - count[:n] < LITERALS) if length >= LEAST else np.arange(n)
    h, exact = np.full(n, length, np.uint64), np.full(len(few), length + WINDOW, np.uint64)
    spread, own = template ^ template >> np.uint64(29), value ^ value >> np.uint64(31)
    for j in range(length):
        h += spread[j : j + n] * FACTORS[j]
        exact += (spread[few + j] + own[few + j] * SIGNS[NUMBER]) * FACTORS[j]
    h[few] = exact
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(32)


WINDOWS = "id long, th long, h long, at int, length int, slots array<long>"


def _windows(rows: DataFrame, lengths: list[int] | None, bitmap=None) -> DataFrame:
    """All windows of ``rows(id, th, text)``, of the given lengths or, for items, of ``WINDOW`` or the whole if shorter."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not state:
            state.append(Templates())
        out = [[] for _ in range(6)]
        for id_, th, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            kind, template, value = state[0](text or "")
            for length in lengths or [min(WINDOW, len(kind))]:
                h = windows(kind, template, value, length)
                at = np.arange(len(h))
                if bitmap is not None:
                    held = bitmap.value
                    for shift in (0, 32):
                        bit = h >> np.uint64(shift) & np.uint64(BITS - 1)
                        ok = (held[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)
                        at, h = at[ok], h[ok]
                for i, x in zip(at.tolist(), h.view(np.int64).tolist(), strict=True):
                    slots = value[i : i + length][kind[i : i + length] != LITERAL].view(np.int64).tolist()
                    for column, v in zip(out, (id_, th, x, i, length, slots), strict=True):
                        column.append(v)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["id", "th", "h", "at", "length", "slots"])

    state: list[Templates] = []
    return map_batches(rows, each, WINDOWS)


def _keyed(docs: DataFrame, id_col: str) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))


def _bitmap(items: DataFrame):
    """The items' window hashes as a broadcast bitmap; at most ``BITS / 64`` words come to the driver."""
    bits = items.select(F.explode(F.array(*[h.bitwiseAND(F.lit(BITS - 1)) for h in (F.col("h"), F.shiftrightunsigned("h", 32))])).alias("bit"))
    words = bits.groupBy(F.shiftright("bit", 6).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit").bitwiseAND(F.lit(63)).cast("int"))).alias("v"))
    held = np.zeros(BITS // 64, np.uint64)
    for w, v in words.collect():
        held[w] = np.int64(v).astype(np.uint64)
    return items.sparkSession.sparkContext.broadcast(held)


def matches(docs: DataFrame, benchmark: DataFrame, coverage: float = 0.5) -> DataFrame:
    """``(doc_id, th, item_id, n_windows, item_windows, coverage, same_slots)`` for each document and item that contaminates it.

    ``docs(doc_id, text, ...)``, ``benchmark(item_id, text, ...)``; ``th`` is the text's hash. Rows
    of docs with the same id (nulls are one) and text are one document; items with a null id count
    as one item. Null, empty and blank texts have no windows and match nothing; empty tables give
    no rows. Windows without a literal, or with fewer than ``LEAST`` tokens, match only with equal
    values, so an item of nothing but numbers and names is found where it stands as it is; one literal
    among them is enough for the same question with other values. Two values of an item may stand for
    one value of a document, one value not for two. The planner broadcasts the items' windows while they are
    small by its threshold; beyond it both sides are shuffled by template, and adaptive execution may split a hot one. An item shorter than a window is one window: one word is in each document
    with this word. ``same_slots``: all paired values are equal, the item is there as it is.
    """
    items = cut_lineage(_windows(_keyed(benchmark, "item_id").distinct(), None))
    sizes = items.groupBy("id").agg(F.count_distinct("th", "at").alias("item_windows")).withColumnRenamed("id", "item_id")
    lengths = sorted(r.length for r in items.select("length").distinct().collect())  # WINDOW at most
    if not lengths:
        lengths = [WINDOW]
    found = _windows(_keyed(docs, "doc_id"), lengths, _bitmap(items))
    item = items.select("h", F.col("id").alias("item_id"), F.col("th").alias("item_th"), F.col("at").alias("item_at"), F.col("slots").alias("item_slots"))
    met = found.select(F.col("id").alias("doc_id"), "th", "h", "at", "slots").join(item, "h").withColumn("along", F.col("at") - F.col("item_at"))
    met = cut_lineage(met.where(F.size("slots") == F.size("item_slots")).drop("h"))
    lane = ["doc_id", "th", "item_id", "item_th", "along"]
    pairs = met.select(*lane, F.explode(F.arrays_zip(F.col("item_slots").alias("i"), F.col("slots").alias("d"))).alias("p")).select(*lane, "p.i", "p.d").distinct()
    values = pairs.groupBy(*lane, "i").agg(F.count("*").alias("n"), F.bool_and(F.col("i") == F.col("d")).alias("same"))
    lanes = values.groupBy(*lane).agg(F.max("n").alias("n"), F.bool_and("same").alias("same"))
    joined = met.alias("m").join(lanes.alias("l"), [F.col(f"m.{c}").eqNullSafe(F.col(f"l.{c}")) for c in lane], "left")
    joined = joined.where("n is null or n = 1 or size(item_slots) = 0")
    joined = joined.select("m.doc_id", "m.th", "m.item_id", "m.item_th", "m.item_at", F.coalesce("l.same", F.lit(True)).alias("same"))
    covered = joined.groupBy("doc_id", "th", "item_id").agg(F.count_distinct("item_th", "item_at").alias("n_windows"), F.bool_and("same").alias("same_slots"))
    return covered.join(sizes, covered["item_id"].eqNullSafe(sizes["item_id"])).select(
        "doc_id", "th", covered["item_id"], "n_windows", "item_windows", (F.col("n_windows") / F.col("item_windows")).alias("coverage"), "same_slots").where(F.col("coverage") >= coverage)


def decontaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all their columns, that no item contaminates."""
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("th"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    bad = matches(docs, benchmark, coverage).select(F.col("doc_id").alias("bad_id"), F.col("th").alias("bad_th")).distinct()
    left = rows.join(bad, F.col("id").eqNullSafe(F.col("bad_id")) & (F.col("th") == F.col("bad_th")), "left_anti")
    return left.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
