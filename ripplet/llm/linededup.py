"""Fuzzy line deduplication by MinHash, in DataFrame functions only.

A line's shingles are all its runs of ``SHINGLE`` UTF-8 bytes. One hash of each shingle gives the
whole signature: the hash picks one of ``BANDS * ROWS`` bins, and each bin keeps its least hash.
``ROWS`` bins make a band; lines that agree in a whole band share its bucket. What shares a bucket
is checked by exact Jaccard similarity of the shingle sets. Links become components by distributed
union-find, and of each component the first occurrence of a line is kept.

A long line's least hashes are small, so only hashes below a bound are looked at, which is set to
leave about ``EXPECTED`` of them. If that leaves a bin empty, the line is signed by all its hashes:
the signature is always that of the whole line.

Most buckets hold one line or two, and these are known from the least and the greatest line of each
bucket; only the lines of larger buckets are gathered by a join. The texts of all lines are needed for
their signatures only and then go; those of lines that share a bucket are read from the documents again.

No bucket is compared pair by pair at once. First every line of a bucket is checked against the
bucket's most frequent line only; the components of these links hold most of each large family.
Then pairs of the others are checked, but only those in a bucket whose lines are still in different
components; a pair in one component could add nothing. So the components are those of all pairs.
Bitmaps of the shingles, which differ in no more bits than the sets in shingles, rule out most of
the pairs of both kinds for certain before their texts are joined.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplet.llm.common import components, cut_lineage, sifted, split_join, written

SHINGLE, BANDS, ROWS = 8, 8, 3  # the bands are a power of two
#: Shorter lines (bytes) have no fuzzy links; equal ones still count as one.
SHORTEST = 20
#: Hashes that a long line's signature looks at first.
EXPECTED = 240
#: 64-bit words of a bitmap, and of the folded one that stars are compared by; bytes of a line that are shingled at once.
WORDS, FOLDED, CHUNK = 32, 8, 4096
#: Hint for the side of a join that has a row a key and only numbers: it is hashed, so that the texts beside it need no sort.
HASHED = "shuffle_hash"
#: A line of these only is blank.
BLANK = " \t\x0b\f\r"
#: Slots of the hash map in front of an aggregation: a task's lines times bands shall find room.
MAP_BITS = "spark.sql.codegen.aggregate.fastHashMap.capacityBit"
#: Whether persisted columns are compressed: texts and hashes gain nothing by it.
PACKED = "spark.sql.inMemoryColumnarStorage.compressed"
#: Persisted tables grow with the input; in memory they were seen to exhaust an executor's heap before enough of them was moved to disk.
LEVEL = StorageLevel.DISK_ONLY


def _kept(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: its rows are read in columns and only those asked for, where a checkpoint has each as an object."""
    return written(df, "lines")


def _rows(docs: DataFrame) -> DataFrame:
    """``(ord, th, text)``: a document is its id (null: last of all) and its text's hash."""
    text = F.col("text").cast("string")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("ord"), F.xxhash64(text).alias("th"), text.alias("text"))


def _occurrences(docs: DataFrame) -> DataFrame:
    """Every line that is not blank: ``(ord, th, pos, line, id)``."""
    found = _rows(docs).select("ord", "th", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return found.where(F.octet_length(F.ltrim("line", F.lit(BLANK))) > 0).withColumn("id", F.xxhash64("line"))


def _exploded(lines: DataFrame, keep: list[str]) -> DataFrame:
    """A row for each shingle of ``lines(*keep, line)``, repeats included: ``(*keep, h)``."""
    cut = lines.select(*keep, F.col("line").cast("binary").alias("data"))
    each = cut.select(*keep, "data", F.explode(F.sequence(F.lit(1), F.octet_length("data") - SHINGLE + 1)).alias("i"))
    once = F.spark_partition_id() * 0  # not deterministic: no filter is moved below the hash, which would then be made twice
    return each.select(*keep, (F.xxhash64(F.substring("data", F.col("i"), F.lit(SHINGLE))) + once).alias("h"))


def _signed(lines: DataFrame, bound: Column) -> DataFrame:
    """``(id, whole, keys)``: the buckets of each line by its hashes below ``bound`` (of 2**56); ``whole`` if those by all hashes are the same.

    An empty bin counts as a value, an empty band has no bucket.
    """
    hashed = _exploded(lines.withColumn("bound", bound.cast("long")), ["id", "bound"])
    every = F.when(F.col("bound") >= 2**56, BANDS).otherwise(0)  # bands of lines that are signed by all hashes count on from BANDS
    placed = hashed.select("id", "bound", "h", F.shiftrightunsigned("h", 8).alias("v")).where("v < bound")
    band = F.col("h").bitwiseAND(F.lit(BANDS - 1)).cast("int")
    cell = F.shiftright(F.shiftrightunsigned("h", 3).bitwiseAND(F.lit(255)).cast("int") * ROWS, 8)  # no division: this is done for each shingle
    placed = placed.select("id", "v", (band + every).alias("at"), cell.alias("cell"))
    least = placed.groupBy("id", "at").agg(*[F.min(F.when(F.col("cell") == r, F.col("v"))).alias(f"m{r}") for r in range(ROWS)])
    key = F.xxhash64("band", *[F.coalesce(f"m{r}", F.lit(-1 - r).cast("long")) for r in range(ROWS)])
    full = F.greatest(*[F.col(f"m{r}").isNull() for r in range(ROWS)])
    least = least.withColumn("band", F.pmod("at", F.lit(BANDS)))
    bands = least.select("id", "at", "band", key.alias("key"), (~full).alias("full")).groupBy("id").agg(F.max("at").alias("at"), F.count_if("full").alias("full"), *[F.max(F.when(F.col("band") == b, F.col("key"))).alias(f"k{b}") for b in range(BANDS)])
    return bands.select("id", ((F.col("full") == BANDS) | (F.col("at") >= BANDS)).alias("whole"), F.filter(F.array(*[f"k{b}" for b in range(BANDS)]), lambda k: k.isNotNull()).alias("keys"))


@contextmanager
def _roomy_maps(spark: SparkSession) -> Iterator[None]:
    """What is planned meanwhile has more slots in front of its aggregations and persists its rows uncompressed."""
    old = {k: spark.conf.get(k, None) for k in (MAP_BITS, PACKED)}
    spark.conf.set(MAP_BITS, "20")
    spark.conf.set(PACKED, "false")
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _lines(found: DataFrame) -> DataFrame:
    """``(id, line, n)``: the different lines of occurrences ``found``, and how many each has."""
    lines = found.withColumn("h", F.hash("line")).groupBy("id").agg(F.first("line").alias("line"), F.count("*").alias("n"), F.min("h").alias("lo"), F.max("h").alias("hi"))
    return lines.where("lo = hi").select("id", "line", "n")


def _signatures(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The persisted table ``(id, whole, keys)``, and ``(id, keys)`` of the lines that are not ``whole`` in it: the buckets of all lines.

    Lines with equal shingle sets have equal signatures, however often a shingle repeats.
    """
    count = F.octet_length("line") - SHINGLE + 1
    with _roomy_maps(lines.sparkSession):
        first = _signed(lines, F.lit(EXPECTED * 2.0**56) / count).persist(LEVEL)
        whole = first.where("whole").select("id", "keys")
        first.agg(F.count("*")).collect()
        rest = cut_lineage(_signed(lines.join(whole.select("id").hint(HASHED), "id", "left_anti"), F.lit(2**56)).select("id", "keys"))
    return first, rest


def _shingles(line: str) -> Column:
    """The hashes of a line's shingles, repeats included, in chunks, so that a long line is not copied for each."""
    data = F.col(line).cast("binary")
    chunks = F.transform(F.sequence(F.lit(1), F.octet_length(data) - SHINGLE + 1, F.lit(CHUNK - SHINGLE + 1)), lambda i: F.substring(data, i, F.lit(CHUNK)))
    each = F.transform(chunks, lambda c: F.transform(F.sequence(F.lit(1), F.octet_length(c) - SHINGLE + 1), lambda i: F.xxhash64(F.substring(c, i, F.lit(SHINGLE)))))
    return F.flatten(each)


def _distinct(lines: DataFrame) -> DataFrame:
    """``(id, set)``: the hashes of each line's distinct shingles.

    A column of its own, as an explode of this expression would compute it, and each of its rows, without generated code.
    """
    once = F.spark_partition_id() >= 0  # not deterministic: no filter on the set is moved below it, which would then be made twice
    return lines.select("id", F.when(once, F.array_distinct(_shingles("line"))).alias("set"))


def _bitmaps(lines: DataFrame) -> DataFrame:
    """``(id, size, bits)``: the number of each line's distinct shingles, and their parities in ``64 * WORDS`` classes.

    Sets that differ in d shingles have parities that differ in d classes at most.
    """
    bit = F.shiftrightunsigned("h", 20).bitwiseAND(F.lit(64 * WORDS - 1))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(63)).cast("int"))
    words = _distinct(lines).select("id", F.explode("set").alias("h")).select("id", F.shiftright(bit, 6).cast("int").alias("w"), one.alias("b"))
    words = words.groupBy("id", "w").agg(F.bit_xor("b").alias("b"), F.count("*").alias("n"))
    wide = words.groupBy("id").agg(F.sum("n").alias("size"), *[F.max(F.when(F.col("w") == k, F.col("b"))).alias(f"w{k}") for k in range(WORDS)])
    bits = F.array(*[F.coalesce(f"w{k}", F.lit(0)) for k in range(WORDS)])
    with _roomy_maps(lines.sparkSession):
        return cut_lineage(wide.select("id", "size", bits.alias("bits")))  # a checkpoint: its words are known not to be null, which keeps `_may` short


def _folded(bitmaps: DataFrame) -> DataFrame:
    """``bitmaps`` with parities in ``64 * FOLDED`` classes, each the union of some of those before."""
    fold = [reduce(Column.bitwiseXOR, [F.col("bits")[k] for k in range(j, WORDS, FOLDED)]) for j in range(FOLDED)]
    return bitmaps.select("id", "size", F.array(*fold).alias("bits"))


def _may(x: str, y: str, similarity: float, words: int) -> Column:
    """Whether the sizes and bitmaps of ``x`` and ``y`` allow the similarity."""
    sizes = F.least(f"{x}.size", f"{y}.size") >= F.greatest(f"{x}.size", f"{y}.size") * (similarity - 1e-9)
    off = sum((F.bit_count(F.col(f"{x}.bits")[k].bitwiseXOR(F.col(f"{y}.bits")[k])) for k in range(words)), F.lit(0))
    return sizes & (off <= (F.col(f"{x}.size") + F.col(f"{y}.size")) * ((1 - similarity) / (1 + similarity) + 1e-9))


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The ``(a, b)`` of ``pairs(a, b, sizes)`` whose lines' shingle sets have this Jaccard similarity at least; ``sizes`` is the sum of those of both sets."""
    both = split_join(_kept(pairs), texts.select(F.col("id").alias("a"), F.col("line").alias("x")), "a")
    both = split_join(both, texts.select(F.col("id").alias("b"), F.col("line").alias("y")), "b")
    common = F.size(F.array_intersect(_shingles("x"), _shingles("y")))
    met = both.select("a", "b", "sizes", common.alias("common"))  # a column of its own, as in _distinct
    met = met.select("a", "b", "sizes", F.explode(F.array("common")).alias("common"))  # exploded: the filter stays behind it
    return met.where(F.col("common") * (1 + similarity) >= F.col("sizes") * similarity - 1e-9).select("a", "b")


def _shared(buckets: DataFrame) -> DataFrame:
    """The rows of ``buckets(key, id)`` whose key several lines have."""
    ends = buckets.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("k")).where("lo < hi")
    with _roomy_maps(buckets.sparkSession):
        ends = _kept(ends)
    two = ends.where("k = 2").select("key", F.explode(F.array("lo", "hi")).alias("id"))
    more = ends.where("k > 2").select("key")
    return two.unionByName(split_join(sifted(buckets, more, ["key"])[0], more, "key"))


def _bucketed(lines: DataFrame, shortest: int) -> DataFrame:
    """``(key, id)``: the buckets that several of the persisted ``lines`` share; ``lines`` goes once they are signed."""
    first, rest = _signatures(lines.where(F.octet_length("line") >= shortest))
    lines.unpersist()
    shared = _kept(_shared(first.where("whole").select("id", "keys").unionByName(rest).select(F.explode("keys").alias("key"), "id")))
    first.unpersist()
    return shared


def _links(shared: DataFrame, found: DataFrame, similarity: float) -> DataFrame:
    """Components ``(node, root)`` of the lines of ``found`` that have a near-duplicate, by the buckets that they share."""
    known = _kept(shared.select("id").distinct())
    some, _ = sifted(found.select("id", "line"), known, ["id"])
    near = _lines(some).join(known.hint(HASHED), "id", "left_semi").persist(LEVEL)  # unlike a checkpoint, it keeps the partitioning by id
    texts = _kept(near)
    bitmaps = _bitmaps(near)
    near.unpersist()
    counted = split_join(shared, texts.select("id", "n"), "id")
    star = counted.groupBy("key").agg(F.max(F.struct("n", "id")).alias("star")).select("key", F.col("star.id").alias("star"))
    others = _kept(split_join(shared, star, "key").where("id != star"))
    rays = others.select(F.col("star").alias("a"), F.col("id").alias("b")).distinct()
    for side in "ab":
        rays = split_join(rays, _folded(bitmaps).select(F.col("id").alias(side), F.struct("size", "bits").alias(f"{side}_of")), side)
    first = cut_lineage(_verified(rays.where(_may("a_of", "b_of", similarity, FOLDED)).select("a", "b", (F.col("a_of.size") + F.col("b_of.size")).alias("sizes")), texts, similarity))
    roots = cut_lineage(components(first))
    rooted = split_join(others.select("key", "id"), roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    rooted = _kept(rooted)
    mixed = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
    mixed = _kept(split_join(rooted, mixed, "key"))
    marked = cut_lineage(split_join(mixed, bitmaps, "id"))  # both sides of the join below
    x, y = marked.alias("x"), marked.alias("y")
    pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.root") < F.col("y.root")) & _may("x", "y", similarity, WORDS))
    pairs = pairs.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"), (F.col("x.size") + F.col("y.size")).alias("sizes")).distinct()
    return components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(_verified(pairs, texts, similarity)))


def duplicates(docs: DataFrame, similarity: float = 0.8, shortest: int = SHORTEST) -> DataFrame:
    """``(ord, th, dropped)``: the line numbers, from 0, that a document loses; others are absent.

    Lines of one component, equal ones included, count as one; its first occurrence by doc_id and
    line number stays. Blank lines stay; lines under ``shortest`` bytes count as one only if they
    are equal. Rows with the same id and text are one document. Null texts have no lines. Unlike
    lines whose first hashes are equal (about 3 in ten billion) are told apart by a second one and stay.
    """
    found = _occurrences(docs)
    with _roomy_maps(docs.sparkSession):
        lines = _lines(found).persist(LEVEL)
        repeated = _kept(lines.where("n > 1").select("id"))  # now the partitioning of lines by id is known and saves shuffles
    shared = _bucketed(lines, max(shortest, SHINGLE))
    del lines  # else its shuffle stays on the disks
    roots = _links(shared, found, similarity)
    roots = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()).withColumnRenamed("node", "id")
    rooted = _kept(repeated.join(roots, "id", "full").select("id", F.coalesce("root", "id").alias("root")))
    held = _kept(split_join(found.select("ord", "th", "pos", "id"), rooted.hint(HASHED), "id").select("ord", "pos", "th", "root"))
    keep = held.groupBy("root").agg(F.min(F.struct("ord", "pos", "th")).alias("keep"))
    lost = split_join(held, keep, "root").where(F.struct("ord", "pos", "th") != F.col("keep"))
    return lost.groupBy("ord", "th").agg(F.array_sort(F.collect_set("pos")).alias("dropped"))


def report(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """``(doc_id, n_lines, n_dropped, dropped)`` for each row of ``docs(doc_id, text, ...)``; ``dropped`` lists line numbers from 0.

    A null text has no line, an empty one a line of no length. Blank lines stay, and lines under
    ``SHORTEST`` bytes but for equal ones. Repeated rows get equal results; null ids come after all others; an empty table gives no rows.
    """
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("ord"), F.xxhash64(text).alias("th"),
                       F.coalesce(F.size(F.split(text, "\n", -1)), F.lit(0)).cast("long").alias("n_lines"))
    return rows.join(duplicates(docs, similarity), ["ord", "th"], "left").select(
        "doc_id", F.when(F.col("n_lines") < 0, 0).otherwise(F.col("n_lines")).alias("n_lines"),
        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"), F.coalesce(F.array_join("dropped", ","), F.lit("")).alias("dropped"))


def deduplicated(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """``docs`` with its columns, each text without its dropped lines and ``n_chars``, if there, counted anew.

    A document that loses its last line that is not blank goes. All other rows stay.
    """
    text, names = F.col("text").cast("string"), docs.columns
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("ord"), F.xxhash64(text).alias("th"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    parts, old = F.split(F.col("row.text").cast("string"), "\n", -1), F.col("dropped").isNull()
    left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("dropped"))
    new = rows.join(duplicates(docs, similarity), ["ord", "th"], "left").select("row", "dropped", F.array_join(F.transform(left, lambda i: parts[i]), "\n").alias("new"))
    new = new.where(old | F.col("new").rlike(r"\S"))
    changed = {"text": F.col("new"), "n_chars": F.char_length("new")}
    field = lambda c: F.col("row").getField(c)
    return new.select(*[(F.when(old, field(c)).otherwise(changed[c].cast(docs.schema[c].dataType)) if c in changed else field(c)).alias(c) for c in names])
