"""A Merkle manifest of a dataset, built and opened by slot pivots.

A row of the table is a leaf. Leaves stand in groups, in the order of their ids. At each level
conditional aggregates spread the up to ``FANOUT`` children of a parent into columns ``s0, s1, …`` of
one row: the columns side by side hash to the parent, and all of them but a child's own are its
siblings, those before it and those after it. The groups' roots, in the order of the groups, are the
leaves of one more tree above.

A node's place is its rank in its group. Ranks come from a sort by ranges and the sizes of its
partitions, so a group of any size is spread over the cluster; a parent has at most ``FANOUT`` rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ripplet.llm.common import cut_lineage, split_join

FANOUT = 16
SLOTS = [f"s{k}" for k in range(FANOUT)]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _field(value: Column) -> Column:
    """A value so that no two lists of values read alike: its bytes' number, a colon and itself, or a dash for null."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(text: Column) -> Column:
    """The digest of a row of ``documents`` with this text."""
    return F.sha2(F.concat(*[_field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")], _field(text)), 256)


def lower_cased(text: Column) -> Column:
    """A text with A-Z in lower case and all else as it is."""
    return F.translate(text, UPPER, LOWER)


def _ranked(rows: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """``rows(g, …)`` with their place ``pos`` in their group by ``order`` and its size ``n``; the largest size.

    The sort's partitions follow each other, so a row's rank is its place in its partition, less
    where its group begins there, and the group's rows in earlier partitions.
    """
    placed = rows.repartitionByRange("g", *order).sortWithinPartitions("g", *order)
    placed = cut_lineage(placed.withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", 33))
    parts = placed.groupBy("_part", "g").agg(F.count("*").alias("_k"), F.min("_at").alias("_first"))  # partitions and groups, no more
    group = Window.partitionBy("g")
    before = F.sum("_k").over(group.orderBy("_part")) - F.col("_k")
    parts = cut_lineage(parts.select("_part", "g", (before - F.col("_first")).alias("_shift"), F.sum("_k").over(group).alias("n")))
    largest = parts.agg(F.max("n")).first()[0] or 0
    found = split_join(placed, parts, ["_part", "g"]).withColumn("pos", F.col("_at") + F.col("_shift"))
    return found.drop("_at", "_part", "_shift"), largest


def _depth(n: int) -> int:
    """Levels above the leaves of the largest group."""
    depth = 0
    while FANOUT**depth < n:
        depth += 1
    return depth


def _pivots(nodes: DataFrame, depth: int) -> tuple[list[DataFrame], DataFrame]:
    """The pivots of all levels, lowest first, and the groups' roots ``(g, pos, n, own)``, of ``nodes(g, pos, n, own struct<h, …>)``.

    A pivot has a row ``(g, pos, n, s0, …)`` for each parent; a group's only node goes up as it is.
    """
    pivots = []
    for _ in range(depth):
        slot = F.pmod("pos", F.lit(FANOUT))
        spread = [F.max(F.when(slot == k, F.col("own"))).alias(s) for k, s in enumerate(SLOTS)]
        pivot = cut_lineage(nodes.groupBy("g", F.expr(f"pos div {FANOUT}").alias("pos"), "n").agg(*spread))
        digest = F.when(F.col("n") == 1, F.col("s0.h")).otherwise(F.sha2(F.concat_ws("", *[f"{s}.h" for s in SLOTS]), 256))
        nodes = pivot.select("g", "pos", F.expr(f"(n + {FANOUT - 1}) div {FANOUT}").alias("n"), F.struct(digest.alias("h")).alias("own"))
        pivots.append(pivot)
    return pivots, nodes


def _opened(pivots: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The leaves below ``tops(g, pos, path, …)`` as ``(g, pos, own, path, …)``.

    A path has, from the leaf's level up, the digests before and after a node's own slot; ``lone``
    marks a level at which nothing was hashed.
    """
    for pivot in reversed(pivots):
        children = []
        for k, s in enumerate(SLOTS):
            step = F.struct(
                F.concat_ws("", *[f"{x}.h" for x in SLOTS[:k]]).alias("before"),
                F.concat_ws("", *[f"{x}.h" for x in SLOTS[k + 1 :]]).alias("after"),
                (F.col("n") == 1).alias("lone"),
            )
            children.append(F.when(F.col(s).isNotNull(), F.struct((F.col("pos") * FANOUT + k).alias("pos"), F.col(s).alias("own"), step.alias("step"))))
        parents = pivot.select("g", "pos", F.filter(F.array(*children), lambda c: c.isNotNull()).alias("children"))
        met = parents.join(tops.drop("own"), ["g", "pos"])
        each = met.select("*", F.explode("children").alias("child")).drop("children", "pos")
        path = F.concat(F.array("child.step"), F.col("path"))
        tops = each.withColumns({"pos": F.col("child.pos"), "own": F.col("child.own"), "path": path}).drop("child")
    return tops


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf's digest and its siblings give."""
    return F.aggregate(path, leaf, lambda h, p: F.when(p.lone, h).otherwise(F.sha2(F.concat(p.before, h, p.after), 256)))


def manifest(docs: DataFrame, changed: Column | None = None) -> DataFrame:
    """For each row of ``docs(doc_id, text, lang, source, n_chars, …)`` its leaf, its source's root, the root, its proof and a check of it.

    ``changed`` is the text as it is found at the check (null: as it was); ``folded_root`` is what
    that text's leaf and the original siblings give, and ``verified`` whether this is the root.
    Rows of a source stand by doc_id, null first, and by their leaf where ids are equal; null is a
    source of its own, the first. Nulls are values like any other, equal rows are leaves of their
    own, an only row is its source's root, and the only source's root is the root. An empty table
    gives no rows; other columns are not read.
    """
    text = F.col("text").cast("string")
    found = leaf_digest(text) if changed is None else F.when(changed.isNotNull(), leaf_digest(changed))
    group = F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("s"), F.col("source").cast("string")))
    own = F.struct(leaf_digest(text).alias("h"), F.col("doc_id").cast("long").alias("doc_id"), found.alias("found"))
    rows = docs.select(group.alias("g"), own.alias("own"))
    leaves, largest = _ranked(rows.select("g", F.col("own.doc_id").alias("_id"), F.col("own.h").alias("_leaf"), "own"), ["_id", "_leaf"])
    if not largest:
        return docs.sparkSession.createDataFrame([], RESULT)
    pivots, roots = _pivots(leaves.select("g", "pos", "n", "own"), _depth(largest))
    named = roots.select(F.lit("").alias("g"), F.col("g").alias("_source"), F.struct("own.h", F.col("g").alias("source")).alias("own"))
    named, sources = _ranked(named, ["_source"])
    above, top = _pivots(named.select("g", "pos", "n", "own"), _depth(sources))
    root = top.first()["own"]["h"]
    no_step = F.array().cast("array<struct<before:string,after:string,lone:boolean>>")
    opened = _opened(above, top.select("g", "pos", "own", no_step.alias("path")))
    tops = cut_lineage(opened.select(F.col("own.source").alias("g"), F.lit(0).cast("long").alias("pos"), "path", F.col("own.h").alias("subroot")))
    if not pivots:  # every source has one row
        leaf = leaves.select("g", "own").join(tops, "g")
    else:
        leaf = _opened(pivots, tops)
    path = F.col("path")
    proof = F.sha2(F.array_join(F.transform(path, lambda p: F.concat(p.before, p.after)), ""), 256)
    out = leaf.select(
        F.col("own.doc_id").alias("doc_id"), F.col("own.h").alias("leaf"), "subroot", F.lit(root).alias("root"), proof.alias("proof_sha256"),
        folded(F.coalesce("own.found", "own.h"), path).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def tampered(docs: DataFrame, every: int = 5) -> Column:
    """The text in lower case where ``every`` divides the crc32 of the id as text, else null: what an audit is tried on."""
    crc = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary"))
    return F.when(crc % every == 0, lower_cased(F.col("text").cast("string")))
