"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared ``spark.checkpoint.dir``; where it is unset, a fresh folder in local mode (tests), an error on a cluster."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and sc.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir: name a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-"))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4()}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder: later stages survive the loss of any executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, and not again if an executor is lost."""
    folder = shared_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def map_batches(df: DataFrame, each: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """``mapInArrow`` with a function from one batch to one batch; memory is bounded by the batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield each(batch)

    return df.mapInArrow(run, schema)


def crc_of_id(id_col: str = "doc_id") -> Column:
    """crc32 of the id written as text; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))


def split_join(left: DataFrame, right: DataFrame, key: str | list[str], how: str = "inner") -> DataFrame:
    """Join where ``left`` may hold a hot key (of one column or several) and ``right`` has each key once.

    The hash of the key as a second join key gives both sides a shuffle of this join's own,
    even if ``right`` comes out of an aggregate over ``key``; adaptive execution splits the
    large partitions of a hot key only between two such shuffles.
    """
    keys = [key] if isinstance(key, str) else key
    salted = [df.withColumn("_h", F.hash(*keys)) for df in (left, right)]
    return salted[0].join(salted[1], [*keys, "_h"], how).drop("_h")


#: Words of 64 bits in the bitmap of ``sifted``: as many rows are broadcast at most, however large the input.
SIEVE = 1 << 18


def sifted(rows: DataFrame, keys: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """``rows`` in two parts without a shuffle: those whose values of ``on`` may be in ``keys``, and those whose are certainly not.

    A bitmap of fixed size holds one bit for each key; the fuller it is, the more rows go to the first part.
    ``keys`` is read once and its bitmap checkpointed. Nulls are values like any other here.
    """
    at = F.pmod(F.xxhash64(*on), F.lit(64 * SIEVE))
    word, bit = F.shiftright(at, 6), F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))
    bitmap = cut_lineage(keys.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits")))
    held = rows.withColumns({"_word": word, "_bit": bit}).join(F.broadcast(bitmap), "_word", "left")
    hit = F.coalesce(F.col("_bits").bitwiseAND(F.col("_bit")) != 0, F.lit(False))
    return held.where(hit).select(*rows.columns), held.where(~hit).select(*rows.columns)


#: Links that one task of a union-find round reads, 16 bytes each.
LINKS_A_TASK = 200_000


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected ``edges(a, b)`` as ``(node, root)``, root the least id.

    Distributed union-find by alternating large-star and small-star rounds: every round moves
    each node's links to the least neighbour it knows, and the rounds end when no link moves.
    Nodes without a link to another node are absent. Self-loops, repeated and null links are
    allowed and have no effect. Each round is checkpointed; the driver sees one row of totals.
    A round reads its links with tasks in proportion to their number; few links make one task,
    between whose steps no files of shuffles are needed.
    """
    clean = edges.where(F.col("a") != F.col("b"))
    links = cut_lineage(clean.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _totals(links)
    for _ in range(max_rounds):
        if not before[0]:
            break
        tasks = 1 + before[0] // LINKS_A_TASK
        ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
        both = links.coalesce(tasks).select(F.explode(ways).alias("way")).select("way.a", "way.b")
        large = _with_least(both, tasks).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
        ways = F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
        small = _with_least(large, tasks).select(F.explode(ways).alias("way")).select("way.a", "way.b")
        links = cut_lineage(small.where("a != b").distinct())
        after = _totals(links)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components: no fixed point after {max_rounds} rounds")
    return links.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _with_least(links: DataFrame, tasks: int) -> DataFrame:
    """``links(a, b)`` with the least ``b`` of each ``a`` as ``m``: by a window in one task, by a join that splits hot nodes in several."""
    if tasks == 1:
        return links.withColumn("m", F.min("b").over(Window.partitionBy("a")))
    return split_join(links, links.groupBy("a").agg(F.min("b").alias("m")), "a")


def _totals(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b"))).first())
