"""Images from the given tables: vectors as 8-bit planes, parts as image shapes.

A sample table is ``(image_id, comp, y, x, v)``; a pixel table has the components side by side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _eight_bit(e: Column) -> Column:
    return F.floor(e.cast("double") * 127 + 128).cast("long")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")


def _eight_bits(v: str) -> Column:
    return F.transform(v, _eight_bit)


def _rows(planes: DataFrame, keys: list[str]) -> DataFrame:
    """The eight rows ``(*keys, y, v)`` of planes ``(*keys, v)`` of 64 samples."""
    each = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda y: F.slice("v", y * 8 + 1, F.lit(8)))
    return planes.select(*keys, F.posexplode(each).alias("y", "v")).withColumn("y", F.col("y").cast("long"))


def gray_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layout A as rows ``(image_id, comp, y, v)``: a vector is one 8x8 image."""
    planes = vectors(spark, sf_dir).select(F.col("vec_id").alias("image_id"), F.lit(0).alias("comp"), _eight_bits("embedding").alias("v"))
    return _rows(planes, ["image_id", "comp"])


def gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layout A: a vector is one 8x8 image."""
    rows = vectors(spark, sf_dir).select(F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("i", "e"))
    return rows.select(
        "image_id", F.lit(0).alias("comp"), F.shiftright("i", 3).cast("long").alias("y"), F.col("i").bitwiseAND(F.lit(7)).cast("long").alias("x"),
        _eight_bit(F.col("e")).alias("v"),
    )


def _planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(image_id, p0, p1, p2)``: three neighbouring vectors; what is missing of the last image is black."""
    of = lambda k: F.first(F.when(F.col("vec_id") % 3 == k, _eight_bits("embedding")), ignorenulls=True)
    planes = vectors(spark, sf_dir).groupBy(F.expr("vec_id div 3").alias("image_id")).agg(*[of(k).alias(f"p{k}") for k in range(3)])
    black = F.array_repeat(F.lit(0).cast("long"), 64)
    return planes.select("image_id", *[F.coalesce(f"p{k}", black).alias(f"p{k}") for k in range(3)])


def rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layout B, a pixel table: three neighbouring vectors are the components ``c0, c1, c2`` of one 8x8 image."""
    rows = _planes(spark, sf_dir).select("image_id", F.posexplode(F.arrays_zip("p0", "p1", "p2")).alias("i", "p"))
    return rows.select(
        "image_id", F.shiftright("i", 3).cast("long").alias("y"), F.col("i").bitwiseAND(F.lit(7)).cast("long").alias("x"),
        *[F.col(f"p.p{k}").alias(f"c{k}") for k in range(3)],
    )


def rgb_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layout B as rows of pixels ``(image_id, y, c0, c1, c2)``, arrays."""
    planes = _planes(spark, sf_dir)
    row = lambda k, y: F.slice(f"p{k}", y * 8 + 1, F.lit(8)).alias(f"c{k}")
    each = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda y: F.struct(y.cast("long").alias("y"), *[row(k, y) for k in range(3)]))
    return planes.select("image_id", F.explode(each).alias("r")).select("image_id", "r.*")


def wide_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layout C as rows ``(image_id, comp, y, v)``: 64 neighbouring vectors are the rows of one image 64 wide; the last one may be lower."""
    return vectors(spark, sf_dir).select(
        F.expr("vec_id div 64").alias("image_id"), F.lit(0).alias("comp"), (F.col("vec_id") % 64).alias("y"), _eight_bits("embedding").alias("v"),
    )


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layout C as samples."""
    return wide_lines(spark, sf_dir).select("image_id", "comp", "y", F.posexplode("v").alias("x", "v")).withColumn("x", F.col("x").cast("long"))


def long_form(pixels: DataFrame) -> DataFrame:
    """A pixel table as samples, without a shuffle."""
    planes = F.explode(F.array(*[F.struct(F.lit(k).alias("comp"), F.col(f"c{k}").alias("v")) for k in range(3)]))
    return pixels.select("image_id", "y", "x", planes.alias("p")).select("image_id", "p.comp", "y", "x", "p.v")


def pixels(samples: DataFrame) -> DataFrame:
    """Samples with components 0 to 2 as a pixel table."""
    return samples.groupBy("image_id", "y", "x").agg(*[F.max(F.when(F.col("comp") == k, F.col("v"))).alias(f"c{k}") for k in range(3)])


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An image shape and coding parameters for each part: ``(image_id, w, h, levels, tile_w, tile_h, cblk_w, cblk_h)``."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size")
    return part.select(
        F.col("p_partkey").alias("image_id"), (F.col("p_size") * 3 + F.col("p_partkey") % 7).cast("long").alias("w"), (F.col("p_partkey") % 90 + 1).cast("long").alias("h"),
        (F.col("p_partkey") % 6).alias("levels"), F.lit(64).cast("long").alias("tile_w"), F.lit(48).cast("long").alias("tile_h"), F.lit(32).cast("long").alias("cblk_w"), F.lit(16).cast("long").alias("cblk_h"))
