"""Tiles, subbands, code-blocks, resolutions and packets, generated from image shapes.

Shapes are rows ``(image_id, w, h, levels, tile_w, tile_h, cblk_w, cblk_h)``; everything is an
explode of a sequence on the row, so nothing is shuffled but to number packets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ripplet.functions.columns import ceil_div

#: The sort keys of each progression order.
ORDERS = {"lrcp": ["layer", "res", "comp", "precinct"], "rlcp": ["res", "layer", "comp", "precinct"], "rpcl": ["res", "precinct", "comp", "layer"],
          "pcrl": ["precinct", "comp", "res", "layer"], "cprl": ["comp", "precinct", "res", "layer"]}


def halved(n: Column, levels: Column | int) -> Column:
    """A size or an origin after so many levels: halved and rounded up each time."""
    return F.ceil(n / F.pow(F.lit(2.0), levels)).cast("long")


def tiles(shapes: DataFrame) -> DataFrame:
    """``(image_id, tile, x0, y0, x1, y1)``, row by row."""
    across, down = ceil_div(F.col("w"), F.col("tile_w")), ceil_div(F.col("h"), F.col("tile_h"))
    cells = shapes.withColumn("across", across).withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), across * down - 1)))
    x0, y0 = (F.col("tile") % F.col("across")) * F.col("tile_w"), F.expr("(tile div across) * tile_h")
    return cells.select(
        "image_id", "tile", x0.alias("x0"), y0.alias("y0"), F.least(x0 + F.col("tile_w"), F.col("w")).alias("x1"),
        F.least(y0 + F.col("tile_h"), F.col("h")).alias("y1"),
    )


def resolutions(shapes: DataFrame) -> DataFrame:
    """``(image_id, reduce, w, h)`` of the image at each reduction."""
    each = shapes.withColumn("reduce", F.explode(F.sequence(F.lit(0).cast("long"), F.col("levels"))))
    return each.select("image_id", "reduce", halved(F.col("w"), F.col("reduce")).alias("w"), halved(F.col("h"), F.col("reduce")).alias("h"))


def subbands(shapes: DataFrame) -> DataFrame:
    """``(image_id, band, orient, level, x_off, y_off, w, h, …)`` in the order of the stream: the deepest low band, then HL, LH, HH from deep to fine."""
    deep = F.struct(F.lit(0).cast("long").alias("band"), F.lit("LL").alias("orient"), F.col("levels").alias("level"), F.lit(0).cast("long").alias("x_off"), F.lit(0).cast("long").alias("y_off"),
                    halved(F.col("w"), F.col("levels")).alias("bw"), halved(F.col("h"), F.col("levels")).alias("bh"))

    def three(r: Column) -> Column:
        level = F.col("levels") - r + 1
        lw, lh = halved(F.col("w"), level), halved(F.col("h"), level)
        hw, hh = halved(F.col("w"), level - 1) - lw, halved(F.col("h"), level - 1) - lh
        zero = F.lit(0).cast("long")
        parts = [("HL", lw, zero, hw, lh), ("LH", zero, lh, lw, hh), ("HH", lw, lh, hw, hh)]
        return F.array(*[F.struct(
            (3 * r - 2 + k).alias("band"), F.lit(o).alias("orient"), level.alias("level"), x.alias("x_off"), y.alias("y_off"), w.alias("bw"),
            h.alias("bh"),
        ) for k, (o, x, y, w, h) in enumerate(parts)])

    finer = F.when(F.col("levels") > 0, F.flatten(F.transform(F.sequence(F.lit(1).cast("long"), F.greatest(F.col("levels"), F.lit(1))), three))).otherwise(F.array().cast("array<struct<band:bigint,orient:string,level:bigint,x_off:bigint,y_off:bigint,bw:bigint,bh:bigint>>"))
    rows = shapes.withColumn("b", F.explode(F.concat(F.array(deep), finer)))
    return rows.select("image_id", "b.band", "b.orient", "b.level", "b.x_off", "b.y_off", F.col("b.bw").alias("w"), F.col("b.bh").alias("h"), "cblk_w", "cblk_h")


def codeblocks(bands: DataFrame) -> DataFrame:
    """``(image_id, band, cb_x, cb_y, cb_w, cb_h)`` of every code-block; bands without samples have none."""
    full = bands.where("w > 0 and h > 0")
    cells = full.withColumn("cb_y", F.explode(F.sequence(
        F.lit(0).cast("long"), F.col("h") - 1, F.col("cblk_h"),
    ))).withColumn("cb_x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("w") - 1, F.col("cblk_w"))))
    return cells.select(
        "image_id", "band", "cb_x", "cb_y", F.least(F.col("cblk_w"), F.col("w") - F.col("cb_x")).alias("cb_w"),
        F.least(F.col("cblk_h"), F.col("h") - F.col("cb_y")).alias("cb_h"),
    )


def packets(precincts: DataFrame, order: str) -> DataFrame:
    """``(image_id, seq, layer, res, comp, precinct)``: the packets of ``precincts(image_id, comp, res, n_precincts, layers)`` in one of five orders."""
    rows = precincts.where("n_precincts > 0 and layers > 0").withColumn("layer", F.explode(F.expr("sequence(0L, layers - 1)"))).withColumn("precinct", F.explode(F.expr("sequence(0L, n_precincts - 1)")))
    at = Window.partitionBy("image_id").orderBy(*ORDERS[order])
    return rows.select("image_id", (F.row_number().over(at) - 1).cast("long").alias("seq"), "layer", "res", "comp", "precinct")


def precinct_counts(precincts: DataFrame) -> DataFrame:
    """``(image_id, n_packets, max_res, max_precincts)``: the totals and maxima over components and resolutions."""
    return precincts.groupBy("image_id").agg(
        F.sum(F.col("n_precincts") * F.col("layers")).alias("n_packets"), (F.max("res") + 1).alias("max_res"),
        F.max("n_precincts").alias("max_precincts"),
    )
