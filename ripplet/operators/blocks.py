"""Code-blocks, neighbourhood contexts and rollups over samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ripplet.functions.columns import bit_length
from ripplet.operators.geometry import halved


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` in as many partitions as shuffles have, by the keys; with a number given, small partitions are not put together, as it is time that their rows take and not bytes."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def in_code_blocks(pieces: DataFrame, plane: list[str], cblk_w: int, cblk_h: int) -> DataFrame:
    """Code-blocks ``(*plane, band, level, orient, cb_x, cb_y, cb_w, cb_h, samples)`` of the pieces of all bands; samples are in rows. A plane's column ``levels`` numbers its bands.

    A piece begins at an edge of its band, so it is cut where blocks end and never put together again
    but with its neighbours in a block.
    """
    step = F.when(F.col("down"), F.lit(cblk_h)).otherwise(F.lit(cblk_w))
    parts = F.transform(F.sequence(F.lit(1), F.size("v"), step), lambda i: F.slice("v", i, step))
    kind = F.array_position(F.array(*map(F.lit, ("HL", "LH", "HH"))), F.col("orient"))
    band = F.when(F.col("orient") == "LL", 0).otherwise(3 * (F.col("levels") - F.col("level")) + kind).cast("long")
    cut = pieces.select(*plane, "level", "orient", "down", "x", "y", F.posexplode(parts).alias("j", "v"))
    along = F.col("j") * F.when(F.col("down"), F.lit(cblk_h)).otherwise(F.lit(cblk_w))
    x, y = F.col("x") + F.when(F.col("down"), 0).otherwise(along), F.col("y") + F.when(F.col("down"), along).otherwise(0)
    cut = cut.select(
        *plane, band.alias("band"), "level", "orient", "down", (x - x % cblk_w).alias("cb_x"), (y - y % cblk_h).alias("cb_y"),
        F.when(F.col("down"), x % cblk_w).otherwise(y % cblk_h).alias("i"), "v",
    )
    cut = spread(cut, *plane, "band", "cb_x", "cb_y")
    held = cut.groupBy(
        *plane, "band", "level", "orient", "down", "cb_x", "cb_y",
    ).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda p: p["v"]).alias("m"))
    rows = F.transform(F.sequence(F.lit(0), F.size(F.get("m", F.lit(0))) - 1), lambda r: F.transform("m", lambda c: F.get(c, r)))
    held = held.withColumn("m", F.when(F.col("down"), rows).otherwise(F.col("m")))
    return held.select(
        *plane, "band", "level", "orient", "cb_x", "cb_y", F.size(F.get("m", F.lit(0))).alias("cb_w"), F.size("m").alias("cb_h"),
        F.flatten("m").cast("array<int>").alias("samples"),
    )


def bit_planes(blocks: DataFrame) -> DataFrame:
    """Code-blocks with ``numbps``, the bit planes of their largest magnitude, and ``n``, their samples."""
    most = F.array_max(F.transform("samples", lambda v: F.abs(v)))
    return blocks.withColumns({"numbps": bit_length(most.cast("long")), "n": F.size("samples").cast("long")})


def neighbours(samples: DataFrame, value: Column, plane: tuple[str, ...] = ("image_id", "comp")) -> DataFrame:
    """Samples with ``value`` of the eight samples around: columns ``nw n ne w c e sw s se``, 0 outside the plane."""
    row, column = (Window.partitionBy(*plane, a).orderBy(b) for a, b in (("y", "x"), ("x", "y")))
    data = samples.withColumn("c", value.cast("long"))
    data = data.withColumns({"n": F.lag("c", 1, 0).over(column), "s": F.lead("c", 1, 0).over(column)})
    sides = {name: f("c" if not at else at, 1, 0).over(row) for name, f, at in (
        ("w", F.lag, ""), ("e", F.lead, ""), ("nw", F.lag, "n"), ("ne", F.lead, "n"), ("sw", F.lag, "s"), ("se", F.lead, "s"),
    )}
    return data.withColumns(sides)


def zero_coding_context(orient: str) -> Column:
    """The context of a sample's significance, 0 to 8, from the significances around it."""
    across, down, corners = F.col("w") + F.col("e"), F.col("n") + F.col("s"), F.col("nw") + F.col("ne") + F.col("sw") + F.col("se")
    few = F.least(corners, F.lit(2))
    if orient == "HH":
        sides = across + down
        return F.when(sides >= 3, 8).when(sides == 2, 6 + F.least(corners, F.lit(1))).when(sides == 1, 3 + few).otherwise(few).cast("long")
    a, b = (down, across) if orient == "HL" else (across, down)
    one = F.when(b >= 1, 7).when(corners >= 1, 6).otherwise(5)
    return F.when(a == 2, 8).when(a == 1, one).when(b > 0, 2 + b).otherwise(few).cast("long")


def sign_context() -> tuple[Column, Column]:
    """Context offset and predicted sign from the signed significances (-1, 0, 1) left, right, above and below."""
    h, v = F.signum((F.col("w") + F.col("e")).cast("double")), F.signum((F.col("n") + F.col("s")).cast("double"))
    offset = F.when((h == 0) & (v == 0), 0).when((h == 0) | (v == 0), 3).when(h == v, 4).otherwise(2)
    return offset.cast("long"), ((h < 0) | ((h == 0) & (v < 0))).cast("long")


def refinement_contexts(samples: DataFrame, plane: tuple[str, ...]) -> DataFrame:
    """``(*plane, y, x, bit, ctx)``: the context, 14 to 16, of every refinement of the samples ``(*plane, y, x, v)`` of blocks.

    A sample is refined in each bit plane below its top one. The first time its context says whether
    a sample around is significant by then, which is one that has a bit in this plane or above: next to
    a significant sample it was found in this plane's first pass at the latest.
    """
    around = neighbours(samples, F.abs("v"), plane)
    most = F.greatest("nw", "n", "ne", "w", "e", "sw", "s", "se")
    top = bit_length(F.col("c")).cast("int") - 1
    each = around.where(F.col("c") >= 2).select(*plane, "y", "x", top.alias("top"), most.alias("most"), F.explode(F.sequence(F.lit(0), top - 1)).alias("bit"))
    near = F.call_function("shiftright", F.col("most"), F.col("bit")) > 0
    ctx = F.when(F.col("bit") < F.col("top") - 1, 16).when(near, 15).otherwise(14)
    return each.select(*plane, "y", "x", F.col("bit").cast("long").alias("bit"), ctx.cast("long").alias("ctx"))


def tag_tree(leaves: DataFrame, levels: int | Column, keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """``(*keys, level, y, x, value)``: the minimum over each node's leaves ``(*keys, y, x, value, …)``, ``levels`` levels above them.

    ``levels`` may be a column, alike for all leaves of a tree: each grid has its own depth. A level is
    summed up from the leaves, in one shuffle for all levels.
    """
    depth = F.lit(levels) if isinstance(levels, int) else levels
    at = lambda c, l: F.call_function("shiftright", F.col(c), l.cast("int")).alias(c)
    places = F.transform(F.sequence(F.lit(0), depth.cast("int")), lambda l: F.struct(l.cast("long").alias("level"), at("y", l), at("x", l)))
    return leaves.select(*keys, F.explode(places).alias("p"), "value").groupBy(*keys, "p.level", "p.y", "p.x").agg(F.min("value").alias("value"))


def tag_tree_sizes(grids: DataFrame) -> DataFrame:
    """``grids(w, h, …)`` with the number of levels of a tag tree over ``w`` by ``h`` leaves, and of its nodes."""
    side = F.greatest("w", "h")
    grown = grids.withColumn("n_levels", F.when((F.col("w") < 1) | (F.col("h") < 1), 0).otherwise(bit_length(side - 1) + 1).cast("long"))
    nodes = F.aggregate(F.sequence(F.lit(0), F.col("n_levels").cast("int") - 1), F.lit(0).cast("long"), lambda n, l: n + halved(F.col("w"), l) * halved(F.col("h"), l))
    return grown.withColumn("n_nodes", F.when(F.col("n_levels") == 0, 0).otherwise(nodes).cast("long"))


def crop(samples: DataFrame, x0: int, y0: int, x1: int, y1: int, dx: Column | int = 1, dy: Column | int = 1) -> DataFrame:
    """The samples of a rectangle, from its own origin.

    The rectangle is on the image's grid, of which a sample's component has every ``dx``-th column
    and every ``dy``-th row; one that is cut by the edge belongs to it.
    """
    if not (0 <= x0 < x1 and 0 <= y0 < y1):
        raise ValueError("an empty region")
    for at, first, last, step in (("x", x0, x1, dx), ("y", y0, y1, dy)):
        begin = F.floor(F.lit(first) / step)
        samples = samples.where((F.col(at) >= begin) & (F.col(at) < F.ceil(F.lit(last) / step))).withColumn(at, F.col(at) - begin)
    return samples


def errors(pairs: DataFrame, peak: int = 255) -> DataFrame:
    """``(image_id, max_error, sse, n, psnr)`` of ``pairs(image_id, a, b)``; psnr is null if nothing differs."""
    d = F.col("a") - F.col("b")
    found = pairs.groupBy("image_id").agg(F.max(F.abs(d)).alias("max_error"), F.sum(d * d).alias("sse"), F.count("*").alias("n"))
    return found.withColumn("psnr", F.when(F.col("sse") > 0, F.round(10 * F.log10(F.lit(float(peak * peak)) * F.col("n") / F.col("sse")), 6)))
