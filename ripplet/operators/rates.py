"""Allocation of a tile's bytes to the coding passes of its blocks.

A pass is worth what it takes off the squared error for each byte it costs. A block's passes come in
their order, so a pass counts with the least worth up to it. Passes are taken by falling worth for as long
as their running sum stays within the tile's bytes; so each block keeps its first passes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ripplet.functions.columns import NORMS_53, NORMS_97, norm

TILE = ["image_id", "ty", "tx", "max_bytes"]
BLOCK = ["comp", "band", "cb_y", "cb_x"]
#: Bytes of a payload's head, and of a block's entry in it.
HEAD, ENTRY = 4, 24


def choose(passes: DataFrame, tile: list[str], block: list[str], budget: Column) -> DataFrame:
    """``(*tile, *block, kept)``: how many of its passes each block of ``passes(*tile, *block, k, cost, gain)`` keeps.

    ``k`` counts a block's passes from 1, ``cost`` is in bytes, ``budget`` a tile's bytes. Passes of equal
    worth go by block and number. Blocks that keep nothing are absent.
    """
    own = Window.partitionBy(*tile, *block).orderBy("k")
    worth = F.min(F.col("gain") / (F.col("cost") + 1)).over(own)
    order = Window.partitionBy(*tile).orderBy(F.desc("worth"), *block, "k")
    sums = passes.withColumn("worth", worth).withColumn("spent", F.sum("cost").over(order))
    return sums.where(F.col("spent") <= budget).groupBy(*tile, *block).agg(F.max("k").alias("kept"))


def allocate(blocks: DataFrame) -> DataFrame:
    """``blocks(…, max_bytes, data, num_passes, ends, errors)`` cut so that a tile's payload has at most ``max_bytes``; a tile is there once for each of its limits.

    ``blocks`` is read twice, for the choice without its data: it should be a table and not what a coder is about to make.
    Errors weigh by the norm of their band. A limit under the size of a tile's block table leaves all
    blocks empty; that table is always written.
    """
    heads = Window.partitionBy(*TILE)
    room = F.col("max_bytes") - HEAD - ENTRY * F.count("*").over(heads)
    orient = F.array_position(F.array(*map(F.lit, ("LL", "HL", "LH", "HH"))), F.col("orient")) - 1
    at = F.when(F.col("orient") == "LL", F.col("level")).otherwise(F.col("level") - 1)
    gain = F.when(F.col("lossless"), norm(NORMS_53, orient, at)).otherwise(norm(NORMS_97, orient, at))
    sized = blocks.select(*TILE, *BLOCK, "ends", "errors", room.alias("room"), (gain * gain).alias("square"))
    each = sized.select(*TILE, *BLOCK, "room", "square", "errors", "ends", F.posexplode("ends").alias("i", "end"))
    before = F.coalesce(F.get("ends", F.col("i") - 1), F.lit(0))
    passes = each.select(
        *TILE, *BLOCK, "room", (F.col("i") + 1).alias("k"), (F.col("end") - before).alias("cost"),
        ((F.get("errors", F.col("i")) - F.get("errors", F.col("i") + 1)) * F.col("square")).alias("gain"))
    kept = choose(passes, TILE, BLOCK, F.col("room"))
    both = blocks.join(kept, [*TILE, *BLOCK], "left").withColumn("num_passes", F.coalesce(F.col("kept"), F.lit(0)).cast("int"))
    end = F.coalesce(F.get("ends", F.col("num_passes") - 1), F.lit(0))
    return both.withColumn("data", F.substring("data", F.lit(1), end)).drop("kept", "ends", "errors")
