"""The named queries: each applies one operator to images from a whole given table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplet.functions import columns as C
from ripplet.operators import blocks, entropy, geometry, packets, rates, wavelets
from ripplet.plans import codec
from ripplet.sources import codestream, ranges, samples, sinks
from ripplet.sources.shared import shared_folder

LINE = ["image_id", "comp", "y"]
PLANE = ["image_id", "comp"]
#: The size of an image of one vector.
EIGHT = ("8", "8")


def _samples(lines: DataFrame) -> DataFrame:
    return wavelets.scattered(lines, ["image_id", "y"], "x")


def _transformed(lines: DataFrame, levels: int, wavelet: str = "53") -> DataFrame:
    """Samples of transformed planes ``lines(image_id, comp, y, v)``."""
    return wavelets.placed(wavelets.decompose(lines, PLANE, levels, wavelet), PLANE)


def _restored(samples: DataFrame, levels: int, size: tuple[str, str], wavelet: str = "53", plane: tuple[str, ...] = ("image_id", "comp")) -> DataFrame:
    return wavelets.transform_2d(samples, levels, wavelet, back=True, plane=plane, size=size).select("image_id", "y", "x", "v")


def _shifted(spark: SparkSession, sf: str) -> DataFrame:
    return samples.rgb(spark, sf).select("image_id", "y", "x", *[(F.col(f"c{k}") - 128).alias(f"c{k}") for k in range(3)])


def _coloured(spark: SparkSession, sf: str) -> DataFrame:
    made = C.rct_forward(*[F.col(f"c{k}") for k in range(3)])
    return _shifted(spark, sf).select("image_id", "y", "x", *[c.alias(f"c{k}") for k, c in enumerate(made)])


def subband_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Colour transform, one wavelet level, and per subband the largest magnitude, the sum and the count."""
    pixels = F.arrays_zip(*[F.transform(f"c{k}", lambda v: v - 128).alias(f"c{k}") for k in range(3)])
    of = lambda k: lambda p: C.rct_forward(p["c0"], p["c1"], p["c2"])[k]
    planes = F.array(*[F.struct(F.lit(k).alias("comp"), F.transform(pixels, of(k)).alias("v")) for k in range(3)])
    lines = samples.rgb_lines(spark, sf).select("image_id", "y", F.explode(planes).alias("p")).select("image_id", "p.comp", "y", "p.v")
    pieces = wavelets.decompose(lines, PLANE, 1)
    band = F.array_position(F.array(*map(F.lit, ("LL", "HL", "LH", "HH"))), F.col("orient")) - 1
    own = pieces.select(
        "image_id", F.col("comp").cast("long").alias("comp"), band.alias("band"), F.array_max(F.transform("v", lambda v: F.abs(v))).alias("m"),
        F.aggregate("v", F.lit(0).cast("long"), lambda a, v: a + v).alias("t"), F.size("v").alias("k"),
    )
    return own.groupBy("image_id", "comp", "band").agg(F.max("m").alias("max_abs"), F.sum("t").alias("total"), F.sum("k").alias("n"))


def dc_shift(spark: SparkSession, sf: str) -> DataFrame:
    return samples.gray(spark, sf).select("image_id", "y", "x", (F.col("v") - 128).alias("v"))


def rct_forward(spark: SparkSession, sf: str) -> DataFrame:
    return _coloured(spark, sf)


def rct_inverse(spark: SparkSession, sf: str) -> DataFrame:
    back = C.rct_inverse(*[F.col(f"c{k}") for k in range(3)])
    return _coloured(spark, sf).select("image_id", "y", "x", *[(c + 128).alias(f"c{k}") for k, c in enumerate(back)])


def ict_forward(spark: SparkSession, sf: str) -> DataFrame:
    made = C.ict_forward(*[F.col(f"c{k}") for k in range(3)])
    return _shifted(spark, sf).select("image_id", "y", "x", *[F.round(c.cast("double"), 3).alias(f"c{k}") for k, c in enumerate(made)])


def ict_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    data = _shifted(spark, sf)
    made = data.select("*", *[c.alias(f"t{k}") for k, c in enumerate(C.ict_forward(*[F.col(f"c{k}") for k in range(3)]))])
    back = C.ict_inverse(*[F.col(f"t{k}") for k in range(3)])
    return made.select("image_id", "y", "x", *[F.round(c).cast("long").alias(f"c{k}") for k, c in enumerate(back)])


def dwt53_1d(spark: SparkSession, sf: str) -> DataFrame:
    return _samples(wavelets.forward(samples.wide_lines(spark, sf)))


def dwt53_1d_inverse(spark: SparkSession, sf: str) -> DataFrame:
    return _samples(wavelets.inverse(wavelets.forward(samples.wide_lines(spark, sf))))


def dwt53_2d(spark: SparkSession, sf: str) -> DataFrame:
    return _transformed(samples.gray_lines(spark, sf), 1).select("image_id", "y", "x", "v")


def dwt53_multilevel(spark: SparkSession, sf: str) -> DataFrame:
    return _transformed(samples.wide_lines(spark, sf), 3).select("image_id", "y", "x", "v")


def dwt53_multilevel_inverse(spark: SparkSession, sf: str) -> DataFrame:
    """Three levels and back; the images' heights are counted."""
    lines = samples.wide_lines(spark, sf)
    sized = lines.join(lines.groupBy("image_id").agg((F.max("y") + 1).alias("h")), "image_id")
    plane = ("image_id", "comp", "h")
    data = wavelets.placed(wavelets.decompose(sized, list(plane), 3), list(plane))
    return _restored(data, 3, ("64", "h"), plane=plane)


def dwt97_1d(spark: SparkSession, sf: str) -> DataFrame:
    lines = samples.wide_lines(spark, sf).withColumn("v", F.col("v").cast("array<double>"))
    return _samples(wavelets.forward(lines, "97").withColumn("v", F.transform("v", lambda v: F.round(v, 6))))


def dwt97_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    lines = samples.gray_lines(spark, sf).withColumn("v", F.col("v").cast("array<double>"))
    return _restored(_transformed(lines, 2, "97"), 2, EIGHT, "97").withColumn("v", F.round("v", 6))


def resolution_decode(spark: SparkSession, sf: str) -> DataFrame:
    """The image at half size: three levels forward, two of them back on the low band."""
    low = _transformed(samples.gray_lines(spark, sf), 3).where("x < 4 and y < 4")
    return _restored(low, 2, ("4", "4"))


def block_numbps(spark: SparkSession, sf: str) -> DataFrame:
    lines = samples.wide_lines(spark, sf).withColumn("levels", F.lit(1))
    plane = [*PLANE, "levels"]
    return blocks.bit_planes(blocks.in_code_blocks(wavelets.decompose(lines, plane, 1), plane, 16, 16)).select("image_id", "band", "cb_x", "cb_y", "numbps", "n")


def tile_grid(spark: SparkSession, sf: str) -> DataFrame:
    return geometry.tiles(samples.shapes(spark, sf))


def resolution_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return geometry.resolutions(samples.shapes(spark, sf))


def subband_layout(spark: SparkSession, sf: str) -> DataFrame:
    return geometry.subbands(samples.shapes(spark, sf)).drop("cblk_w", "cblk_h")


def band_dimensions(spark: SparkSession, sf: str) -> DataFrame:
    """Samples by orientation and level over all images, which add up to the images."""
    return geometry.subbands(samples.shapes(spark, sf)).groupBy("orient", "level").agg(
        F.count("*").alias("bands"), F.sum(F.col("w") * F.col("h")).alias("samples"), F.max("w").alias("max_w"), F.max("h").alias("max_h"),
    )


def codeblock_grid(spark: SparkSession, sf: str) -> DataFrame:
    return geometry.codeblocks(geometry.subbands(samples.shapes(spark, sf)))


def codeblock_count(spark: SparkSession, sf: str) -> DataFrame:
    bands = geometry.subbands(samples.shapes(spark, sf))
    n = F.when((F.col("w") > 0) & (F.col("h") > 0), C.ceil_div(F.col("w"), F.col("cblk_w")) * C.ceil_div(F.col("h"), F.col("cblk_h"))).otherwise(0)
    return bands.groupBy("image_id").agg(F.count("*").alias("bands"), F.sum(n).cast("long").alias("blocks"))


def _precincts(spark: SparkSession, sf: str) -> DataFrame:
    """Up to three components of up to four resolutions with one to three precincts each; two layers."""
    shapes = samples.shapes(spark, sf).select("image_id", "levels")
    each = shapes.withColumn("comp", F.explode(F.sequence(F.lit(0).cast("long"), F.col("image_id") % 3)))
    each = each.withColumn("res", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("levels"), 1 + F.col("comp") + F.col("image_id") % 2))))
    return each.select(
        "image_id", "comp", "res", (1 + (F.col("image_id") + F.col("comp") + F.col("res")) % 3).alias("n_precincts"),
        F.lit(2).cast("long").alias("layers"),
    )


def packets_in(order: str):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        return geometry.packets(_precincts(spark, sf), order)

    return query


def packet_counts(spark: SparkSession, sf: str) -> DataFrame:
    return geometry.precinct_counts(_precincts(spark, sf))


def tagtree_min(spark: SparkSession, sf: str) -> DataFrame:
    return blocks.tag_tree(samples.gray(spark, sf).withColumnRenamed("v", "value"), 3)


def tagtree_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    leaves = samples.gray(spark, sf).select("image_id", "y", "x", F.shiftright("v", 4).alias("value"))
    return packets.read_tag_trees(packets.code_tag_trees(leaves, 8, 8, 17), 8, 8, 17)


def _coefficients(spark: SparkSession, sf: str) -> DataFrame:
    lines = samples.gray_lines(spark, sf).withColumn("v", F.transform("v", lambda v: (v - 128) * 16))
    return _transformed(lines, 1).select("image_id", "y", "x", "v")


def quantize_band(spark: SparkSession, sf: str) -> DataFrame:
    step = C.step_size(F.lit(5), F.lit(512), 2)
    return _coefficients(spark, sf).select("image_id", "y", "x", C.quantize(F.col("v"), step).alias("q"))


def dequantize_band(spark: SparkSession, sf: str) -> DataFrame:
    step = C.step_size(F.lit(5), F.lit(512), 2)
    return _coefficients(spark, sf).select("image_id", "y", "x", C.dequantize(C.quantize(F.col("v"), step), step).alias("v"))


def no_quantize(spark: SparkSession, sf: str) -> DataFrame:
    return _coefficients(spark, sf).select("image_id", "y", "x", C.no_quantize(F.col("v"), 2).alias("v"))


def stepsizes(spark: SparkSession, sf: str) -> DataFrame:
    """The step sizes of an image with each part's levels, for both wavelets, with their 16-bit form and value."""
    params = samples.shapes(spark, sf).select(
        "image_id", (F.col("levels") + 1).alias("num_res"), (8 + F.col("image_id") % 5).alias("precision"),
        (F.col("image_id") % 2 == 0).alias("reversible"),
    )
    return C.step_sizes(params).select(
        "image_id", "band", "exponent", "mantissa", C.pack_step(F.col("exponent"), F.col("mantissa")).alias("packed"),
        F.round(C.step_size(F.col("exponent"), F.col("mantissa")), 6).alias("step"),
    )


def band_norms(spark: SparkSession, sf: str) -> DataFrame:
    bands = geometry.subbands(samples.shapes(spark, sf)).withColumn("o", F.array_position(F.array(*map(F.lit, ("LL", "HL", "LH", "HH"))), F.col("orient")) - 1)
    return bands.select(
        "image_id", "band", C.norm(C.NORMS_53, F.col("o"), F.col("level")).alias("norm_53"),
        C.norm(C.NORMS_97, F.col("o"), F.col("level")).alias("norm_97"),
    )


def lsb_compat(spark: SparkSession, sf: str) -> DataFrame:
    return _coefficients(spark, sf).select("image_id", "y", "x", C.lsb_compat(F.col("v")).alias("v"))


def compat_decode(spark: SparkSession, sf: str) -> DataFrame:
    """What coding and decoding with the lost last bit makes of the images, without the coder."""
    lines = samples.gray_lines(spark, sf).withColumn("v", F.transform("v", lambda v: v - 128))
    data = _transformed(lines, 2).withColumn("v", C.lsb_compat(F.col("v")))
    return _restored(data, 2, EIGHT).withColumn("v", F.col("v") + 128)


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    a, b = samples.gray(spark, sf).withColumnRenamed("v", "a"), compat_decode(spark, sf).withColumnRenamed("v", "b")
    return a.join(b, ["image_id", "y", "x"])


def psnr(spark: SparkSession, sf: str) -> DataFrame:
    return blocks.errors(_pairs(spark, sf)).select("image_id", "psnr", "n")


def max_abs_error(spark: SparkSession, sf: str) -> DataFrame:
    return blocks.errors(_pairs(spark, sf)).select("image_id", "max_error", "sse")


def region_crop(spark: SparkSession, sf: str) -> DataFrame:
    return blocks.crop(samples.wide(spark, sf), 10, 3, 43, 21).select("image_id", "y", "x", "v")


def zc_contexts(spark: SparkSession, sf: str) -> DataFrame:
    around = blocks.neighbours(samples.gray(spark, sf), (F.col("v") >= 140).cast("int"))
    return around.select("image_id", "y", "x", *[blocks.zero_coding_context(o).alias(f"zc_{o.lower()}") for o in ("LL", "HL", "HH")])


def sc_contexts(spark: SparkSession, sf: str) -> DataFrame:
    around = blocks.neighbours(samples.gray(spark, sf), F.when(F.col("v") >= 140, 1).when(F.col("v") < 116, -1).otherwise(0))
    ctx, flip = blocks.sign_context()
    return around.select("image_id", "y", "x", ctx.alias("ctx"), flip.alias("flip"))


def parameter_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Header fields from parameters: exponents of block sizes, band counts, order names, reduced tile origins."""
    s = samples.shapes(spark, sf)
    return s.select("image_id", C.log2_floor(F.col("w")).alias("log2_w"), C.bit_length(F.col("h")).alias("bits_h"), (1 + 3 * F.col("levels")).alias("n_bands"), C.progression(F.col("image_id") % 7).alias("progression"),
                    C.ceil_div(F.col("w"), F.col("tile_w")).alias("across"), geometry.halved(F.col("tile_h"), F.col("levels")).alias("reduced_origin"))


def detect_format(spark: SparkSession, sf: str) -> DataFrame:
    """Containers, codestreams, and files that have lost their first two bytes, by turns."""
    files = codestream.rewrapped(_files(spark, sf, levels=1, format="j2k"), F.lit(False), F.lit(False), F.col("image_id") % 3 == 0)
    cut = F.when(F.col("image_id") % 3 == 2, F.substring(F.col("content"), F.lit(3), F.octet_length("content"))).otherwise(F.col("content"))
    return files.select("image_id", codestream.detect_format(cut).alias("format"))


def cblk_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Coefficients of 4x4 blocks through the block coder and back."""
    p = codec.EncodeParams(levels=1, cblk_w=4, cblk_h=4, format="j2k")
    data = codec.coded_blocks(samples.gray(spark, sf), p).withColumn("orient", F.get(F.array(*map(F.lit, ("LL", "HL", "LH", "HH"))), F.col("band").cast("int")))
    back = entropy.decode_blocks(data, "image_id long, band long, cb_x long, cb_y long, cb_w int").select("*", F.posexplode("samples").alias("i", "v"))
    at = lambda hi, c, i: F.when(F.col("band").isin(*hi), 4).otherwise(0) + F.col(c) + i
    return back.select(
        "image_id", at((2, 3), "cb_y", F.floor(F.col("i") / F.col("cb_w"))).cast("long").alias("y"),
        at((1, 3), "cb_x", F.col("i") % F.col("cb_w")).cast("long").alias("x"), F.col("v").cast("long").alias("v"),
    )


def _files(spark: SparkSession, sf: str, **params) -> DataFrame:
    return codec.encode(samples.long_form(samples.rgb(spark, sf)), codec.EncodeParams(**params))


def _stored(files: DataFrame) -> DataFrame:
    """Files as a table in the shared folder, as one has them to decode; so a plan that reads them in several places does not encode them there."""
    folder = shared_folder(files.sparkSession, "files")
    sinks.write_table(files, folder)
    return files.sparkSession.read.schema(files.schema).parquet(folder)


def tile_payload(spark: SparkSession, sf: str) -> DataFrame:
    """The block tables of files of 5x5 tiles: places, bit planes and passes."""
    rows = codestream.scan_blocks(_files(spark, sf, levels=1, tile_w=5, tile_h=5, format="j2k"))
    longs = ("tile", "comp", "band", "cb_x", "cb_y", "cb_w", "cb_h", "numbps", "num_passes")
    return rows.where("error is null").groupBy("image_id", *[F.col(c).cast("long").alias(c) for c in longs]).agg(F.count("*").alias("n"))


def j2k_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Encode in 5x5 tiles and decode."""
    return samples.pixels(codec.decode(_stored(_files(spark, sf, levels=2, tile_w=5, tile_h=5, format="j2k")), levels=2))


def jp2_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    return samples.pixels(codec.decode(_stored(_files(spark, sf, levels=2)), levels=2))


def region_decode(spark: SparkSession, sf: str) -> DataFrame:
    """A rectangle of tiled files; tiles outside are not decoded."""
    return samples.pixels(codec.decode(_stored(_files(spark, sf, levels=1, tile_w=4, tile_h=4)), region=(2, 1, 4, 6), levels=1))


def reduced_decode(spark: SparkSession, sf: str) -> DataFrame:
    """Files of gray images at half size; the finest bands are not decoded."""
    files = _stored(codec.encode(samples.gray(spark, sf), codec.EncodeParams(levels=3)))
    return codec.decode(files, reduce=1, levels=3).select("image_id", "y", "x", "v")


def file_headers(spark: SparkSession, sf: str) -> DataFrame:
    found = codestream.scan_headers(_files(spark, sf, levels=2, tile_w=5, tile_h=5))
    h = "header"
    return found.select(
        "image_id",
        *[F.col(f"{h}.{c}").cast("long").alias(c) for c in ("width", "height", "tile_w", "tile_h", "n_comps", "layers", "levels", "cblk_w", "cblk_h", "quant_style")],
        F.col(f"{h}.mct").alias("mct"), F.col(f"{h}.reversible").alias("reversible"), F.size(f"{h}.steps").cast("long").alias("n_steps"),
    )


def file_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """The boxes of each container but the codestream's length, which depends on the image."""
    return codestream.scan_boxes(_files(spark, sf, levels=1)).select(
        "image_id", "type", "offset", F.when(F.col("type") != "jp2c", F.col("length")).alias("length"), "parent",
    )


def t2_packets(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks through packets, one for each component and band, and back: passes and bit planes."""
    p = codec.EncodeParams(levels=1, cblk_w=4, cblk_h=4)
    keys = ["image_id", "comp", "band"]
    packed = packets.packets(codec.coded_blocks(samples.long_form(samples.rgb(spark, sf)), p), keys)
    return packets.contributions(packed, keys).select("image_id", F.col("comp").cast("long").alias("comp"), "band", "k", "planes", "num_passes")


def stepsizes_unpacked(spark: SparkSession, sf: str) -> DataFrame:
    """Exponents and mantissas from the 16-bit form of the step sizes."""
    exponent, mantissa = C.unpack_step(F.col("packed"))
    return stepsizes(spark, sf).select("image_id", "band", exponent.alias("exponent"), mantissa.alias("mantissa"))


def colour_norms(spark: SparkSession, sf: str) -> DataFrame:
    """The norms of both colour transforms for up to four components of each part's image."""
    each = samples.shapes(spark, sf).select("image_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("image_id") % 4)).alias("comp"))
    return each.select("image_id", "comp", C.colour_norm(F.col("comp"), F.col("image_id") % 2 == 0).alias("norm"))


def tagtree_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Levels and nodes of a tag tree over each part's code-blocks."""
    s = samples.shapes(spark, sf).select("image_id", C.ceil_div(F.col("w"), F.col("cblk_w")).alias("w"), C.ceil_div(F.col("h"), F.col("cblk_h")).alias("h"))
    return blocks.tag_tree_sizes(s).select("image_id", "w", "h", "n_levels", "n_nodes")


def file_colours(spark: SparkSession, sf: str) -> DataFrame:
    """Image header and colour boxes of the containers."""
    found = codestream.scan_colours(_files(spark, sf, levels=1)).where("error is null")
    return found.select("image_id", "height", "width", *[F.col(c).cast("long").alias(c) for c in ("n_comps", "bpc", "method", "enum_cs")])


def file_capabilities(spark: SparkSession, sf: str) -> DataFrame:
    """Which files ask for high-throughput blocks; every other one is marked so in its coding style."""
    files = _files(spark, sf, levels=1, format="j2k")
    marked = F.concat(F.substring("content", 1, 63), F.unhex(F.lit("40")), F.substring(F.col("content"), F.lit(65), F.octet_length("content")))
    files = files.withColumn("content", F.when(F.col("image_id") % 2 == 1, marked).otherwise(F.col("content")))
    return codestream.scan_headers(files).select("image_id", F.col("header.high_throughput").alias("high_throughput"))


def file_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Every third file is cut off in its last tile: the kinds of errors that decoding meets."""
    files = _files(spark, sf, levels=1, tile_w=5, tile_h=5, format="j2k")
    cut = F.substring(F.col("content"), F.lit(1), F.octet_length("content") - 40)
    files = files.withColumn("content", F.when(F.col("image_id") % 3 == 1, cut).otherwise(F.col("content")))
    return codec.decode_errors(files).select("image_id", F.split("error", ":")[0].alias("kind"))


def region_errors(spark: SparkSession, sf: str) -> DataFrame:
    """A region that leaves the images."""
    return codec.decode_errors(_files(spark, sf, levels=1, tile_w=5, tile_h=5), region=(4, 4, 20, 20)).select("image_id", F.split("error", ":")[0].alias("kind"))


def region_subsampled(spark: SparkSession, sf: str) -> DataFrame:
    """A rectangle of images whose second and third component have every second row and column."""
    step = F.when(F.col("comp") == 0, 1).otherwise(2)
    return blocks.crop(_subsampled(spark, sf), 3, 1, 6, 7, step, step).select("image_id", F.col("comp").cast("long").alias("comp"), "y", "x", "v")


def mixed_decode(spark: SparkSession, sf: str) -> DataFrame:
    """One table of files of 0 to 5 levels, every other one lossy, through one plan: how far each image is from what it was."""
    levels, lossless = (F.col("image_id") % 6).cast("int"), F.expr("(image_id div 6) % 2 = 0")
    data = samples.gray(spark, sf)
    files = _stored(codec.encode(data.withColumns({"levels": levels, "lossless": lossless}), codec.EncodeParams(levels=5, format="j2k")))
    back = codec.decode(files, levels=5).withColumnRenamed("v", "b")
    found = blocks.errors(data.withColumnRenamed("v", "a").join(back, ["image_id", "comp", "y", "x"]))
    return found.select(
        "image_id", levels.cast("long").alias("levels"), lossless.alias("lossless"), "n", F.when(lossless, F.col("max_error")).alias("max_error"),
        (F.col("max_error") <= 2).alias("near"),
    )


def _packed(spark: SparkSession, sf: str, **params) -> DataFrame:
    """The tile index of files that lie in packs in the shared folder."""
    return ranges.index_tiles(sinks.write_packs(_files(spark, sf, **params), shared_folder(spark, "packs")))


def tile_index(spark: SparkSession, sf: str) -> DataFrame:
    """The tiles of packed containers; none lies in another, and none has more bytes than its file."""
    found = _packed(spark, sf, levels=1, tile_w=3, tile_h=5)
    return found.groupBy("image_id", F.col("tile").cast("long").alias("tile")).agg(
        F.count("*").alias("n"), F.min(F.col("length") > 0).alias("full"), F.min("header.tile_w").cast("long").alias("tile_w"),
    )


def region_ranged(spark: SparkSession, sf: str) -> DataFrame:
    """A rectangle of packed files of which only the bytes of its tiles are read."""
    region = (2, 1, 4, 6)
    hit = ranges.in_region(_packed(spark, sf, levels=1, tile_w=4, tile_h=4), region)
    return samples.pixels(codec.decode_scanned(ranges.scan_ranges(hit), 1, region=region))


def region_bytes(spark: SparkSession, sf: str) -> DataFrame:
    """How many tiles a region of the right half reads, and whether their bytes are what is left of all tiles' without the others."""
    index = _packed(spark, sf, levels=1, tile_w=4, tile_h=4)
    whole = index.groupBy("image_id").agg(F.count("*").alias("tiles"), F.sum("length").alias("bytes"))
    hit = ranges.in_region(index, (4, 0, 8, 8)).groupBy("image_id").agg(F.count("*").alias("hits"), F.sum("length").alias("part"))
    return whole.join(hit, "image_id").select("image_id", "tiles", "hits", (F.col("part") < F.col("bytes")).alias("fewer"))


def _plane_passes(spark: SparkSession, sf: str) -> DataFrame:
    """For each band of each gray image and each of its bit planes, from the top, what it costs and gains: a bit for each significant sample, and what of the squared error it takes."""
    data = _coefficients(spark, sf)
    band = F.when(F.col("x") >= 4, 1).otherwise(0) + F.when(F.col("y") >= 4, 2).otherwise(0)
    m = F.abs("v")
    each = data.select("image_id", band.cast("long").alias("band"), m.alias("m"), F.explode(F.sequence(F.lit(0), F.lit(12))).alias("bit"))
    low = lambda n: F.col("m") - F.call_function("shiftleft", F.call_function("shiftright", F.col("m"), n), n)
    gain = low(F.col("bit") + 1) * low(F.col("bit") + 1) - low(F.col("bit")) * low(F.col("bit"))
    cost = F.when(F.call_function("shiftright", F.col("m"), F.col("bit")) > 0, 1).otherwise(0)
    return each.groupBy("image_id", "band", (13 - F.col("bit")).cast("long").alias("k")).agg(F.sum(cost).alias("cost"), F.sum(gain).alias("gain"))


def rate_choice(spark: SparkSession, sf: str) -> DataFrame:
    """The bit planes that each band keeps if an image has 200 bits."""
    return rates.choose(_plane_passes(spark, sf), ["image_id"], ["band"], F.lit(200)).select("image_id", "band", "kept")


def rate_limited(spark: SparkSession, sf: str) -> DataFrame:
    """Gray images in payloads of at most 140, 160 and 200 bytes: all are within, all decode, and more bytes never leave more error over all images of a group of sixteen."""
    limits = (140, 160, 200)
    made = codec.encode_within(samples.gray(spark, sf), limits, codec.EncodeParams(levels=1, format="j2k"))
    own = lambda k: (F.col("image_id") * 3 + k).alias("image_id")  # noqa: E731  each limit's file is an image of its own, in one plan
    files = _stored(made.select(own(F.array_position(F.array(*map(F.lit, limits)), F.col("max_bytes")) - 1), "content"))
    sizes = codestream.scan_markers(files).where("marker = 'SOD'").select("image_id", "length")
    data = samples.gray(spark, sf).withColumn("k", F.explode(F.array(*map(F.lit, range(3))))).select(own(F.col("k")), "comp", "y", "x", F.col("v").alias("a"))
    back = blocks.errors(data.join(codec.decode(files, levels=1).withColumnRenamed("v", "b"), ["image_id", "comp", "y", "x"]))
    at = F.col("image_id") % 3
    most = F.get(F.array(*map(F.lit, limits)), at.cast("int"))
    sums = [F.sum(F.when(at == k, F.col("sse"))) for k in range(3)]
    return back.join(sizes, "image_id").groupBy(F.expr("image_id div 48").alias("part")).agg(
        F.min(F.col("length") <= most).alias("within"), F.sum("n").alias("n"), ((sums[0] >= sums[1]) & (sums[1] >= sums[2]) & (sums[0] > sums[2])).alias("falls"),
    )


def refinement_contexts(spark: SparkSession, sf: str) -> DataFrame:
    """The context of each refinement of the coefficients of 4x4 blocks, one for each band."""
    band = F.when(F.col("x") >= 4, 1).otherwise(0) + F.when(F.col("y") >= 4, 2).otherwise(0)
    data = _coefficients(spark, sf).select(
        "image_id", band.cast("long").alias("band"), (F.col("y") % 4).alias("y"), (F.col("x") % 4).alias("x"), F.shiftright("v", 4).alias("v"),
    )
    return blocks.refinement_contexts(data, ("image_id", "band"))


def tagtree_grids(spark: SparkSession, sf: str) -> DataFrame:
    """Tag trees over the code-blocks of each part's image, each of its own depth."""
    s = samples.shapes(spark, sf).select("image_id", C.ceil_div(F.col("w"), F.col("cblk_w")).alias("w"), C.ceil_div(F.col("h"), F.col("cblk_h")).alias("h"))
    sized = blocks.tag_tree_sizes(s)
    cells = sized.withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), F.col("h") - 1))).withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("w") - 1)))
    leaves = cells.withColumn("value", (F.col("image_id") * 31 + F.col("y") * 17 + F.col("x") * 7) % 23)
    return blocks.tag_tree(leaves, F.col("n_levels") - 1)


def _subsampled(spark: SparkSession, sf: str) -> DataFrame:
    """Samples of images whose second and third component have every second row and column."""
    step = F.when(F.col("comp") == 0, 1).otherwise(2)
    planes = samples.long_form(samples.rgb(spark, sf)).where((F.col("x") % step == 0) & (F.col("y") % step == 0))
    return planes.withColumns({"x": F.floor(F.col("x") / step), "y": F.floor(F.col("y") / step)})


def _chroma(spark: SparkSession, sf: str) -> DataFrame:
    p = codec.EncodeParams(levels=1, tile_w=5, tile_h=3, dx=(1, 2, 2), dy=(1, 2, 2))
    return _stored(codec.encode(_subsampled(spark, sf), p))


def subsampled_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Files with 2x2 chroma in tiles of odd sizes."""
    return codec.decode(_chroma(spark, sf), levels=1).select("image_id", F.col("comp").cast("long").alias("comp"), "y", "x", "v")


def region_subsampled_decode(spark: SparkSession, sf: str) -> DataFrame:
    """A rectangle of files with 2x2 chroma."""
    return codec.decode(_chroma(spark, sf), region=(3, 1, 6, 7), levels=1).select("image_id", F.col("comp").cast("long").alias("comp"), "y", "x", "v")


def file_markers(spark: SparkSession, sf: str) -> DataFrame:
    """All markers but the tiles' of containers: every other one has a capability segment, every third one a box with a 16-byte header."""
    files = codestream.rewrapped(_files(spark, sf, levels=2), F.col("image_id") % 2 == 1, F.col("image_id") % 3 == 1)
    found = codestream.scan_markers(files).where("marker not in ('SOD', 'EOC')")
    return found.select("image_id", F.col("box_header").cast("long").alias("box_header"), "marker", "offset", "length")


QUERIES = [
    stepsizes_unpacked, colour_norms, tagtree_sizes, file_colours, file_capabilities, file_errors, region_errors, region_subsampled,
    subband_stats, dc_shift, rct_forward, rct_inverse, ict_forward, ict_roundtrip, dwt53_1d, dwt53_1d_inverse, dwt53_2d, dwt53_multilevel, dwt53_multilevel_inverse, dwt97_1d, dwt97_roundtrip,
    resolution_decode, block_numbps, tile_grid, resolution_sizes, subband_layout, band_dimensions, codeblock_grid, codeblock_count, packet_counts, tagtree_min, tagtree_roundtrip, quantize_band,
    dequantize_band, no_quantize, stepsizes, band_norms, lsb_compat, compat_decode, psnr, max_abs_error, region_crop, zc_contexts, sc_contexts, parameter_columns, detect_format, cblk_roundtrip,
    mixed_decode, tile_index, region_ranged, region_bytes, rate_choice, rate_limited, refinement_contexts, tagtree_grids, subsampled_roundtrip, region_subsampled_decode, file_markers,
    tile_payload, j2k_roundtrip, jp2_roundtrip, region_decode, reduced_decode, file_headers, file_boxes, t2_packets,
]
ALL = {f.__name__: f for f in QUERIES} | {f"packets_{o}": packets_in(o) for o in geometry.ORDERS}
