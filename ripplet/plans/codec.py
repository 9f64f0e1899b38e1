"""Whole images to files and back, as one plan of array lines, groupings and block coding."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplet.functions.columns import ceil_div, ict_forward, ict_inverse, rct_forward, rct_inverse
from ripplet.operators.blocks import crop, in_code_blocks, spread
from ripplet.operators.entropy import decode_blocks, encode_blocks
from ripplet.operators.geometry import halved
from ripplet.operators.rates import allocate
from ripplet.operators.wavelets import compose, decompose
from ripplet.sources import codestream
from ripplet.sources.codestream import scan_blocks, scan_headers
from ripplet.sources.shared import shared_folder

#: A component of a tile; tiles go by row and column until the image's width is known.
PLANE = ["image_id", "ty", "tx", "comp", "levels", "lossless"]


@dataclass(frozen=True)
class EncodeParams:
    """How to encode: tiles of 0 are the whole image; ``format`` is jp2 or j2k.

    Samples may have columns ``levels`` (at most ``levels``) and ``lossless``, alike for all samples of
    an image, which then say these for their image. ``dx`` and ``dy`` are the steps of each component on
    the image's grid (empty: 1): component k has every ``dx[k]``-th column and ``dy[k]``-th row. The colour
    transform is for images of three components or more with steps of 1. ``max_bytes`` bounds a tile's
    payload: whole passes are left out, those of least worth.
    """

    lossless: bool = True
    levels: int = 5
    cblk_w: int = 64
    cblk_h: int = 64
    format: str = "jp2"
    tile_w: int = 0
    tile_h: int = 0
    precision: int = 8
    signed: bool = False
    max_bytes: int | None = None
    dx: tuple[int, ...] = ()
    dy: tuple[int, ...] = ()

    @property
    def subsampled(self) -> bool:
        return any(d != 1 for d in (*self.dx, *self.dy))


def _own(samples: DataFrame, p: EncodeParams) -> tuple[Column, Column]:
    """The levels of a sample's image, and whether it is lossless."""
    levels = F.least(F.col("levels").cast("int"), F.lit(p.levels)) if "levels" in samples.columns else F.lit(p.levels)
    return levels.alias("levels"), (F.col("lossless") if "lossless" in samples.columns else F.lit(p.lossless)).alias("lossless")


def _of(steps: tuple[int, ...], comp: Column) -> Column:
    """The step of a component."""
    return F.coalesce(F.get(F.array(*map(F.lit, steps)), comp.cast("int")), F.lit(1)) if steps else F.lit(1)


def lines(samples: DataFrame, p: EncodeParams) -> DataFrame:
    """``(*PLANE, y, v)``: shifted and colour-transformed rows of each tile, from the tile's own origin."""
    dx, dy = _of(p.dx, F.col("comp")), _of(p.dy, F.col("comp"))
    tw, th = p.tile_w or 1 << 30, p.tile_h or 1 << 30
    tx, ty = F.floor(F.col("x") * dx / tw).cast("int"), F.floor(F.col("y") * dy / th).cast("int")
    shift = 0 if p.signed else 1 << (p.precision - 1)
    levels, lossless = _own(samples, p)
    placed = samples.select(
        "image_id", ty.alias("ty"), tx.alias("tx"), (F.col("y") - ceil_div(ty * th, dy)).alias("y"), levels, lossless,
        F.struct("comp", (F.col("x") - ceil_div(tx * tw, dx)).alias("x"), (F.col("v") - shift).alias("v")).alias("s"))
    rows = placed.groupBy("image_id", "ty", "tx", "levels", "lossless", "y").agg(F.sort_array(F.collect_list("s")).alias("s"))
    comps = F.array_distinct(F.transform("s", lambda s: s["comp"]))
    each = F.transform(comps, lambda c: F.struct(c.cast("int").alias("comp"), F.transform(F.filter("s", lambda s: s["comp"] == c), lambda s: s["v"]).alias("v")))
    parts = rows.withColumn("parts", each).drop("s")
    if not p.subsampled:
        parts = parts.withColumn("parts", F.when(F.size("parts") >= 3, coloured("parts", "lossless")).otherwise(F.col("parts")))
    whole = parts.select("*", F.explode("parts").alias("p")).select(*[c for c in PLANE if c != "comp"], F.col("p.comp").alias("comp"), "y", F.col("p.v").alias("v"))
    return whole.select(*PLANE, "y", "v") if _always(samples, p) else whole.select(*PLANE, "y", F.col("v").cast("array<double>").alias("v"))


def _always(samples: DataFrame, p: EncodeParams) -> bool:
    """Whether all images are lossless, so that samples stay integers."""
    return p.lossless and "lossless" not in samples.columns


def coloured(parts: str, reversible: str, inverse: bool = False) -> Column:
    """A row's components ``array<struct<comp, v array>>``, the first three colour-transformed, by the reversible or the irreversible transform."""
    pixel = F.arrays_zip(*[F.get(parts, F.lit(k)).getField("v").alias(f"c{k}") for k in range(3)])
    whole, real = (rct_inverse, ict_inverse) if inverse else (rct_forward, ict_forward)
    of = lambda change, kind, k: lambda t: change(*[t[f"c{j}"].cast(kind) for j in range(3)])[k].cast("double")
    made = []
    for k in range(3):
        v = F.when(F.col(reversible), F.transform(pixel, of(whole, "long", k))).otherwise(F.transform(pixel, of(real, "float", k)))
        made.append(F.struct(F.lit(k).alias("comp"), v.alias("v")))
    rest = F.transform(F.slice(
        parts, F.lit(4), F.greatest(F.size(parts) - 3, F.lit(0)),
    ), lambda p: F.struct(p["comp"].alias("comp"), p["v"].cast("array<double>").alias("v")))
    kind = "array<struct<comp:int,v:array<double>>>"
    return F.concat(F.array(*made).cast(kind), rest.cast(kind))


def coefficients(samples: DataFrame, p: EncodeParams) -> DataFrame:
    """The pieces of all bands of all tiles, with the columns ``PLANE`` in front; whole numbers."""
    own = lines(samples, p)
    if "lossless" in samples.columns:
        wavelet = "lossless"
    else:
        wavelet = "53" if p.lossless else "97"
        own = own.withColumn("v", F.col("v").cast("array<bigint>" if p.lossless else "array<double>"))
    pieces = decompose(own, PLANE, p.levels, wavelet, "levels" if "levels" in samples.columns else None)
    return pieces if wavelet == "53" else pieces.withColumn("v", F.transform("v", lambda v: F.round(v).cast("long")))


def coded_blocks(samples: DataFrame, p: EncodeParams) -> DataFrame:
    """Every code-block with its data, and for each of its passes what it costs and is worth if ``max_bytes`` asks for it; blocks are spread over the cluster by their place."""
    blocks = in_code_blocks(coefficients(samples, p), PLANE, p.cblk_w, p.cblk_h)
    keep = "image_id long, ty int, tx int, comp int, levels int, lossless boolean, band long, level int, orient string, cb_x long, cb_y long, cb_w int, cb_h int"
    return encode_blocks(blocks, keep, p.max_bytes is not None)


def payloads(blocks: DataFrame, limited: bool = False) -> DataFrame:
    """``(image_id, ty, tx, levels, lossless, payload)``: a tile's blocks by component, band and place; a tile is the largest unit that a task holds.

    Where they are ``limited``, a payload has no more bytes than the blocks' column ``max_bytes``, which is then
    a column of the payloads and may differ within an image: its blocks keep the passes that ``rates.allocate`` chooses.
    """
    names, kind = ["image_id", "ty", "tx", "levels", "lossless"], "image_id long, ty int, tx int, levels int, lossless boolean"
    if limited:
        blocks, names, kind = allocate(blocks), [*names, "max_bytes"], f"{kind}, max_bytes int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for bs in batch.column("blocks").to_pylist():
                rows = [(b["comp"], b["band"], b["cb_x"], b["cb_y"], b["cb_w"], b["cb_h"], b["numbps"], b["num_passes"], b["data"]) for b in bs]
                made.append(codestream.write_payload(rows))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(made, pa.binary())], [*names, "payload"])

    order = F.struct("comp", "band", "cb_y", "cb_x", "cb_w", "cb_h", "numbps", "num_passes", "data")
    tiles = blocks.groupBy(*names).agg(F.sort_array(F.collect_list(order)).alias("blocks"))
    return tiles.mapInArrow(run, f"{kind}, payload binary")


def encode(samples: DataFrame, params: EncodeParams | None = None) -> DataFrame:
    """``(image_id, content)``: a file for each image of ``samples(image_id, comp, y, x, v)``; an image's coded bytes meet in one row."""
    p = params or EncodeParams()
    if p.max_bytes is not None:
        return encode_within(samples, (p.max_bytes,), p).drop("max_bytes")
    return _files(payloads(coded_blocks(samples, p)), samples, p)


def encode_within(samples: DataFrame, limits: tuple[int, ...], params: EncodeParams | None = None) -> DataFrame:
    """``(image_id, max_bytes, content)``: a file for each image and each of the ``limits`` of its tiles' payloads.

    The blocks are coded once, into a table in the shared folder: each limit's choice of passes reads
    the passes, and what it leaves reads the data.
    """
    p, folder = replace(params or EncodeParams(), max_bytes=max(limits)), shared_folder(samples.sparkSession, "blocks")
    made = coded_blocks(samples, p)
    made.write.parquet(folder)
    blocks = samples.sparkSession.read.schema(made.schema).parquet(folder)
    each = blocks.withColumn("max_bytes", F.explode(F.array(*map(F.lit, dict.fromkeys(limits)))))
    return _files(payloads(each, limited=True), samples, p, ["max_bytes"])


def _files(tiles: DataFrame, samples: DataFrame, p: EncodeParams, more: list[str] | None = None) -> DataFrame:
    """``(image_id, *more, content)``: the files of the payloads ``tiles`` of ``samples``; ``more`` are columns of ints that tell an image's files apart."""
    more = more or []
    dx, dy = _of(p.dx, F.col("comp")), _of(p.dy, F.col("comp"))
    size = samples.groupBy("image_id").agg(
        (F.max(F.col("x") * dx) + 1).cast("int").alias("w"), (F.max(F.col("y") * dy) + 1).cast("int").alias("h"), (F.max("comp") + 1).cast("int").alias("n"))
    tiles = tiles.groupBy("image_id", "levels", "lossless", *more).agg(F.sort_array(F.collect_list(F.struct("ty", "tx", "payload"))).alias("tiles"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = []
            for w, h, n, levels, lossless, parts in zip(*(batch.column(c).to_pylist() for c in ("w", "h", "n", "levels", "lossless", "tiles")), strict=True):
                header = {
                    "width": w, "height": h, "tile_w": p.tile_w or w, "tile_h": p.tile_h or h, "n_comps": n, "precisions": [p.precision] * n, "signed": [p.signed] * n,
                    "dx": [*p.dx, *[1] * n][:n], "dy": [*p.dy, *[1] * n][:n], "mct": n >= 3 and not p.subsampled, "levels": levels, "cblk_w": p.cblk_w, "cblk_h": p.cblk_h, "reversible": lossless,
                }
                across = -(-w // header["tile_w"])
                data = codestream.write_main_header(header) + b"".join(codestream.write_tile(t["ty"] * across + t["tx"], t["payload"]) for t in parts) + b"\xff\xd9"
                files.append(codestream.wrap(data, header) if p.format == "jp2" else data)
            yield pa.RecordBatch.from_arrays([batch.column("image_id"), *(batch.column(c) for c in more), pa.array(files, pa.binary())], ["image_id", *more, "content"])

    return tiles.join(size, "image_id").mapInArrow(run, ", ".join(["image_id long", *(f"{c} int" for c in more), "content binary"]))


def decode(files: DataFrame, reduce: int = 0, region: tuple[int, int, int, int] | None = None, exact: bool = True, levels: int | None = None) -> DataFrame:
    """``samples(image_id, comp, y, x, v)`` of ``files(image_id, content)``; broken files give none (``decode_errors`` tells why).

    ``reduce`` drops so many of the finest levels, at most all; ``region`` = (x0, y0, x1, y1), at
    full resolution only, gives that rectangle, or an error if it leaves the image. Both leave out
    blocks and tiles before decoding. Files of all levels and both wavelets go through one plan.
    ``levels`` is the most that a file has, and a file with more is an error; without it one number is
    read from the headers first.
    """
    if levels is None:
        levels = scan_headers(files).agg(F.max("header.levels")).first()[0] or 0
    _check(region, reduce)
    return decode_scanned(scan_blocks(files, reduce=reduce, region=region), levels, reduce, region, exact)


def _check(region: tuple[int, int, int, int] | None, reduce: int) -> None:
    if region and (reduce or not (0 <= region[0] < region[2] and 0 <= region[1] < region[3])):
        raise ValueError("an empty region, or one of a reduced image")


def decode_errors(files: DataFrame, region: tuple[int, int, int, int] | None = None) -> DataFrame:
    """``(image_id, error)`` for each file of which ``decode`` gives nothing: a broken header or payload, or a region that leaves the image."""
    return scan_blocks(files, region=region).where("error is not null").select("image_id", "error")


#: What a plane's samples need of their file and tile.
ABOUT = "tw long, th long, ox long, oy long, levels int, reversible boolean, mct boolean, shift long, dx int, dy int"
ABOUT_NAMES = [c.split()[0] for c in ABOUT.split(", ")]


def decode_scanned(scanned: DataFrame, levels: int, reduce: int = 0, region: tuple[int, int, int, int] | None = None, exact: bool = True) -> DataFrame:
    """The samples of the blocks that ``scan_blocks`` or ``scan_ranges`` found, with at most ``levels`` levels.

    Blocks are shuffled once; each level's pass decodes its own.
    """
    h = "header"
    own, k = F.col(f"{h}.levels"), F.col("band") - 1
    many = F.raise_error(F.concat(F.lit(f"a file of more than {levels} levels: "), F.col("image_id").cast("string")))
    own = F.when(own > levels, many.cast("int")).otherwise(own)
    across = ceil_div(F.col(f"{h}.width"), F.col(f"{h}.tile_w"))
    x0, y0 = (F.col("tile") % across) * F.col(f"{h}.tile_w"), F.floor(F.col("tile") / across) * F.col(f"{h}.tile_h")
    blocks = scanned.where("error is null").withColumns({"levels": own, "x0": x0, "y0": y0})
    blocks = blocks.withColumns({
        "level": F.when(k < 0, F.col("levels")).otherwise(F.col("levels") - F.floor(k / 3)).cast("int"),
        "x1": F.least(F.col("x0") + F.col(f"{h}.tile_w"), F.col(f"{h}.width")), "y1": F.least(F.col("y0") + F.col(f"{h}.tile_h"), F.col(f"{h}.height")),
        "dx": F.get(f"{h}.dx", F.col("comp")), "dy": F.get(f"{h}.dy", F.col("comp")),
    })
    ox, oy = ceil_div(F.col("x0"), F.col("dx")), ceil_div(F.col("y0"), F.col("dy"))
    orient = F.when(k < 0, "LL").otherwise(F.get(F.array(*map(F.lit, ("HL", "LH", "HH"))), (k % 3).cast("int")))
    shift = F.when(F.get(f"{h}.signed", F.col("comp")), 0).otherwise(F.call_function("shiftleft", F.lit(1), F.get(f"{h}.precisions", F.col("comp")) - 1))
    blocks = blocks.select(
        "image_id", F.col("tile").cast("long").alias("tile"), "comp", orient.alias("orient"), F.when(F.col("level") > reduce, F.col("level")).otherwise(0).alias("level"),
        F.col("cb_x").cast("long").alias("cb_x"), F.col("cb_y").cast("long").alias("cb_y"), "cb_w", "cb_h", "data", "numbps", "num_passes",
        (ceil_div(F.col("x1"), F.col("dx")) - ox).alias("tw"), (ceil_div(F.col("y1"), F.col("dy")) - oy).alias("th"),
        halved(ox, F.least(F.col("levels"), F.lit(reduce))).alias("ox"), halved(oy, F.least(F.col("levels"), F.lit(reduce))).alias("oy"),
        "levels", F.col(f"{h}.reversible").alias("reversible"), F.col(f"{h}.mct").alias("mct"), shift.cast("long").alias("shift"), F.col("dx").cast("int").alias("dx"), F.col("dy").cast("int").alias("dy"))
    blocks = spread(blocks, "image_id", "tile", "comp", "cb_x", "cb_y", "orient")
    keep = "image_id long, tile long, comp int, orient string, cb_x long, cb_y long, cb_w int, cb_h int, " + ABOUT
    plane = ["image_id", "tile", "comp", *ABOUT_NAMES]
    rows_of = lambda n, each: F.transform(F.sequence(F.lit(0), F.col(n) - 1), each)

    def pieces(level: int) -> DataFrame:
        held = decode_blocks(blocks, keep, exact, level)
        columns = rows_of("cb_w", lambda c: rows_of("cb_h", lambda r: F.get("samples", r * F.col("cb_w") + c).cast("double")))
        each = held.select(*plane, "orient", "cb_x", "cb_y", F.posexplode(columns).alias("i", "v"))
        return each.select(*plane, "orient", (F.col("cb_x") + F.col("i")).alias("x"), F.col("cb_y").alias("y"), "v")

    low = decode_blocks(blocks, keep, exact, 0)  # of planes without a level that is undone
    cut = rows_of("cb_h", lambda r: F.slice("samples", r * F.col("cb_w") + 1, F.col("cb_w")).cast("array<double>"))
    low = low.select(*plane, "cb_x", "cb_y", F.posexplode(cut).alias("i", "v"))
    done = low.select(*plane, (F.col("cb_y") + F.col("i")).alias("y"), F.col("cb_x").alias("x"), "v")
    if levels > reduce:
        rows = compose(pieces, plane, levels, "reversible", reduce)
        done = done.unionByName(rows.select(*plane, "y", F.lit(0).cast("long").alias("x"), "v"))
    return _shown(done, region)


def _shown(rows: DataFrame, region: tuple[int, int, int, int] | None) -> DataFrame:
    """Samples from the decoded rows of planes, or parts of rows: back to colours, shifted, at their places in the image."""
    part = F.struct("comp", "x", "v", F.struct(*ABOUT_NAMES).alias("about"))
    met = rows.groupBy("image_id", "tile", "y").agg(F.sort_array(F.collect_list(part)).alias("s"))
    comps = F.array_distinct(F.transform("s", lambda s: s["comp"]))

    def whole(c: Column) -> Column:
        own = F.filter("s", lambda s: s["comp"] == c)
        return F.struct(c.alias("comp"), F.flatten(F.transform(own, lambda s: s["v"])).alias("v"), F.get(own, F.lit(0)).getField("about").alias("about"))

    met = met.select("image_id", "tile", "y", F.transform(comps, whole).alias("parts"))
    first = F.get("parts", F.lit(0)).getField("about")
    met = met.withColumns({"reversible": first.getField("reversible"), "plain": F.transform("parts", lambda p: F.struct(p["comp"].alias("comp"), p["v"].alias("v")))})
    colours = F.when(first.getField("mct") & (F.size("parts") >= 3), coloured("plain", "reversible", inverse=True)).otherwise(F.col("plain"))
    each = met.select("image_id", "y", "reversible", F.explode(F.arrays_zip(colours.alias("c"), F.col("parts").alias("p"))).alias("z"))
    each = each.select("image_id", "y", F.col("z.p.comp").alias("comp"), F.col("z.p.about").alias("about"), "reversible", F.posexplode("z.c.v").alias("i", "v"))
    v = F.when(F.col("reversible"), F.col("v")).otherwise(F.round(F.col("v").cast("float").cast("double"))).cast("long") + F.col("about.shift")
    out = each.select("image_id", "comp", (F.col("y") + F.col("about.oy")).alias("y"), (F.col("i") + F.col("about.ox")).alias("x"), v.alias("v"), "about")
    if region:
        out = crop(out, *region, dx=F.col("about.dx"), dy=F.col("about.dy"))
    return out.drop("about")
