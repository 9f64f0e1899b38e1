"""Codestreams and containers: small readers and writers of headers, and scans of files as tables.

Headers are big-endian. A tile's payload is this format's own little-endian block table: a count,
24 bytes for each block, then all blocks' data in that order.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplet.functions.errors import CodecError, InvalidData, OutOfBounds, Unsupported
from ripplet.functions.schemas import to_arrow

# Marker codes, box types, the container's signature and brand, colour spaces.
SOC, SIZ, COD, QCD, SOT, SOD, EOC, CAP = 0xFF4F, 0xFF51, 0xFF52, 0xFF5C, 0xFF90, 0xFF93, 0xFFD9, 0xFF50
SIGNATURE, BRAND = bytes.fromhex("0D0A870A"), b"jp2 "
SRGB, GRAY = 16, 17

HEADER = ("width int, height int, tile_w int, tile_h int, n_comps int, precisions array<int>, signed array<boolean>, dx array<int>, dy array<int>, progression int, layers int, "
          "mct boolean, levels int, cblk_w int, cblk_h int, cblk_style int, reversible boolean, quant_style int, steps array<int>, high_throughput boolean")  # fmt: skip
BOX = "type string, offset long, length long, header_size int, parent string"


def take(fmt: str, data: bytes, at: int) -> tuple:
    """Unpack ``fmt`` at a place, or ``OutOfBounds``."""
    if at < 0 or at + struct.calcsize(fmt) > len(data):
        raise OutOfBounds(f"{struct.calcsize(fmt)} bytes at {at} of {len(data)}")
    return struct.unpack_from(fmt, data, at)


def detect_format(content: Column) -> Column:
    """``jp2``, ``j2k`` or null, from the first bytes."""
    jp2 = (F.octet_length(content) >= 12) & (F.substring(content, 5, 4) == F.lit(b"jP  "))
    return F.when(jp2, "jp2").when(F.substring(content, 1, 2) == F.lit(struct.pack(">H", SOC)), "j2k")


def box_header(data: bytes, left: int) -> tuple[str, int, int]:
    """``(type, header size, whole size)`` of the box at the start of ``data``, of which ``left`` bytes are left in the file."""
    size, kind = take(">I4s", data, 0)
    head = 8
    if size == 1:
        (size,), head = take(">Q", data, 8), 16
    elif size == 0:
        size = left
    if size < head or size > left:
        raise InvalidData(f"a box of {size} bytes where {left} are left")
    return kind.decode("latin-1"), head, size


def boxes(data: bytes, at: int = 0, end: int | None = None, parent: str = "") -> Iterator[tuple[str, int, int, int, str]]:
    """``(type, offset of the payload, its length, header size, parent)`` of every box; the header box is entered."""
    end = len(data) if end is None else end
    while at < end:
        name, head, size = box_header(data[at : at + 16], end - at)
        yield name, at + head, size - head, head, parent
        if name == "jp2h":
            yield from boxes(data, at + head, at + size, name)
        at += size


def box(kind: str, payload: bytes, wide: bool = False) -> bytes:
    n = len(payload) + (16 if wide else 8)
    return (struct.pack(">I4sQ", 1, kind.encode(), n) if wide else struct.pack(">I4s", n, kind.encode())) + payload


def image_header(payload: bytes) -> dict:
    height, width, n, bits, compression, unknown, ipr = take(">IIHBBBB", payload, 0)
    if compression != 7:
        raise InvalidData(f"compression {compression}")
    return {"height": height, "width": width, "n_comps": n, "bpc": bits, "unknown_colours": unknown, "ipr": ipr}


def colour(payload: bytes) -> dict:
    method, precedence, approx = take(">BBB", payload, 0)
    if method == 1:
        return {"method": 1, "enum_cs": take(">I", payload, 3)[0], "icc": None}
    if method == 2:
        return {"method": 2, "enum_cs": None, "icc": payload[3:]}
    raise Unsupported(f"colour method {method}")


def wrap(codestream: bytes, header: dict, icc: bytes | None = None, wide: bool = False) -> bytes:
    """A container with a codestream; ``wide`` gives its box a header of 16 bytes."""
    bits = header["precisions"][0] - 1 | 0x80 * header["signed"][0]
    ihdr = box("ihdr", struct.pack(">IIHBBBB", header["height"], header["width"], header["n_comps"], bits, 7, 0, 0))
    colr = box("colr", struct.pack(">BBB", 2, 0, 0) + icc if icc is not None else struct.pack(">BBBI", 1, 0, 0, SRGB if header["n_comps"] >= 3 else GRAY))
    return box("jP  ", SIGNATURE) + box("ftyp", BRAND + bytes(4) + BRAND) + box("jp2h", ihdr + colr) + box("jp2c", codestream, wide)


def unwrap(data: bytes) -> bytes:
    """The codestream of a file of either kind."""
    if data[:2] == struct.pack(">H", SOC):
        return data
    if len(data) < 12 or data[4:8] != b"jP  ":
        raise InvalidData("neither a container nor a codestream")
    for name, at, n, _, parent in boxes(data):
        if name == "jp2c" and not parent:
            return data[at : at + n]
    raise InvalidData("no codestream in the container")


def main_header(data: bytes) -> tuple[dict, int]:
    """The main header and where the first tile begins; other segments are skipped by their length."""
    if take(">H", data, 0)[0] != SOC:
        raise InvalidData("no start of a codestream")
    at, out, seen = 2, {"high_throughput": False}, set()
    while True:
        (marker,) = take(">H", data, at)
        if marker >> 8 != 0xFF:
            raise InvalidData(f"no marker at {at}")
        if marker in (SOT, EOC):
            break
        (length,) = take(">H", data, at + 2)
        body = data[at + 4 : at + 2 + length]
        if length < 2 or len(body) != length - 2:
            raise OutOfBounds(f"a segment of {length} bytes at {at}")
        seen.add(marker)
        if marker == SIZ:
            _, width, height, _, _, tile_w, tile_h, _, _, n = take(">HIIIIIIIIH", body, 0)
            comps = [take(">BBB", body, 36 + 3 * k) for k in range(n)]
            if not n or not tile_w or not tile_h:
                raise InvalidData("an image without components or with empty tiles")
            out |= {"width": width, "height": height, "tile_w": tile_w, "tile_h": tile_h, "n_comps": n, "precisions": [(p & 0x7F) + 1 for p, _, _ in comps],
                    "signed": [bool(p >> 7) for p, _, _ in comps], "dx": [x for _, x, _ in comps], "dy": [y for _, _, y in comps]}
        elif marker == COD:
            _, progression, layers, mct, levels, cw, ch, style, transform = take(">BBHBBBBBB", body, 0)
            out |= {"progression": progression, "layers": layers, "mct": bool(mct), "levels": levels, "cblk_w": 4 << cw, "cblk_h": 4 << ch, "cblk_style": style, "reversible": transform == 1}
            out["high_throughput"] = bool(style & 0x40)
        elif marker == QCD:
            (style,) = take(">B", body, 0)
            out |= {"quant_style": style, "steps": list(body[1:]) if not style & 0x1F else list(struct.unpack(f">{(len(body) - 1) // 2}H", body[1 : 1 + (len(body) - 1) // 2 * 2]))}
        elif marker == CAP:
            capabilities(body)
        at += 2 + length
    if not {SIZ, COD, QCD} <= seen:
        raise InvalidData("a main header without SIZ, COD or QCD")
    return out, at


def capabilities(body: bytes) -> tuple[int, list[int]]:
    """The capability word and one number for each of its bits."""
    (word,) = take(">I", body, 0)
    if len(body) != 4 + 2 * word.bit_count():
        raise InvalidData("a capability segment of the wrong length")
    return word, list(struct.unpack_from(f">{word.bit_count()}H", body, 4))


def capability_segment(word: int, numbers: list[int]) -> bytes:
    return struct.pack(f">HI{len(numbers)}H", 6 + 2 * len(numbers), word, *numbers)


def write_main_header(h: dict) -> bytes:
    comps = b"".join(struct.pack(">BBB", p - 1 | 0x80 * s, x, y) for p, s, x, y in zip(h["precisions"], h["signed"], h["dx"], h["dy"], strict=True))
    siz = struct.pack(">HHIIIIIIIIH", 38 + len(comps), 0, h["width"], h["height"], 0, 0, h["tile_w"], h["tile_h"], 0, 0, h["n_comps"]) + comps
    exp = lambda n: max(0, n.bit_length() - 3)
    cod = struct.pack(">HBBHBBBBBB", 12, 0, h.get("progression", 0), h.get("layers", 1), h["mct"], h["levels"], exp(h["cblk_w"]), exp(h["cblk_h"]), 0, h["reversible"])
    bands = 1 + 3 * h["levels"]
    steps = b"\0" * bands if h["reversible"] else struct.pack(">H", 0x0020) * bands
    qcd = struct.pack(">HB", 3 + len(steps), 0 if h["reversible"] else 2) + steps
    return struct.pack(">H", SOC) + b"".join(struct.pack(">H", m) + s for m, s in ((SIZ, siz), (COD, cod), (QCD, qcd)))


def write_tile(index: int, payload: bytes) -> bytes:
    return struct.pack(">HHHIBB", SOT, 10, index, 14 + len(payload), 0, 1) + struct.pack(">H", SOD) + payload


def tile_head(head: bytes, left: int) -> tuple[int, int]:
    """``(tile, size)`` of the tile part that begins with these 14 bytes, of which ``left`` bytes are left in the stream."""
    if take(">H", head, 0)[0] != SOT:
        raise InvalidData("no tile part")
    length, index, size, _, _ = take(">HHIBB", head, 2)
    if length != 10 or take(">H", head, 12)[0] != SOD:
        raise InvalidData("a broken tile part")
    size = size or left - 2
    if not 14 <= size <= left:
        raise OutOfBounds(f"a tile part of {size} bytes where {left} are left")
    return index, size


def tile_parts(data: bytes, at: int) -> Iterator[tuple[int, bytes]]:
    """``(tile, payload)`` of each tile part up to the end marker."""
    while take(">H", data, at)[0] != EOC:
        index, size = tile_head(data[at : at + 14], len(data) - at)
        yield index, data[at + 14 : at + size]
        at += size


# Names of the markers that files have here.
MARKERS = {SOC: "SOC", SIZ: "SIZ", COD: "COD", QCD: "QCD", CAP: "CAP", SOT: "SOT", SOD: "SOD", EOC: "EOC"}


def segments(data: bytes) -> Iterator[tuple[str, int, int]]:
    """``(marker, offset, length)`` of all markers of a codestream: the length of a segment without its marker, of a tile's data for SOD."""
    at = 0
    while True:
        (marker,) = take(">H", data, at)
        if marker >> 8 != 0xFF:
            raise InvalidData(f"no marker at {at}")
        name = MARKERS.get(marker, f"{marker:04X}")
        if marker in (SOC, EOC):
            yield name, at, 0
            if marker == EOC:
                return
            at += 2
            continue
        if marker == SOT:
            _, size = tile_head(data[at : at + 14], len(data) - at)
            yield name, at, 10
            yield "SOD", at + 12, size - 14
            at += size
            continue
        (length,) = take(">H", data, at + 2)
        if length < 2 or at + 2 + length > len(data):
            raise OutOfBounds(f"a segment of {length} bytes at {at}")
        if marker == CAP:
            capabilities(data[at + 4 : at + 2 + length])
        yield name, at, length
        at += 2 + length


def with_capabilities(data: bytes, word: int, numbers: list[int]) -> bytes:
    """A codestream with a capability segment behind its SIZ segment."""
    (length,) = take(">H", data, 4)
    return data[: 4 + length] + struct.pack(">H", CAP) + capability_segment(word, numbers) + data[4 + length :]


PAYLOAD = struct.Struct("<6H3I")


def write_payload(blocks: list[tuple]) -> bytes:
    """A tile's payload of ``(comp, band, cb_x, cb_y, cb_w, cb_h, numbps, num_passes, data)`` in their order."""
    return struct.pack("<I", len(blocks)) + b"".join(PAYLOAD.pack(*b[:8], len(b[8])) for b in blocks) + b"".join(b[8] for b in blocks)


def read_payload(payload: bytes) -> Iterator[tuple]:
    (n,) = take("<I", payload, 0)
    at = 4 + n * PAYLOAD.size
    for k in range(n):
        *head, size = take(PAYLOAD.format, payload, 4 + k * PAYLOAD.size)
        if at + size > len(payload):
            raise OutOfBounds("a block beyond the payload")
        yield *head, payload[at : at + size]
        at += size


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """``(path, content)`` of the files under a path."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


BLOCKS = "image_id long, tile int, comp int, band int, cb_x int, cb_y int, cb_w int, cb_h int, numbps int, num_passes int, data binary, "
BLOCKS += "header struct<" + HEADER.replace(" ", ": ").replace(",: ", ", ") + ">, error string"


def scan_headers(files: DataFrame) -> DataFrame:
    """``(image_id, header, error)`` for each of ``files(image_id, content)``; a broken file has a null header and an error."""
    schema = "image_id long, header struct<" + HEADER.replace(" ", ": ").replace(",: ", ", ") + ">, error string"
    arrow = to_arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows.append({"image_id": name, "header": main_header(unwrap(content or b""))[0], "error": None})
                except CodecError as e:
                    rows.append({"image_id": name, "header": None, "error": f"{type(e).__name__}: {e}"})
            yield pa.RecordBatch.from_pylist(rows, arrow)

    return files.select("image_id", "content").mapInArrow(run, schema)


def _tile_wanted(header: dict, tile: int, region: tuple[int, int, int, int] | None) -> bool:
    across = -(-header["width"] // header["tile_w"])
    x0, y0 = tile % across * header["tile_w"], tile // across * header["tile_h"]
    return region is None or x0 < region[2] and region[0] < x0 + header["tile_w"] and y0 < region[3] and region[1] < y0 + header["tile_h"]


def _check_region(header: dict, region: tuple[int, int, int, int] | None) -> None:
    if region and (region[2] > header["width"] or region[3] > header["height"]):
        raise OutOfBounds(f"region {region} of an image of {header['width']} by {header['height']}")


def tile_blocks(payload: bytes, header: dict, reduce: int) -> Iterator[tuple]:
    """The blocks of a tile's payload but those of the finest ``reduce`` levels."""
    most = 3 * (header["levels"] - min(reduce, header["levels"]))
    return (b for b in read_payload(payload) if b[1] <= most)


def scan_blocks(files: DataFrame, reduce: int = 0, region: tuple[int, int, int, int] | None = None) -> DataFrame:
    """Every code-block of ``files(image_id, content)`` with its file's header; a broken file gives one row with an error.

    Blocks of the finest ``reduce`` levels, and tiles outside ``region`` (x0, y0, x1, y1), are left
    out here, before anything is decoded. A region that leaves the image is an error.
    """
    arrow = to_arrow(BLOCKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = []
                try:
                    data = unwrap(content or b"")
                    header, at = main_header(data)
                    _check_region(header, region)
                    for tile, payload in tile_parts(data, at):
                        if _tile_wanted(header, tile, region):
                            rows += [dict(zip(arrow.names, (name, tile, *b, header, None), strict=True)) for b in tile_blocks(payload, header, reduce)]
                except CodecError as e:
                    rows = [{"image_id": name, "error": f"{type(e).__name__}: {e}"}]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, arrow)

    return files.select("image_id", "content").mapInArrow(run, BLOCKS)


def scan_boxes(files: DataFrame) -> DataFrame:
    """``(image_id, type, offset, length, header_size, parent)`` of every box of container files."""
    schema = f"image_id long, {BOX}"
    arrow = to_arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if content and content[4:8] == b"jP  " and (rows := [dict(zip(arrow.names, (name, *b), strict=True)) for b in boxes(content)]):
                    yield pa.RecordBatch.from_pylist(rows, arrow)

    return files.select("image_id", "content").mapInArrow(run, schema)


COLOUR = "image_id long, height long, width long, n_comps int, bpc int, method int, enum_cs long, icc_length int, error string"


def scan_colours(files: DataFrame) -> DataFrame:
    """The image header and colour boxes of container files, in the columns of ``COLOUR``; an error if one is missing or broken. Other files give no row."""
    arrow = to_arrow(COLOUR)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if content and content[4:8] == b"jP  ":
                    row = {"image_id": name}
                    try:
                        found = {kind: content[at : at + n] for kind, at, n, _, parent in boxes(content) if parent == "jp2h"}
                        if not {"ihdr", "colr"} <= found.keys():
                            raise InvalidData("no image header or colour box")
                        row |= image_header(found["ihdr"]) | colour(found["colr"])
                        row["icc_length"] = None if row["icc"] is None else len(row["icc"])
                    except CodecError as e:
                        row = {"image_id": name, "error": f"{type(e).__name__}: {e}"}
                    rows.append(row)
            if rows:
                yield pa.RecordBatch.from_pylist([{c: r.get(c) for c in arrow.names} for r in rows], arrow)

    return files.select("image_id", "content").mapInArrow(run, COLOUR)


MARKER = "image_id long, box_header int, marker string, offset long, length long, error string"


def scan_markers(files: DataFrame) -> DataFrame:
    """All markers of ``files(image_id, content)``, in the columns of ``MARKER``.

    Places are in the codestream; ``box_header`` is the header size of the box that holds it, 0 without
    a container. Markers up to an error have rows, and the error one of its own.
    """
    arrow = to_arrow(MARKER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    data = content or b""
                    head = 0 if data[:2] == b"\xff\x4f" else next((b[3] for b in boxes(data) if b[0] == "jp2c"), 0)
                    for marker, at, length in segments(unwrap(data)):
                        rows.append((name, head, marker, at, length, None))
                except CodecError as e:
                    rows.append((name, None, None, None, None, f"{type(e).__name__}: {e}"))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), arrow.types, strict=True)], schema=arrow)

    return files.select("image_id", "content").mapInArrow(run, MARKER)


def rewrapped(files: DataFrame, capable: Column, wide: Column, contained: Column | None = None) -> DataFrame:
    """``files(image_id, content)`` with a capability segment where ``capable`` holds, in containers where ``contained`` does (null: all), in a box with a 16-byte header where ``wide`` does."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for content, cap, wide, boxed in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3, 4)), strict=True):
                data = unwrap(content)
                header, _ = main_header(data)
                data = with_capabilities(data, 0x00020000, [0x0020]) if cap else data
                made.append(wrap(data, header, wide=wide) if boxed else data)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["image_id", "content"])

    boxed = F.lit(True) if contained is None else contained
    return files.select("image_id", "content", capable.alias("c"), wide.alias("w"), boxed.alias("b")).mapInArrow(run, "image_id long, content binary")
