"""An index of the tiles of files, and reads of no more bytes than those of the tiles that are asked for.

A file is ``(image_id, path, start, size)``: an own file, or a part of a pack. The index has a row for each
tile part, ``INDEX``; a region is a filter on it, and its tiles are read by ranges inside tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplet.functions.columns import ceil_div
from ripplet.functions.errors import CodecError, InvalidData, OutOfBounds
from ripplet.functions.schemas import to_arrow
from ripplet.sources import codestream
from ripplet.sources.shared import file_system

#: Bytes that are read for a main header at first.
HEAD = 4096
HEADER = "header struct<" + codestream.HEADER.replace(" ", ": ").replace(",: ", ", ") + ">"
INDEX = f"image_id long, path string, tile int, offset long, length long, {HEADER}, read long, error string"


class Part:
    """A part of a file as a sequence of bytes; ``read`` counts those that were read."""

    def __init__(self, file, start: int, size: int):
        self.file, self.start, self.size, self.read = file, start, size, 0

    def bytes(self, at: int, n: int) -> bytes:
        n = max(0, min(n, self.size - at))
        self.read += n
        return self.file.read_at(n, self.start + at)


def _main_header(part: Part) -> tuple[dict, int, int]:
    """The main header, where its codestream begins, and where the first tile part does; containers are entered by their boxes' headers."""
    at = 0
    if part.bytes(0, 2) != b"\xff\x4f":
        if part.bytes(4, 4) != b"jP  ":
            raise InvalidData("neither a container nor a codestream")
        while True:
            if at >= part.size:
                raise InvalidData("no codestream in the container")
            kind, head, size = codestream.box_header(part.bytes(at, 16), part.size - at)
            if kind == "jp2c":
                at += head
                break
            at += size
    n = HEAD
    while True:
        try:
            header, used = codestream.main_header(part.bytes(at, n))
            return header, at, at + used
        except OutOfBounds:
            if at + n >= part.size:
                raise
            n *= 4


def index_tiles(files: DataFrame) -> DataFrame:
    """``INDEX`` of ``files(image_id, path, start, size)``: a row for each tile part with its payload's place.

    ``read`` is how many bytes of a file this took, in its first row. A broken file has a row with an error.
    """
    schema = to_arrow(INDEX)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, path, start, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                system, inner = file_system(path)
                with system.open_input_file(inner) as f:
                    part, own = Part(f, start, size), []
                    try:
                        header, _, at = _main_header(part)
                        while (head := part.bytes(at, 14))[:2] != b"\xff\xd9":
                            tile, length = codestream.tile_head(head, part.size - at)
                            own.append({"image_id": name, "path": path, "tile": tile, "offset": start + at + 14, "length": length - 14, "header": header, "read": 0})
                            at += length
                        if own:
                            own[0]["read"] = part.read
                    except CodecError as e:
                        own = [{"image_id": name, "path": path, "read": part.read, "error": f"{type(e).__name__}: {e}"}]
                rows += own
            yield pa.RecordBatch.from_pylist(rows, schema)

    return files.select("image_id", "path", "start", "size").mapInArrow(run, INDEX)


def in_region(index: DataFrame, region: tuple[int, int, int, int]) -> DataFrame:
    """The rows of an index whose tile meets ``region``; none of an image that the region leaves."""
    w, h, tw, th = (F.col(f"header.{c}") for c in ("width", "height", "tile_w", "tile_h"))
    across = ceil_div(w, tw)
    x0, y0 = (F.col("tile") % across) * tw, F.floor(F.col("tile") / across) * th
    x_in, y_in = (x0 < region[2]) & (x0 + tw > region[0]), (y0 < region[3]) & (y0 + th > region[1])
    return index.where("error is null").where((w >= region[2]) & (h >= region[3]) & x_in & y_in)


def scan_ranges(index: DataFrame, reduce: int = 0) -> DataFrame:
    """The code-blocks of the tiles of an index, in the columns of ``codestream.BLOCKS``; of each file only these tiles' bytes are read."""
    arrow = to_arrow(codestream.BLOCKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def opened(path: str):
            system, inner = file_system(path)
            return system.open_input_file(inner)

        file = lru_cache(4)(opened)
        for batch in batches:
            for r in batch.to_pylist():
                try:
                    payload = file(r["path"]).read_at(r["length"], r["offset"])
                    rows = [dict(zip(
                        arrow.names, (r["image_id"], r["tile"], *b, r["header"], None), strict=True,
                    )) for b in codestream.tile_blocks(payload, r["header"], reduce)]
                except CodecError as e:
                    rows = [{"image_id": r["image_id"], "error": f"{type(e).__name__}: {e}"}]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, arrow)

    return index.select("image_id", "path", "tile", "offset", "length", "header").mapInArrow(run, codestream.BLOCKS)
