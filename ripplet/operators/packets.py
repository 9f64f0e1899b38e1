"""Packets of code-blocks and tag-tree codes: bit-packed headers, a pure function of a packet's few blocks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplet.functions.errors import InvalidData, OutOfBounds
from ripplet.functions.schemas import to_arrow

# The markers around packet headers, and the codes of pass counts as (least count, prefix, bits of the prefix, bits of the rest).
SOP, EPH = b"\xff\x91\x00\x04\x00\x00", b"\xff\x92"
PASSES = [(1, 0b0, 1, 0), (2, 0b10, 2, 0), (3, 0b1100, 4, 2), (6, 0b1101, 4, 5), (37, 0b11100000, 8, 7)]


class Bits:
    """Bits to bytes; after a byte FF only seven follow."""

    def __init__(self):
        self.out, self.hold, self.room = bytearray(), 0, 8

    def put(self, value: int, n: int = 1) -> None:
        for k in reversed(range(n)):
            self.room -= 1
            self.hold |= (value >> k & 1) << self.room
            if not self.room:
                self._next()

    def _next(self) -> None:
        self.out.append(self.hold)
        self.room, self.hold = 7 if self.hold == 0xFF else 8, 0

    def bytes(self) -> bytes:
        if self.room < 8:  # also a byte of no bits after FF
            self._next()
            if self.room == 7:
                self._next()
        return bytes(self.out)


class BitSource:
    """The bits of such bytes."""

    def __init__(self, data: bytes):
        self.data, self.at, self.left = data, -1, 0

    def get(self, n: int = 1) -> int:
        value = 0
        for _ in range(n):
            if not self.left:
                self.left = 7 if self.at >= 0 and self.data[self.at] == 0xFF else 8
                self.at += 1
                if self.at >= len(self.data):
                    raise OutOfBounds("a packet header ends early")
            self.left -= 1
            value = value << 1 | self.data[self.at] >> self.left & 1
        return value

    def used(self) -> int:
        """Bytes up to the end of the header, with the byte that follows an FF."""
        return self.at + 1 + (self.at >= 0 and self.data[self.at] == 0xFF)


def encode_packet(blocks: list[tuple[bool, int, int, bytes]], sop: bool = False, eph: bool = False) -> bytes:
    """A packet of ``(included, zero bit planes, passes, data)`` for each block."""
    bits, there = Bits(), any(inc and data for inc, _, _, data in blocks)
    bits.put(int(there))
    for inc, zero, passes, data in blocks if there else []:
        bits.put(int(inc))
        if inc:
            if not 1 <= passes <= 164 or len(data) >= 1 << 24:
                raise InvalidData("a block with no passes, too many or too much data")
            least, prefix, n, rest = [p for p in PASSES if p[0] <= passes][-1]
            size = max(1, -(-len(data).bit_length() // 8))
            for value, width in ((zero, 8), (prefix, n), (passes - least, rest), (size, 2), (len(data), 8 * size)):
                bits.put(value, width)
    return SOP * sop + bits.bytes() + EPH * eph + b"".join(data for inc, _, _, data in blocks if inc and there)


def decode_packet(packet: bytes, n_blocks: int) -> tuple[list[tuple[bool, int, int, bytes]], int]:
    """The blocks of a packet, and the bytes it took."""
    at = len(SOP) if packet[:2] == SOP[:2] else 0
    bits, found = BitSource(packet[at:]), []
    there = bits.get()
    for _ in range(n_blocks):
        if not there or not bits.get():
            found.append((False, 0, 0, 0))
            continue
        zero, prefix, n = bits.get(8), 0, 0
        while (match := [p for p in PASSES if (p[1], p[2]) == (prefix, n)]) == [] or n == 0:
            prefix, n = prefix << 1 | bits.get(), n + 1
            if n > 8:
                raise InvalidData("a code of no pass count")
        least, _, _, rest = match[0]
        passes = least + bits.get(rest)
        found.append((True, zero, passes, bits.get(8 * bits.get(2))))
    at += bits.used()
    if packet[at : at + 2] == EPH:
        at += 2
    blocks = []
    for inc, zero, passes, size in found:
        if at + size > len(packet):
            raise OutOfBounds("a block beyond the packet")
        blocks.append((inc, zero, passes, packet[at : at + size]))
        at += size
    return blocks, at


def packets(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """``(*keys, n_blocks, packet)``: the blocks with equal keys, by ``cb_y, cb_x``, as one packet each; ``numbps`` below 32."""
    grouped = blocks.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("cb_y", "cb_x", F.col("numbps").alias("planes"), "num_passes", "data"))).alias("bs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("bs").to_pylist()
            made = [encode_packet([(b["num_passes"] > 0, 32 - b["planes"], b["num_passes"], b["data"]) for b in bs]) for bs in lists]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(map(len, lists), pa.int64()), pa.array(made, pa.binary())], [*keys, "n_blocks", "packet"])

    kinds = ", ".join(f"{k} {t}" for k, t in grouped.dtypes if k in keys)
    return grouped.mapInArrow(run, f"{kinds}, n_blocks long, packet binary")


def contributions(packed: DataFrame, keys: list[str]) -> DataFrame:
    """``(*keys, k, planes, num_passes, size, used)``: a row for each block of a packet, ``used`` the packet's bytes."""
    schema = ", ".join(f"{k} {t}" for k, t in packed.dtypes if k in keys) + ", k long, planes long, num_passes long, size long, used long"
    arrow = to_arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, rows = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True)), []
            for name, n, packet in zip(names, batch.column("n_blocks").to_pylist(), batch.column("packet").to_pylist(), strict=True):
                blocks, used = decode_packet(packet, n)
                rows += [(*name, k, 32 - zero if inc else 0, passes, len(data), used) for k, (inc, zero, passes, data) in enumerate(blocks)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    return packed.mapInArrow(run, schema)


class TagTree:
    """A tag tree over leaves in rows: a node's value is the least below it. ``put`` and ``get`` code whether values lie below a threshold."""

    def __init__(self, w: int, h: int, values: list[int] | None = None):
        self.sizes = [(w, h)]
        while self.sizes[-1] != (1, 1):
            self.sizes.append(tuple((n + 1) // 2 for n in self.sizes[-1]))
        self.value = [[0] * (a * b) for a, b in self.sizes]
        self.low = [[0] * (a * b) for a, b in self.sizes]
        self.known = [bytearray(a * b) for a, b in self.sizes]
        if values:
            self.value[0] = list(values)
            for level in range(1, len(self.sizes)):
                (a, b), (pa_, pb) = self.sizes[level], self.sizes[level - 1]
                self.value[level] = [min(self.value[level - 1][y * pa_ + x] for y in range(2 * v, min(2 * v + 2, pb)) for x in range(2 * u, min(2 * u + 2, pa_))) for v in range(b) for u in range(a)]

    def _walk(self, x: int, y: int, threshold: int, ask) -> int:
        low = 0
        for level in reversed(range(len(self.sizes))):
            k = (y >> level) * self.sizes[level][0] + (x >> level)
            if not self.known[level][k]:
                low = max(low, self.low[level][k])
                while low < threshold and not ask(level, k, low):
                    low += 1
                self.known[level][k], self.low[level][k] = low < threshold, low
                if low < threshold:
                    self.value[level][k] = low
            else:
                low = self.value[level][k]
        return self.value[0][y * self.sizes[0][0] + x]

    def put(self, bits: Bits, x: int, y: int, threshold: int) -> None:
        def ask(level: int, k: int, low: int) -> bool:
            bits.put(int(reached := low >= self.value[level][k]))
            return reached

        self._walk(x, y, threshold, ask)

    def get(self, bits: BitSource, x: int, y: int, threshold: int) -> int:
        return self._walk(x, y, threshold, lambda *_: bool(bits.get()))


def code_tag_trees(leaves: DataFrame, w: int, h: int, threshold: int) -> DataFrame:
    """``(image_id, code)``: the bits of each image's leaf values ``(image_id, y, x, value)``, leaf by leaf."""
    rows = leaves.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("y", "x", "value"))).alias("l")).select("image_id", F.expr("transform(l, p -> p.value)").alias("values"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = []
            for values in batch.column(1).to_pylist():
                tree, bits = TagTree(w, h, values), Bits()
                for k in range(w * h):
                    tree.put(bits, k % w, k // w, threshold)
                codes.append(bits.bytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes, pa.binary())], ["image_id", "code"])

    return rows.mapInArrow(run, "image_id long, code binary")


def read_tag_trees(codes: DataFrame, w: int, h: int, threshold: int) -> DataFrame:
    """The leaves ``(image_id, y, x, value)`` again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, code in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tree, bits = TagTree(w, h), BitSource(code)
                rows += [(name, k // w, k % w, tree.get(bits, k % w, k // w, threshold)) for k in range(w * h)]
            yield pa.RecordBatch.from_pydict(dict(zip(("image_id", "y", "x", "value"), map(list, zip(*rows, strict=True)), strict=True)))

    return codes.select("image_id", "code").mapInArrow(run, "image_id long, y long, x long, value long")
