import re
import math
import random
import struct
from dataclasses import replace

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ripplet.functions import columns as C
from ripplet.functions.errors import CodecError, InvalidData, OutOfBounds, Unsupported
from ripplet.operators import blocks, entropy, packets, rates, wavelets
from ripplet.plans import codec, queries
from ripplet.sources import codestream, ranges, sinks
from ripplet.streaming import files as streaming


def image(name, w, h, *planes):
    """Samples of one image; a plane is a function of the row-major index."""
    return [(name, c, i // w, i % w, int(f(i))) for c, f in enumerate(planes) for i in range(w * h)]


def frame(spark, *images):
    return spark.createDataFrame([r for i in images for r in i], "image_id long, comp int, y long, x long, v long")


def values(df):
    return {(r.image_id, r.comp, r.y, r.x): r.v for r in df.collect()}


GRAY64 = image(1, 64, 64, lambda i: i % 256)
RGB16 = image(2, 16, 16, lambda i: 7 * i % 256, lambda i: (11 * i + 50) % 256, lambda i: (3 * i + 100) % 256)
ALT16 = image(3, 16, 16, lambda i: 50 if i % 2 else 200)
CONST16 = image(4, 16, 16, lambda i: 128)
TILED16 = image(5, 16, 16, lambda i: (7 * i + 3) % 256)
QUAD16 = image(6, 16, 16, lambda i: 50 + 50 * (i % 16 // 8) + 100 * (i // 128))
ODD = image(7, 13, 9, lambda i: (i * i + 5) % 256)
ONE = image(8, 1, 1, lambda i: 200)
FOUR = image(9, 6, 5, *[lambda i, k=k: (9 * i + 31 * k) % 256 for k in range(4)])


@pytest.mark.parametrize(("kind", "tile", "levels"), [("jp2", 0, 2), ("j2k", 8, 1), ("j2k", 7, 3)])
def test_lossless_is_exact(spark, kind, tile, levels):
    df = frame(spark, RGB16, ALT16, CONST16, TILED16, QUAD16, ODD, ONE, FOUR)
    files = codec.encode(df, codec.EncodeParams(levels=levels, cblk_w=16, cblk_h=8, format=kind, tile_w=tile, tile_h=tile)).cache()
    assert {r.f for r in files.select(codestream.detect_format(F.col("content")).alias("f")).collect()} == {kind}
    assert values(codec.decode(files)) == values(df)


def test_compat_mode_stays_in_the_known_bounds(spark):
    df = frame(spark, RGB16, CONST16, TILED16)
    files = codec.encode(df, codec.EncodeParams(levels=1, format="j2k"))
    a, b = values(df), values(codec.decode(files, exact=False))
    error = {n: max(abs(a[k] - b[k]) for k in a if k[0] == n) for n in (2, 4, 5)}
    assert error[4] == 0 and 0 < error[5] <= 3 and 0 < error[2] <= 5


def test_lossy_quality(spark):
    df = frame(spark, GRAY64, image(10, 32, 32, lambda i: (8 * (i % 32) + 4 * (i // 32)) % 256), RGB16)
    got = codec.decode(codec.encode(df, codec.EncodeParams(lossless=False, levels=3)))
    pairs = df.withColumnRenamed("v", "a").join(got.withColumnRenamed("v", "b"), ["image_id", "comp", "y", "x"])
    assert all(r.psnr is None or r.psnr > 30 for r in blocks.errors(pairs).collect())


def test_region_and_resolution(spark):
    df = frame(spark, GRAY64)
    files = codec.encode(df, codec.EncodeParams(levels=2, tile_w=16, tile_h=16)).cache()
    whole = values(df)
    for box in ((0, 0, 64, 64), (16, 16, 48, 48), (10, 20, 11, 21)):
        got = values(codec.decode(files, region=box))
        assert got == {(n, c, y - box[1], x - box[0]): v for (n, c, y, x), v in whole.items() if box[0] <= x < box[2] and box[1] <= y < box[3]}
    for bad in ((10, 10, 10, 20), (10, 20, 20, 20), (-1, 0, 4, 4)):
        with pytest.raises(ValueError):
            codec.decode(files, region=bad)
    files = codec.encode(frame(spark, ODD), codec.EncodeParams(levels=2))
    for reduce, size in ((1, (7, 5)), (2, (4, 3)), (9, (4, 3))):
        got = values(codec.decode(files, reduce=reduce))
        assert (max(k[3] for k in got) + 1, max(k[2] for k in got) + 1) == size and len(got) == size[0] * size[1]


def test_broken_files_are_reported(spark):
    (r,) = codec.encode(frame(spark, TILED16), codec.EncodeParams(levels=1, format="j2k")).collect()
    data = bytes(r.content)
    at = data.index(struct.pack(">H", codestream.QCD))
    odd = {1: data, 2: data[:at] + b"\xff\x60\x00\x04\xab\xcd" + data[at:], 3: data[:30], 4: b"", 5: b"plain text that is no image", 6: data[:at] + data[at + 9 :], 7: data[: len(data) // 2], 8: None}
    files = spark.createDataFrame([(k, bytearray(v) if v is not None else None) for k, v in odd.items()], "image_id long, content binary")
    errors = {r.image_id: r.error for r in codestream.scan_headers(files).collect()}
    assert errors[1] is None and errors[2] is None and errors[7] is None and all(errors[k] for k in (3, 4, 5, 6, 8))
    rows = codestream.scan_blocks(files).where("error is not null").collect()
    assert {r.image_id for r in rows} == {3, 4, 5, 6, 7, 8}
    got = values(codec.decode(files))
    assert {k[0] for k in got} == {1, 2} and len(got) == 512


@pytest.mark.parametrize("lossless", [True, False])
def test_limited_payloads(spark, lossless):
    """Payloads keep within their bytes and decode; more bytes leave less error, and all bytes none that the full file has not."""
    df = frame(spark, TILED16, RGB16, ODD)
    shape = {"levels": 2, "cblk_w": 8, "cblk_h": 8, "format": "j2k", "lossless": lossless, "tile_w": 16, "tile_h": 16}
    errors = []
    for limit in (600, 900, 1500, 10**6):  # the block table of 21 blocks takes 508
        p = codec.EncodeParams(max_bytes=limit, **shape)
        files = codec.encode(df, p).cache()
        assert all(r.length <= limit for r in codestream.scan_markers(files).where("marker = 'SOD'").collect())
        got, want = values(codec.decode(files, levels=2)), values(df)
        assert got.keys() == want.keys()
        errors.append(sum((got[k] - want[k]) ** 2 for k in want))
    full = values(codec.decode(codec.encode(df, codec.EncodeParams(**shape)), levels=2))
    assert errors == sorted(errors, reverse=True) and errors[0] > errors[2] and errors[3] == sum((full[k] - want[k]) ** 2 for k in want)


def test_limits_share_their_blocks(spark, sf):
    """Files of several limits are those of each limit alone, and the query of three limits plans one decoding; blocks are coded before any choice."""
    df = frame(spark, TILED16, RGB16)
    p = codec.EncodeParams(levels=1, cblk_w=8, cblk_h=8, format="j2k", max_bytes=500)
    got = {(r.image_id, r.max_bytes): r.content for r in codec.encode_within(df, (300, 500, 300), p).collect()}
    want = {(r.image_id, b): r.content for b in (300, 500) for r in codec.encode(df, replace(p, max_bytes=b)).collect()}
    assert got == want and got[2, 300] != got[2, 500]
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "ends" in plan(codec.encode(df, p)) and plan(codec.encode(df, p)).count("MapInArrow") == 2  # payloads and files
    decoding = plan(codec.decode(codec.encode(df, replace(p, max_bytes=None)), levels=1)).count("MapInArrow")
    assert plan(queries.rate_limited(spark, sf)).count("MapInArrow") <= decoding


def test_choice_of_passes(spark):
    """By hand: passes of falling worth, one that counts with the worth before it, and a block that keeps nothing."""
    rows = [(1, 1, 1, 10, 1000.0), (1, 1, 2, 10, 10.0), (1, 1, 3, 1, 500.0), (1, 2, 1, 10, 900.0), (1, 2, 2, 10, 800.0), (1, 3, 1, 40, 400.0), (2, 1, 1, 99, 5.0)]
    df = spark.createDataFrame(rows, "tile long, block long, k long, cost long, gain double")
    got = {(r.tile, r.block): r.kept for r in rates.choose(df, ["tile"], ["block"], F.lit(70)).collect()}
    assert got == {(1, 1): 1, (1, 2): 2, (1, 3): 1}
    got = {(r.tile, r.block): r.kept for r in rates.choose(df, ["tile"], ["block"], F.lit(80)).collect()}
    assert got == {(1, 1): 2, (1, 2): 2, (1, 3): 1}


def test_a_file_by_hand(spark):
    """All bytes of the codestream of a flat image: no block has data."""
    (r,) = codec.encode(frame(spark, CONST16), codec.EncodeParams(levels=1, cblk_w=8, cblk_h=8, format="j2k")).collect()
    block = lambda band: struct.pack("<6H3I", 0, band, 0, 0, 8, 8, 0, 0, 0)
    payload = struct.pack("<I", 4) + b"".join(map(block, range(4)))
    want = "FF4F FF51 0029 0000 00000010 00000010 00000000 00000000 00000010 00000010 00000000 00000000 0001 07 01 01"
    want += "FF52 000C 00 00 0001 00 01 01 01 00 01 FF5C 0007 00 00000000 FF90 000A 0000 00000072 00 01 FF93"
    assert bytes(r.content) == bytes.fromhex(want) + payload + b"\xff\xd9"


def test_levels_and_wavelets_as_columns(spark):
    """Images of all levels and both wavelets in one table are decoded as they are alone."""
    images = [RGB16, GRAY64, ODD, ONE, FOUR, ALT16]
    df = frame(spark, *images)
    levels, lossless = (F.col("image_id") % 4).cast("int"), F.col("image_id") % 3 != 1
    files = codec.encode(df.withColumns({"levels": levels, "lossless": lossless}), codec.EncodeParams(levels=3, format="j2k", tile_w=11, tile_h=9)).cache()
    got, want = values(codec.decode(files)), values(df)
    assert got.keys() == want.keys() and all(got[k] == v for k, v in want.items() if k[0] % 3 != 1)
    assert max(abs(got[k] - v) for k, v in want.items()) <= 3
    for n in (1, 7):
        own = codec.EncodeParams(levels=n % 4, lossless=n % 3 != 1, format="j2k", tile_w=11, tile_h=9)
        alone = codec.encode(df.where(F.col("image_id") == n), own)
        assert [bytes(r.content) for r in alone.collect()] == [bytes(r.content) for r in files.where(F.col("image_id") == n).collect()]
    half = values(codec.decode(files, reduce=1))
    assert {k[0] for k in half} == {k[0] for k in want} and len([k for k in half if k[0] == 8]) == 1
    with pytest.raises(Exception, match="more than 2 levels"):
        codec.decode(files, levels=2).collect()


def test_subsampled_colour(spark):
    """Components with steps of 2 and 3 in tiles that their steps do not divide, whole and as regions."""
    steps = ((1, 2, 3), (1, 2, 1))
    full = image(4, 17, 11, *[lambda i, k=k: (13 * i + 40 * k) % 256 for k in range(3)])
    planes = [(n, c, y // steps[1][c], x // steps[0][c], v) for n, c, y, x, v in full if x % steps[0][c] == 0 and y % steps[1][c] == 0]
    df = frame(spark, planes)
    files = codec.encode(df, codec.EncodeParams(levels=2, tile_w=7, tile_h=5, dx=steps[0], dy=steps[1])).cache()
    head = codestream.scan_headers(files).select("header.*").first()
    assert (head.width, head.height, list(head.dx), list(head.dy), head.mct) == (17, 11, [1, 2, 3], [1, 2, 1], False)
    want = values(df)
    assert values(codec.decode(files)) == want
    x0, y0, x1, y1 = box = (5, 2, 13, 10)
    part = {(n, c, y - y0 // steps[1][c], x - x0 // steps[0][c]): v for (n, c, y, x), v in want.items()
            if x0 // steps[0][c] <= x < -(-x1 // steps[0][c]) and y0 // steps[1][c] <= y < -(-y1 // steps[1][c])}
    assert values(codec.decode(files, region=box)) == part


def test_ranged_reads(spark, tmp_path):
    """Only the bytes of a region's tiles are read; the samples are those of the whole file."""
    df = frame(spark, GRAY64, TILED16)
    for kind in ("jp2", "j2k"):
        files = codec.encode(df, codec.EncodeParams(levels=2, tile_w=16, tile_h=16, format=kind)).cache()
        index = ranges.index_tiles(sinks.write_packs(files, f"file:{tmp_path}/{kind}")).cache()
        assert {(r.image_id, r.n) for r in index.groupBy("image_id").agg(F.count("*").alias("n")).collect()} == {(1, 16), (5, 1)}
        sizes = {r.image_id: len(r.content) for r in files.collect()}
        assert all(0 < r.read < sizes[r.image_id] or sizes[r.image_id] < ranges.HEAD for r in index.where("read > 0").collect())
        hit = ranges.in_region(index, (20, 4, 40, 30))
        assert sorted(r.tile for r in hit.collect()) == [1, 2, 5, 6]
        assert values(codec.decode_scanned(ranges.scan_ranges(hit), 2, region=(20, 4, 40, 30))) == values(codec.decode(files.where("image_id = 1"), region=(20, 4, 40, 30)))
    broken = spark.createDataFrame([(1, bytearray(b"no image")), (2, bytearray(bytes(files.first().content)[:200])), (3, None)], "image_id long, content binary")
    found = ranges.index_tiles(sinks.write_packs(broken, str(tmp_path / "broken")))
    assert sorted(r.image_id for r in found.where("error is not null").collect()) == [1, 2, 3] and ranges.in_region(found, (0, 0, 1, 1)).count() == 0


def test_equal_bytes_at_any_partitioning(spark):
    df = frame(spark, TILED16, RGB16)
    p = codec.EncodeParams(levels=2, cblk_w=4, cblk_h=4, tile_w=8, tile_h=8)
    a, b = ({r.image_id: bytes(r.content) for r in codec.encode(d, p).collect()} for d in (df.coalesce(1), df.repartition(7)))
    assert a == b


def test_boxes_and_segments():
    head = {"width": 3, "height": 2, "n_comps": 3, "precisions": [8, 8, 8], "signed": [True, False, False]}
    for icc in (None, bytes(range(256))):
        found = {b[0]: b for b in codestream.boxes(codestream.wrap(b"\xff\x4f", head, icc))}
        data = codestream.wrap(b"\xff\x4f", head, icc)
        part = lambda n: data[found[n][1] : found[n][1] + found[n][2]]
        assert codestream.colour(part("colr")) == ({"method": 2, "enum_cs": None, "icc": icc} if icc else {"method": 1, "enum_cs": 16, "icc": None})
        assert codestream.image_header(part("ihdr"))["bpc"] == 0x87 and codestream.unwrap(data) == b"\xff\x4f"
    wide = codestream.box("free", b"abc", wide=True)
    assert list(codestream.boxes(wide)) == [("free", 16, 3, 16, "")]
    assert list(codestream.boxes(struct.pack(">I4s", 0, b"free") + b"abcd")) == [("free", 8, 4, 8, "")]
    with pytest.raises(InvalidData):
        list(codestream.boxes(struct.pack(">I4s", 4, b"ftyp")))
    with pytest.raises(Unsupported):
        codestream.colour(b"\3\0\0")
    with pytest.raises(InvalidData):
        codestream.image_header(struct.pack(">IIHBBBB", 1, 1, 1, 7, 6, 0, 0))
    segment = codestream.capability_segment(0x00030000, [0x0020, 0x4000])
    assert codestream.capabilities(segment[2:]) == (0x00030000, [0x0020, 0x4000])
    with pytest.raises(CodecError):
        codestream.capabilities(segment[2:-2])
    with pytest.raises(Unsupported):
        entropy.decode_high_throughput(b"", 4, 4, 1)


def test_known_bytes():
    """A constant block: one run-length pass per four rows, then nothing; passes are cleanup first."""
    data, planes, rates = entropy.encode_block([15] * 16, 4, 4, "LL")
    assert planes == 4 and len(rates) == 10
    kinds = [f.__name__ for f, _ in entropy.Block(4, 4, "LL").passes(planes)]
    assert kinds[:4] == ["cleanup", "significance", "refinement", "cleanup"]
    assert entropy.encode_block([0] * 16, 4, 4, "HH") == (b"", 0, [])


BLOCK = st.tuples(st.integers(1, 9), st.integers(1, 9)).flatmap(lambda s: st.tuples(st.just(s), st.lists(st.integers(-300, 300) | st.just(0), min_size=s[0] * s[1], max_size=s[0] * s[1])))


@given(BLOCK, st.sampled_from(["LL", "HL", "LH", "HH"]), st.sampled_from([0, entropy.RESET, entropy.TERMINATE_ALL]))
@settings(max_examples=150, deadline=None)
def test_block_coder(block, orient, style):
    (w, h), v = block
    data, planes, rates = entropy.encode_block(v, w, h, orient, style)
    assert len(rates) == max(0, 3 * planes - 2)
    assert entropy.decode_block(data, w, h, orient, planes, None, style, rates) == v
    lost = entropy.decode_block(data, w, h, orient, planes, None, style, rates, exact=False)
    assert lost == [int(math.copysign(abs(x) | 1, x)) if abs(x) >= 2 else x for x in v]
    for n in range(0, len(rates), 4):  # fewer passes: nearer and nearer
        part = entropy.decode_block(data, w, h, orient, planes, n, style, rates)
        assert all(abs(a - b) < 1 << planes - (n + 2) // 3 + 1 for a, b in zip(part, v, strict=True)) or n == 0


@given(st.lists(st.tuples(st.integers(0, 18), st.integers(0, 1)), max_size=800))
@settings(max_examples=100, deadline=None)
def test_arithmetic_coder(decisions):
    coder = entropy.Writer()
    for ctx, bit in decisions:
        coder.code(ctx, bit)
    reader = entropy.Reader(coder.finish())
    assert [reader.code(ctx) for ctx, _ in decisions] == [b for _, b in decisions]


@given(st.lists(st.tuples(st.booleans(), st.integers(0, 255), st.integers(1, 164), st.binary(max_size=400).filter(lambda d: d[:2] != b"\xff\x92")), max_size=6), st.booleans(), st.booleans())
@settings(max_examples=200, deadline=None)
def test_packets(contributions, sop, eph):
    # coded data never has a marker, which would pass for the end of a packet's header
    packet = packets.encode_packet(contributions, sop, eph)
    got, used = packets.decode_packet(packet + b"tail", len(contributions))
    there = any(inc and data for inc, _, _, data in contributions)
    want = [(inc, zero, n, data) if inc and there else (False, 0, 0, b"") for inc, zero, n, data in contributions]
    assert [(i, z, n, bytes(d) if d else b"") for i, z, n, d in got] == want and used == len(packet)


@given(st.lists(st.tuples(st.integers(1, 20), st.integers(0, 2**20 - 1)), max_size=60))
@settings(max_examples=100, deadline=None)
def test_bits(fields):
    bits = packets.Bits()
    for n, v in fields:
        bits.put(v & (1 << n) - 1, n)
    data = bits.bytes()
    source = packets.BitSource(data)
    assert [source.get(n) for n, _ in fields] == [v & (1 << n) - 1 for n, v in fields]
    assert all(b < 0x90 for a, b in zip(data, data[1:]) if a == 0xFF)


@pytest.mark.parametrize(("w", "h", "leaves", "root"), [(2, 2, [5, 3, 7, 2], 2), (3, 2, [4, 1, 5, 9, 2, 6], 1), (4, 4, [3, 1, 4, 1, 5, 9, 2, 6, 5, 3, 5, 8, 9, 7, 9, 3], 1), (1, 1, [4], 4)])
def test_tag_tree(w, h, leaves, root):
    tree = packets.TagTree(w, h, leaves)
    assert tree.value[-1] == [root]
    assert sum(a * b for a, b in tree.sizes) == {(2, 2): 5, (3, 2): 9, (4, 4): 21, (1, 1): 1}[w, h]
    bits = packets.Bits()
    for limit in range(1, 11):
        for k in range(w * h):
            tree.put(bits, k % w, k // w, limit)
    reader, source = packets.TagTree(w, h), packets.BitSource(bits.bytes())
    for limit in range(1, 11):
        got = [reader.get(source, k % w, k // w, limit) for k in range(w * h)]
        assert all(g == v for g, v in zip(got, leaves, strict=True) if v < limit)
    assert got == leaves


LINES = [[10, 20, 30, 40], list(range(1, 65)), [5, 10, 15, 20, 25], [42], [100, 200], [10, 20, 30], [-100, 50, -25, 75, -10, 30, -60, 90], [7, 7, 7, 9, 1, -3, 2]]


def lift(line):
    """One 5/3 step by the rule on half bands."""
    low, high = line[::2], line[1::2]
    at = lambda band, i: band[-i if i < 0 else 2 * len(band) - 2 - i if i >= len(band) else i] if len(band) > 1 else band[0]
    if not high:
        return line
    high = [h - (at(low, i) + at(low, i + 1) >> 1) for i, h in enumerate(high)]
    return [x + (at(high, i - 1) + at(high, i) + 2 >> 2) for i, x in enumerate(low)] + high


def test_lines(spark):
    df = spark.createDataFrame([(n, x, v) for n, line in enumerate(LINES) for x, v in enumerate(line)], "line long, x long, v long")
    done = wavelets.forward_53(df, ["line"], "x")
    got = {(r.line, r.x): r.v for r in done.collect()}
    assert got == {(n, x): v for n, line in enumerate(LINES) for x, v in enumerate(lift(line))}
    back = {(r.line, r.x): r.v for r in wavelets.inverse_53(done, ["line"], "x").collect()}
    assert back == {(n, x): v for n, line in enumerate(LINES) for x, v in enumerate(line)}
    real = df.withColumn("v", F.col("v") * 3.7 + 0.5)
    back = wavelets.inverse_97(wavelets.forward_97(real, ["line"], "x"), ["line"], "x")
    assert {(r.line, r.x): round(r.v, 6) for r in back.collect()} == {(r.line, r.x): round(r.v, 6) for r in real.collect()}


def test_colours(spark):
    rng, rows = random.Random(99999), [(255, 255, 255), (255, 0, 0), (128, 100, 50), (64, 32, 16), (200, 180, 220), (0, 50, 100), (255, 128, 64)]
    rows += [tuple(rng.randrange(256) for _ in range(3)) for _ in range(1000)]
    df = spark.createDataFrame(rows, "r long, g long, b long")
    y = df.select("*", *[c.alias(n) for n, c in zip("ypq", C.rct_forward(F.col("r"), F.col("g"), F.col("b")), strict=True)])
    y = y.select("*", *[c.alias(n) for n, c in zip("RGB", C.rct_inverse(F.col("y"), F.col("p"), F.col("q")), strict=True)], *[c.alias(f"i{k}") for k, c in enumerate(C.ict_forward(F.col("r"), F.col("g"), F.col("b")))])
    y = y.select("*", *[c.alias(f"o{k}") for k, c in enumerate(C.ict_inverse(F.col("i0"), F.col("i1"), F.col("i2")))])
    got = y.collect()
    assert {(r.r, r.g, r.b): (r.y, r.p, r.q) for r in got if (r.r, r.g) in ((255, 255), (255, 0))} == {(255, 255, 255): (255, 0, 0), (255, 0, 0): (63, 0, 255)}
    assert all((r.R, r.G, r.B) == (r.r, r.g, r.b) and max(abs(r.o0 - r.r), abs(r.o1 - r.g), abs(r.o2 - r.b)) < 0.01 for r in got)


def test_quantizer(spark):
    df = spark.createDataFrame([(v,) for v in (100, -200, 300, 0, -52, 1024, 1000, -2000, 500, -750, 3000)], "v long")
    wide, fine = (C.step_size(F.lit(10), F.lit(0), g) for g in (0, 2))
    step = C.step_size(F.lit(10), F.lit(512), 2)
    got = {r.v: r for r in df.select("v", C.no_quantize(F.col("v"), 2).alias("n"), C.quantize(F.col("v"), wide).alias("w"), C.quantize(F.col("v"), fine).alias("f"), C.dequantize(C.quantize(F.col("v"), step), step).alias("d")).collect()}
    assert [got[v].n for v in (100, -200, 300, 0, -52)] == [25, -50, 75, 0, -13]
    assert got[1024].w == 1 and got[1024].f == 4
    assert all(r.d == 0 or (r.d > 0) == (v > 0) and abs(r.d - v) <= 160 for v, r in got.items())
    sizes = C.step_sizes(spark.createDataFrame([(5, 8, True), (5, 8, False)], "num_res long, precision long, reversible boolean")).collect()
    assert len(sizes) == 26 and all(0 <= r.exponent < 32 and 0 <= r.mantissa < 2048 for r in sizes)
    n = spark.range(1).select(*[C.norm(t, F.lit(o), F.lit(l)).alias(f"n{k}") for k, (t, o, l) in enumerate([(C.NORMS_53, 0, 1), (C.NORMS_53, 3, 0), (C.NORMS_97, 1, 0), (C.NORMS_97, 0, 99), (C.NORMS_97, 3, 99)])]).first()
    assert tuple(n) == (1.5, 0.7186, 2.022, 540.9, 557.2)


def test_files_and_stream(spark, tmp_path):
    df = frame(spark, TILED16, ALT16)
    files = codec.encode(df, codec.EncodeParams(levels=1))
    sinks.write_files(files, str(tmp_path / "in"))
    read = codestream.read_files(spark, str(tmp_path / "in/*.jp2")).withColumn("image_id", F.regexp_extract("path", r"(\d+)\.jp2", 1).cast("long"))
    assert values(codec.decode(read)) == values(df)
    (tmp_path / "in/broken.jp2").write_bytes(b"no image")
    streaming.decode_to(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"), errors=str(tmp_path / "errors")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 512
    assert [r.error.split(":")[0] for r in spark.read.parquet(str(tmp_path / "errors")).collect()] == ["InvalidData"]
    heads = streaming.header_stream(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("heads").outputMode("append").trigger(availableNow=True).start()
    heads.awaitTermination()
    assert spark.sql("select count(*) from heads where header.width = 16 and error is null").first()[0] == 2


def test_no_step_has_a_whole_image_in_one_task(spark):
    """Shuffles of a wavelet transform go by line or by chunk of columns; a level shuffles its low band only."""
    rows = spark.range(64 * 64).selectExpr("id div 4096 as image_id", "0 as comp", "id div 64 as y", "id % 64 as x", "id as v")
    forward = wavelets.transform_2d(rows, 3)
    back = wavelets.transform_2d(forward, 3, back=True, size=("64", "64"))
    for df in (forward, back):
        plan = df._jdf.queryExecution().executedPlan().toString()
        keys = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
        assert keys and all(re.search(r"\b(x|y|_c)#", k) for k in keys) and "Window" not in plan
    assert {(r.y, r.x): r.v for r in back.collect()} == {(r.y, r.x): r.v for r in rows.collect()}


def test_errors_of_decoding_have_rows(spark):
    """A cut file and a region that leaves the image give an error and no samples; whole files are not touched."""
    rows = spark.range(128).selectExpr("id div 64 as image_id", "0 as comp", "(id % 64) div 8 as y", "id % 8 as x", "id as v")
    files = codec.encode(rows, codec.EncodeParams(levels=1, format="j2k")).collect()
    broken = spark.createDataFrame([(f.image_id, bytes(f.content[:-20]) if f.image_id else bytes(f.content)) for f in files], "image_id long, content binary")
    assert [(r.image_id, r.error.split(":")[0]) for r in codec.decode_errors(broken).collect()] == [(1, "OutOfBounds")]
    assert {r.image_id for r in codec.decode(broken).collect()} == {0}
    whole = spark.createDataFrame([(f.image_id, bytes(f.content)) for f in files], "image_id long, content binary")
    assert codec.decode(whole, region=(4, 4, 20, 20)).count() == 0 and codec.decode_errors(whole, region=(4, 4, 20, 20)).count() == 2
    assert codec.decode_errors(whole, region=(4, 4, 8, 8)).count() == 0 and codec.decode(whole, region=(4, 4, 8, 8)).count() == 32


def test_steps_and_colour_boxes(spark):
    row = spark.range(1).select(*C.unpack_step(F.lit(13 << 11 | 517))).first()
    assert tuple(row) == (13, 517)
    icc = bytes(range(256))
    header = {"precisions": [8], "signed": [False], "height": 3, "width": 5, "n_comps": 1}
    files = spark.createDataFrame([(0, codestream.wrap(b"", header, icc)), (1, codestream.wrap(b"", header)), (2, codestream.wrap(b"", header)[:50]), (3, b"\xff\x4f\xff\x51"), (4, None)], "image_id long, content binary")
    found = {r.image_id: r for r in codestream.scan_colours(files).collect()}
    assert found.keys() == {0, 1, 2} and (found[0].method, found[0].icc_length, found[0].height, found[0].width) == (2, 256, 3, 5)
    assert (found[1].method, found[1].enum_cs) == (1, 17) and found[2].error and found[2].height is None
