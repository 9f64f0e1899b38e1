"""DuckDB SQL for the named queries, put together from common table expressions."""

from __future__ import annotations

from ripplet.functions.columns import NORMS_53, NORMS_97, NORMS_MCT, NORMS_MCT_REAL
from ripplet.operators.geometry import ORDERS
from ripplet.operators.wavelets import ALPHA, BETA, DELTA, GAMMA, K

V = "CAST(floor(CAST({} AS DOUBLE) * 127 + 128) AS BIGINT)"
N64 = "(SELECT unnest(range(64)) AS i)"
GRAY = f"g AS (SELECT vec_id AS image_id, i // 8 AS y, i % 8 AS x, {V.format('embedding[i + 1]')} AS v FROM embeddings, {N64})"
WIDE = f"c AS (SELECT vec_id // 64 AS image_id, vec_id % 64 AS y, i AS x, {V.format('embedding[i + 1]')} AS v FROM embeddings, {N64})"
RGB = f"""rgb AS (SELECT a.vec_id // 3 AS image_id, i // 8 AS y, i % 8 AS x, {V.format('a.embedding[i + 1]')} AS c0, coalesce({V.format('b.embedding[i + 1]')}, 0) AS c1, coalesce({V.format('d.embedding[i + 1]')}, 0) AS c2
 FROM (SELECT * FROM embeddings WHERE vec_id % 3 = 0) a LEFT JOIN embeddings b ON b.vec_id = a.vec_id + 1 LEFT JOIN embeddings d ON d.vec_id = a.vec_id + 2, {N64})"""
RCT = "rct AS (SELECT image_id, y, x, ((c0 - 128) + 2 * (c1 - 128) + (c2 - 128)) >> 2 AS c0, c2 - c1 AS c1, c0 - c1 AS c2 FROM rgb)"
SHAPES = """s AS (SELECT p_partkey AS image_id, CAST(p_size * 3 + p_partkey % 7 AS BIGINT) AS w, p_partkey % 90 + 1 AS h, p_partkey % 6 AS levels, 64 AS tile_w, 48 AS tile_h, 32 AS cblk_w, 16 AS cblk_h FROM part)"""
LONG = "t AS (SELECT image_id, 0 AS comp, y, x, c0 AS v FROM {0} UNION ALL SELECT image_id, 1, y, x, c1 FROM {0} UNION ALL SELECT image_id, 2, y, x, c2 FROM {0})"


def half(n: str, level: str) -> str:
    return f"CAST(ceil({n} / pow(2, {level})) AS BIGINT)"


BANDS = f"""b AS (SELECT image_id, 0 AS band, 'LL' AS orient, levels AS level, 0 AS x_off, 0 AS y_off, {half('w', 'levels')} AS w, {half('h', 'levels')} AS h, cblk_w, cblk_h FROM s
 UNION ALL SELECT image_id, 3 * r - 2 + k, ['HL', 'LH', 'HH'][k + 1], levels - r + 1, CASE WHEN k = 1 THEN 0 ELSE lw END, CASE WHEN k = 0 THEN 0 ELSE lh END,
  CASE WHEN k = 1 THEN lw ELSE uw - lw END, CASE WHEN k = 0 THEN lh ELSE uh - lh END, cblk_w, cblk_h
 FROM (SELECT *, {half('w', 'levels - r + 1')} AS lw, {half('h', 'levels - r + 1')} AS lh, {half('w', 'levels - r')} AS uw, {half('h', 'levels - r')} AS uh FROM s, (SELECT unnest(range(1, 7)) AS r) WHERE r <= levels), (SELECT unnest(range(3)) AS k))"""
PRECINCTS = """p AS (SELECT image_id, comp, res, 1 + (image_id + comp + res) % 3 AS n_precincts, 2 AS layers FROM s, (SELECT unnest(range(3)) AS comp), (SELECT unnest(range(7)) AS res)
 WHERE comp <= image_id % 3 AND res <= least(levels, 1 + comp + image_id % 2))"""

RIGHT_LOW = "coalesce(lead(lo) OVER w, lag(lo) OVER w, lo)"
HIGHS = "coalesce(lag(hi) OVER w, lead(hi) OVER w, hi) + coalesce(hi, lag(hi, 2) OVER w, lag(hi, 1) OVER w)"


def steps(src: str, dst: str, keys: str, lifts: list[tuple[str, str]]) -> str:
    """Lifting steps from pairs ``(keys, i, lo, hi)``; the last table is ``dst``."""
    out, last = [], src
    for n, (column, value) in enumerate(lifts):
        name = dst if n + 1 == len(lifts) else f"{dst}_{n}"
        lo, hi = (f"coalesce({value}, lo)", "hi") if column == "lo" else ("lo", value)
        out.append(f"{name} AS (SELECT {keys}, i, {lo} AS lo, {hi} AS hi FROM {last} WINDOW w AS (PARTITION BY {keys} ORDER BY i))")
        last = name
    return ", ".join(out)


def forward(src: str, dst: str, keys: str, at: str, lifts: list[tuple[str, str]]) -> str:
    return f"""{dst}_p AS (SELECT {keys}, {at} // 2 AS i, v AS lo, hi FROM (SELECT *, lead(v) OVER (PARTITION BY {keys} ORDER BY {at}) AS hi FROM {src}) WHERE {at} % 2 = 0),
 {steps(f'{dst}_p', f'{dst}_q', keys, lifts)}, {dst}_n AS (SELECT *, count(*) OVER (PARTITION BY {keys}) AS n FROM {dst}_q),
 {dst} AS (SELECT {keys}, i AS {at}, lo AS v FROM {dst}_n UNION ALL SELECT {keys}, n + i, hi FROM {dst}_n WHERE hi IS NOT NULL)"""


def inverse(src: str, dst: str, keys: str, at: str, lifts: list[tuple[str, str]]) -> str:
    same = " AND ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    return f"""{dst}_o AS (SELECT *, (count(*) OVER (PARTITION BY {keys}) + 1) // 2 AS nl FROM {src}),
 {dst}_p AS (SELECT {', '.join(f'a.{k}' for k in keys.split(', '))}, a.{at} AS i, a.v AS lo, b.v AS hi FROM {dst}_o a LEFT JOIN {dst}_o b ON {same} AND b.{at} = a.{at} + a.nl WHERE a.{at} < a.nl),
 {steps(f'{dst}_p', f'{dst}_q', keys, lifts)},
 {dst} AS (SELECT {keys}, 2 * i AS {at}, lo AS v FROM {dst}_q UNION ALL SELECT {keys}, 2 * i + 1, hi FROM {dst}_q WHERE hi IS NOT NULL)"""


F53 = [("hi", f"hi - ((lo + {RIGHT_LOW}) >> 1)"), ("lo", f"lo + (({HIGHS} + 2) >> 2)")]
I53 = [("lo", f"lo - (({HIGHS} + 2) >> 2)"), ("hi", f"hi + ((lo + {RIGHT_LOW}) >> 1)")]
F97 = [("hi", f"hi + {ALPHA!r}e0 * (lo + {RIGHT_LOW})"), ("lo", f"lo + {BETA!r}e0 * ({HIGHS})"), ("hi", f"hi + {GAMMA!r}e0 * (lo + {RIGHT_LOW})"), ("lo", f"lo + {DELTA!r}e0 * ({HIGHS})"),
       ("lo", f"lo * {1 / K!r}e0"), ("hi", f"hi * {K!r}e0")]


def transform(src: str, dst: str, levels: int, plane: str = "image_id", back: bool = False) -> str:
    """The 5/3 transform of ``src(plane, y, x, v)`` or, ``back``, its inverse."""
    size = " AND ".join(f"d.{k} = z.{k}" for k in plane.split(", "))
    out, data = [f"{dst}_z AS (SELECT {plane}, max(x) + 1 AS zw, max(y) + 1 AS zh FROM {src} GROUP BY {plane})"], src
    for level in reversed(range(levels)) if back else range(levels):
        name = f"{dst}_{level}"
        out.append(f"{name}_d AS (SELECT d.*, d.x < {half('zw', str(level))} AND d.y < {half('zh', str(level))} AS inside FROM (SELECT {plane}, y, x, v FROM {data}) d JOIN {dst}_z z ON {size})")
        out.append(f"{name}_i AS (SELECT {plane}, y, x, v FROM {name}_d WHERE inside)")
        step, lifts = (inverse, I53) if back else (forward, F53)
        (a, b) = ("y", "x") if back else ("x", "y")
        out.append(step(f"{name}_i", f"{name}_a", f"{plane}, {b}", a, lifts))
        out.append(step(f"{name}_a", f"{name}_b", f"{plane}, {a}", b, lifts))
        out.append(f"{name} AS (SELECT {plane}, y, x, v FROM {name}_b UNION ALL SELECT {plane}, y, x, v FROM {name}_d WHERE NOT inside)")
        data = name
    out.append(f"{dst} AS (SELECT {plane}, y, x, v FROM {data})")
    return ", ".join(out)


def sql(select: str, *ctes: str) -> str:
    return f"WITH {', '.join(ctes)} {select}"


def _norms(table: list[list[float]]) -> str:
    return f"[{', '.join('[' + ', '.join(f'{x!r}e0' for x in row) + ']' for row in table)}][o + 1][least(level, CASE WHEN o = 0 THEN 9 ELSE 8 END) + 1]"


COEFFICIENTS = [GRAY, "k AS (SELECT image_id, y, x, (v - 128) * 16 AS v FROM g)", transform("k", "t", 1)]
STEP = "(1 + 512 / 2048.0) * pow(2.0, 3)"
QUANT = f"CAST(sign(v) * floor(abs(v) / ({STEP})) AS BIGINT)"
COMPAT = "CASE WHEN abs(v) >= 2 THEN CAST(sign(v) AS BIGINT) * (abs(v) | 1) ELSE v END"
COMPAT_DECODE = [GRAY, "k AS (SELECT image_id, y, x, v - 128 AS v FROM g)", transform("k", "t", 2), f"l AS (SELECT image_id, y, x, {COMPAT} AS v FROM t)", transform("l", "u", 2, back=True)]
PAIRS = [*COMPAT_DECODE, "e AS (SELECT g.image_id, g.v - (u.v + 128) AS d FROM g JOIN u USING (image_id, y, x))"]
BAND1 = "CASE WHEN x < 4 AND y < 4 THEN 0 WHEN y < 4 THEN 1 WHEN x < 4 THEN 2 ELSE 3 END"
SIDES = {name: f"coalesce({fn}({col}) OVER {win}, 0)" for name, fn, col, win in (("w", "lag", "c", "r"), ("e", "lead", "c", "r"), ("nw", "lag", "n", "r"), ("ne", "lead", "n", "r"), ("sw", "lag", "s", "r"), ("se", "lead", "s", "r"))}


def around(value: str) -> list[str]:
    return [GRAY, f"q AS (SELECT image_id, y, x, CAST({value} AS BIGINT) AS c FROM g)", "r1 AS (SELECT *, coalesce(lag(c) OVER k, 0) AS n, coalesce(lead(c) OVER k, 0) AS s FROM q WINDOW k AS (PARTITION BY image_id, x ORDER BY y))",
            f"a AS (SELECT *, {', '.join(f'{v} AS {k}' for k, v in SIDES.items())} FROM r1 WINDOW r AS (PARTITION BY image_id, y ORDER BY x))",
            "m AS (SELECT *, w + e AS hh, n + s AS vv, nw + ne + sw + se AS dd FROM a)"]


def zc(a: str, b: str) -> str:
    return f"CAST(CASE WHEN {a} = 2 THEN 8 WHEN {a} = 1 AND {b} >= 1 THEN 7 WHEN {a} = 1 AND dd >= 1 THEN 6 WHEN {a} = 1 THEN 5 WHEN {b} = 2 THEN 4 WHEN {b} = 1 THEN 3 WHEN dd >= 2 THEN 2 WHEN dd = 1 THEN 1 ELSE 0 END AS BIGINT)"


ZC_HH = "CAST(CASE WHEN hh + vv >= 3 THEN 8 WHEN hh + vv = 2 AND dd >= 1 THEN 7 WHEN hh + vv = 2 THEN 6 WHEN hh + vv = 1 AND dd >= 2 THEN 5 WHEN hh + vv = 1 AND dd = 1 THEN 4 WHEN hh + vv = 1 THEN 3 WHEN dd >= 2 THEN 2 WHEN dd = 1 THEN 1 ELSE 0 END AS BIGINT)"
ICT3 = [f"CAST({p}e0 AS FLOAT) * r + CAST({q}e0 AS FLOAT) * gg + CAST({s}e0 AS FLOAT) * b" for p, q, s in (("0.299", "0.587", "0.114"), ("-0.16875", "-0.33126", "0.5"), ("0.5", "-0.41869", "-0.08131"))]
FLOATS = "f AS (SELECT image_id, y, x, CAST(c0 - 128 AS FLOAT) AS r, CAST(c1 - 128 AS FLOAT) AS gg, CAST(c2 - 128 AS FLOAT) AS b FROM rgb)"
SAME_RGB = sql("SELECT image_id, y, x, c0, c1, c2 FROM rgb", RGB)
SAME_WIDE = sql("SELECT image_id, y, x, v FROM c", WIDE)
CODED = [RGB, RCT, LONG.format("rct"), transform("t", "u", 1, "image_id, comp"), f"bl AS (SELECT image_id, comp, {BAND1} AS band, max(abs(v)) AS m FROM u GROUP BY ALL)"]
PLANES = "CASE WHEN m = 0 THEN 0 ELSE length(bin(m)) END"
FIVE = ["tt AS (SELECT image_id, comp, CASE WHEN x < 5 AND y < 5 THEN 0 WHEN y < 5 THEN 1 WHEN x < 5 THEN 2 ELSE 3 END AS tile, y % 5 AS y, x % 5 AS x, v FROM t)", transform("tt", "u", 1, "image_id, comp, tile"),
        "z AS (SELECT image_id, comp, tile, (max(x) + 2) // 2 AS lw, (max(y) + 2) // 2 AS lh FROM u GROUP BY ALL)",
        "bl AS (SELECT image_id, comp, tile, CASE WHEN x < lw AND y < lh THEN 0 WHEN y < lh THEN 1 WHEN x < lw THEN 2 ELSE 3 END AS band, max(x) - min(x) + 1 AS cb_w, max(y) - min(y) + 1 AS cb_h, max(abs(v)) AS m FROM u JOIN z USING (image_id, comp, tile) GROUP BY ALL)"]

#: The image that a vector begins.
FILE = "(vec_id // 3)"
STEPSIZES = sql(
        """SELECT image_id, band, exponent, mantissa, (exponent << 11) | mantissa AS packed, round((1 + mantissa / 2048e0) * pow(2, exponent), 6) AS step
 FROM (SELECT *, bits - (p - 13) AS exponent, (CASE WHEN p > 11 THEN s >> (p - 11) ELSE s << (11 - p) END) & 2047 AS mantissa FROM q3)""", SHAPES,
        "q0 AS (SELECT image_id, levels + 1 AS num_res, 8 + image_id % 5 AS prec, image_id % 2 = 0 AS rev, band FROM s, (SELECT unnest(range(16)) AS band) WHERE band <= 3 * levels)",
        "q1 AS (SELECT *, CASE WHEN band = 0 THEN 0 ELSE (band - 1) % 3 + 1 END AS o, num_res - 1 - CASE WHEN band = 0 THEN 0 ELSE (band - 1) // 3 + 1 END AS level FROM q0)",
        f"q2 AS (SELECT *, prec + CASE WHEN NOT rev OR o = 0 THEN 0 WHEN o = 3 THEN 2 ELSE 1 END AS bits, CAST(floor(CASE WHEN rev THEN 1e0 ELSE 1e0 / {_norms(NORMS_97)} END * 8192) AS BIGINT) AS s FROM q1)",
        "q3 AS (SELECT *, length(bin(s)) - 1 AS p FROM q2)")

SQL = {
    "subband_stats": sql(f"SELECT image_id, CAST(comp AS BIGINT) AS comp, CAST({BAND1} AS BIGINT) AS band, max(abs(v)) AS max_abs, CAST(sum(v) AS BIGINT) AS total, count(*) AS n FROM u GROUP BY ALL", RGB, RCT, LONG.format("rct"), transform("t", "u", 1, "image_id, comp")),
    "dc_shift": sql("SELECT image_id, y, x, v - 128 AS v FROM g", GRAY),
    "rct_forward": sql("SELECT image_id, y, x, c0, c1, c2 FROM rct", RGB, RCT),
    "rct_inverse": SAME_RGB,
    "ict_forward": sql(f"SELECT image_id, y, x, {', '.join(f'round(CAST({e} AS DOUBLE), 3) AS c{k}' for k, e in enumerate(ICT3))} FROM f", RGB, FLOATS),
    "ict_roundtrip": sql("SELECT image_id, y, x, c0 - 128 AS c0, c1 - 128 AS c1, c2 - 128 AS c2 FROM rgb", RGB),
    "dwt53_1d": sql("SELECT image_id, y, x, v FROM d", WIDE, forward("c", "d", "image_id, y", "x", F53)),
    "dwt53_1d_inverse": SAME_WIDE,
    "dwt53_2d": sql("SELECT image_id, y, x, v FROM t", GRAY, transform("g", "t", 1)),
    "dwt53_multilevel": sql("SELECT image_id, y, x, v FROM t", WIDE, transform("c", "t", 3)),
    "dwt53_multilevel_inverse": SAME_WIDE,
    "dwt97_1d": sql("SELECT image_id, y, x, round(v, 6) AS v FROM d", WIDE, "f AS (SELECT image_id, y, x, CAST(v AS DOUBLE) AS v FROM c)", forward("f", "d", "image_id, y", "x", F97)),
    "dwt97_roundtrip": sql("SELECT image_id, y, x, CAST(v AS DOUBLE) AS v FROM g", GRAY),
    "resolution_decode": sql("SELECT image_id, y, x, v FROM t WHERE x < 4 AND y < 4", GRAY, transform("g", "t", 1)),
    "block_numbps": sql(
        f"SELECT image_id, CAST(band AS BIGINT) AS band, bx - bx % 16 AS cb_x, byy - byy % 16 AS cb_y, CAST({PLANES.replace('m', 'max(abs(v))')} AS BIGINT) AS numbps, count(*) AS n FROM p GROUP BY image_id, band, bx - bx % 16, byy - byy % 16",
        WIDE, transform("c", "t", 1), "z AS (SELECT image_id, (max(x) + 2) // 2 AS lw, (max(y) + 2) // 2 AS lh FROM c GROUP BY ALL)",
        "p AS (SELECT image_id, CASE WHEN x < lw AND y < lh THEN 0 WHEN y < lh THEN 1 WHEN x < lw THEN 2 ELSE 3 END AS band, CASE WHEN x < lw THEN x ELSE x - lw END AS bx, CASE WHEN y < lh THEN y ELSE y - lh END AS byy, v FROM t JOIN z USING (image_id))"),
    "tile_grid": sql("""SELECT image_id, tile, (tile % across) * tile_w AS x0, (tile // across) * tile_h AS y0, least((tile % across + 1) * tile_w, w) AS x1, least((tile // across + 1) * tile_h, h) AS y1
 FROM (SELECT *, (w + tile_w - 1) // tile_w AS across, (h + tile_h - 1) // tile_h AS down FROM s), (SELECT unnest(range(64)) AS tile) WHERE tile < across * down""", SHAPES),
    "resolution_sizes": sql(f"SELECT image_id, r AS reduce, {half('w', 'r')} AS w, {half('h', 'r')} AS h FROM s, (SELECT unnest(range(6)) AS r) WHERE r <= levels", SHAPES),
    "subband_layout": sql("SELECT image_id, CAST(band AS BIGINT) AS band, orient, CAST(level AS BIGINT) AS level, CAST(x_off AS BIGINT) AS x_off, CAST(y_off AS BIGINT) AS y_off, w, h FROM b", SHAPES, BANDS),
    "band_dimensions": sql("SELECT orient, CAST(level AS BIGINT) AS level, count(*) AS bands, CAST(sum(w * h) AS BIGINT) AS samples, max(w) AS max_w, max(h) AS max_h FROM b GROUP BY ALL", SHAPES, BANDS),
    "codeblock_grid": sql("""SELECT image_id, CAST(band AS BIGINT) AS band, CAST(i * cblk_w AS BIGINT) AS cb_x, CAST(j * cblk_h AS BIGINT) AS cb_y, least(cblk_w, w - i * cblk_w) AS cb_w, least(cblk_h, h - j * cblk_h) AS cb_h
 FROM b, (SELECT unnest(range(8)) AS i), (SELECT unnest(range(8)) AS j) WHERE i * cblk_w < w AND j * cblk_h < h""", SHAPES, BANDS),
    "codeblock_count": sql("SELECT image_id, count(*) AS bands, CAST(sum(CASE WHEN w > 0 AND h > 0 THEN ((w + cblk_w - 1) // cblk_w) * ((h + cblk_h - 1) // cblk_h) ELSE 0 END) AS BIGINT) AS blocks FROM b GROUP BY ALL", SHAPES, BANDS),
    "packet_counts": sql("SELECT image_id, CAST(sum(n_precincts * layers) AS BIGINT) AS n_packets, max(res) + 1 AS max_res, max(n_precincts) AS max_precincts FROM p GROUP BY ALL", SHAPES, PRECINCTS),
    "tagtree_min": sql("SELECT image_id, CAST(l AS BIGINT) AS level, y >> l AS y, x >> l AS x, min(v) AS value FROM g, (SELECT unnest(range(4)) AS l) GROUP BY ALL", GRAY),
    "tagtree_roundtrip": sql("SELECT image_id, y, x, v >> 4 AS value FROM g", GRAY),
    "quantize_band": sql(f"SELECT image_id, y, x, {QUANT} AS q FROM t", *COEFFICIENTS),
    "dequantize_band": sql(f"SELECT image_id, y, x, CASE WHEN q = 0 THEN 0 ELSE CAST(round(sign(q) * (abs(q) + 0.5) * ({STEP})) AS BIGINT) END AS v FROM (SELECT *, {QUANT} AS q FROM t)", *COEFFICIENTS),
    "no_quantize": sql("SELECT image_id, y, x, v >> 2 AS v FROM t", *COEFFICIENTS),
    "stepsizes": STEPSIZES,
    "band_norms": sql(f"SELECT image_id, CAST(band AS BIGINT) AS band, {_norms(NORMS_53)} AS norm_53, {_norms(NORMS_97)} AS norm_97 FROM (SELECT *, list_position(['LL', 'HL', 'LH', 'HH'], orient) - 1 AS o FROM b)", SHAPES, BANDS),
    "lsb_compat": sql(f"SELECT image_id, y, x, {COMPAT} AS v FROM t", *COEFFICIENTS),
    "compat_decode": sql("SELECT image_id, y, x, v + 128 AS v FROM u", *COMPAT_DECODE),
    "psnr": sql("SELECT image_id, CASE WHEN sum(d * d) > 0 THEN round(10 * log10(65025e0 * count(*) / CAST(sum(d * d) AS DOUBLE)), 6) END AS psnr, count(*) AS n FROM e GROUP BY image_id", *PAIRS),
    "max_abs_error": sql("SELECT image_id, max(abs(d)) AS max_error, CAST(sum(d * d) AS BIGINT) AS sse FROM e GROUP BY image_id", *PAIRS),
    "region_crop": sql("SELECT image_id, y - 3 AS y, x - 10 AS x, v FROM c WHERE x >= 10 AND x < 43 AND y >= 3 AND y < 21", WIDE),
    "zc_contexts": sql(f"SELECT image_id, y, x, {zc('hh', 'vv')} AS zc_ll, {zc('vv', 'hh')} AS zc_hl, {ZC_HH} AS zc_hh FROM m", *around("v >= 140")),
    "sc_contexts": sql("""SELECT image_id, y, x, CAST(CASE WHEN hh = 0 AND vv = 0 THEN 0 WHEN hh = 0 OR vv = 0 THEN 3 WHEN (hh > 0) = (vv > 0) THEN 4 ELSE 2 END AS BIGINT) AS ctx, CAST(hh < 0 OR (hh = 0 AND vv < 0) AS BIGINT) AS flip FROM m""",
                       *around("CASE WHEN v >= 140 THEN 1 WHEN v < 116 THEN -1 ELSE 0 END")),
    "parameter_columns": sql(f"""SELECT image_id, CAST(CASE WHEN w <= 1 THEN 0 ELSE length(bin(w)) - 1 END AS BIGINT) AS log2_w, CAST(length(bin(h)) AS BIGINT) AS bits_h, 1 + 3 * levels AS n_bands,
 ['LRCP', 'RLCP', 'RPCL', 'PCRL', 'CPRL'][image_id % 7 + 1] AS progression, (w + tile_w - 1) // tile_w AS across, {half('tile_h', 'levels')} AS reduced_origin FROM s""", SHAPES),
    "detect_format": f"SELECT {FILE} AS image_id, CASE {FILE} % 3 WHEN 0 THEN 'jp2' WHEN 1 THEN 'j2k' END AS format FROM embeddings WHERE vec_id % 3 = 0",
    "cblk_roundtrip": sql("SELECT image_id, y, x, v FROM t", GRAY, "k AS (SELECT image_id, y, x, v - 128 AS v FROM g)", transform("k", "t", 1)),
    "tile_payload": sql(f"""SELECT image_id, CAST(tile AS BIGINT) AS tile, CAST(comp AS BIGINT) AS comp, CAST(band AS BIGINT) AS band, CAST(0 AS BIGINT) AS cb_x, CAST(0 AS BIGINT) AS cb_y, cb_w, cb_h,
 CAST({PLANES} AS BIGINT) AS numbps, CAST(CASE WHEN m = 0 THEN 0 ELSE 3 * length(bin(m)) - 2 END AS BIGINT) AS num_passes, CAST(1 AS BIGINT) AS n FROM bl""", RGB, RCT, LONG.format("rct"), *FIVE),
    "j2k_roundtrip": SAME_RGB,
    "jp2_roundtrip": SAME_RGB,
    "region_decode": sql("SELECT image_id, y - 1 AS y, x - 2 AS x, c0, c1, c2 FROM rgb WHERE x >= 2 AND x < 4 AND y >= 1 AND y < 6", RGB),
    "reduced_decode": sql("SELECT image_id, y, x, v + 128 AS v FROM t WHERE x < 4 AND y < 4", GRAY, "k AS (SELECT image_id, y, x, v - 128 AS v FROM g)", transform("k", "t", 1)),
    "file_headers": "SELECT DISTINCT vec_id // 3 AS image_id, 8::BIGINT AS width, 8::BIGINT AS height, 5::BIGINT AS tile_w, 5::BIGINT AS tile_h, 3::BIGINT AS n_comps, 1::BIGINT AS layers, 2::BIGINT AS levels, 64::BIGINT AS cblk_w, 64::BIGINT AS cblk_h, 0::BIGINT AS quant_style, true AS mct, true AS reversible, 7::BIGINT AS n_steps FROM embeddings WHERE vec_id % 3 = 0",
    "stepsizes_unpacked": sql("SELECT image_id, band, packed >> 11 AS exponent, packed & 2047 AS mantissa FROM u", f"u AS ({STEPSIZES})"),
    "colour_norms": sql(f"SELECT image_id, comp, coalesce(CASE WHEN image_id % 2 = 0 THEN {NORMS_MCT}[comp + 1] ELSE {NORMS_MCT_REAL}[comp + 1] END, 1.0)::DOUBLE AS norm FROM s, (SELECT unnest(range(4)) AS comp) WHERE comp <= image_id % 4", SHAPES),
    "tagtree_sizes": sql("""SELECT image_id, w, h, count(*) AS n_levels, CAST(sum(lw * lh) AS BIGINT) AS n_nodes
 FROM (SELECT *, CAST(ceil(w / pow(2, l)) AS BIGINT) AS lw, CAST(ceil(h / pow(2, l)) AS BIGINT) AS lh FROM n, (SELECT unnest(range(12)) AS l) WHERE l = 0 OR pow(2, l - 1) < greatest(w, h)) GROUP BY image_id, w, h""",
                         SHAPES, "n AS (SELECT image_id, (w + cblk_w - 1) // cblk_w AS w, (h + cblk_h - 1) // cblk_h AS h FROM s)"),
    "file_colours": f"SELECT {FILE} AS image_id, 8::BIGINT AS height, 8::BIGINT AS width, 3::BIGINT AS n_comps, 7::BIGINT AS bpc, 1::BIGINT AS method, 16::BIGINT AS enum_cs FROM embeddings WHERE vec_id % 3 = 0",
    "file_capabilities": f"SELECT {FILE} AS image_id, {FILE} % 2 = 1 AS high_throughput FROM embeddings WHERE vec_id % 3 = 0",
    "file_errors": f"SELECT {FILE} AS image_id, 'OutOfBounds' AS kind FROM embeddings WHERE vec_id % 3 = 0 AND {FILE} % 3 = 1",
    "region_errors": f"SELECT {FILE} AS image_id, 'OutOfBounds' AS kind FROM embeddings WHERE vec_id % 3 = 0",
    "region_subsampled": sql("""SELECT image_id, comp::BIGINT AS comp, y // d - 1 // d AS y, x // d - 3 // d AS x, v FROM (SELECT *, CASE WHEN comp = 0 THEN 1 ELSE 2 END AS d FROM t)
 WHERE x % d = 0 AND y % d = 0 AND x // d >= 3 // d AND x // d < (6 + d - 1) // d AND y // d >= 1 // d AND y // d < (7 + d - 1) // d""", RGB, LONG.format("rgb")),
    "mixed_decode": """SELECT vec_id AS image_id, vec_id % 6 AS levels, (vec_id // 6) % 2 = 0 AS lossless, 64::BIGINT AS n, CASE WHEN (vec_id // 6) % 2 = 0 THEN 0::BIGINT END AS max_error, true AS near FROM embeddings""",
    "tile_index": f"SELECT {FILE} AS image_id, t AS tile, 1::BIGINT AS n, true AS \"full\", 3::BIGINT AS tile_w FROM embeddings, (SELECT unnest(range(6)) AS t) WHERE vec_id % 3 = 0",
    "region_ranged": sql("SELECT image_id, y - 1 AS y, x - 2 AS x, c0, c1, c2 FROM rgb WHERE x >= 2 AND x < 4 AND y >= 1 AND y < 6", RGB),
    "region_bytes": f"SELECT {FILE} AS image_id, 4::BIGINT AS tiles, 2::BIGINT AS hits, true AS fewer FROM embeddings WHERE vec_id % 3 = 0",
    "rate_choice": sql("""SELECT image_id, band, max(k) AS kept FROM (SELECT *, sum(cost) OVER (PARTITION BY image_id ORDER BY worth DESC, band, k) AS spent FROM w) WHERE spent <= 200 GROUP BY ALL""", *COEFFICIENTS,
                       "c AS (SELECT image_id, CASE WHEN x >= 4 THEN 1 ELSE 0 END + CASE WHEN y >= 4 THEN 2 ELSE 0 END AS band, abs(v)::BIGINT AS m, b FROM t, (SELECT unnest(range(13)) AS b))",
                       """e AS (SELECT image_id, band::BIGINT AS band, 13 - b AS k, sum(CASE WHEN m >> b > 0 THEN 1 ELSE 0 END) AS cost, sum((m & ((2::BIGINT << b) - 1)) ** 2 - (m & ((1::BIGINT << b) - 1)) ** 2) AS gain FROM c GROUP BY ALL)""",
                       "w AS (SELECT *, min(gain::DOUBLE / (cost + 1)) OVER (PARTITION BY image_id, band ORDER BY k) AS worth FROM e)"),
    "rate_limited": "SELECT vec_id // 16 AS part, true AS within, 192 * count(*) AS n, true AS falls FROM embeddings GROUP BY ALL",
    "refinement_contexts": sql("""SELECT image_id, band, y, x, b AS bit, CASE WHEN m >> (b + 2) > 0 THEN 16 WHEN greatest(w, e, n, s, nw, ne, sw, se) >> b > 0 THEN 15 ELSE 14 END::BIGINT AS ctx
 FROM a, (SELECT unnest(range(16)) AS b) WHERE m >> (b + 1) > 0""", *COEFFICIENTS,
                               "q AS (SELECT image_id, (CASE WHEN x >= 4 THEN 1 ELSE 0 END + CASE WHEN y >= 4 THEN 2 ELSE 0 END)::BIGINT AS band, y % 4 AS y, x % 4 AS x, abs(v >> 4) AS m FROM t)",
                               "r AS (SELECT *, coalesce(lag(m) OVER k, 0) AS n, coalesce(lead(m) OVER k, 0) AS s FROM q WINDOW k AS (PARTITION BY image_id, band, x ORDER BY y))",
                               f"a AS (SELECT *, {', '.join(f'{v} AS {k}' for k, v in SIDES.items()).replace('(c)', '(m)')} FROM r WINDOW r AS (PARTITION BY image_id, band, y ORDER BY x))"),
    "tagtree_grids": sql("""SELECT image_id, l AS level, y >> l AS y, x >> l AS x, min((image_id * 31 + y * 17 + x * 7) % 23) AS value
 FROM n, (SELECT unnest(range(12)) AS l), (SELECT unnest(range(64)) AS y), (SELECT unnest(range(64)) AS x) WHERE y < h AND x < w AND (l = 0 OR (1 << (l - 1)::INTEGER) < greatest(w, h)) GROUP BY ALL""",
                         SHAPES, "n AS (SELECT image_id, (w + cblk_w - 1) // cblk_w AS w, (h + cblk_h - 1) // cblk_h AS h FROM s)"),
    "subsampled_roundtrip": sql("SELECT image_id, comp::BIGINT AS comp, y // d AS y, x // d AS x, v FROM (SELECT *, CASE WHEN comp = 0 THEN 1 ELSE 2 END AS d FROM t) WHERE x % d = 0 AND y % d = 0", RGB, LONG.format("rgb")),
    "region_subsampled_decode": sql("""SELECT image_id, comp::BIGINT AS comp, y // d - 1 // d AS y, x // d - 3 // d AS x, v FROM (SELECT *, CASE WHEN comp = 0 THEN 1 ELSE 2 END AS d FROM t)
 WHERE x % d = 0 AND y % d = 0 AND x // d >= 3 // d AND x // d < (6 + d - 1) // d AND y // d >= 1 // d AND y // d < (7 + d - 1) // d""", RGB, LONG.format("rgb")),
    "file_markers": f"""SELECT image_id, CASE WHEN image_id % 3 = 1 THEN 16 ELSE 8 END::BIGINT AS box_header, m.m AS marker, (m.o + CASE WHEN m.late AND image_id % 2 = 1 THEN 10 ELSE 0 END)::BIGINT AS "offset", m.l::BIGINT AS length FROM (SELECT {FILE} AS image_id FROM embeddings WHERE vec_id % 3 = 0),
 (SELECT unnest([{{'m': 'SOC', 'o': 0, 'l': 0, 'late': false}}, {{'m': 'SIZ', 'o': 2, 'l': 47, 'late': false}}, {{'m': 'CAP', 'o': 51, 'l': 8, 'late': false}}, {{'m': 'COD', 'o': 51, 'l': 12, 'late': true}}, {{'m': 'QCD', 'o': 65, 'l': 10, 'late': true}}, {{'m': 'SOT', 'o': 77, 'l': 10, 'late': true}}]) AS m)
 WHERE m.m <> 'CAP' OR image_id % 2 = 1""",
    "file_boxes": """SELECT vec_id // 3 AS image_id, b.type AS "type", CAST(b.o AS BIGINT) AS "offset", CAST(b.l AS BIGINT) AS length, b.parent AS parent FROM embeddings,
 (SELECT unnest([{'type': 'jP  ', 'o': 8, 'l': 4, 'parent': ''}, {'type': 'ftyp', 'o': 20, 'l': 12, 'parent': ''}, {'type': 'jp2h', 'o': 40, 'l': 37, 'parent': ''}, {'type': 'ihdr', 'o': 48, 'l': 14, 'parent': 'jp2h'}, {'type': 'colr', 'o': 70, 'l': 7, 'parent': 'jp2h'}, {'type': 'jp2c', 'o': 85, 'l': NULL, 'parent': ''}]) AS b) WHERE vec_id % 3 = 0""",
    "t2_packets": sql(f"""SELECT image_id, CAST(comp AS BIGINT) AS comp, CAST(band AS BIGINT) AS band, CAST(0 AS BIGINT) AS k, CAST({PLANES} AS BIGINT) AS planes, CAST(CASE WHEN m = 0 THEN 0 ELSE 3 * length(bin(m)) - 2 END AS BIGINT) AS num_passes FROM bl""", *CODED),
} | {
    f"packets_{o}": sql(f"""SELECT image_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY {', '.join(keys)}) - 1 AS BIGINT) AS seq, layer, res, comp, precinct
 FROM p, (SELECT unnest(range(2)) AS layer), (SELECT unnest(range(3)) AS precinct) WHERE layer < layers AND precinct < n_precincts""", SHAPES, PRECINCTS) for o, keys in ORDERS.items()
}
