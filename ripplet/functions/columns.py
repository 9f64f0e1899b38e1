"""Columns of the pointwise steps; everything stays inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Norms of the synthesis filters by orientation (LL, HL, LH, HH) and level, and of the colour transforms.
NORMS_53 = [
    [1.000, 1.500, 2.750, 5.375, 10.68, 21.34, 42.67, 85.33, 170.7, 341.3],
    [1.038, 1.592, 2.919, 5.703, 11.33, 22.64, 45.25, 90.48, 180.9, 0.0],
    [1.038, 1.592, 2.919, 5.703, 11.33, 22.64, 45.25, 90.48, 180.9, 0.0],
    [0.7186, 0.9218, 1.586, 3.043, 6.019, 12.01, 24.00, 47.97, 95.93, 0.0],
]
NORMS_97 = [
    [1.000, 1.965, 4.177, 8.403, 16.90, 33.84, 67.69, 135.3, 270.6, 540.9],
    [2.022, 3.989, 8.355, 17.04, 34.27, 68.63, 137.3, 274.6, 549.0, 0.0],
    [2.022, 3.989, 8.355, 17.04, 34.27, 68.63, 137.3, 274.6, 549.0, 0.0],
    [2.080, 3.865, 8.307, 17.18, 34.71, 69.59, 139.3, 278.6, 557.2, 0.0],
]
NORMS_MCT, NORMS_MCT_REAL = [1.732, 0.8292, 0.8292], [1.732, 1.805, 1.573]
PROGRESSIONS = ["LRCP", "RLCP", "RPCL", "PCRL", "CPRL"]
ICT = [[0.299, 0.587, 0.114], [-0.16875, -0.33126, 0.5], [0.5, -0.41869, -0.08131]]


def ceil_div(a: Column, b: Column | int) -> Column:
    b = b if isinstance(b, Column) else F.lit(b)
    return F.ceil(a / b).cast("long")


def log2_floor(v: Column) -> Column:
    """Integer logarithm; 0 for values up to 1."""
    return F.when(v <= 1, F.lit(0)).otherwise(F.length(F.bin(v)) - 1).cast("long")


def bit_length(v: Column) -> Column:
    return F.when(v == 0, F.lit(0)).otherwise(F.length(F.bin(v))).cast("long")


def progression(code: Column) -> Column:
    """The progression order of a code, null for unknown ones."""
    return F.get(F.array(*map(F.lit, PROGRESSIONS)), code.cast("int"))


def rct_forward(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    return F.shiftright(r + 2 * g + b, 2), b - g, r - g


def rct_inverse(y: Column, cb: Column, cr: Column) -> tuple[Column, Column, Column]:
    g = y - F.shiftright(cb + cr, 2)
    return cr + g, g, cb + g


def _f32(x: float) -> Column:
    return F.lit(x).cast("float")


def ict_forward(r: Column, g: Column, b: Column) -> tuple[Column, ...]:
    """The irreversible transform in single precision."""
    r, g, b = (c.cast("float") for c in (r, g, b))
    return tuple(_f32(p) * r + _f32(q) * g + _f32(s) * b for p, q, s in ICT)


def ict_inverse(y: Column, cb: Column, cr: Column) -> tuple[Column, Column, Column]:
    return y + _f32(1.402) * cr, y - _f32(0.34413) * cb - _f32(0.71414) * cr, y + _f32(1.772) * cb


def step_size(exponent: Column, mantissa: Column, guard_bits: Column | int = 0) -> Column:
    return (1 + mantissa / 2048) * F.pow(F.lit(2.0), exponent - guard_bits)


def pack_step(exponent: Column, mantissa: Column) -> Column:
    return F.shiftleft(exponent, 11).bitwiseOR(mantissa.bitwiseAND(F.lit(0x7FF)))


def unpack_step(packed: Column) -> tuple[Column, Column]:
    """Exponent and mantissa of a step size's 16-bit form."""
    return F.shiftright(packed, 11), packed.bitwiseAND(F.lit(0x7FF))


def colour_norm(comp: Column, reversible: Column) -> Column:
    """The norm of a component of a colour transform; components past the third have none (1)."""
    of = lambda table: F.coalesce(F.get(F.array(*map(F.lit, table)), comp.cast("int")), F.lit(1.0))
    return F.when(reversible, of(NORMS_MCT)).otherwise(of(NORMS_MCT_REAL))


def quantize(c: Column, step: Column) -> Column:
    return (F.signum(c.cast("double")) * F.floor(F.abs(c) / step)).cast("long")


def dequantize(q: Column, step: Column) -> Column:
    """Midpoint reconstruction, rounded half away from zero."""
    return F.when(q == 0, F.lit(0)).otherwise(F.round(F.signum(q.cast("double")) * (F.abs(q) + 0.5) * step)).cast("long")


def no_quantize(c: Column, guard_bits: int) -> Column:
    return F.shiftright(c, guard_bits)


def lsb_compat(c: Column) -> Column:
    """What a coefficient is after coding with the lost last bit: magnitudes of 2 and more get it set."""
    return F.when(F.abs(c) >= 2, F.signum(c.cast("double")).cast("long") * F.abs(c).bitwiseOR(F.lit(1))).otherwise(c)


def norm(table: list[list[float]], orient: Column, level: Column) -> Column:
    """A norm by orientation and level; levels past the table's end take its last entry."""
    rows = F.array(*[F.array(*map(F.lit, row)) for row in table])
    return F.get(F.get(rows, orient.cast("int")), F.least(level, F.when(orient == 0, F.lit(9)).otherwise(F.lit(8))).cast("int"))


def step_sizes(params: DataFrame) -> DataFrame:
    """``(…, band, exponent, mantissa)`` for each band of ``params(num_res, precision, reversible, …)``."""
    bands = params.withColumn("band", F.explode(F.sequence(F.lit(0), (3 * F.col("num_res") - 3).cast("int"))))
    orient = F.when(F.col("band") == 0, F.lit(0)).otherwise((F.col("band") - 1) % 3 + 1)
    level = F.col("num_res") - 1 - F.when(F.col("band") == 0, F.lit(0)).otherwise(F.expr("(band - 1) div 3 + 1"))
    gain = F.when(~F.col("reversible") | (orient == 0), F.lit(0)).when(orient == 3, F.lit(2)).otherwise(F.lit(1))
    raw = F.when(F.col("reversible"), F.lit(1.0)).otherwise(F.lit(1.0) / norm(NORMS_97, orient, level))
    scaled = bands.withColumn("s", F.floor(raw * 8192).cast("long")).withColumn("p", log2_floor(F.col("s"))).withColumn("bits", F.col("precision") + gain)
    mantissa = F.expr("case when p > 11 then shiftright(s, cast(p - 11 as int)) else shiftleft(s, cast(11 - p as int)) end").bitwiseAND(F.lit(0x7FF))
    return scaled.select(
        *params.columns, F.col("band").cast("long").alias("band"), (F.col("bits") - (F.col("p") - 13)).cast("long").alias("exponent"),
        mantissa.alias("mantissa"),
    )
