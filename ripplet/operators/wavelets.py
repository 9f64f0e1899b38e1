"""Wavelet transforms on lines as arrays.

A line is a row ``(*keys, v array)``. A step splits it into its low and its high band and lifts them
with higher-order functions, so nothing is shuffled. At the ends a half band's neighbour is the next
nearest of its own: the sample after a missing left one, the one before a missing right one.

A level of a plane lifts its rows, transposes them by chunks of columns, and lifts the columns. Its
three high bands are set aside as pieces; only the low band goes on to the next level. So a level
shuffles what the level before left over, and one row or column is the largest unit of a task, a
chunk of columns the largest group. The levels and the wavelet of a plane may be columns of its rows:
a plane that has no more levels leaves the plan.

A piece is a run of one band's samples: ``(*plane, level, orient, x, y, down, v, x_off, y_off)`` with its
start in the band, its direction, and where the band begins in the transformed plane.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Lifting steps and scale of the 9/7 wavelet.
ALPHA, BETA, GAMMA, DELTA, K = -1.586134342, -0.052980118, 0.882911075, 0.443506852, 1.230174105

#: Columns that are transposed together.
CHUNK = 64
#: ``53``, ``97``, or the name of a boolean column that is true where it is 5/3; then samples are doubles.
Wavelet = str


def _lo_beside(s: str) -> str:
    """For each high sample of bands ``s`` the sum of its low neighbours."""
    beyond = f"coalesce(get({s}.lo, size({s}.lo) - 2), get({s}.lo, 0))"
    return f"slice(zip_with({s}.lo, concat(slice({s}.lo, 2, size({s}.lo)), array({beyond})), (a, b) -> a + b), 1, size({s}.hi))"


def _hi_beside(s: str) -> str:
    """For each low sample of bands ``s`` the sum of its high neighbours."""
    first, last = f"coalesce(get({s}.hi, 1), get({s}.hi, 0))", f"coalesce(get({s}.hi, size({s}.hi) - 2), get({s}.hi, 0))"
    return f"slice(zip_with(concat(array({first}), {s}.hi), concat({s}.hi, array({last})), (a, b) -> a + b), 1, size({s}.lo))"


def _steps(wavelet: Wavelet, sign: str) -> list[tuple[str, str]]:
    """The lifting steps in forward order: which band changes, and how a sample ``x`` does by the sum ``n`` of its neighbours."""
    minus, plus = ("-", "+") if sign == "+" else ("+", "-")
    if wavelet == "53":
        return [("hi", f"x {minus} shiftright(n, 1)"), ("lo", f"x {plus} shiftright(n + 2, 2)")]
    real = [(("hi", "lo")[k % 2], f"x {plus} {factor!r}D * n") for k, factor in enumerate((ALPHA, BETA, GAMMA, DELTA))]
    if wavelet == "97":
        return real
    whole = [f"x {minus} floor(n / 2)", f"x {plus} floor((n + 2) / 4)", "x", "x"]
    return [(band, f"cast(if({wavelet}, {f}, {g}) as double)") for (band, g), f in zip(real, whole, strict=True)]


def _with(value: str, name: str, then: str) -> str:
    """``then``, in which ``name`` stands for ``value``, which is worked out once."""
    return f"get(transform(array({value}), {name} -> {then}), 0)"


def _lifted(bands: str, steps: list[tuple[str, str]]) -> str:
    """Bands after the steps in turn; a line of one sample has no high band and stays as it is."""
    for band, change in steps:
        beside = _lo_beside("s") if band == "hi" else _hi_beside("s")
        own = f"if(size(s.hi) = 0, s.{band}, zip_with(s.{band}, {beside}, (x, n) -> {change}))"
        lo, hi = ("s.lo", own) if band == "hi" else (own, "s.hi")
        bands = _with(bands, "s", f"named_struct('lo', {lo}, 'hi', {hi})")
    return bands


def _scaled(bands: str, wavelet: Wavelet, lo: float, hi: float) -> str:
    if wavelet == "53":
        return bands
    keep = "size(s.hi) = 0" + ("" if wavelet == "97" else f" or {wavelet}")
    parts = ", ".join(f"'{band}', if({keep}, s.{band}, transform(s.{band}, x -> x * {factor!r}D))" for band, factor in (("lo", lo), ("hi", hi)))
    return _with(bands, "s", f"named_struct({parts})")


def split_of(v: str, wavelet: Wavelet) -> str:
    """SQL of the bands, a struct of ``lo`` and ``hi``, of an array."""
    bands = f"named_struct('lo', filter({v}, (x, i) -> i % 2 = 0), 'hi', filter({v}, (x, i) -> i % 2 = 1))"
    return _scaled(_lifted(bands, _steps(wavelet, "+")), wavelet, 1 / K, K)


def joined_of(bands: str, wavelet: Wavelet) -> str:
    """SQL of the array whose bands are the struct ``bands``."""
    done = _lifted(_scaled(bands, wavelet, K, 1 / K), _steps(wavelet, "-")[::-1])
    return _with(done, "s", "flatten(zip_with(s.lo, s.hi, (a, b) -> if(b is null, array(a), array(a, b))))")


def halves_of(v: str) -> str:
    """SQL of the bands of an array whose low band stands before its high band."""
    n = f"int((size({v}) + 1) div 2)"
    return f"named_struct('lo', slice({v}, 1, {n}), 'hi', slice({v}, {n} + 1, size({v})))"


def forward(lines: DataFrame, wavelet: Wavelet = "53") -> DataFrame:
    """Lines ``(…, v)`` with their low band before their high band."""
    return lines.withColumn("v", F.expr(_with(split_of("v", wavelet), "b", "concat(b.lo, b.hi)")))


def inverse(lines: DataFrame, wavelet: Wavelet = "53") -> DataFrame:
    """Lines from their low band before their high band."""
    return lines.withColumn("v", F.expr(joined_of(halves_of("v"), wavelet)))


def gathered(samples: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Lines ``(*keys, v)`` of samples ``(*keys, at, v)``."""
    return samples.groupBy(*keys).agg(F.expr(f"transform(sort_array(collect_list(struct({at}, v))), p -> p.v)").alias("v"))


def scattered(lines: DataFrame, keys: list[str], at: str) -> DataFrame:
    return lines.selectExpr(*keys, f"posexplode(v) as ({at}, v)").withColumn(at, F.col(at).cast("long"))


def transposed(lines: DataFrame, keys: list[str], at: str, other: str) -> DataFrame:
    """Lines ``(*keys, other, v)`` down a plane from all lines ``(*keys, at, v)`` across it, by a shuffle of chunks."""
    cut = lines.selectExpr(*keys, at, f"inline(transform(sequence(1, size(v), {CHUNK}), (i, j) -> named_struct('_c', j, 'part', slice(v, i, {CHUNK}))))")
    stacked = cut.groupBy(*keys, "_c").agg(F.expr(f"transform(sort_array(collect_list(struct({at}, part))), p -> p.part)").alias("rows"))
    column = f"named_struct('{other}', cast(_c * {CHUNK} + k as bigint), 'v', transform(rows, r -> get(r, k)))"
    return stacked.selectExpr(*keys, f"inline(transform(sequence(0, size(get(rows, 0)) - 1), k -> {column}))")


def decompose(lines: DataFrame, plane: list[str], levels: int, wavelet: Wavelet = "53", own_levels: str | None = None) -> DataFrame:
    """The pieces of all bands of planes ``lines(*plane, y, v)``, after ``levels`` levels, or after as many as the column ``own_levels`` says, at most that."""
    n, out, rows = own_levels or str(levels), None, lines
    if own_levels or not levels:
        out = lines.where(f"{n} = 0").selectExpr(*plane, "0 as level", "'LL' as orient", "0L as x", "bigint(y) as y", "false as down", "v", "0L as x_off", "0L as y_off")
        rows = lines.where(f"{n} > 0")
    for level in range(1, levels + 1):
        across = rows.selectExpr(*plane, "bigint((size(v) + 1) div 2) as _low", "y", f"{_with(split_of('v', wavelet), 'b', 'concat(b.lo, b.hi)')} as v")
        columns = transposed(across, [*plane, "_low"], "y", "x").selectExpr(*plane, "_low", "x", f"{split_of('v', wavelet)} as b")
        piece = lambda o, x, v, dx, dy: f"named_struct('level', {level}, 'orient', '{o}', 'x', {x}, 'y', 0L, 'down', true, 'v', b.{v}, 'x_off', {dx}, 'y_off', bigint({dy}))"  # noqa: B023, E731
        left = f"array({piece('LH', 'x', 'hi', '0L', 'size(b.lo)')}, if({n} = {level}, {piece('LL', 'x', 'lo', '0L', '0')}, null))"
        right = f"array({piece('HL', 'x - _low', 'lo', '_low', '0')}, {piece('HH', 'x - _low', 'hi', '_low', 'size(b.lo)')})"
        made = columns.selectExpr(*plane, f"inline(filter(if(x < _low, {left}, {right}), p -> size(p.v) > 0))")
        out = made if out is None else out.unionByName(made)
        if level < levels:
            rows = transposed(columns.where(f"x < _low and {n} > {level}").selectExpr(*plane, "x", "b.lo as v"), plane, "x", "y")
    return out


def compose(
    pieces: Callable[[int], DataFrame], plane: list[str], levels: int, wavelet: Wavelet = "53", reduce: int = 0, size: tuple[str, str] = ("tw", "th"),
) -> DataFrame:
    """Rows ``(*plane, y, v)`` of planes from ``pieces(level)``, the pieces ``(*plane, orient, x, y, v)`` down each band of a level, the low one of planes that end there included.

    ``size`` has expressions of a plane's size. The finest ``reduce`` levels are left out; planes that have no more levels than that are not among the rows.
    """
    current = None
    for level in range(levels, reduce, -1):
        low = f"ceil({size[0]} / {1 << level})"
        columns = pieces(level).selectExpr(*plane, f"bigint(x + if(orient in ('HL', 'HH'), {low}, 0)) as x", "orient in ('LH', 'HH') as second", "bigint(y) as y", "v")
        if current is not None:
            columns = columns.unionByName(current.selectExpr(*plane, "x", "false as second", "0L as y", "v"))
        held = columns.groupBy(*plane, "x").agg(F.expr("sort_array(collect_list(struct(second, y, v)))").alias("parts"))
        part = lambda which: f"flatten(transform(filter(parts, p -> {which}), p -> p.v))"
        bands = f"named_struct('lo', {part('not p.second')}, 'hi', {part('p.second')})"
        down = held.selectExpr(*plane, "x", f"{joined_of(bands, wavelet)} as v")
        rows = inverse(transposed(down, plane, "x", "y"), wavelet)
        if level > reduce + 1:
            current = transposed(rows, plane, "y", "x")
    return rows


def placed(pieces: DataFrame, plane: list[str]) -> DataFrame:
    """Samples ``(*plane, y, x, v)`` of pieces, at their places in the transformed plane."""
    each = pieces.selectExpr(*plane, "y + y_off as y", "x + x_off as x", "down", "posexplode(v) as (i, v)")
    return each.selectExpr(*plane, "y + if(down, i, 0) as y", "x + if(down, 0, i) as x", "v")


def cut_bands(samples: DataFrame, plane: list[str], levels: int, size: tuple[str, str]) -> Callable[[int], DataFrame]:
    """The pieces of transformed planes ``samples(*plane, y, x, v)`` of a size, for ``compose``: each sample is one."""

    def pieces(level: int) -> DataFrame:
        lw, lh, w, h = (F.ceil(F.expr(size[k]) / (1 << n)).cast("long") for n in (level, level - 1) for k in (0, 1))
        inside = (F.col("x") < w) & (F.col("y") < h)
        right, below = F.col("x") >= lw, F.col("y") >= lh
        wanted = inside if level == levels else inside & (right | below)
        orient = F.when(right & below, "HH").when(right, "HL").when(below, "LH").otherwise("LL")
        return samples.where(wanted).select(
            *plane, orient.alias("orient"), (F.col("x") - F.when(right, lw).otherwise(0)).alias("x"),
            (F.col("y") - F.when(below, lh).otherwise(0)).alias("y"), F.array("v").alias("v"),
        )

    return pieces


def transform_2d(
    samples: DataFrame, levels: int, wavelet: Wavelet = "53", back: bool = False, plane: tuple[str, ...] = ("image_id", "comp"),
    size: tuple[str, str] | None = None,
) -> DataFrame:
    """Transform ``samples(*plane, y, x, v)`` by ``levels`` levels, rows then columns, or back.

    Back needs ``size``, expressions of the width and height of a sample's plane. Every plane has its
    own size. For a lower resolution, transform the samples of its low band back by as many levels fewer.
    """
    keys = list(plane)
    if not levels:
        return samples.select(*keys, "y", "x", "v")
    data = samples.withColumn("v", F.col("v").cast("double")) if wavelet == "97" else samples
    if not back:
        return placed(decompose(gathered(data, [*keys, "y"], "x"), keys, levels, wavelet), keys)
    if size is None:
        raise ValueError("size: what the planes' sizes are")
    return scattered(compose(cut_bands(data, keys, levels, size), keys, levels, wavelet, size=size), [*keys, "y"], "x")


def _line_step(back: bool, wavelet: Wavelet) -> Callable[[DataFrame, list[str], str], DataFrame]:
    def step(samples: DataFrame, keys: list[str], at: str) -> DataFrame:
        data = samples.withColumn("v", F.col("v").cast("double")) if wavelet == "97" else samples
        lines = gathered(data, keys, at)
        done = inverse(lines, wavelet) if back else forward(lines, wavelet)
        return scattered(done, keys, at)

    return step


#: One step on the lines of ``samples(*keys, at, v)`` with given keys: forward leaves the low band in front of the high one.
forward_53, inverse_53, forward_97, inverse_97 = (_line_step(back, w) for w in ("53", "97") for back in (False, True))
