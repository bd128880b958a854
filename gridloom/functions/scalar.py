"""Cell-wise functions: mathematics, arithmetic, comparison, logic and casts, all as Columns.

Missing stays missing. Division and powers never raise under ANSI mode: x / 0 is an infinity or NaN as in floating
point. Only the gamma family has no built-in form; it is a series of Column operations, so it stays in the JVM too.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.model import Grid

NAN, INF = float("nan"), float("inf")


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x)) if isinstance(x, (int, float)) and not isinstance(x, bool) else F.lit(x)


def divide(a, b) -> Column:
    """Floating division: x / 0 is signed infinity, 0 / 0 is NaN."""
    a, b = _c(a).cast("double"), _c(b).cast("double")
    return F.when(b != 0, a / F.when(b != 0, b)).when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when((a == 0) | F.isnan(a), NAN).otherwise(F.when(a > 0, INF).otherwise(-INF))


def floor_mod(a, b) -> Column:
    """The remainder that has the divisor's sign."""
    a, b = _c(a).cast("double"), _c(b).cast("double")
    return F.when(b == 0, F.lit(NAN)).otherwise(a - b * F.floor(a / F.when(b != 0, b)).cast("double"))


def floor_div(a, b) -> Column:
    b = _c(b).cast("double")
    q = divide(a, b)
    return F.when(b == 0, q).otherwise(F.floor(F.when(b != 0, q)).cast("double"))


def trunc(v: Column) -> Column:
    return F.when(v < 0, F.ceil(v)).otherwise(F.floor(v)).cast("double")


def signif(v: Column, digits: int = 6) -> Column:
    """v rounded to so many significant digits, half to even on the scaled number."""
    e = F.floor(F.log10(F.abs(F.when(v != 0, v))))
    scale = F.pow(F.lit(10.0), F.lit(digits - 1) - e)
    return F.when(v == 0, 0.0).otherwise(F.rint(v * scale) / scale)


def _log(v: Column) -> Column:
    return F.when(v == 0, -INF).when(v < 0, NAN).otherwise(F.log(F.when(v > 0, v)))


def _guarded(f: Callable[[Column], Column], ok: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda v: F.when(ok(v), f(F.when(ok(v), v))).when(v.isNotNull(), NAN)


# The coefficients of a Lanczos approximation (g = 7, nine terms), as published by Godfrey.
_LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
    12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
)


def _lgamma_right(x: Column) -> Column:
    """log gamma for x >= 0.5."""
    z = x - 1.0
    series = F.lit(_LANCZOS[0])
    for k, c in enumerate(_LANCZOS[1:], 1):
        series = series + F.lit(c) / (z + float(k))
    t = z + 7.5
    return 0.5 * math.log(2 * math.pi) + (z + 0.5) * F.log(t) - t + F.log(series)


def _pole(v: Column) -> Column:
    return (v <= 0) & (v == F.floor(v).cast("double"))


def lgamma(v: Column) -> Column:
    """log of the absolute value of the gamma function; infinite at its poles."""
    low, right = v < 0.5, F.when(v >= 0.5, v)
    mirror = F.when(low & ~_pole(v), v)
    left = F.log(F.lit(math.pi) / F.abs(F.sin(math.pi * mirror))) - _lgamma_right(1.0 - mirror)
    return F.when(_pole(v), INF).when(low, left).otherwise(_lgamma_right(right))


def gamma(v: Column) -> Column:
    """Gamma function, NaN at its poles; whole numbers up to 20 by their factorials."""
    sign = F.when((v < 0) & (F.pmod(F.floor(v), F.lit(2)) == 1), -1.0).otherwise(1.0)
    whole = (v >= 1) & (v <= 21) & (v == F.floor(v).cast("double"))
    fact = F.factorial(F.when(whole, v - 1).cast("int")).cast("double")
    return F.when(_pole(v), NAN).when(whole, fact).otherwise(sign * F.exp(lgamma(F.when(~_pole(v) & ~whole, v))))


def _shifted(v: Column, order: int) -> tuple[Column, Column]:
    """v moved up past 10 by the recurrence, and the sum of the steps' terms 1 / x^order."""
    steps = F.greatest(F.lit(0), F.ceil(F.lit(10.0) - v)).cast("int")
    terms = F.aggregate(F.sequence(F.lit(0), steps), F.lit(0.0), lambda a, k: a + F.when(k < steps, F.lit(1.0) / F.pow(v + k, F.lit(float(order)))).otherwise(0.0))
    return v + steps, terms


def _digamma_right(v: Column) -> Column:
    x, s = _shifted(v, 1)
    r = 1 / (x * x)
    return F.log(x) - 0.5 / x - r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r * (1 / 240 - r * (1 / 132 - r * (691 / 32760 - r / 12)))))) - s


def _trigamma_right(v: Column) -> Column:
    x, s = _shifted(v, 2)
    r = 1 / (x * x)
    return 1 / x + r / 2 + r / x * (1 / 6 - r * (1 / 30 - r * (1 / 42 - r * (1 / 30 - r * (5 / 66 - r * (691 / 2730 - r * (7 / 6))))))) + s


def digamma(v: Column) -> Column:
    up, down = F.when(v > 0, v), F.when((v <= 0) & ~_pole(v), v)
    return F.when(_pole(v), NAN).when(v > 0, _digamma_right(up)).otherwise(_digamma_right(1 - down) - math.pi / F.tan(math.pi * down))


def trigamma(v: Column) -> Column:
    up, down = F.when(v > 0, v), F.when((v <= 0) & ~_pole(v), v)
    return F.when(_pole(v), INF).when(v > 0, _trigamma_right(up)).otherwise(F.pow(math.pi / F.sin(math.pi * down), F.lit(2.0)) - _trigamma_right(1 - down))


#: The functions that apply to a grid, by name; anything else is an error.
MATH: dict[str, Callable[[Column], Column]] = {
    "abs": F.abs, "sign": F.signum, "sqrt": _guarded(F.sqrt, lambda v: v >= 0), "floor": lambda v: F.floor(v).cast("double"), "ceiling": lambda v: F.ceil(v).cast("double"), "trunc": trunc,
    "round": F.rint, "signif": signif, "exp": F.exp, "log": _log, "expm1": F.expm1, "log1p": lambda v: F.when(v == -1, -INF).when(v < -1, NAN).otherwise(F.log1p(F.when(v > -1, v))),
    "cos": F.cos, "sin": F.sin, "tan": F.tan, "cospi": lambda v: F.cos(v * math.pi), "sinpi": lambda v: F.sin(v * math.pi), "tanpi": lambda v: F.tan(v * math.pi),
    "acos": F.acos, "asin": F.asin, "atan": F.atan, "lgamma": lgamma, "gamma": gamma, "digamma": digamma, "trigamma": trigamma,
}

ARITHMETIC: dict[str, Callable[[Column, Column], Column]] = {
    "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": divide, "^": lambda a, b: F.pow(a, b), "%%": floor_mod, "%/%": floor_div,
}
COMPARISON: dict[str, Callable[[Column, Column], Column]] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
}
LOGIC: dict[str, Callable[[Column, Column], Column]] = {"&": lambda a, b: a.cast("boolean") & b.cast("boolean"), "|": lambda a, b: a.cast("boolean") | b.cast("boolean")}
BINARY = ARITHMETIC | COMPARISON | LOGIC


def _each(grid: Grid, f: Callable[[Column], Column]) -> DataFrame:
    v = F.transform("v", f) if grid.layered else f(F.col("v"))
    return grid.cells.withColumn("v", v)


def math_function(grid: Grid, name: str, digits: int | None = None) -> Grid:
    """One of MATH on every cell and layer; round and signif take digits."""
    if name not in MATH:
        raise ValueError(f"{name} does not apply to grids")
    f = MATH[name]
    if digits is not None:
        f = {"round": lambda v: F.bround(v, digits), "signif": lambda v: signif(v, digits)}[name]
    return grid.with_cells(_each(grid, f))


def combine(one: Grid, op: str, other: Grid | float | bool) -> Grid:
    """A binary operation with a number, or with a grid of equal dimensions, cell by cell.

    Cells that only one of the grids has are missing in the result; & and | follow three-valued logic, so there
    a cell of one side can decide alone. Metadata are those of the second grid, if there is one.
    """
    f = BINARY[op]
    if not isinstance(other, Grid):
        b = _c(other)
        return one.with_cells(_each(one, lambda v: f(v, b)))
    if one.dim != other.dim:
        raise ValueError("grids differ in dimensions")
    a, b = one.cells.select("i", "j", F.col("v").alias("_a")), other.cells.select("i", "j", F.col("v").alias("_b"))
    both = a.join(b, ["i", "j"], "full" if op in LOGIC else "inner")
    if one.layered and other.layered:
        v = F.zip_with("_a", "_b", f)
    elif one.layered:
        v = F.transform("_a", lambda x: f(x, F.col("_b")))
    elif other.layered:
        v = F.transform("_b", lambda x: f(F.col("_a"), x))
    else:
        v = f(F.col("_a"), F.col("_b"))
    return other.with_cells(both.select("i", "j", v.alias("v")).where("v is not null"))


def negate(grid: Grid) -> Grid:
    return grid.with_cells(_each(grid, lambda v: F.lit(0.0) - v))


def logical_not(grid: Grid) -> Grid:
    return grid.with_cells(_each(grid, lambda v: ~v.cast("boolean")))


def cast(grid: Grid, kind: str) -> Grid:
    """Cells as boolean, double or int; int drops the fraction, and is missing beyond its range."""
    if kind not in ("boolean", "double", "int"):
        raise ValueError("cells are cast to boolean, double or int")
    f = (lambda v: v.try_cast("int")) if kind == "int" else (lambda v: v.cast(kind))
    return grid.with_cells(_each(grid, f).where("v is not null"))


def back_transform(prediction: str = "p", variance: str = "v") -> Column:
    """The mean of a log-normal value: exp(p + v / 2)."""
    return F.exp(F.col(prediction) + F.col(variance) / 2)


def standardise(df: DataFrame, *columns: str) -> DataFrame:
    """Columns minus their mean, over their sample standard deviation; one aggregate, joined as one row."""
    stats = df.agg(*(f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_samp)))).first()
    return df.withColumns({c: (F.col(c) - stats[f"_m_{c}"]) / stats[f"_s_{c}"] for c in columns})
