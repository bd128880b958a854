"""Summaries of grids, variogram bin statistics and block occupancy."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.model import Grid, completeness, present

_REDUCERS: dict[str, Callable[[Column], Column]] = {"max": F.max, "min": F.min, "sum": F.sum, "prod": F.product, "mean": F.avg, "any": lambda v: F.bool_or(v.cast("boolean")), "all": lambda v: F.bool_and(v.cast("boolean"))}


def _values(grid: Grid) -> DataFrame:
    cells = present(grid.cells)
    return cells.select(F.explode("v").alias("v")) if grid.layered else cells.select("v")


def summarise(grid: Grid, names: list[str], na_rm: bool = False) -> DataFrame:
    """Reductions over all cells and layers, as one row. Without na_rm a missing cell makes the result missing.

    any and all follow three-valued logic: a true (false) cell decides despite missing ones.
    """
    layers = F.max(F.size("v")) if grid.layered else F.max(F.lit(1))
    n_layer = present(grid.cells).agg(layers).first()[0] or 1
    whole = F.count("*") == len(grid) * n_layer
    out = []
    for name in names:
        if name == "range":
            out += [F.when(F.lit(na_rm) | whole, f("v")).alias(a) for a, f in (("range_min", F.min), ("range_max", F.max))]
            continue
        r = _REDUCERS[name](F.col("v"))
        decided = {"any": r, "all": ~r}.get(name)
        ok = F.lit(na_rm) | whole if decided is None else F.lit(na_rm) | whole | decided
        out.append(F.when(ok, r).alias(name))
    return _values(grid).agg(*out)


def describe(grid: Grid) -> DataFrame:
    """One row: completeness, counts, range, resolution and extent."""
    low_y, high_y, low_x, high_x = grid.extent
    v = F.col("v").cast("double")
    spread = F.max(v) - F.min(v)
    digits = F.least(F.greatest(F.lit(3), F.coalesce(F.rint(-F.log10(F.when(spread > 0, spread))), F.lit(0.0)).cast("int")), F.lit(12))
    layers = 1
    n = F.count("*")
    cells = present(grid.cells)
    if grid.layered:
        layers = cells.select(F.size("v")).limit(1).first()
        layers = layers[0] if layers else 1
    seen = n / layers
    kind = F.when(n == 0, "empty").when(seen == len(grid), "complete").otherwise("incomplete")
    meta = [F.lit(grid.ny).alias("ny"), F.lit(grid.nx).alias("nx"), F.lit(grid.dy).alias("dy"), F.lit(grid.dx).alias("dx"), F.lit(low_y).alias("y_from"), F.lit(high_y).alias("y_to"), F.lit(low_x).alias("x_from"), F.lit(high_x).alias("x_to")]
    return _values(grid).agg(kind.alias("completeness"), seen.cast("long").alias("n_observed"), F.lit(len(grid)).alias("n"), F.lit(layers).alias("n_layer"), F.min(v).alias("least"), F.max(v).alias("greatest"), digits.alias("digits"), *meta)


def line(grid: Grid) -> str:
    """One line about a grid."""
    kind = completeness(grid).value
    what = "" if grid.cells is None else f" of {'layers' if grid.layered else grid.cells.schema['v'].dataType.simpleString()}"
    return f"{grid.ny} x {grid.nx} {kind} grid{what}"


def sample_variance(grid: Grid) -> float:
    row = _values(grid).agg(F.var_samp("v")).first()
    return float(row[0]) if row[0] is not None else 1.0


# -- variogram bins

_STATISTICS: dict[str, Callable[[], Column]] = {
    "classical": lambda: F.avg(F.col("dabs") * F.col("dabs")),
    "root_mean": lambda: F.pow(F.avg(F.sqrt("dabs")), F.lit(4.0)) / (0.457 + 0.494 / F.count("*")),
    "root_median": lambda: F.pow(F.percentile(F.sqrt("dabs"), F.lit(0.5)), F.lit(4.0)) / 0.457,
}


def bin_statistics(pairs: DataFrame, stat: str | Column = "classical") -> DataFrame:
    """(bin, n, d_mean, stat) of variogram pairs; stat is a name, an aggregate Column over dabs, or a grouped pandas UDF of it."""
    value = _STATISTICS[stat]() if isinstance(stat, str) else stat
    return pairs.groupBy("bin").agg(F.count("*").alias("n"), F.avg("d").alias("d_mean"), value.alias("stat"))


# -- blocks


def occupancy(grid: Grid, factor: int) -> Grid:
    """Whether any cell of each factor x factor block is true; partial blocks at the far ends are dropped."""
    from dataclasses import replace

    ny, nx = grid.ny // factor, grid.nx // factor
    block = lambda c: (F.floor((F.col(c) - 1) / factor) + 1).cast("int")
    cells = grid.cells.select(block("i").alias("i"), block("j").alias("j"), F.col("v").cast("boolean").alias("v")).where((F.col("i") <= ny) & (F.col("j") <= nx))
    return replace(grid, ny=ny, nx=nx, dy=grid.dy * factor, dx=grid.dx * factor, cells=cells.groupBy("i", "j").agg(F.bool_or("v").alias("v")))


def occupancy_bias(grid: Grid, factors: list[int], true_area: float) -> DataFrame:
    """(factor, n_occupied, bias): by how much the area of occupied blocks is over the true one, as a share."""
    spark, f = grid.cells.sparkSession, F.col("factor")
    table = spark.createDataFrame([(int(x),) for x in factors], "factor int")
    yes = grid.cells.where(F.col("v").cast("boolean"))
    bi, bj = F.floor((F.col("i") - 1) / f), F.floor((F.col("j") - 1) / f)
    blocks = yes.withColumn("factor", F.explode(F.lit([int(x) for x in factors]))).where((bi < F.floor(F.lit(grid.ny) / f)) & (bj < F.floor(F.lit(grid.nx) / f))).select("factor", bi.alias("bi"), bj.alias("bj")).distinct()
    n = blocks.groupBy("factor").agg(F.count("*").alias("n_occupied"))
    area = grid.dy * grid.dx
    n_occ = F.coalesce("n_occupied", F.lit(0)).cast("long")
    return table.join(n, "factor", "left").select("factor", n_occ.alias("n_occupied"), ((n_occ * f * f * area - true_area) / true_area).alias("bias"))
