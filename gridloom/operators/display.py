"""Tables behind plots: decimated cells with levels or breaks, and covariance footprints."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.kernels import correlation
from gridloom.model import Grid, Params, present
from gridloom.operators.index import layer as one_layer
from gridloom.operators.index import up_scale

#: Distinct names that a display may have.
NAMES = 10_000


def pretty(low: float, high: float, n: int = 5) -> list[float]:
    """About n round ticks that cover a range."""
    if not high > low:
        return [low]
    raw = (high - low) / n
    unit = 10 ** math.floor(math.log10(raw))
    step = min((m * unit for m in (1, 2, 5, 10)), key=lambda s: abs(math.log(s / raw)))
    a, b = math.floor(low / step + 1e-9), math.ceil(high / step - 1e-9)
    return [round(k * step, 12) for k in range(a, b + 1)]


def heatmap(grid: Grid, layer: int = 1, px_max: int = 2000, n_colour: int = 1000) -> tuple[Grid, DataFrame | None, list]:
    """The grid to draw (decimated over px_max lines), its cells with a colour level, and the legend's entries.

    Logical cells have the levels false and true; strings their sorted distinct values; integers each whole number
    from least to greatest; other numbers n_colour equal steps with round ticks; one value gives one level.
    """
    if grid.cells is None:
        return grid, None, []
    g = one_layer(grid, layer) if grid.layered else grid
    up = tuple(max(1, math.ceil(n / px_max)) for n in g.dim)
    if max(up) > 1:
        g = up_scale(g, up)
    cells = present(g.cells)
    kind = g.cells.schema["v"].dataType.typeName()
    if kind == "boolean":
        return g, cells.withColumn("level", F.col("v").cast("int") + 1), [False, True]
    if kind == "string":
        names = sorted(r[0] for r in cells.select("v").distinct().limit(NAMES + 1).collect())
        if len(names) > NAMES:
            raise ValueError(f"over {NAMES} distinct names are no levels of a display")
        return g, cells.withColumn("level", F.array_position(F.lit(names), F.col("v")).cast("int")), names
    low, high = cells.agg(F.min("v"), F.max("v")).first()
    if low is None:
        return g, None, []
    if low == high:
        return g, cells.withColumn("level", F.lit(1)), [low]
    if kind in ("integer", "long", "short", "byte"):
        return g, cells.withColumn("level", (F.col("v") - low + 1).cast("int")), list(range(low, high + 1))
    level = F.least(F.floor((F.col("v") - low) / (high - low) * n_colour) + 1, F.lit(n_colour)).cast("int")
    return g, cells.withColumn("level", level), pretty(low, high)


def footprint(spark: SparkSession, params: Params, grid: Grid | None = None, n: int = 101) -> DataFrame:
    """(i, j, dy, dx, cov) around a centre cell; the nugget at lag zero only.

    Without a grid, n x n cells (n odd) whose outer lines have a correlation of about the root of 0.05.
    """
    n += 1 - n % 2
    if grid is None:
        far = {}
        for a, axis in (("y", params.y), ("x", params.x)):
            d = np.linspace(axis.rho / 100, axis.rho * 10, 1000)
            far[a] = float(d[np.abs(correlation(axis, d) - math.sqrt(0.05)).argmin()]) / (n // 2)
        grid = Grid(n, n, far["y"], far["x"])
    ci, cj = (grid.ny + 1) // 2, (grid.nx + 1) // 2
    i, j = np.mgrid[1 : grid.ny + 1, 1 : grid.nx + 1]
    dy, dx = grid.dy * np.abs(i - ci), grid.dx * np.abs(j - cj)
    cov = params.psill * correlation(params.y, dy.ravel()) * correlation(params.x, dx.ravel())
    cov += params.eps * ((i == ci) & (j == cj)).ravel()
    return spark.createDataFrame([tuple(map(float, r)) for r in zip(i.ravel(), j.ravel(), dy.ravel(), dx.ravel(), cov)], "i double, j double, dy double, dx double, cov double").select(F.col("i").cast("int"), F.col("j").cast("int"), "dy", "dx", "cov")
