"""Samples of cells and of cell pairs, distance bins, and theoretical variograms."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.kernels import correlation, correlation_column
from gridloom.model import Grid, Params, present, spine

BINS = 25


def model(params: Params, dy: Column, dx: Column, standard: bool = False) -> Column:
    """The variogram at offsets: 2 eps + psill (1 - cy cx); ``standard``: twice the whole semi-variogram."""
    part = params.psill * (1 - correlation_column(params.y, dy) * correlation_column(params.x, dx))
    return 2 * params.eps + (2 * part if standard else part)


def envelope(params: Params, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest variogram at distances d, over the directions along y, along x and diagonal."""
    d = np.asarray(d, float)
    s = d / math.sqrt(2)
    one, rest = (lambda a, u: correlation(a, u)), np.zeros_like(d)
    rows = [2 * params.eps + params.psill * (1 - one(params.y, a) * one(params.x, b)) for a, b in ((d, rest), (rest, d), (s, s))]
    return np.minimum.reduce(rows), np.maximum.reduce(rows)


def _order(grid: Grid, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), grid.k())


def sample_cells(grid: Grid, n: int = 100, seed: int = 0, inner: int = 0) -> DataFrame:
    """(r, i, j) of n observed cells (all cells of an empty grid), without replacement, in a hash order of their index.

    ``inner`` keeps that many lines from the borders. The top n come by a bounded heap in each task.
    """
    cells = present(grid.cells) if grid.cells is not None and grid.cells.limit(1).count() else None
    if cells is None:
        raise ValueError("use sample_centres with a session for a grid without data")
    return _ranked(cells, grid, n, seed, inner)


def _ranked(cells: DataFrame, grid: Grid, n: int, seed: int, inner: int = 0) -> DataFrame:
    inside = F.col("i").between(inner + 1, grid.ny - inner) & F.col("j").between(inner + 1, grid.nx - inner)
    top = cells.where(inside).orderBy(_order(grid, seed), grid.k()).limit(n)
    return top.withColumn("r", F.row_number().over(Window.orderBy(_order(grid, seed), grid.k())))  # n rows


def neighbourhoods(spark, grid: Grid, n: int, lag_max: int, up: int = 0, over: bool = False, seed: int = 0) -> DataFrame:
    """(centre, i, j, v) of square neighbourhoods of radius lag_max, every up+1 lines, around n inner cells.

    Unless ``over``, centres are spread evenly over the (up+1) squared classes of line remainders, so that
    neighbourhoods of different classes share no cell.
    """
    sep = up + 1
    if lag_max % sep:
        raise ValueError("up + 1 must divide lag_max")
    if grid.ny - 2 * lag_max <= 0 or grid.nx - 2 * lag_max <= 0:
        raise ValueError("lag_max is too large for the grid")
    seen = present(grid.cells) if grid.cells is not None else spine(spark, grid)
    inside = F.col("i").between(lag_max + 1, grid.ny - lag_max) & F.col("j").between(lag_max + 1, grid.nx - lag_max)
    pool = seen.select("i", "j").where(inside).withColumn("h", _order(grid, seed))
    if not over and sep > 1:
        # water-filling: the r-th centre of each class comes before the r+1-th of any other
        w = Window.partitionBy((F.col("i") % sep).alias("ci"), (F.col("j") % sep).alias("cj")).orderBy("h")
        pool = pool.withColumn("round", F.row_number().over(w)).where(F.col("round") <= n)
        pool = pool.orderBy("round", "h").limit(n)
    else:
        pool = pool.orderBy("h").limit(n)
    steps = list(range(-lag_max, lag_max + 1, sep))
    near = pool.select(grid.k().alias("centre"), "i", "j").select("centre", F.explode(F.lit(steps)).alias("di"), "i", "j").select("centre", "di", F.explode(F.lit(steps)).alias("dj"), "i", "j")
    cells = near.select("centre", (F.col("i") + F.col("di")).alias("i"), (F.col("j") + F.col("dj")).alias("j"))
    return cells.join(grid.cells, ["i", "j"], "left") if grid.cells is not None else cells.withColumn("v", F.lit(None).cast("double"))


def points_for_pairs(n_pp: int, n_obs: int) -> int:
    """The least number of points with n_pp pairs or just fewer, at most n_obs."""
    return min((1 + math.isqrt(1 + 8 * n_pp)) // 2, n_obs)


def pairs(grid: Grid, n_pp: int = 10_000, n_bin: int = BINS, n_layer_max: int | None = None, seed: int = 0) -> DataFrame:
    """Pairs of sampled cells with their absolute difference, offsets, distance and bin.

    The sample has about sqrt(2 n_pp) cells, so the pair join is bounded by n_pp, whatever the grid's size. With
    layers, the same pairs are taken in the root of their number, chosen by hash.
    """
    n_obs = present(grid.cells).count()
    s = sample_cells(grid, points_for_pairs(n_pp, n_obs), seed).select("r", "i", "j", "v").withColumn("k", grid.k())
    if grid.layered:
        size = s.select(F.size("v")).first()
        n_layer = size[0] if size else 0
        take = min(n_layer, n_layer_max or math.ceil(math.sqrt(n_layer)))
        order = F.array_sort(F.transform(F.sequence(F.lit(1), F.lit(n_layer)), lambda m: F.struct(F.xxhash64(F.lit(seed), m).alias("h"), m.alias("m"))))
        s = s.withColumn("lyr", F.explode(F.slice(order["m"], 1, take))).withColumn("v", F.element_at("v", F.col("lyr")))
    else:
        s = s.withColumn("lyr", F.lit(1))
    a, b = s.alias("a"), s.alias("b")
    both = a.join(F.broadcast(b), (F.col("a.lyr") == F.col("b.lyr")) & (F.col("a.r") > F.col("b.r")))
    di, dj = F.abs(F.col("b.i") - F.col("a.i")), F.abs(F.col("b.j") - F.col("a.j"))
    out = both.select(
        F.abs(F.col("b.v") - F.col("a.v")).alias("dabs"), F.col("a.k").alias("p1"), F.col("b.k").alias("p2"), F.col("a.i").alias("p1_i"), F.col("a.j").alias("p1_j"), F.col("b.i").alias("p2_i"), F.col("b.j").alias("p2_j"),
        di.alias("di"), dj.alias("dj"), (di * grid.dy).alias("dy"), (dj * grid.dx).alias("dx"), F.col("a.lyr").alias("lyr"),
    )
    return add_bins(out.withColumn("d", F.sqrt(F.col("dy") * F.col("dy") + F.col("dx") * F.col("dx"))), n_bin)


def add_bins(rows: DataFrame, n_bin: int = BINS, probs: list[float] | None = None, width: bool = False) -> DataFrame:
    """rows with the bin of d: intervals between exact quantiles (linear interpolation), closed on the left.

    The greatest distance lies beyond the last break, in bin n_bin + 1. ``width``: equal widths instead. More bins
    than rows are reduced to the rows; one bin takes everything.
    """
    n = rows.count()
    n_bin = min(n_bin, max(n, 1))
    if n_bin == 1 and probs is None:
        return rows.withColumn("bin", F.lit(1))
    if width:
        low, high = rows.agg(F.min("d"), F.max("d")).first()
        return rows.withColumn("bin", F.least(F.width_bucket("d", F.lit(low), F.lit(high), F.lit(n_bin)), F.lit(n_bin)).cast("int"))
    probs = probs or [k / n_bin for k in range(n_bin + 1)]
    breaks = rows.agg(F.percentile("d", F.lit([float(p) for p in probs])).alias("_b"))  # one row of n_bin + 1 numbers
    return rows.crossJoin(F.broadcast(breaks)).withColumn("bin", F.size(F.filter("_b", lambda b: b <= F.col("d")))).drop("_b")


def semivariogram(rows: DataFrame, params: Params | None = None, d_max: float | None = None, stat: str = "classical", n_ribbon: int = 100) -> tuple[DataFrame, DataFrame | None]:
    """Bins with half of their statistic for d < d_max (default: the greatest d), and half of the model's envelope."""
    from gridloom.operators.aggregate import bin_statistics

    top = float(d_max if d_max is not None else rows.agg(F.max("d")).first()[0])
    bins = bin_statistics(rows.where(F.col("d") < top), stat).withColumn("stat", F.col("stat") / 2)
    if params is None:
        return bins, None
    d = np.linspace(0, top, n_ribbon)
    low, high = envelope(params, d)
    ribbon = rows.sparkSession.createDataFrame([(float(a), float(b) / 2, float(c) / 2) for a, b, c in zip(d, low, high)], "d double, low double, high double")
    return bins, ribbon
