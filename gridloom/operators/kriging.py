"""Generalised least squares, kriging predictions and their variances.

The observed cells (or the lattice they form) are factored once on the driver. Every output cell then needs its
own row of the cross-covariance only, so output tiles are computed where they are needed, each from the small
factor. Trend and covariates are added as Columns, joined by (i, j).
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.kernels import first_row
from gridloom.model import Grid, Mean, Params
from gridloom.plans.linalg import N_MAX, Dense, Separable, listed_power, run_tiles, toeplitz_cells
from gridloom.plans.strategy import Observed, TooMany, collect

#: Cross-covariance entries that a tile holds at once.
TILE_ENTRIES = 4_000_000


@dataclass
class Trend:
    """Coefficients (averaged over layers), the design's inverse cross product, and the design at the observed cells."""

    b: np.ndarray
    by_layer: np.ndarray
    inverse: np.ndarray
    design: np.ndarray
    whitened: np.ndarray  # V^-1 X


def design(obs: Observed, mean: Mean) -> np.ndarray:
    """The observed cells' design: an intercept, and covariates matched by (i, j)."""
    one = np.ones((len(obs.i), 1))
    if mean.kind != "covariates":
        return one
    x = _aligned(obs, mean.value, "x")
    if np.isnan(x).any():
        raise ValueError("a covariate is missing at an observed cell")
    return np.hstack([one, x])


def _aligned(obs: Observed, table: DataFrame, column: str) -> np.ndarray:
    """A column of a table (i, j, column) at the observed cells, a row each; NaN where it is missing."""
    got = obs.grid.cells.select("i", "j").join(table.select("i", "j", column), ["i", "j"]).toArrow().combine_chunks()
    values = got.column(column).combine_chunks()
    if pa.types.is_list(values.type):
        width = len(values[0]) if len(values) else 1
        if pa.compute.any(pa.compute.not_equal(pa.compute.fill_null(pa.compute.list_value_length(values), -1), width)).as_py():
            raise ValueError("a covariate is missing at an observed cell")
        values = values.flatten()
    else:
        width = 1
    x = values.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, width)
    key = lambda i, j: np.asarray(i, np.int64) + np.int64(obs.grid.ny) * (np.asarray(j, np.int64) - 1)
    there = key(got.column("i").to_numpy(), got.column("j").to_numpy())
    order, want = np.argsort(there), key(obs.i, obs.j)
    at = np.minimum(np.searchsorted(there[order], want), max(0, len(there) - 1))
    out = np.full((len(want), width), np.nan)
    if len(there):
        hit = there[order][at] == want
        out[hit] = x[order][at[hit]]
    return out


def gls(obs: Observed, factor: Dense | Separable, mean: Mean) -> Trend:
    if len(obs.i) < 2:
        raise ValueError("a trend needs two observed cells or more")
    x = design(obs, mean)
    hx, hz = factor.half(x), factor.half(obs.z)
    inverse = np.linalg.inv(hx.T @ hx)
    by_layer = inverse @ (hx.T @ hz)
    return Trend(by_layer.mean(1), by_layer, inverse, x, factor.power(x))


def gls_coefficients(grid: Grid, params: Params, mean: Mean = Mean.constant(), method: str = "eigen") -> np.ndarray:
    obs = collect(grid)
    return gls(obs, obs.factor(params, method), mean).b


def linear_predictor(spark: SparkSession, grid: Grid, b: np.ndarray, mean: Mean) -> DataFrame:
    """(i, j, v): the trend at all cells (those with covariates)."""
    from gridloom.model import spine

    if mean.kind != "covariates":
        return spine(spark, grid).withColumn("v", F.lit(float(b[0])))
    return mean.value.select("i", "j", _dot(F.col("x"), b).alias("v"))


def _dot(x: Column, b: np.ndarray) -> Column:
    terms = [F.get(x, F.lit(k)) * float(c) for k, c in enumerate(b[1:])]
    return reduce(lambda a, t: a + t, terms, F.lit(float(b[0])))


def _tile_function(obs: Observed, params: Params, grid: Grid, factor: Dense | Separable, w: np.ndarray, vx: np.ndarray | None, variance: bool):
    """f(tile) and the number of tiles: spread weights, V^-1 X products and quadratic forms of a run of output cells."""
    n, io, jo, lines = len(obs.i), obs.i, obs.j, obs.lines
    grid = replace(grid, cells=None)  # tasks get numbers only
    cy, cx = first_row(params.y, grid.ny, grid.dy), first_row(params.x, grid.nx, grid.dx)
    psill, layers, p = params.psill, w.shape[1], 0 if vx is None else vx.shape[1]
    right = np.hstack([w, vx]) if p else w

    def batch(i: np.ndarray, j: np.ndarray, s: np.ndarray, q: np.ndarray | None) -> pa.RecordBatch:
        out = {"i": i.astype(np.int32), "j": j.astype(np.int32)}
        out |= {f"s{k}": s[:, k] for k in range(layers)} | {f"a{k}": s[:, layers + k] for k in range(p)}
        return pa.RecordBatch.from_pydict(out | ({"q": q} if q is not None else {}))

    if isinstance(factor, Separable):
        li, lj = (np.array(lines[a]) for a in "ij")
        m = [c.reshape(len(lj), len(li)).T for c in right.T]
        b = cx[np.abs(np.arange(1, grid.nx + 1)[:, None] - lj[None, :])]  # nx x lattice columns
        mb = [psill * (x @ b.T) for x in m]  # lattice rows x nx, small beside the output
        ev = 1 / factor.values
        qy, evb = factor.qy, ev @ ((b @ factor.qx) ** 2).T
        rows = max(1, 100_000 // grid.nx)

        def lattice(t: int):
            i = np.arange(t * rows + 1, min(grid.ny, (t + 1) * rows) + 1)
            a = cy[np.abs(i[:, None] - li[None, :])]
            s = np.stack([(a @ x).ravel() for x in mb], 1)
            q = (psill**2 * ((a @ qy) ** 2 @ evb)).ravel() if variance else None
            yield batch(np.repeat(i, grid.nx), np.tile(np.arange(1, grid.nx + 1), len(i)), s, q)

        return lattice, -(-grid.ny // rows)

    half = (factor.inverse if factor.method == "chol" else (factor.vectors / np.sqrt(factor.values)).T) if variance else None
    size = max(1, TILE_ENTRIES // max(1, n))

    def listed(t: int):
        k = np.arange(t * size, min(len(grid), (t + 1) * size))
        i, j = k % grid.ny + 1, k // grid.ny + 1
        c = psill * cy[np.abs(i[:, None] - io[None, :])] * cx[np.abs(j[:, None] - jo[None, :])]
        yield batch(i, j, c @ right, ((half @ c.T) ** 2).sum(0) if variance else None)

    return listed, -(-len(grid) // size)


def krige(
    spark: SparkSession, grid: Grid, params: Params, mean: Mean = Mean.constant(), prediction: bool = True, variance: bool = False, detrend: bool = False, method: str = "chol", separable: bool = True, n_max: int = N_MAX
) -> DataFrame:
    """(i, j, p, v): predictions and kriging variances at all cells, as asked for.

    Mean.known: simple kriging; the data must have that mean taken off already, unless ``detrend``. Mean.constant:
    ordinary; Mean.covariates: universal kriging, at the cells that have covariates. Predictions carry no nugget,
    so they smooth at observed cells, and the variance leaves it out. Layers share one factor and give arrays.
    More listed cells than n_max are solved for as a distributed table: predictions of one layer, simple or ordinary.
    """
    try:
        obs = collect(grid, n_max, separable)
    except TooMany:
        if variance or grid.layered or not prediction or mean.kind == "covariates" or isinstance(mean.value, DataFrame):
            raise
        return _krige_distributed(grid, params, mean, detrend)
    factor = obs.factor(params, method)
    z, b, trend = obs.z, None, None
    if mean.kind != "known":
        trend = gls(obs, factor, mean)
        b = trend.by_layer
        z = z - trend.design @ b
    elif detrend:
        z = z - _known_at(obs, mean)[:, None]
    w = factor.power(z)
    f, n = _tile_function(obs, params, grid, factor, w, trend.whitened if trend and variance else None, variance)
    names = [f"s{k}" for k in range(w.shape[1])] + [f"a{k}" for k in range(trend.whitened.shape[1] if trend and variance else 0)] + ["q"] * variance
    out = run_tiles(spark, n, f, "i int, j int, " + ", ".join(f"{c} double" for c in names))
    if mean.kind == "covariates":
        out = out.join(mean.value.select("i", "j", "x"), ["i", "j"])
    columns = []
    if prediction:
        if mean.kind == "known":
            if isinstance(mean.value, DataFrame):
                out = out.join(mean.value.select("i", "j", F.col("mean").alias("_m")), ["i", "j"])
                add = [F.col("_m")] * w.shape[1]
            else:
                add = [F.lit(float(mean.value))] * w.shape[1]
        else:
            add = [_dot(F.col("x"), b[:, k]) if mean.kind == "covariates" else F.lit(float(b[0, k])) for k in range(w.shape[1])]
        each = [F.col(f"s{k}") + a for k, a in enumerate(add)]
        columns.append((F.array(*each) if grid.layered else each[0]).alias("p"))
    if variance:
        v = F.lit(float(params.psill)) - F.col("q")
        if trend is not None:
            m = trend.inverse
            x = [F.lit(1.0), *(F.get("x", F.lit(k)) for k in range(len(m) - 1))]
            r = [c - F.col(f"a{k}") for k, c in enumerate(x)]
            v = v + reduce(lambda a, t: a + t, [r[a] * r[c] * float(m[a, c]) for a in range(len(m)) for c in range(len(m))])
        columns.append(v.alias("v"))
    return out.select("i", "j", *columns)


def _krige_distributed(grid: Grid, params: Params, mean: Mean, detrend: bool) -> DataFrame:
    """(i, j, p) from conjugate gradients on the cells and FFTs along the grid's lines."""
    from gridloom.model import present

    cells = present(grid.cells).select("i", "j", "v")
    if mean.kind == "known":
        add = float(mean.value)
        w = listed_power(cells.withColumn("v", F.col("v") - add) if detrend else cells, params, grid)
    else:
        one, z = listed_power(cells.withColumn("v", F.lit(1.0)), params, grid), listed_power(cells, params, grid)
        total = lambda df: df.agg(F.sum("v")).first()[0]
        add = total(z) / total(one)
        w = z.join(one.withColumnRenamed("v", "_o"), ["i", "j"]).select("i", "j", (F.col("v") - add * F.col("_o")).alias("v"))
    return toeplitz_cells(w, params, grid).select("i", "j", (F.col("v") + add).alias("p"))


def _known_at(obs: Observed, mean: Mean) -> np.ndarray:
    if not isinstance(mean.value, DataFrame):
        return np.full(len(obs.i), float(mean.value))
    return _aligned(obs, mean.value, "mean")[:, 0]


def down_scaled(spark: SparkSession, grid: Grid, down: int | tuple[int, int], params: Params, mean: Mean = Mean.constant(), **how) -> tuple[Grid, DataFrame]:
    """The finer grid, and predictions at all its cells."""
    from gridloom.operators.index import down_scale

    fine = down_scale(grid, down)
    return fine, krige(spark, fine, params, mean, **how)


def detrended(spark: SparkSession, grid: Grid, params: Params, mean: Mean = Mean.constant()) -> Grid:
    """The grid minus its fitted trend."""
    b = gls_coefficients(grid, params, mean)
    line = linear_predictor(spark, grid, b, mean).withColumnRenamed("v", "_t")
    v = F.transform("v", lambda x: x - F.col("_t")) if grid.layered else F.col("v") - F.col("_t")
    return grid.with_cells(grid.cells.join(line, ["i", "j"]).select("i", "j", v.alias("v")))
