"""One-dimensional correlation kernels, as Columns and as numpy arrays, and lag tables."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.model import Axis, Grid, Params


def bessel_k(nu: float, u: np.ndarray) -> np.ndarray:
    """The modified Bessel function of the second kind, by the trapezoid rule on its integral over cosh."""
    u = np.asarray(u, float)
    top = np.arccosh(1 + 745 / np.maximum(u, 1e-300))
    t = np.linspace(0, 1, 400)[:, None] * top[None, :]
    with np.errstate(under="ignore", over="ignore", invalid="ignore"):
        f = np.exp(-u[None, :] * np.cosh(t)) * np.cosh(nu * t)
    f = np.nan_to_num(f)
    return (f.sum(0) - 0.5 * (f[0] + f[-1])) * (top / 399)


def correlation(axis: Axis, d: np.ndarray) -> np.ndarray:
    """The kernel at distances d."""
    d = np.abs(np.asarray(d, float))
    t = d / axis.rho
    if axis.k == "exp":
        return np.exp(-t)
    if axis.k == "gau":
        return np.exp(-(t**2))
    if axis.k == "sph":
        return np.where(t < 1, 1 - 1.5 * t + 0.5 * t**3, 0.0)
    if axis.k == "gxp":
        return np.exp(-(t**axis.kap))
    out = np.ones_like(t)
    far = t > 0
    u = 2 * math.sqrt(axis.kap) * t[far]
    out[far] = 2 ** (1 - axis.kap) / math.gamma(axis.kap) * u**axis.kap * bessel_k(axis.kap, u)
    return out


def correlation_column(axis: Axis, d: Column) -> Column:
    """The kernel of a distance column; a Matern shape must be half of an odd number here, which has a closed form."""
    t = F.abs(d) / axis.rho
    if axis.k == "exp":
        return F.exp(-t)
    if axis.k == "gau":
        return F.exp(-(t * t))
    if axis.k == "sph":
        return F.when(t < 1, 1 - 1.5 * t + 0.5 * t * t * t).otherwise(0.0)
    if axis.k == "gxp":
        return F.exp(-F.pow(t, F.lit(float(axis.kap))))
    p = axis.kap - 0.5
    if p < 0 or p != int(p):
        raise ValueError("use a lag table for a Matern shape that is not half of an odd number")
    p, u = int(p), 2 * math.sqrt(axis.kap) * t
    total = F.lit(0.0)
    for i in range(p + 1):
        c = math.factorial(p + i) / (math.factorial(i) * math.factorial(p - i))
        total = total + c * F.pow(2 * u, F.lit(float(p - i)))
    return F.exp(-u) * total * (math.factorial(p) / math.factorial(2 * p))


def first_row(axis: Axis, n: int, res: float) -> np.ndarray:
    """Correlations at lags 0 to n - 1."""
    return correlation(axis, res * np.arange(n))


def matrix(axis: Axis, n: int, res: float = 1.0, i: np.ndarray | None = None, j: np.ndarray | None = None) -> np.ndarray:
    """The symmetric Toeplitz matrix, or its block for the lines i and j (from 1)."""
    row = first_row(axis, n, res)
    i = np.arange(1, n + 1) if i is None else np.asarray(i)
    j = np.arange(1, n + 1) if j is None else np.asarray(j)
    return row[np.abs(i[:, None] - j[None, :])]


def lag_table(spark: SparkSession, params: Params, grid: Grid) -> DataFrame:
    """(axis, lag, c): ny + nx rows."""
    rows = [("y", k, float(c)) for k, c in enumerate(first_row(params.y, grid.ny, grid.dy))]
    rows += [("x", k, float(c)) for k, c in enumerate(first_row(params.x, grid.nx, grid.dx))]
    return spark.createDataFrame(rows, "axis string, lag int, c double")


def lag_array(axis: Axis, n: int, res: float) -> Column:
    """The lags as an array literal, for lookups without a join."""
    return F.lit([float(c) for c in first_row(axis, n, res)])
