"""Covariance algebra: dense on the driver for few observations, separable for lattices, distributed for large ones."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.kernels import first_row, matrix
from gridloom.model import Grid, Params

#: Observations up to which dense algebra runs on the driver; a matrix of them takes 8 n^2 bytes.
N_MAX = 5000


def covariance(params: Params, grid: Grid, i: np.ndarray, j: np.ndarray, scaled: bool = False) -> np.ndarray:
    """V of the cells (i, j): psill cy cx and the nugget on the diagonal; scaled: over psill."""
    cy, cx = first_row(params.y, grid.ny, grid.dy), first_row(params.x, grid.nx, grid.dx)
    c = cy[np.abs(i[:, None] - i[None, :])] * cx[np.abs(j[:, None] - j[None, :])]
    psill, eps = (1.0, params.eps / params.psill) if scaled else (params.psill, params.eps)
    return psill * c + eps * np.eye(len(i))


def components(params: Params, grid: Grid) -> tuple[np.ndarray, np.ndarray]:
    """The correlation matrices along y and x; V is psill times their Kronecker product (x outer), and the nugget."""
    return matrix(params.y, grid.ny, grid.dy), matrix(params.x, grid.nx, grid.dx)


def kronecker(params: Params, grid: Grid) -> np.ndarray:
    cy, cx = components(params, grid)
    return params.psill * np.kron(cx, cy) + params.eps * np.eye(len(grid))


@dataclass
class Dense:
    """A factor of V for listed cells."""

    v: np.ndarray
    method: str = "chol"

    def __post_init__(self) -> None:
        if self.method == "chol":
            self.l = np.linalg.cholesky(self.v)
            self.inverse = np.linalg.inv(self.l)  # used for every right side
        else:
            self.values, self.vectors = np.linalg.eigh(self.v)
            if self.values.min() <= 0:
                raise np.linalg.LinAlgError("the covariance matrix has an eigenvalue that is not positive; a larger nugget helps")

    def power(self, z: np.ndarray, p: float = -1.0) -> np.ndarray:
        if self.method == "chol":
            if p != -1:
                raise ValueError("powers other than -1 need the eigen method")
            return self.inverse.T @ (self.inverse @ z)
        return self.vectors @ ((self.values**p)[(slice(None),) + (None,) * (z.ndim - 1)] * (self.vectors.T @ z))

    def half(self, z: np.ndarray) -> np.ndarray:
        """A whitening of z: its squares sum to z' V^-1 z."""
        if self.method == "chol":
            return self.inverse @ z
        return (self.values**-0.5)[(slice(None),) + (None,) * (z.ndim - 1)] * (self.vectors.T @ z)

    def log_det(self) -> float:
        return float(2 * np.log(np.diag(self.l)).sum() if self.method == "chol" else np.log(self.values).sum())


@dataclass
class Separable:
    """A factor of V for a complete lattice; vectors are column-vectorised (index i + ny (j - 1))."""

    params: Params
    grid: Grid

    def __post_init__(self) -> None:
        cy, cx = components(self.params, self.grid)
        (ly, self.qy), (lx, self.qx) = np.linalg.eigh(cy), np.linalg.eigh(cx)
        self.values = self.params.eps + self.params.psill * ly[:, None] * lx[None, :]
        if self.values.min() <= 0:
            raise np.linalg.LinAlgError("the covariance matrix has an eigenvalue that is not positive; a larger nugget helps")

    def _matrix(self, z: np.ndarray) -> np.ndarray:
        return z.reshape(self.grid.nx, self.grid.ny).T

    def _one(self, z: np.ndarray, p: float, back: bool = True) -> np.ndarray:
        m = self.values**p * (self.qy.T @ self._matrix(z) @ self.qx)
        return (self.qy @ m @ self.qx.T if back else m).T.ravel()

    def power(self, z: np.ndarray, p: float = -1.0) -> np.ndarray:
        return self._one(z, p) if z.ndim == 1 else np.stack([self._one(c, p) for c in z.T], 1)

    def half(self, z: np.ndarray) -> np.ndarray:
        return self._one(z, -0.5, False) if z.ndim == 1 else np.stack([self._one(c, -0.5, False) for c in z.T], 1)

    def log_det(self) -> float:
        return float(np.log(self.values).sum())


def toeplitz(y: np.ndarray, z: np.ndarray, x: np.ndarray | None = None) -> np.ndarray:
    """The Toeplitz matrix of first row y times z (times that of x), by circulant embedding and the real FFT."""

    def left(row: np.ndarray, m: np.ndarray) -> np.ndarray:
        n = len(row)
        size = 1 << (2 * n - 1).bit_length()
        c = np.zeros(size)
        c[:n], c[size - n + 1 :] = row, row[:0:-1]
        out = np.zeros_like(m)
        live = np.abs(m).sum(0) > 0  # columns of zeros stay zero
        out[:, live] = np.fft.irfft(np.fft.rfft(c)[:, None] * np.fft.rfft(m[:, live], size, axis=0), size, axis=0)[:n]
        return out

    z = np.asarray(z, float).reshape(len(y), -1)
    out = left(np.asarray(y, float), z)
    return out if x is None else left(np.asarray(x, float), out.T).T


# -- distributed forms, for lattices whose cells do not fit one machine


def _along(cells: DataFrame, axis: str, f) -> DataFrame:
    """f on each line of cells (i, j, v): groups are lines, so they are bounded by ny or nx."""
    other = "j" if axis == "i" else "i"

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        out = f(table.column(axis).to_numpy(), table.column("v").to_numpy())
        n = len(out)
        cols = {axis: pa.array(np.arange(1, n + 1, dtype=np.int32)), other: pa.array(np.full(n, key[0].as_py(), np.int32)), "v": pa.array(out)}
        return pa.table({"i": cols["i"], "j": cols["j"], "v": cols["v"]})

    return cells.select("i", "j", F.col("v").cast("double").alias("v")).groupBy(other).applyInArrow(run, "i int, j int, v double")


def _dense_line(at: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    z = np.zeros(n)
    z[at - 1] = v
    return z


def two_sided(cells: DataFrame, a: np.ndarray, b: np.ndarray) -> DataFrame:
    """A Z B' for cells as Z: by columns, then by rows. Missing cells are zeros, and lines of zeros cost nothing."""
    one = _along(cells, "i", lambda at, v: a[:, at - 1] @ v)
    return _along(one, "j", lambda at, v: b[:, at - 1] @ v)


def separable_power(cells: DataFrame, params: Params, grid: Grid, p: float = -1.0) -> DataFrame:
    """V^p z of a complete lattice, distributed: into the eigenbasis, scaled there, and back."""
    s = Separable(params, grid)
    inner = two_sided(cells, s.qy.T, s.qx.T)
    ly = np.linalg.eigvalsh(components(params, grid)[0])
    lx = np.linalg.eigvalsh(components(params, grid)[1])
    value = params.eps + params.psill * F.get(F.lit(ly.tolist()), F.col("i") - 1) * F.get(F.lit(lx.tolist()), F.col("j") - 1)
    return two_sided(inner.withColumn("v", F.col("v") * F.pow(value, F.lit(float(p)))), s.qy, s.qx)


def toeplitz_cells(cells: DataFrame, params: Params, grid: Grid) -> DataFrame:
    """psill Cy Z Cx of sparse cells, by FFT along columns, then along rows; only lines with cells are touched first."""
    cy, cx = first_row(params.y, grid.ny, grid.dy), first_row(params.x, grid.nx, grid.dx)
    one = _along(cells, "i", lambda at, v: toeplitz(cy, _dense_line(at, v, len(cy)))[:, 0])
    return _along(one, "j", lambda at, v: toeplitz(cx, _dense_line(at, v, len(cx)))[:, 0]).withColumn("v", F.col("v") * params.psill)


def checkpoints(spark) -> None:
    """Sees to a checkpoint folder: spark.checkpoint.dir, or, on one machine, one of our own where it is unset."""
    if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        return
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(base or tempfile.mkdtemp(prefix="gridloom-"))


def listed_power(cells: DataFrame, params: Params, grid: Grid, tolerance: float = 1e-9, rounds: int = 1000) -> DataFrame:
    """V^-1 z of any observed cells (i, j, v), distributed, by conjugate gradients: each step is one `toeplitz_cells`.

    Rounds go on until the residual is `tolerance` of z, about as many as the root of V's condition number asks for.
    """
    checkpoints(cells.sparkSession)
    at = cells.select("i", "j", F.lit(0.0).alias("x"), F.col("v").cast("double").alias("r"), F.col("v").cast("double").alias("p")).checkpoint()
    first = old = at.agg(F.sum(F.col("r") * F.col("r"))).first()[0] or 0.0
    for _ in range(rounds):
        if old <= tolerance**2 * first:
            return at.select("i", "j", F.col("x").alias("v"))
        spread_out = toeplitz_cells(at.select("i", "j", F.col("p").alias("v")), params, grid).withColumnRenamed("v", "q")
        both = at.join(spread_out, ["i", "j"]).withColumn("q", F.col("q") + params.eps * F.col("p")).checkpoint()
        step = old / both.agg(F.sum(F.col("p") * F.col("q"))).first()[0]
        moved = both.select("i", "j", (F.col("x") + step * F.col("p")).alias("x"), (F.col("r") - step * F.col("q")).alias("r"), "p")
        new = moved.agg(F.sum(F.col("r") * F.col("r"))).first()[0]
        at, old = moved.withColumn("p", F.col("r") + new / old * F.col("p")), new
    raise ValueError(f"no solution to {tolerance} in {rounds} rounds; a larger nugget helps")


def spread(weights: DataFrame, params: Params, grid: Grid) -> DataFrame:
    """psill Cy W Cx of sparse weights (i, j, v) at all cells, by two aggregations of Columns and no Python.

    First each weight goes down its column of cells, then each column along the rows, with partial sums before
    either shuffle: rows are n_obs * ny, then columns with weights * all cells.
    """
    cy = F.lit(first_row(params.y, grid.ny, grid.dy).tolist())
    cx = F.lit(first_row(params.x, grid.nx, grid.dx).tolist())
    w = weights.select(F.col("i").alias("io"), F.col("j").alias("jo"), F.col("v").alias("w"))
    down = w.select("jo", "io", "w", F.explode(F.sequence(F.lit(1), F.lit(grid.ny))).alias("i"))
    one = down.groupBy("i", "jo").agg(F.sum(F.get(cy, F.abs(F.col("i") - F.col("io"))) * F.col("w")).alias("a"))
    out = one.select("i", "jo", "a", F.explode(F.sequence(F.lit(1), F.lit(grid.nx))).alias("j"))
    return out.groupBy("i", "j").agg((params.psill * F.sum(F.get(cx, F.abs(F.col("j") - F.col("jo"))) * F.col("a"))).alias("v"))


def normal_noise(cells: DataFrame, grid: Grid, seed: int, layer: int = 1) -> DataFrame:
    """Independent normal values keyed by seed, layer and cell index: the same on every recomputation."""
    unit = lambda tag: (F.pmod(F.xxhash64(F.lit(seed), F.lit(layer), F.lit(tag), grid.k()), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return cells.select("i", "j", (F.sqrt(-2 * F.log(unit(1))) * F.cos(2 * np.pi * unit(2))).alias("v"))


def tiles(total: int, size: int) -> list[tuple[int, int]]:
    return [(a, min(a + size, total)) for a in range(0, total, size)]


def run_tiles(spark, n: int, f, schema: str) -> DataFrame:
    """f(tile) -> record batch for tiles 0 to n - 1, each on its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0).to_pylist():
                yield from f(t)

    slices = max(1, min(n, 4 * spark.sparkContext.defaultParallelism))
    return spark.range(0, n, 1, slices).mapInArrow(run, schema)
