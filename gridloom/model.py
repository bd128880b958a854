"""The data model: a grid is small metadata on the driver and a DataFrame of its observed cells.

Cells are sparse: a cell without a row has no value. Single-layer grids hold `v DOUBLE`; multi-layer grids hold
`v ARRAY<DOUBLE>`, all layers with one mask. Row 1 is at the top (largest y), column 1 at the left, and the
column-vectorised index is `k = i + ny * (j - 1)`.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace
from enum import Enum

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, NumericType, StringType


class Completeness(Enum):
    EMPTY = "empty"
    INCOMPLETE = "incomplete"
    COMPLETE = "complete"


@dataclass(frozen=True)
class Grid:
    """Metadata of a regular grid, and its cells (i, j, v), or None for a grid without data."""

    ny: int
    nx: int
    dy: float = 1.0
    dx: float = 1.0
    y0: float = 0.0
    x0: float = 0.0
    crs: str | None = None
    cells: DataFrame | None = field(default=None, compare=False, repr=False)

    def __post_init__(self) -> None:
        for name in ("ny", "nx"):
            if not isinstance(getattr(self, name), (int, np.integer)) or getattr(self, name) < 2:
                raise ValueError(f"{name} must be a whole number of at least two grid lines")
        for name in ("dy", "dx"):
            if not getattr(self, name) > 0:
                raise ValueError(f"{name} must be positive")
        if self.crs is not None and not isinstance(self.crs, str):
            raise ValueError("crs must be one string")
        if self.cells is not None and not {"i", "j", "v"} <= set(self.cells.columns):
            raise ValueError("cells must have the columns i, j and v")

    # -- shape
    def __len__(self) -> int:
        return self.ny * self.nx

    @property
    def dim(self) -> tuple[int, int]:
        return self.ny, self.nx

    @property
    def layered(self) -> bool:
        return self.cells is not None and isinstance(self.cells.schema["v"].dataType, ArrayType)

    @property
    def y(self) -> np.ndarray:
        """Ascending y of the grid lines."""
        return self.y0 + self.dy * np.arange(self.ny)

    @property
    def x(self) -> np.ndarray:
        return self.x0 + self.dx * np.arange(self.nx)

    @property
    def extent(self) -> tuple[float, float, float, float]:
        """Edges of the outer cells: y from, y to, x from, x to."""
        return self.y0 - self.dy / 2, self.y0 + (self.ny - 0.5) * self.dy, self.x0 - self.dx / 2, self.x0 + (self.nx - 0.5) * self.dx

    def with_cells(self, cells: DataFrame | None) -> Grid:
        return replace(self, cells=cells)

    # -- columns
    def k(self) -> Column:
        return (F.col("i") + F.lit(self.ny) * (F.col("j") - 1)).cast("long")

    def y_of(self, i: Column | str = "i") -> Column:
        return F.lit(float(self.y0)) + (F.lit(self.ny) - (F.col(i) if isinstance(i, str) else i)) * F.lit(float(self.dy))

    def x_of(self, j: Column | str = "j") -> Column:
        return F.lit(float(self.x0)) + ((F.col(j) if isinstance(j, str) else j) - 1) * F.lit(float(self.dx))

    # -- checks
    def validate(self, counted: bool = True) -> Grid:
        """Checks the cells against the metadata in one aggregate: bounds, uniqueness, equal layers."""
        if self.cells is None:
            return self
        size = F.size("v") if self.layered else F.lit(1)
        n, d, low_i, high_i, low_j, high_j, low, high = self.cells.agg(F.count("*"), F.count_distinct("i", "j") if counted else F.count("*"), F.min("i"), F.max("i"), F.min("j"), F.max("j"), F.min(size), F.max(size)).first()
        if n and (low_i < 1 or high_i > self.ny or low_j < 1 or high_j > self.nx):
            raise ValueError("cells lie outside the grid")
        if n != d:
            raise ValueError("cells come more than once")
        if n and low != high:
            raise ValueError("layers differ in number")
        if self.layered and n and self.cells.where(F.exists("v", lambda x: x.isNull()) & F.exists("v", lambda x: x.isNotNull())).limit(1).count():
            raise ValueError("layers do not miss the same cells")
        return self


def present(cells: DataFrame) -> DataFrame:
    """Observed cells only; NaN counts as missing."""
    kind = cells.schema["v"].dataType
    if isinstance(kind, ArrayType):
        return cells.where(F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x)))
    if kind.typeName() in ("double", "float"):
        return cells.where(F.col("v").isNotNull() & ~F.isnan("v"))
    return cells.where(F.col("v").isNotNull())


def create(
    cells: DataFrame | None = None,
    dim: tuple[int, int] | int | None = None,
    res: tuple[float, float] | float | None = None,
    lines: tuple[list[float], list[float]] | None = None,
    origin: tuple[float, float] = (0.0, 0.0),
    crs: str | None = None,
    check: bool = True,
) -> Grid:
    """A grid from its dimensions or its grid lines (ascending y and x), with or without cells.

    A resolution that is given beside the lines must agree with them to one part in a million.
    """
    if lines is not None:
        ys, xs = (np.asarray(a, float) for a in lines)
        if dim is not None and tuple(np.broadcast_to(dim, 2)) != (len(ys), len(xs)):
            raise ValueError("lines and dimensions do not match")
        dim = (len(ys), len(xs))
        if min(dim) < 2:
            raise ValueError("a grid needs two lines along each axis at least")
        steps = []
        for a, given in zip((ys, xs), np.broadcast_to(res, 2) if res is not None else (None, None)):
            step = a[1] - a[0]
            if not np.allclose(np.diff(a), step, rtol=1e-6) or step <= 0:
                raise ValueError("grid lines must ascend in equal steps")
            if given is not None and abs(given / step - 1) > 1e-6:
                raise ValueError("the resolution does not agree with the grid lines")
            steps.append(float(step))
        res, origin = tuple(steps), (float(ys[0]), float(xs[0]))
    if dim is None:
        raise ValueError("the dimensions of the grid are missing")
    if np.ndim(dim) and len(dim) > 2:
        raise ValueError("a grid has two dimensions")
    ny, nx = (int(n) for n in np.broadcast_to(dim, 2))
    dy, dx = (float(r) for r in np.broadcast_to(1.0 if res is None else res, 2))
    grid = Grid(ny, nx, dy, dx, float(origin[0]), float(origin[1]), crs)
    if cells is None:
        return grid
    kind = cells.schema["v"].dataType
    if isinstance(kind, ArrayType):
        value = F.col("v").cast("array<double>")
    elif isinstance(kind, (NumericType, BooleanType, StringType)):
        value = F.col("v")
    else:
        raise ValueError(f"cells of type {kind.simpleString()} are not supported")
    out = grid.with_cells(present(cells.select(F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), value.alias("v"))))
    return out.validate() if check else out


def constant(spark: SparkSession, grid: Grid, value: float) -> Grid:
    """The grid with one value in all its cells."""
    return grid.with_cells(spine(spark, grid).withColumn("v", F.lit(float(value))))


def spine(spark: SparkSession, grid: Grid) -> DataFrame:
    """All cells (i, j) of the grid, made where they are needed."""
    k = F.col("id")
    return spark.range(len(grid)).select((k % grid.ny + 1).cast("int").alias("i"), (F.floor(k / grid.ny) + 1).cast("int").alias("j"))


def completeness(grid: Grid) -> Completeness:
    n = 0 if grid.cells is None else grid.cells.count()
    return Completeness.EMPTY if not n else Completeness.COMPLETE if n == len(grid) else Completeness.INCOMPLETE


# -- covariance parameters

#: Parameters of each kernel.
KERNELS = {"exp": ("rho",), "gau": ("rho",), "sph": ("rho",), "gxp": ("rho", "kap"), "mat": ("rho", "kap")}


@dataclass(frozen=True)
class Axis:
    """A one-dimensional kernel and its parameters; None is still to be fitted."""

    k: str = "gau"
    rho: float | None = None
    kap: float | None = None

    def __post_init__(self) -> None:
        if self.k == "gex":
            object.__setattr__(self, "k", "gxp")
        if self.k not in KERNELS:
            raise ValueError(f"unknown kernel {self.k!r}")
        if self.kap is not None and "kap" not in KERNELS[self.k]:
            raise ValueError(f"kernel {self.k} has no shape")

    @property
    def names(self) -> tuple[str, ...]:
        return KERNELS[self.k]


@dataclass(frozen=True)
class Params:
    """Nugget, partial sill and the kernels along y and x."""

    y: Axis = Axis()
    x: Axis = Axis()
    psill: float | None = None
    eps: float | None = None

    @property
    def names(self) -> list[str]:
        return ["eps", "psill", *(f"y.{n}" for n in self.y.names), *(f"x.{n}" for n in self.x.names)]

    def vector(self) -> list[float | None]:
        return [self.eps, self.psill, *(getattr(self.y, n) for n in self.y.names), *(getattr(self.x, n) for n in self.x.names)]

    def update(self, values: list[float], iso: bool = False, eps_scaled: bool = False, na_omit: bool = False) -> Params:
        """The parameters with new values in the order of `names`.

        ``iso``: the x kernel takes the y kernel's values, which are then left out at the end; ``eps_scaled``: the
        nugget comes as a multiple of the partial sill; ``na_omit``: values stand for the missing ones only.
        """
        names = [n for n in self.names if not (iso and n.startswith("x."))]
        old = dict(zip(self.names, self.vector()))
        if na_omit:
            names = [n for n in names if old[n] is None]
        if len(values) != len(names):
            raise ValueError(f"expected {len(names)} values for {names}")
        new = old | dict(zip(names, map(float, values)))
        if iso:
            if self.y.k != self.x.k:
                raise ValueError("isotropic parameters need one kernel")
            new |= {f"x.{n}": new[f"y.{n}"] for n in self.y.names}
        if eps_scaled:
            new["eps"] = new["eps"] * new["psill"]
        return Params(Axis(self.y.k, *(new[f"y.{n}"] for n in self.y.names)), Axis(self.x.k, *(new[f"x.{n}"] for n in self.x.names)), new["psill"], new["eps"])

    def missing(self) -> list[str]:
        return [n for n, v in zip(self.names, self.vector()) if v is None]

    def text(self, digits: int = 3) -> str:
        """A readable form: the kernels, then each part with so many significant digits."""
        one = lambda v: "NA" if v is None else f"{v:.{digits}g}"
        axis = lambda a: a.k + "(" + ", ".join(f"{n} = {one(getattr(a, n))}" for n in a.names) + ")"
        return f"{self.y.k} x {self.x.k} kernel (nugget = {one(self.eps)}, partial sill = {one(self.psill)}), y: {axis(self.y)}, x: {axis(self.x)}"


def make_params(spec: str | tuple[str, str] | dict | Params = "gau") -> Params:
    """Parameters from a kernel name, a pair of names, a nested mapping or parameters themselves."""
    if isinstance(spec, Params):
        return spec
    if isinstance(spec, str):
        return Params(Axis(spec), Axis(spec))
    if isinstance(spec, tuple):
        if len(spec) != 2:
            raise ValueError("one kernel or two are needed")
        return Params(Axis(spec[0]), Axis(spec[1]))
    known = {"y", "x", "psill", "eps"}
    if set(spec) - known:
        raise ValueError(f"unknown parameters {sorted(set(spec) - known)}")
    axes = {a: spec.get(a) for a in "yx"}
    axes = {a: axes[a] if axes[a] is not None else axes["x" if a == "y" else "y"] for a in "yx"}
    made = {a: v if isinstance(v, Axis) else Axis(v) if isinstance(v, str) else Axis(**(v or {})) for a, v in axes.items()}
    return Params(made["y"], made["x"], spec.get("psill"), spec.get("eps"))


def geometric(low: float, high: float) -> float:
    return math.sqrt(low * high)


# -- the mean of a model


@dataclass(frozen=True)
class Mean:
    """known: a number or a table (i, j, mean); constant: estimated; covariates: a table (i, j, x ARRAY<DOUBLE>)."""

    kind: str
    value: float | DataFrame | None = None

    @staticmethod
    def known(value: float | DataFrame = 0.0) -> Mean:
        return Mean("known", value)

    @staticmethod
    def constant() -> Mean:
        return Mean("constant")

    @staticmethod
    def covariates(table: DataFrame) -> Mean:
        return Mean("covariates", table)
