"""Assignment of scattered points to the lines of a grid."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.model import Grid, spine
from gridloom.plans.ordering import numbered


@dataclass(frozen=True)
class Lattice:
    """What a caller knows of the target: dimensions, or a resolution, or a whole grid; or nothing."""

    dim: tuple[int, int] | None = None
    res: tuple[float, float] | None = None
    grid: Grid | None = None


def nearest(value: Column, first: float, res: float, n: int) -> Column:
    """The nearest of n lines (from 0), in closed form; a tie goes to the lower coordinate."""
    return F.least(F.greatest(F.ceil((value - first) / res - 0.5), F.lit(0)), F.lit(n - 1)).cast("int")


def crop(points: DataFrame, grid: Grid) -> DataFrame:
    """Points within the grid's outer lines; a range predicate that the scan can use."""
    return points.where(F.col("y").between(float(grid.y[0]), float(grid.y[-1])) & F.col("x").between(float(grid.x[0]), float(grid.x[-1])))


def _box(points: DataFrame) -> tuple[int, float, float, float, float]:
    return tuple(points.agg(F.count("*"), F.min("y"), F.max("y"), F.min("x"), F.max("x")).first())


def target(points: DataFrame, lattice: Lattice, crop_from: bool, crop_g: bool) -> Grid:
    """The grid that the points are snapped to, from one aggregate of the points."""
    n, y1, y2, x1, x2 = _box(points)
    if not n:
        raise ValueError("no point is left to snap")
    g = lattice.grid
    if g is None:
        axes = []
        dims = lattice.dim or (None if lattice.res else (max(2, n), max(2, n)))
        for k, (a, b) in enumerate(((y1, y2), (x1, x2))):
            if dims is not None:
                m = int(dims[k])
                step = (b - a) / (m - 1) if b > a else 1.0
                axes.append((m, step, a))
            else:
                step = float(lattice.res[k])
                m = 1 + math.floor((b - a) / step)
                axes.append((max(2, m), step, a + math.fmod(b - a, step) / 2))
        (ny, dy, y0), (nx, dx, x0) = axes
        return Grid(ny, nx, dy, dx, y0, x0)
    if crop_from and not crop_g:
        return replace(g, cells=None)
    ends = []
    for lo, hi, first, res, m in ((y1, y2, g.y0, g.dy, g.ny), (x1, x2, g.x0, g.dx, g.nx)):
        a, b = (math.ceil((v - first) / res - 0.5) for v in (lo, hi))  # lattice steps of the outer points
        if not crop_g:
            a, b = min(a, 0), max(b, m - 1)
        ends.append((a, max(b, a + 1)))
    (ya, yb), (xa, xb) = ends
    return replace(g, ny=yb - ya + 1, nx=xb - xa + 1, y0=g.y0 + ya * g.dy, x0=g.x0 + xa * g.dx, cells=None)


def snap(points: DataFrame, lattice: Lattice = Lattice(), crop_from: bool = False, crop_g: bool = False) -> tuple[Grid, DataFrame]:
    """The grid with a cell for each line pair that a point is nearest to, and a one-row report.

    ``points`` has pt_id (input order), y, x and maybe v; without v a cell holds the order number of its point. Of
    several points at a cell the first by pt_id stays. crop_from: points beyond the given grid go first; crop_g: the
    grid shrinks to the points. The report has n_points, n_cells, n_duplicates and the largest snapping distance.
    """
    if lattice.grid is not None and crop_from:
        points = crop(points, lattice.grid)
    g = target(points, lattice, crop_from, crop_g)
    if "v" not in points.columns:
        points = numbered(points, "pt_id", "_n").withColumn("v", F.col("_n").cast("double")).drop("_n")
    iy, jx = nearest(F.col("y"), g.y0, g.dy, g.ny), nearest(F.col("x"), g.x0, g.dx, g.nx)
    put = points.select("pt_id", "v", (g.ny - iy).cast("int").alias("i"), (jx + 1).cast("int").alias("j"), F.greatest(F.abs(F.col("y") - (g.y0 + iy * g.dy)), F.abs(F.col("x") - (g.x0 + jx * g.dx))).alias("off"))
    # the first of a cell by a partial aggregate, so that points of a hot cell are combined before the shuffle
    first = put.groupBy("i", "j").agg(F.min_by("v", "pt_id").alias("v"), F.min("pt_id").alias("pt_id"), F.count("*").alias("n"), F.max("off").alias("off"))
    report = first.agg(F.sum("n").alias("n_points"), F.count("*").alias("n_cells"), (F.sum("n") - F.count("*")).alias("n_duplicates"), F.max("off").alias("max_distance"))
    return g.with_cells(first.select("i", "j", "v").where("v is not null")), report


def snapped_points(points: DataFrame, g: Grid) -> DataFrame:
    """Every point with its cell and its snapping distance."""
    iy, jx = nearest(F.col("y"), g.y0, g.dy, g.ny), nearest(F.col("x"), g.x0, g.dx, g.nx)
    d = F.sqrt(F.pow(F.col("y") - (g.y0 + iy * g.dy), F.lit(2.0)) + F.pow(F.col("x") - (g.x0 + jx * g.dx), F.lit(2.0)))
    return points.select("pt_id", (g.ny - iy).cast("int").alias("i"), (jx + 1).cast("int").alias("j"), d.alias("distance"))


def all_cells(points: DataFrame, lattice: Lattice = Lattice(), **crops) -> DataFrame:
    """The dense form of `snap`: every cell, null where no point is nearest."""
    g, _ = snap(points, lattice, **crops)
    return spine(points.sparkSession, g).join(g.cells, ["i", "j"], "left")
