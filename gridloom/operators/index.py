"""Index arithmetic, sub-grids, rescaling and element access."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.model import Grid, present, spine


def to_k(ny: int, i: str = "i", j: str = "j") -> Column:
    """(i, j) to the column-vectorised index; an i over ny is an error at run time."""
    k = F.col(i).cast("long") + ny * (F.col(j).cast("long") - 1)
    return F.when(F.col(i) > ny, F.raise_error(F.lit("row index is over the number of rows")).cast("long")).otherwise(k)


def to_ij(ny: int, k: str = "k") -> tuple[Column, Column]:
    """The index back to (i, j)."""
    j = F.ceil(F.col(k) / ny).cast("long")
    return (F.col(k) - ny * (j - 1)).cast("long"), j


def _line_table(spark: SparkSession, lines: list[int], name: str) -> DataFrame:
    return spark.createDataFrame([(int(x), p) for p, x in enumerate(lines, 1)], f"{name} int, _p{name} int")


def sub_index(spark: SparkSession, grid: Grid, i: list[int] | None = None, j: list[int] | None = None, mask: bool = False, nosort: bool = False) -> DataFrame:
    """Indices k of the cells on the given lines, in sorted line order or (nosort) the given one; or a mask over all cells."""
    i = list(range(1, grid.ny + 1)) if i is None else list(i) if nosort else sorted(set(i))
    j = list(range(1, grid.nx + 1)) if j is None else list(j) if nosort else sorted(set(j))
    ij = _line_table(spark, i, "i").crossJoin(_line_table(spark, j, "j"))  # exactly the cells asked for
    hit = ij.select(grid.k().alias("k"), (F.col("_pi") + len(i) * (F.col("_pj") - 1)).cast("long").alias("pos"))
    if not mask:
        return hit
    return spark.range(1, len(grid) + 1).select(F.col("id").alias("k")).join(hit.select("k", F.lit(True).alias("_in")).distinct(), "k", "left").select("k", F.coalesce("_in", F.lit(False)).alias("inside"))


def sub_grid(spark: SparkSession, grid: Grid, keep: dict[str, list[int]] | None = None, rem: dict[str, list[int]] | None = None, mirror: bool = False) -> Grid:
    """The grid of the kept lines (or without the removed ones; keep wins), renumbered.

    Lines left must be in equal steps. ``mirror``: removed lines are removed from the other end as well. The
    y coordinates are those of the kept rows.
    """
    lines = {}
    for axis, n in (("i", grid.ny), ("j", grid.nx)):
        every = range(1, n + 1)
        if keep is not None:
            lines[axis] = sorted(set(keep.get(axis) or every))
        else:
            gone = set((rem or {}).get(axis) or ())
            if mirror:
                gone |= {n - x + 1 for x in gone}
            lines[axis] = [x for x in every if x not in gone]
        step = set(np.diff(lines[axis]).tolist())
        if len(lines[axis]) < 2 or len(step) > 1 or lines[axis][0] < 1 or lines[axis][-1] > n:
            raise ValueError("a sub-grid needs two lines or more along each axis, in equal steps")
    si, sj = lines["i"][1] - lines["i"][0], lines["j"][1] - lines["j"][0]
    meta = replace(grid, ny=len(lines["i"]), nx=len(lines["j"]), dy=grid.dy * si, dx=grid.dx * sj, y0=grid.y0 + grid.dy * (grid.ny - lines["i"][-1]), x0=grid.x0 + grid.dx * (lines["j"][0] - 1), cells=None)
    if grid.cells is None:
        return meta
    # equal steps make selection and renumbering arithmetic; the filter reaches the scan
    i0, j0 = lines["i"][0], lines["j"][0]
    inside = F.col("i").between(i0, lines["i"][-1]) & F.col("j").between(j0, lines["j"][-1]) & (F.pmod(F.col("i") - i0, F.lit(si)) == 0) & (F.pmod(F.col("j") - j0, F.lit(sj)) == 0)
    return meta.with_cells(grid.cells.where(inside).select((F.floor((F.col("i") - i0) / si) + 1).cast("int").alias("i"), (F.floor((F.col("j") - j0) / sj) + 1).cast("int").alias("j"), "v"))


def trim(spark: SparkSession, grid: Grid, batch: int = 128) -> dict[str, tuple[int, int]]:
    """Line ranges without a missing cell: the outer line with the largest missing share goes, again and again.

    Ties: rows before columns, first side before last. Lines go in batches. For one, the driver gets the numbers of
    present cells in the outermost `batch` lines of each side, and the cells where two such lines cross, from
    aggregates of the cells that are left: 4 batch numbers and 4 batch^2 cells at most, whatever the grid's size.
    """
    cells = present(grid.cells).select((F.col("i") - 1).alias("i"), (F.col("j") - 1).alias("j"))
    a, b, c, d = 0, grid.ny, 0, grid.nx
    while a < b and c < d:
        box = cells.where(F.col("i").between(a, b - 1) & F.col("j").between(c, d - 1))
        outer = {"i": (F.col("i") < a + batch) | (F.col("i") >= b - batch), "j": (F.col("j") < c + batch) | (F.col("j") >= d - batch)}
        missing = (b - a) * (d - c) - box.count()
        here = {x: dict(box.where(on).groupBy(x).count().collect()) for x, on in outer.items()}
        crossing: dict[tuple[str, int], list[int]] = {}
        for r in box.where(outer["i"] & outer["j"]).collect():
            crossing.setdefault(("i", r.i), []).append(r.j)
            crossing.setdefault(("j", r.j), []).append(r.i)
        for _ in range(batch):
            if not missing or a >= b or c >= d:
                break
            lines = [("i", a, d - c), ("i", b - 1, d - c), ("j", c, b - a), ("j", d - 1, b - a)]
            lost = [size - here[x].get(k, 0) for x, k, size in lines]
            worst = int(np.argmax([n / size for n, (_, _, size) in zip(lost, lines)]))
            x, k, _ = lines[worst]
            missing -= lost[worst]
            other = here["j" if x == "i" else "i"]
            for m in crossing.get((x, k), ()):
                other[m] -= 1
            a, b, c, d = a + (worst == 0), b - (worst == 1), c + (worst == 2), d - (worst == 3)
        if not missing:
            break
    if a >= b or c >= d:
        raise ValueError("no line is left without missing cells")
    return {"i": (a + 1, b), "j": (c + 1, d)}


def find_sub_grid(grid: Grid) -> dict | None:
    """The regular complete lattice that the observed cells form, or None: lines, steps and size, from one aggregate.

    The line sets are bounded by ny + nx.
    """
    row = present(grid.cells).agg(F.count("*").alias("n"), F.sort_array(F.collect_set("i")).alias("i"), F.sort_array(F.collect_set("j")).alias("j")).first()
    out = {"n": row.n, "ij": {"i": list(row.i), "j": list(row.j)}, "step": {}}
    if not row.n or row.n != len(row.i) * len(row.j):
        return None
    for axis in "ij":
        steps = set(np.diff(out["ij"][axis]).tolist())
        if len(steps) > 1:
            return None
        out["step"][axis] = steps.pop() if steps else None
    out["dim"] = (len(row.i), len(row.j))
    return out


def up_scale(grid: Grid, up: int | tuple[int, int]) -> Grid:
    """Every up-th line from the first on."""
    uy, ux = (int(u) for u in np.broadcast_to(up, 2))
    ny, nx = (grid.ny - 1) // uy + 1, (grid.nx - 1) // ux + 1
    y0 = grid.y0 + grid.dy * (grid.ny - 1 - (ny - 1) * uy)
    out = replace(grid, ny=ny, nx=nx, dy=grid.dy * uy, dx=grid.dx * ux, y0=y0, cells=None)
    if grid.cells is None:
        return out
    kept = grid.cells.where((F.pmod(F.col("i") - 1, F.lit(uy)) == 0) & (F.pmod(F.col("j") - 1, F.lit(ux)) == 0))
    return out.with_cells(kept.select((F.floor((F.col("i") - 1) / uy) + 1).cast("int").alias("i"), (F.floor((F.col("j") - 1) / ux) + 1).cast("int").alias("j"), "v"))


def down_scale(grid: Grid, down: int | tuple[int, int]) -> Grid:
    """down - 1 empty lines between any two; observed cells only change their numbers."""
    ey, ex = (int(u) for u in np.broadcast_to(down, 2))
    out = replace(grid, ny=grid.ny + (ey - 1) * (grid.ny - 1), nx=grid.nx + (ex - 1) * (grid.nx - 1), dy=grid.dy / ey, dx=grid.dx / ex, cells=None)
    if grid.cells is None:
        return out
    return out.with_cells(grid.cells.select(((F.col("i") - 1) * ey + 1).cast("int").alias("i"), ((F.col("j") - 1) * ex + 1).cast("int").alias("j"), "v"))


# -- element access


def dense(spark: SparkSession, grid: Grid) -> DataFrame:
    """(k, i, j, v) of every cell, null where missing."""
    return spine(spark, grid).join(grid.cells, ["i", "j"], "left").select(grid.k().alias("k"), "i", "j", "v")


def at(grid: Grid, keys: DataFrame, layer: int | None = None) -> DataFrame:
    """Values at the indices k of a table, null where missing."""
    v = F.element_at("v", layer) if layer is not None else F.col("v")
    return keys.join(grid.cells.select(grid.k().alias("k"), v.alias("v")), "k", "left")


def where(grid: Grid, mask: Grid) -> DataFrame:
    """(k, v) of the cells that a logical grid selects."""
    yes = mask.cells.where(F.col("v").cast("boolean")).select("i", "j")
    return grid.cells.join(yes, ["i", "j"], "left_semi").select(grid.k().alias("k"), "v")


def layer(grid: Grid, n: int) -> Grid:
    return grid.with_cells(grid.cells.select("i", "j", F.element_at("v", n).alias("v")))


def assign(grid: Grid, new: DataFrame) -> Grid:
    """The grid with the cells (i, j, v) of a table put in; a null value takes the cell out."""
    new = new.select("i", "j", F.col("v").alias("_new"), F.lit(True).alias("_set"))
    both = grid.cells.join(new, ["i", "j"], "full")
    return grid.with_cells(both.select("i", "j", F.when(F.col("_set"), F.col("_new")).otherwise(F.col("v")).alias("v")).where("v is not null"))


def assign_where(grid: Grid, mask: Grid, value: float) -> Grid:
    yes = mask.cells.where(F.col("v").cast("boolean")).select("i", "j", F.lit(float(value)).alias("v"))
    return assign(grid, yes)


def assign_layer(grid: Grid, n: int, new: DataFrame) -> Grid:
    """One layer replaced by the values (i, j, v); cells that are not in the table keep theirs."""
    both = grid.cells.join(new.select("i", "j", F.col("v").alias("_new")), ["i", "j"], "left")
    return grid.with_cells(both.select("i", "j", F.transform("v", lambda x, k: F.when(k == n - 1, F.coalesce("_new", x)).otherwise(x)).alias("v")))


def missing(spark: SparkSession, grid: Grid) -> DataFrame:
    """(i, j, missing) of every cell."""
    if grid.cells is None:
        return spine(spark, grid).withColumn("missing", F.lit(True))
    seen = present(grid.cells).select("i", "j", F.lit(False).alias("_m"))
    return spine(spark, grid).join(seen, ["i", "j"], "left").select("i", "j", F.coalesce("_m", F.lit(True)).alias("missing"))


def any_missing(grid: Grid) -> bool:
    return grid.cells is None or present(grid.cells).count() < len(grid)


def rows_as_arrays(grid: Grid, n: int = 1) -> DataFrame:
    """(i, row): the dense matrix of a layer, one array a grid row, null where missing."""
    cells = layer(grid, n).cells if grid.layered else grid.cells
    one = cells.groupBy("i").agg(F.map_from_entries(F.collect_list(F.struct("j", "v"))).alias("m"))
    return one.select("i", F.transform(F.sequence(F.lit(1), F.lit(grid.nx)), lambda j: F.try_element_at("m", j)).alias("row"))


def vector(spark: SparkSession, grid: Grid) -> DataFrame:
    """(k, v) of all cells in index order; the order is in k."""
    return dense(spark, grid).select("k", "v").orderBy("k")
