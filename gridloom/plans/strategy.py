"""Choice of algebra from what is observed: a complete lattice (perhaps a coarser one) or listed cells."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np

from gridloom.model import Grid, Params, present
from gridloom.operators.index import find_sub_grid
from gridloom.plans.linalg import N_MAX, Dense, Separable, covariance


@dataclass
class Observed:
    """Observed cells on the driver in column-vectorised order, and the lattice they form, if they do."""

    grid: Grid
    i: np.ndarray
    j: np.ndarray
    z: np.ndarray  # n x layers
    lattice: Grid | None
    lines: dict[str, list[int]] | None

    def factor(self, params: Params, method: str = "chol") -> Dense | Separable:
        if self.lattice is not None:
            return Separable(params, self.lattice)
        return Dense(covariance(params, self.grid, self.i, self.j), method)


def lattice_of(grid: Grid, found: dict) -> Grid | None:
    if min(found["dim"]) < 2:
        return None
    return replace(grid, ny=found["dim"][0], nx=found["dim"][1], dy=grid.dy * found["step"]["i"], dx=grid.dx * found["step"]["j"], cells=None)


class TooMany(ValueError):
    """More observed cells than driver algebra may have."""


#: Cells up to which all are fetched at once and looked at on the driver.
FETCH = 100_000


def _lines(i: np.ndarray, j: np.ndarray) -> dict | None:
    """`find_sub_grid` of cells on the driver."""
    ij = {"i": np.unique(i), "j": np.unique(j)}
    steps = {a: np.unique(np.diff(x)) for a, x in ij.items()}
    if not len(i) or len(i) != len(ij["i"]) * len(ij["j"]) or max(map(len, steps.values())) > 1:
        return None
    return {"n": len(i), "ij": {a: x.tolist() for a, x in ij.items()}, "step": {a: int(x[0]) if len(x) else None for a, x in steps.items()}, "dim": (len(ij["i"]), len(ij["j"]))}


def collect(grid: Grid, n_max: int = N_MAX, separable: bool = True, lattice_max: int = 4_000_000) -> Observed:
    """The observed cells for driver algebra. n_max bounds listed cells; a lattice, which needs no n x n matrix, may have lattice_max."""
    cells = present(grid.cells).select("i", "j", "v")
    table = cells.limit(FETCH + 1).toArrow()  # few cells take one job
    if table.num_rows <= FETCH:
        n, found = table.num_rows, _lines(table.column("i").to_numpy(), table.column("j").to_numpy()) if separable else None
    else:
        found = find_sub_grid(grid) if separable else None
        n = found["n"] if found else cells.count()
    lattice = lattice_of(grid, found) if found else None
    if n > (lattice_max if lattice is not None else n_max):
        raise TooMany(f"{n} observed cells are over the bound; use the distributed forms in plans.linalg, or a sub-grid")
    if n > FETCH:
        table = cells.toArrow()
    i, j = (table.column(c).to_numpy().astype(np.int64) for c in "ij")
    v = table.column("v")
    z = np.array(v.to_pylist(), float).reshape(len(i), -1) if grid.layered else v.to_numpy().astype(float)[:, None]
    order = np.lexsort((i, j))
    return Observed(grid, i[order], j[order], z[order], lattice, found["ij"] if lattice is not None else None)
