"""DuckDB SQL for kriging and likelihoods: Gauss-Jordan elimination of all observed cells in a recursive query."""

from __future__ import annotations

PARS = "select 1 pid, 6.0 ry, 5.0 rx, 4.0 psill, 0.5 eps"
CELLS = "(select unnest(range(1, {ny} + 1)) i) ci, (select unnest(range(1, {nx} + 1)) j) cj"


def cov(p: str, q: str, dy: float = 1.0, dx: float = 2.0) -> str:
    """The separable Gaussian covariance of the cells p and q, without the nugget."""
    return f"psill * exp(-pow({dy} * ({p}.i - {q}.i) / ry, 2)) * exp(-pow({dx} * ({p}.j - {q}.j) / rx, 2))"


class System:
    """CTEs that solve V s = r for all cells of a table (i, j, v) and each row of parameters (pid, ry, rx, psill, eps).

    gj holds each step of the elimination: the rows' columns that are left, and the pivots; so, the solutions by cell:
    r[1], r[2], ... of the right sides, given as an expression in the columns of `a`. With `cells`, the covariances c
    with every cell of the grid follow as further right sides.
    """

    def __init__(self, table: str, name: str, right: str, pars: str = PARS, cells: bool = False, dim: tuple[int, int] = (50, 11), res: tuple[float, float] = (1.0, 2.0)):
        self.dim, self.res = dim, res
        c = self.cov
        self.ctes = [
            table,
            f"ob as (select row_number() over (order by j, i) k, count(*) over () n, cast(i as int) i, cast(j as int) j, v from {name})",
            f"pars as ({pars})",
            f"ce as (select row_number() over (order by j, i) c, cast(i as int) i, cast(j as int) j from {CELLS.format(ny=dim[0], nx=dim[1])})",
        ]
        if cells:
            self.ctes.append(f"kc as (select pid, k, list({c('ob', 'ce')} order by ce.c) c from pars, ob, ce group by all)")
            self.ctes.append("aa as (select pars.*, ob.*, kc.c from pars, ob join kc on kc.k = ob.k where kc.pid = pars.pid)")
        else:
            self.ctes.append("aa as (select pars.*, ob.*, [] c from pars, ob)")
        self.ctes += [
            f"sy as (select a.pid, a.k i, any_value(a.n) n, list({c('a', 'b')} + case when a.k = b.k then eps else 0 end order by b.k) || any_value({right} || a.c) r from aa a, ob b group by a.pid, a.k)",
            """gj as (select pid, 1 k, i, n, r, null::double pv from sy union all
 select g.pid, g.k + 1, g.i, g.n, case when g.i = g.k then list_transform(g.r[2:], lambda x: x / g.r[1]) else list_transform(list_zip(g.r[2:], p.r[2:]), lambda t: t[1] - g.r[1] / p.r[1] * t[2]) end,
  case when g.i = g.k then g.r[1] else g.pv end from gj g join gj p on p.pid = g.pid and p.i = p.k where g.k <= g.n)""",
            "so as (select gj.pid, ob.*, r, pv from gj join ob on gj.i = ob.k where gj.k = gj.n + 1)",
        ]

    def cov(self, p: str, q: str) -> str:
        return cov(p, q, *self.res)

    def add(self, *ctes: str) -> System:
        self.ctes += ctes
        return self

    def text(self, final: str) -> str:
        return "with recursive " + ",\n ".join(self.ctes) + "\n" + final


def _trend(covariate: bool) -> list[str]:
    """CTE tr (pid, b0[, b1], i00[, i01, i11]): coefficients and their covariances, of the right sides 1[, x], v."""
    if not covariate:
        return ["tr as (select pid, sum(r[2]) / sum(r[1]) b0, 1 / sum(r[1]) i00 from so group by pid)"]
    sums = "sum(r[1]) a00, sum(i / 10.0 * r[1]) a01, sum(i / 10.0 * r[2]) a11, sum(r[3]) g0, sum(i / 10.0 * r[3]) g1"
    return [
        f"ts as (select pid, {sums} from so group by pid)",
        "tr as (select pid, (a11 * g0 - a01 * g1) / det b0, (a00 * g1 - a01 * g0) / det b1, a11 / det i00, -a01 / det i01, a00 / det i11 from (select *, a00 * a11 - a01 * a01 det from ts))",
    ]


def _right(covariate: bool) -> str:
    return "[1.0, a.i / 10.0, a.v]" if covariate else "[1.0, a.v]"


def gls(table: str, name: str, covariate: bool) -> str:
    s = System(table, name, _right(covariate)).add(*_trend(covariate))
    b = ["b0", "b1"][: 1 + covariate]
    return s.text("select cast(k as int) k, round(b, 6) + 0.0 b from (" + " union all ".join(f"select {k} k, {c} b from tr" for k, c in enumerate(b)) + ")")


def simple(table: str, name: str, mean: float) -> str:
    s = System(table, name, f"[a.v - {mean}]")
    return s.text(f"select ce.i, ce.j, round({mean} + sum(r[1] * {s.cov('so', 'ce')}), 6) + 0.0 p from ce, so, pars group by all")


def detrended(table: str, name: str) -> str:
    return System(table, name, _right(False)).add(*_trend(False)).text("select i, j, round(v - b0, 6) + 0.0 v from so join tr using (pid)")


def kriging(table: str, name: str, covariate: bool = False, variance: bool = False, **grid) -> str:
    """Predictions at all cells of the grid, with their variances if wanted; the covariate is i / 10."""
    s = System(table, name, _right(covariate), cells=variance, **grid).add(*_trend(covariate))
    m = 2 + covariate  # right sides before those of the cells
    rest, mean = (f"r[{m}] - b0 * r[1]" + " - b1 * r[2]" * covariate), "b0" + " + b1 * ce.i / 10.0" * covariate
    c = s.cov("so", "ce")
    more = f", sum(e * r[{m} + x.c]) q, sum(e * r[1]) k0, sum(e * r[{m - 1}]) k1" if variance else ""
    s.add(f"pr as (select x.c, ce.i, ce.j, any_value({mean}) m, sum(e * ({rest})) p{more} from (select ce.c, so.k, {c} e from ce, so, pars) x join ce on ce.c = x.c join so on so.k = x.k, tr group by all)")
    if not variance:
        return s.text("select i, j, round(m + p, 6) + 0.0 p from pr")
    v = "psill - q + (1.0 - k0) * (1.0 - k0) * i00"
    if covariate:
        v += " + 2 * (1.0 - k0) * (i / 10.0 - k1) * i01 + (i / 10.0 - k1) * (i / 10.0 - k1) * i11"
    return s.text(f"select i, j, round(m + p, 6) + 0.0 p, round({v}, 6) + 0.0 v from pr, tr, pars")


def layers(table: str, name: str, n: int, **grid) -> str:
    """Ordinary kriging of the layers v1 to vn, each with a mean of its own."""
    values = [f"v{k}" for k in range(1, n + 1)]
    one = f"{name}_v as (select i, j, [{', '.join(values)}] v from {name})"
    s = System(f"{table}, {one}", f"{name}_v", "[1.0] || a.v", **grid)
    s.add(f"tr as (select {', '.join(f'sum(r[{k + 1}]) / sum(r[1]) b{k}' for k in range(1, n + 1))} from so)")
    p = [f"any_value(b{k}) + sum({s.cov('so', 'ce')} * (r[{k + 1}] - b{k} * r[1])) p{k}" for k in range(1, n + 1)]
    s.add(f"pr as (select ce.i, ce.j, {', '.join(p)} from ce, so, pars, tr group by all)")
    return s.text(" union all ".join(f"select i, j, {k} lyr, round(p{k}, 6) + 0.0 p from pr" for k in range(1, n + 1)))


def likelihood(table: str, name: str, pars: str, mean: float | None, columns: str, **grid) -> str:
    """log_lik, aic, bic, quad_form, log_det of each parameter row."""
    s = System(table, name, "[1.0, a.v]" if mean is None else f"[1.0, a.v - {mean}]", pars, **grid)
    s.add(*_trend(False))
    b = "b0" if mean is None else "0"
    value = "v" if mean is None else f"v - {mean}"
    s.add(
        f"qu as (select pid, any_value(n) n_obs, sum((({value}) - {b}) * (r[2] - {b} * r[1])) quad_form, sum(ln(pv)) log_det from so join tr using (pid) group by pid)",
        f"li as (select *, -0.5 * (n_obs * ln(2 * pi()) + log_det + quad_form) log_lik, cast(4 + {int(mean is None)} - case when ry = rx then 1 else 0 end as int) n_pars from qu join pars using (pid))",
        "re as (select *, -2 * log_lik + 2 * n_pars aic, -2 * log_lik + n_pars * ln(n_obs) bic from li)",
    )
    return s.text(f"select {columns} from re")
