"""Queries of variograms, kernels, covariances, kriging, likelihoods, fits and simulation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from gridloom.functions import kernels
from gridloom.model import Axis, Grid, Mean, Params
from gridloom.operators import aggregate, display, kriging, likelihood, simulate, variogram
from gridloom.plans import linalg
from gridloom.queries import solve
from gridloom.queries.grids import GAU, MIXED, T1, T2, T3, T4, T5, t1, t2, t3, t4, t5
from gridloom.queries.relational import query, six

_ALL = f"""{T3}, ob as (select *, i + 50 * (j - 1) k from t3), pr as (select least(a.k, b.k) lo, greatest(a.k, b.k) hi, abs(a.v - b.v) dabs, abs(a.i - b.i) di, abs(a.j - b.j) dj, sqrt(pow(abs(a.i - b.i), 2) + pow(2.0 * abs(a.j - b.j), 2)) d
 from ob a join ob b on a.k > b.k)"""


def _breaks(n: int) -> str:
    return "[" + ", ".join(str(k / n) for k in range(n + 1)) + "]"


_BINNED = _ALL + f", br as (select quantile_cont(d, {_breaks(25)}) q from pr), bn as (select pr.*, cast(len([b for b in q if b <= d]) as int) bin from pr, br)"


@query("vg1_model", f"select cast(a.n as int) dy, cast(b.n as int) dx, round(2 * 0.5 + 4.0 * (1 - exp(-pow(a.n / 6.0, 2)) * exp(-pow(b.n / 5.0, 2))), 6) + 0.0 vg from (select unnest(range(0, 20)) n) a, (select unnest(range(0, 20)) n) b")
def _(spark, d):
    lags = spark.range(20).select(F.col("id").cast("int").alias("dy")).crossJoin(spark.range(20).select(F.col("id").cast("int").alias("dx")))
    return lags.select("dy", "dx", variogram.model(GAU, F.col("dy").cast("double"), F.col("dx").cast("double")).alias("vg"))


@query("vg1_envelope", "select round(d, 6) + 0.0 d, round(least(a, b, c), 6) + 0.0 low, round(greatest(a, b, c), 6) + 0.0 high from (select d, 1.0 + 4.0 * (1 - exp(-pow(d / 6.0, 2))) a, 1.0 + 4.0 * (1 - exp(-pow(d / 5.0, 2))) b, 1.0 + 4.0 * (1 - exp(-pow(d / sqrt(2) / 6.0, 2)) * exp(-pow(d / sqrt(2) / 5.0, 2))) c from (select unnest(range(0, 30)) * 1.0 d))")
def _(spark, d):
    x = np.arange(30.0)
    low, high = variogram.envelope(GAU, x)
    return spark.createDataFrame([tuple(map(float, r)) for r in zip(x, low, high)], "d double, low double, high double")


@query("vg2_sample")
def _(spark, d):
    return variogram.sample_cells(t1(spark, d), 100, seed=3).select("r", "i", "j")


@query("vg3_neighbourhoods")
def _(spark, d):
    return variogram.neighbourhoods(spark, t1(spark, d), 4, 4, up=1, seed=5)


def _pairs(spark, d, **how):
    """All pairs of the cells of t3, of which there are 550 at most."""
    return variogram.pairs(t3(spark, d), n_pp=550 * 549 // 2, **how)


@query("vg5_pairs", f"with {_BINNED} select cast(lo as bigint) lo, cast(hi as bigint) hi, {six('dabs', 'd')}, cast(di as int) di, cast(dj as int) dj, bin from bn")
def _(spark, d):
    p = _pairs(spark, d)
    return p.select(F.least("p1", "p2").alias("lo"), F.greatest("p1", "p2").alias("hi"), "dabs", "d", "di", "dj", "bin")


@query("vg6_layers")
def _(spark, d):
    return variogram.pairs(t4(spark, d), n_pp=500, seed=2).select("lyr", "p1", "p2", "dabs", "d", "bin")


@query("vg7_bins", f"with {_BINNED} select bin, count(*) n, round(min(d), 6) + 0.0 d_min, round(max(d), 6) + 0.0 d_max from bn group by bin")
def _(spark, d):
    return _pairs(spark, d).groupBy("bin").agg(F.count("*").alias("n"), F.min("d").alias("d_min"), F.max("d").alias("d_max"))


@query("vg8_widths", f"with {_ALL}, r as (select min(d) lo, max(d) hi from pr) select cast(least(floor((d - r.lo) / (r.hi - r.lo) * 10) + 1, 10) as int) bin, count(*) n from pr, r group by 1")
def _(spark, d):
    p = _pairs(spark, d, n_bin=1).drop("bin")
    return variogram.add_bins(p, 10, width=True).groupBy("bin").agg(F.count("*").alias("n"))


_STAT = {"classical": "avg(dabs * dabs)", "root_mean": "pow(avg(sqrt(dabs)), 4) / (0.457 + 0.494 / count(*))", "root_median": "pow(quantile_cont(sqrt(dabs), 0.5), 4) / 0.457"}


def _stat_query(name: str, sql: str):
    @query(f"ag6_{name}", f"with {_BINNED} select bin, count(*) n, round(avg(d), 6) + 0.0 d_mean, round({sql}, 4) + 0.0 stat from bn group by bin")
    def _(spark, d):
        return aggregate.bin_statistics(_pairs(spark, d), name).withColumn("stat", F.round("stat", 4))  # squares of three digits tie at six


for _n, _s in _STAT.items():
    _stat_query(_n, _s)


@query("ag6_user", f"with {_BINNED} select bin, count(*) n, round(avg(d), 6) + 0.0 d_mean, round(max(dabs), 6) + 0.0 stat from bn group by bin")
def _(spark, d):
    @F.pandas_udf("double")
    def largest(x: pd.Series) -> float:
        return float(x.max())

    p = _pairs(spark, d)
    own = p.groupBy("bin").agg(largest("dabs").alias("stat"))  # a user's aggregate stands alone in its plan
    return aggregate.bin_statistics(p).drop("stat").join(own, "bin")


@query("pl3_semivariogram", f"with {_BINNED} select bin, count(*) n, round(avg(d), 6) + 0.0 d_mean, round(avg(dabs * dabs) / 2, 4) + 0.0 stat from bn where d < (select max(d) from pr) group by bin")
def _(spark, d):
    return variogram.semivariogram(_pairs(spark, d))[0].withColumn("stat", F.round("stat", 4))


@query("pl3_ribbon", f"""with {_ALL}, ds as (select unnest(range(0, 100)) * (select max(d) from pr) / 99 d), en as (select d, 1.0 + 4.0 * (1 - exp(-pow(d / 6.0, 2))) a, 1.0 + 4.0 * (1 - exp(-pow(d / 5.0, 2))) b, 1.0 + 4.0 * (1 - exp(-pow(d / sqrt(2) / 6.0, 2)) * exp(-pow(d / sqrt(2) / 5.0, 2))) c from ds)
 select round(d, 6) + 0.0 d, round(least(a, b, c) / 2, 6) + 0.0 low, round(greatest(a, b, c) / 2, 6) + 0.0 high from en""")
def _(spark, d):
    return variogram.semivariogram(_pairs(spark, d), GAU)[1]


@query("pl2_footprint", "select cast(a.i as int) i, cast(b.j as int) j, abs(a.i - 11.0) + 0.0 dy, 2.0 * abs(b.j - 6.0) + 0.0 dx, round(4.0 * exp(-pow((a.i - 11) / 6.0, 2)) * exp(-pow(2.0 * (b.j - 6) / 5.0, 2)) + case when a.i = 11 and b.j = 6 then 0.5 else 0 end, 6) + 0.0 cov from (select unnest(range(1, 22)) i) a, (select unnest(range(1, 12)) j) b")
def _(spark, d):
    return display.footprint(spark, GAU, Grid(21, 11, 1.0, 2.0))


@query("se2_union", f"with {_ALL}, un as (select dabs, d from pr where di > 5 union all select dabs, d from pr where dj > 3), br as (select quantile_cont(d, {_breaks(10)}) q from un) select bin, count(*) n, round(avg(d), 6) + 0.0 d_mean, round(avg(dabs * dabs), 4) + 0.0 stat from (select un.*, cast(len([b for b in q if b <= d]) as int) bin from un, br) group by bin")
def _(spark, d):
    p = _pairs(spark, d).select("dabs", "d", "di", "dj")
    both = p.where("di > 5").select("dabs", "d").unionByName(p.where("dj > 3").select("dabs", "d"))
    return aggregate.bin_statistics(variogram.add_bins(both, 10)).withColumn("stat", F.round("stat", 4))


# -- parameters


@query("pr2_bounds", "select * from (values ('y.kap', 1.0::double, 10.0::double, 30.0::double), ('x.kap', 0.5, 1.0, 2.0)) t(param, lower, initial, upper)")
def _(spark, d):
    b = likelihood.bounds(t3(spark, d), Params(Axis("mat"), Axis("gxp")))
    return likelihood.bounds_table(spark, b).drop("fitted").where("param like '%kap'")


@query("pr3_make", "select * from (values ('eps', null::double), ('psill', 2.0), ('y.rho', 3.0), ('x.rho', null)) t(param, value)")
def _(spark, d):
    from gridloom.model import make_params

    p = make_params({"y": {"k": "exp", "rho": 3.0}, "x": {"k": "exp"}, "psill": 2.0})
    return spark.createDataFrame(list(zip(p.names, p.vector())), "param string, value double")


@query("pr5_templates", "select * from (values ('exp', ['rho']), ('gau', ['rho']), ('sph', ['rho']), ('gxp', ['rho', 'kap']), ('mat', ['rho', 'kap'])) t(k, names)")
def _(spark, d):
    from gridloom.model import KERNELS

    return spark.createDataFrame([(k, list(v)) for k, v in KERNELS.items()], "k string, names array<string>")


@query("pr1_defaults", f"with {T3}, s as (select var_samp(v) s from t3) select param, round(lower, 6) + 0.0 lower, round(initial, 6) + 0.0 initial, round(upper, 6) + 0.0 upper from (select 'eps' param, 1e-6 lower, s / 2 initial, 2 * s upper from s union all select 'psill', 1e-6, s / 2, 2 * s from s union all select 'y.rho', 1, sqrt(50), 50 union all select 'x.rho', 2, sqrt(2 * 22), 22)")
def _(spark, d):
    g = t3(spark, d)
    return likelihood.bounds_table(spark, likelihood.bounds(g, Params())).drop("fitted")


@query("pr4_update", "select * from (values ('eps', 1.0::double), ('psill', 2.0), ('y.rho', 3.0), ('x.rho', 3.0)) t(param, value)")
def _(spark, d):
    p = GAU.update([0.5, 2.0, 3.0], iso=True, eps_scaled=True)
    return spark.createDataFrame(list(zip(p.names, p.vector())), "param string, value double")


# -- kernels


# a Bessel function by the trapezoid rule
_BESSEL = "list_sum(list_transform(range(0, 1200), lambda k: case when k = 0 then 0.5 else 1 end * exp(-a * cosh(k / 100.0)) * cosh(1.7 * k / 100.0))) / 100"


@query("kn_mat_any", f"select cast(n as int) lag, round(case when n = 0 then 1 else pow(2, 1 - 1.7) / gamma(1.7) * pow(a, 1.7) * {_BESSEL} end, 6) + 0.0 c from (select n, 2 * sqrt(1.7) * n / 4.0 a from (select unnest(range(0, 30)) n))")
def _(spark, d):
    """A Matern kernel of any shape, by numerical integration."""
    return spark.createDataFrame([(k, float(c)) for k, c in enumerate(kernels.first_row(Axis("mat", 4.0, 1.7), 30, 1.0))], "lag int, c double")


_N = "(select unnest(range(0, 30)) n)"


def _kernel(name: str, axis: Axis, sql: str) -> None:
    @query(f"kn_{name}", f"select cast(n as int) lag, round({sql}, 6) + 0.0 c from {_N}")
    def _(spark, d):
        return spark.range(30).select(F.col("id").cast("int").alias("lag"), kernels.correlation_column(axis, F.col("id").cast("double")).alias("c"))

    @query(f"kn_{name}_numpy", f"select cast(n as int) lag, round({sql}, 6) + 0.0 c from {_N}")
    def _(spark, d):
        return spark.createDataFrame([(k, float(c)) for k, c in enumerate(kernels.first_row(axis, 30, 1.0))], "lag int, c double")


_kernel("exp", Axis("exp", 4.0), "exp(-n / 4.0)")
_kernel("gau", Axis("gau", 4.0), "exp(-pow(n / 4.0, 2))")
_kernel("sph", Axis("sph", 9.0), "case when n < 9 then 1 - 1.5 * (n / 9.0) + 0.5 * pow(n / 9.0, 3) else 0 end")
_kernel("gxp", Axis("gxp", 4.0, 1.3), "exp(-pow(n / 4.0, 1.3))")
_kernel("mat15", Axis("mat", 4.0, 1.5), "(1 + 2 * sqrt(1.5) * n / 4.0) * exp(-2 * sqrt(1.5) * n / 4.0)")
_kernel("mat25", Axis("mat", 4.0, 2.5), "(1 + 2 * sqrt(2.5) * n / 4.0 + pow(2 * sqrt(2.5) * n / 4.0, 2) / 3) * exp(-2 * sqrt(2.5) * n / 4.0)")


@query("kn6_lags", "select 'y' axis, cast(n as int) lag, round(exp(-pow(n / 6.0, 2)), 6) + 0.0 c from (select unnest(range(0, 50)) n) union all select 'x', cast(n as int), round(exp(-pow(2.0 * n / 5.0, 2)), 6) + 0.0 from (select unnest(range(0, 11)) n)")
def _(spark, d):
    return kernels.lag_table(spark, GAU, Grid(50, 11, 1.0, 2.0))


# -- covariance

_COV = "4.0 * exp(-pow((a.i - b.i) / 6.0, 2)) * exp(-pow(2.0 * (a.j - b.j) / 5.0, 2))"


@query("cv1_entries", f"with {T3} select a.i ia, a.j ja, b.i ib, b.j jb, round({_COV} + case when a.i = b.i and a.j = b.j then 0.5 else 0 end, 6) + 0.0 c from t3 a, t3 b")
def _(spark, d):
    g = t3(spark, d)
    ob = g.cells
    a, b = ob.select(F.col("i").alias("ia"), F.col("j").alias("ja")), ob.select(F.col("i").alias("ib"), F.col("j").alias("jb"))
    cy, cx = kernels.lag_array(GAU.y, g.ny, g.dy), kernels.lag_array(GAU.x, g.nx, g.dx)
    same = (F.col("ia") == F.col("ib")) & (F.col("ja") == F.col("jb"))
    c = GAU.psill * F.get(cy, F.abs(F.col("ia") - F.col("ib"))) * F.get(cx, F.abs(F.col("ja") - F.col("jb"))) + F.when(same, GAU.eps).otherwise(0.0)
    return a.crossJoin(b).withColumn("c", c)  # the matrix itself is all pairs of observed cells


@query("cv2_kronecker", "select cast(a.i + 4 * (a.j - 1) as int) a, cast(b.i + 4 * (b.j - 1) as int) b, round(4.0 * exp(-pow((a.i - b.i) / 6.0, 2)) * exp(-pow((a.j - b.j) / 5.0, 2)) + case when a.i = b.i and a.j = b.j then 0.5 else 0 end, 6) + 0.0 c from (select * from (select unnest(range(1, 5)) i), (select unnest(range(1, 4)) j)) a, (select * from (select unnest(range(1, 5)) i), (select unnest(range(1, 4)) j)) b")
def _(spark, d):
    v = linalg.kronecker(GAU, Grid(4, 3))
    return spark.createDataFrame([(a + 1, b + 1, float(v[a, b])) for a in range(12) for b in range(12)], "a int, b int, c double")


@query("cv1_scaled", f"with {T3} select a.i ia, a.j ja, b.i ib, b.j jb, round(exp(-pow((a.i - b.i) / 6.0, 2)) * exp(-pow(2.0 * (a.j - b.j) / 5.0, 2)) + case when a.i = b.i and a.j = b.j then 0.125 else 0 end, 6) + 0.0 c from t3 a, t3 b")
def _(spark, d):
    from gridloom.plans.strategy import collect

    obs = collect(t3(spark, d))
    v = linalg.covariance(GAU, obs.grid, obs.i, obs.j, scaled=True)
    a, b = np.indices(v.shape).reshape(2, -1)
    return spark.createDataFrame(pd.DataFrame({"ia": obs.i[a], "ja": obs.j[a], "ib": obs.i[b], "jb": obs.j[b], "c": v.ravel()}), "ia int, ja int, ib int, jb int, c double")


@query("cv3_factor", solve.System(T3, "t3", "[1.0]").text("select g.i - 1 a, g.k - 1 b, round(g.r[1] / sqrt(p.r[1]), 6) + 0.0 l from gj g join gj p on p.k = g.k and p.i = p.k where g.i >= g.k and g.k <= g.n"))
def _(spark, d):
    from gridloom.plans.strategy import collect

    low = collect(t3(spark, d), separable=False).factor(GAU).l  # of listed cells, also where they form a lattice
    a, b = np.tril_indices(len(low))
    return spark.createDataFrame(pd.DataFrame({"a": a, "b": b, "l": low[a, b]}), "a long, b long, l double")


@query("cv5_solve", solve.System(T3, "t3", "[a.v]").text("select i, j, round(r[1], 6) + 0.0 v from so"))
def _(spark, d):
    from gridloom.plans.strategy import collect

    obs = collect(t3(spark, d))
    w = obs.factor(GAU).power(obs.z)[:, 0]
    return spark.createDataFrame([(int(i), int(j), float(v)) for i, j, v in zip(obs.i, obs.j, w)], "i int, j int, v double")


@query("cv4_quadratic", solve.System(T3, "t3", "[a.v]").text("select round(sum(v * r[1]), 6) + 0.0 q from so"))
def _(spark, d):
    from gridloom.plans.strategy import collect

    obs = collect(t3(spark, d))
    return spark.createDataFrame([(float((obs.factor(GAU, "eigen").half(obs.z) ** 2).sum()),)], "q double")


@query("cv5_distributed", f"with {T1} select i, j, {six('v')} from t1")
def _(spark, d):
    """V^(1/2) V^(1/2) V^-1 z is z again, each power distributed over columns and rows."""
    g = t1(spark, d)
    one = linalg.separable_power(g.cells, MIXED, g, -1.0)
    for _ in range(2):
        one = linalg.separable_power(one, MIXED, g, 0.5)
    return one


_SPREAD = f"with {T3}, ob as (select i, j, (v - 38) / 100 w from t3) select cast(a.i as int) i, cast(a.j as int) j, round(sum(w * {_COV}), 6) + 0.0 v from (select a.i, b.j from (select unnest(range(1, 51)) i) a, (select unnest(range(1, 12)) j) b) a, ob b group by a.i, a.j"


@query("cv6_spread", _SPREAD)
def _(spark, d):
    g = t3(spark, d)
    return linalg.spread(g.cells.withColumn("v", (F.col("v") - 38) / 100), GAU, g)


@query("cv6_fft", _SPREAD)
def _(spark, d):
    g = t3(spark, d)
    return linalg.toeplitz_cells(g.cells.withColumn("v", (F.col("v") - 38) / 100), GAU, g)


# -- kriging


@query("es1_gls", solve.gls(T3, "t3", False))
def _(spark, d):
    b = kriging.gls_coefficients(t3(spark, d), GAU)
    return spark.createDataFrame([(k, float(v)) for k, v in enumerate(b)], "k int, b double")


def _covariate(spark, d):
    return t1(spark, d).cells.select("i", "j", F.array(F.col("i") / 10).alias("x"))


@query("es1_gls_covariate", solve.gls(T3, "t3", True))
def _(spark, d):
    b = kriging.gls_coefficients(t3(spark, d), GAU, Mean.covariates(_covariate(spark, d)))
    return spark.createDataFrame([(k, float(v)) for k, v in enumerate(b)], "k int, b double")


@query("es2_simple", solve.simple(T3, "t3", 38.0))
def _(spark, d):
    return kriging.krige(spark, t3(spark, d), GAU, Mean.known(38.0), detrend=True)


@query("es3_ordinary", solve.kriging(T3, "t3"))
def _(spark, d):
    return kriging.krige(spark, t3(spark, d), GAU)


@query("es4_universal", solve.kriging(T3, "t3", True))
def _(spark, d):
    return kriging.krige(spark, t3(spark, d), GAU, Mean.covariates(_covariate(spark, d)))


@query("es5_variance", solve.kriging(T3, "t3", False, True))
def _(spark, d):
    return kriging.krige(spark, t3(spark, d), GAU, variance=True)


@query("es5_universal", solve.kriging(T3, "t3", True, True))
def _(spark, d):
    return kriging.krige(spark, t3(spark, d), GAU, Mean.covariates(_covariate(spark, d)), variance=True)


_T2 = {"dim": (13, 21), "res": (1.0, 1.0)}


@query("es6_lattice", solve.kriging(T2, "t2", False, True, **_T2))
def _(spark, d):
    """The cells form a coarse lattice, so the separable path answers; SQL has the dense one."""
    return kriging.krige(spark, t2(spark, d), GAU, variance=True)


@query("es3_layers", solve.layers(T4, "t4", 3, dim=(50, 9), res=(1.0, 1.0)))
def _(spark, d):
    return kriging.krige(spark, t4(spark, d), GAU).select("i", "j", F.posexplode("p").alias("lyr", "p")).withColumn("lyr", F.col("lyr") + 1)


@query("ds1_down_scale", solve.kriging(T2, "t2", False, True, **_T2))
def _(spark, d):
    return kriging.down_scaled(spark, t5(spark, d), 2, GAU, variance=True)[1]


@query("dt1_detrend", solve.detrended(T3, "t3"))
def _(spark, d):
    return kriging.detrended(spark, t3(spark, d), GAU).cells


# -- likelihood

_LIK = "round(log_lik, 6) + 0.0 log_lik, round(aic, 6) + 0.0 aic, round(bic, 6) + 0.0 bic, round(quad_form, 6) + 0.0 quad_form, round(log_det, 6) + 0.0 log_det, cast(n_obs as int) n_obs, n_pars, 1 n_layer"


@query("ll1_known", solve.likelihood(T3, "t3", solve.PARS, 38.0, _LIK))
def _(spark, d):
    return likelihood.as_table(spark, likelihood.log_likelihood(t3(spark, d), GAU, Mean.known(38.0)))


@query("ll1_profile", solve.likelihood(T3, "t3", solve.PARS, None, _LIK))
def _(spark, d):
    return likelihood.as_table(spark, likelihood.log_likelihood(t3(spark, d), GAU, Mean.constant(), method="eigen"))


_SURFACE = "select row_number() over () pid, 4.0 psill, 0.5 eps, ry, rx from (select unnest([2.0, 4.0, 6.0, 9.0]) ry) a, (select unnest([3.0, 5.0, 8.0]) rx) b"


_T5 = {"dim": (7, 11), "res": (2.0, 2.0)}


@query("ll3_surface", solve.likelihood(T5, "t5", _SURFACE, 38.0, "ry + 0.0 as y_rho, rx + 0.0 as x_rho, round(-log_lik, 6) + 0.0 nll", **_T5))
def _(spark, d):
    return likelihood.surface(spark, t5(spark, d), GAU, {"y.rho": [2.0, 4.0, 6.0, 9.0], "x.rho": [3.0, 5.0, 8.0]}, Mean.known(38.0)).drop("p")


@query("st2_arg_min", solve.likelihood(T5, "t5", _SURFACE, 38.0, "ry + 0.0 as yr, rx + 0.0 as xr, round(-log_lik, 6) + 0.0 nll", **_T5) + " order by nll limit 1")
def _(spark, d):
    s = likelihood.surface(spark, t5(spark, d), GAU, {"y.rho": [2.0, 4.0, 6.0, 9.0], "x.rho": [3.0, 5.0, 8.0]}, Mean.known(38.0))
    return s.orderBy("nll").limit(1).select(F.col("y_rho").alias("yr"), F.col("x_rho").alias("xr"), "nll")


@query("ft1_fit")
def _(spark, d):
    f = likelihood.fit(t3(spark, d), "gau", iso=True)
    fitted = dict(zip(f.params.names, f.params.vector()))
    return likelihood.bounds_table(spark, f.bounds, fitted)


@query("ft2_one")
def _(spark, d):
    f = likelihood.fit(t5(spark, d), {"y": {"k": "exp", "rho": None}, "x": {"k": "exp", "rho": None}, "psill": 4.0, "eps": 0.5}, iso=True)
    return spark.createDataFrame([(f.params.y.rho, f.nll, f.initial_nll, f.improved)], "rho double, nll double, initial_nll double, improved boolean")


@query("sm1_simulate")
def _(spark, d):
    return simulate.simulate(spark, Grid(40, 30), MIXED, seed=11).cells


@query("cx1_folds")
def _(spark, d):
    return simulate.folds(t3(spark, d), 5, 2, seed=1)


@query("cx1_scores")
def _(spark, d):
    models = {"gau": GAU, "exp": Params(Axis("exp", 6.0), Axis("exp", 6.0), 4.0, 0.5), "mat": MIXED}
    return simulate.cross_validate(t3(spark, d), models, 5, 2, seed=1)

