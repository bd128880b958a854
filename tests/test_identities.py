"""Algebraic identities and brute-force checks of the grid library, with fixed seeds."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import kernels, scalar
from gridloom.model import Axis, Grid, Mean, Params, completeness, constant, create, make_params
from gridloom.operators import aggregate, display, index, kriging, likelihood, simulate, snap, variogram
from gridloom.plans import linalg
from gridloom.plans.strategy import collect
from gridloom.sources import tables

P = Params(Axis("gau", 3.0), Axis("gau", 4.0), 2.0, 0.5)
MAT = Params(Axis("mat", 3.0, 1.7), Axis("exp", 4.0), 2.0, 0.3)


def grid_of(spark, z: np.ndarray, **meta) -> Grid:
    rows = [(int(i) + 1, int(j) + 1, float(z[i, j])) for i, j in zip(*np.nonzero(~np.isnan(z)))]
    return create(spark.createDataFrame(rows, "i int, j int, v double"), dim=z.shape, **meta)


def matrix_of(grid: Grid, column: str = "v", cells=None) -> np.ndarray:
    out = np.full(grid.dim, np.nan)
    for r in (cells if cells is not None else grid.cells).collect():
        out[r["i"] - 1, r["j"] - 1] = r[column]
    return out


@pytest.fixture(scope="module")
def z():
    return np.random.default_rng(3).standard_normal((9, 7))


@pytest.fixture(scope="module")
def holes(z):
    out = z.copy()
    out[np.random.default_rng(4).random(z.shape) < 0.6] = np.nan
    return out


# -- construction


def test_construction_and_errors(spark, z):
    g = grid_of(spark, z)
    assert g.dim == (9, 7) and len(g) == 63 and completeness(g).value == "complete"
    assert completeness(create(dim=5)).value == "empty" and create(dim=5).dim == (5, 5)
    with pytest.raises(ValueError):
        create(dim=(1, 4))
    with pytest.raises(ValueError):
        create(dim=(2, 3, 4))
    with pytest.raises(ValueError):
        create()
    with pytest.raises(ValueError):
        create(lines=([0.0, 1.0, 3.0], [0.0, 1.0]))
    with pytest.raises(ValueError):
        create(lines=([0.0, 1.0], [0.0, 1.0]), res=(1.1, 1.0))
    assert create(lines=([5.0, 7.0, 9.0], [0.0, 1.0])).dy == 2.0
    twice = spark.createDataFrame([(1, 1, 1.0), (1, 1, 2.0)], "i int, j int, v double")
    with pytest.raises(ValueError):
        create(twice, dim=(3, 3))
    outside = spark.createDataFrame([(4, 1, 1.0)], "i int, j int, v double")
    with pytest.raises(ValueError):
        create(outside, dim=(3, 3))
    assert matrix_of(constant(spark, create(dim=(3, 2)), 4.0)).tolist() == [[4.0, 4.0]] * 3
    with pytest.raises(ValueError):
        tables.require_crs("A", "B")
    assert tables.require_crs("A", None) == "A"


def test_layers_share_a_mask(spark):
    rows = spark.createDataFrame([(1, 1, 1, 1.0), (1, 1, 2, 2.0), (2, 2, 1, 3.0), (2, 2, 2, 4.0)], "i int, j int, layer int, v double")
    g = tables.from_layers(rows, (2, 2), 2)
    assert g.layered and index.layer(g, 2).cells.orderBy("i").collect()[1]["v"] == 4.0
    with pytest.raises(Exception, match="layers"):
        tables.from_layers(rows.where("not (i = 2 and layer = 2)"), (2, 2), 2).cells.collect()


def test_no_data(spark):
    g = create(dim=(3, 4))
    assert index.any_missing(g) and index.missing(spark, g).where("missing").count() == 12


def test_csv_and_parquet_round_trip(spark, tmp_path):
    pts = spark.createDataFrame([(1, 0.5, 1.5, 2.0), (2, 1.0, 2.0, float("nan"))], "pt_id long, y double, x double, v double")
    for kind in ("parquet", "csv"):
        tables.write(pts, str(tmp_path / kind), kind, ("pt_id",))
        back = tables.read_points(spark, str(tmp_path / kind), kind).orderBy("pt_id").collect()
        assert back[0]["v"] == 2.0 and back[1]["v"] is None


# -- index


@pytest.mark.parametrize("up", [(2, 3), (4, 2), (1, 1)])
def test_up_undoes_down(spark, z, up):
    g = grid_of(spark, z)
    back = index.up_scale(index.down_scale(g, up), up)
    assert back.dim == g.dim and np.allclose(matrix_of(back), z)
    assert math.isclose(back.dy, g.dy) and math.isclose(back.y0, g.y0)


def test_index_round_trip_and_guard(spark):
    i, j = index.to_ij(9)
    rows = spark.range(1, 64).select(F.col("id").alias("k")).select("k", i.alias("i"), j.alias("j"))
    assert rows.where(index.to_k(9) != F.col("k")).count() == 0
    with pytest.raises(Exception, match="row index"):
        spark.createDataFrame([(10, 1)], "i int, j int").select(index.to_k(9)).collect()


def test_up_scale_keeps_coordinates_of_its_rows(spark, z):
    g = grid_of(spark, z[:8])  # (ny - 1) is no multiple of the factor
    u = index.up_scale(g, (3, 1))
    want = {1: 7.0, 2: 4.0, 3: 1.0}
    assert {r["i"]: r["y"] for r in u.cells.withColumn("y", u.y_of()).collect()} == want


def test_sub_grid_and_find(spark, z):
    m = np.full((20, 20), np.nan)
    m[2:20:6, 3:19:5] = z[:3, :4]
    g = grid_of(spark, m)
    f = index.find_sub_grid(g)
    assert f["ij"] == {"i": [3, 9, 15], "j": [4, 9, 14, 19]} and f["step"] == {"i": 6, "j": 5}
    sub = index.sub_grid(spark, g, keep=f["ij"])
    assert np.allclose(matrix_of(sub), z[:3, :4])
    one = np.full((4, 4), np.nan)
    one[1, 2] = 5.0
    assert index.find_sub_grid(grid_of(spark, one))["dim"] == (1, 1)
    m[0, 0] = 1.0
    assert index.find_sub_grid(grid_of(spark, m)) is None
    with pytest.raises(ValueError):
        index.sub_grid(spark, g, keep={"i": [1, 2, 4]})


def test_trim_peels_borders(spark, z):
    m = np.full((13, 12), np.nan)
    m[2:11, 3:10] = z
    assert index.trim(spark, grid_of(spark, m)) == {"i": (3, 11), "j": (4, 10)}


# -- functions


def test_gamma_family(spark):
    xs = [0.1, 0.5, 1.0, 1.5, 2.0, 3.7, 9.0, 25.5, -0.5, -1.5, -2.3]
    df = spark.createDataFrame([(x,) for x in xs], "v double").select("v", scalar.gamma(F.col("v")).alias("g"), scalar.lgamma(F.col("v")).alias("l"), scalar.digamma(F.col("v")).alias("d"), scalar.trigamma(F.col("v")).alias("t"))
    for r in df.collect():
        assert math.isclose(r["g"], math.gamma(r["v"]), rel_tol=1e-10)
        assert math.isclose(r["l"], math.lgamma(r["v"]), rel_tol=1e-9, abs_tol=1e-11)
        h = 1e-5
        f = lambda v: math.log(abs(math.gamma(v)))
        assert math.isclose(r["d"], (f(r["v"] + h) - f(r["v"] - h)) / (2 * h), rel_tol=1e-5, abs_tol=1e-7)
    got = {r["v"]: r for r in df.collect()}
    assert math.isclose(got[1.0]["d"], -0.57721566490153286, rel_tol=1e-12) and math.isclose(got[1.0]["t"], math.pi**2 / 6, rel_tol=1e-12)
    assert math.isclose(got[0.5]["t"], math.pi**2 / 2, rel_tol=1e-12)
    poles = spark.createDataFrame([(0.0,), (-3.0,)], "v double").select(scalar.gamma(F.col("v")).alias("g"), scalar.lgamma(F.col("v")).alias("l")).collect()
    assert all(math.isnan(r["g"]) and math.isinf(r["l"]) for r in poles)


def test_division_never_raises(spark):
    df = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (7.0, -3.0), (None, 1.0)], "a double, b double")
    got = df.select(scalar.divide(F.col("a"), F.col("b")).alias("q"), scalar.floor_mod(F.col("a"), F.col("b")).alias("m")).collect()
    assert got[0]["q"] == math.inf and got[1]["q"] == -math.inf and math.isnan(got[2]["q"]) and got[4]["q"] is None
    assert math.isnan(got[0]["m"]) and got[3]["m"] == -2.0


def test_unknown_function_and_dimensions(spark, z):
    g = grid_of(spark, z)
    with pytest.raises(ValueError):
        scalar.math_function(g, "cumsum")
    with pytest.raises(ValueError):
        scalar.combine(g, "+", grid_of(spark, z[:5]))
    assert len(scalar.MATH) == 25
    assert np.allclose(matrix_of(scalar.math_function(g, "round")), np.round(z))


def test_layered_arithmetic_on_incomplete_grids(spark):
    g = create(spark.createDataFrame([(1, 1, [1.0, 2.0]), (2, 2, [3.0, 4.0])], "i int, j int, v array<double>"), dim=(3, 3))
    out = {r["i"]: r["v"] for r in scalar.combine(g, "*", scalar.math_function(g, "sqrt")).cells.collect()}
    assert np.allclose(out[2], [3 * math.sqrt(3), 8.0])


# -- snapping


def test_snap_modes(spark):
    g = create(dim=(4, 3), res=(1.0, 2.0), origin=(10.0, 0.0))
    pts = spark.createDataFrame([(1, 10.5, 1.0, 5.0), (2, 10.4, 0.9, 6.0), (3, 15.2, -3.0, 7.0)], "pt_id long, y double, x double, v double")
    whole, report = snap.snap(pts, snap.Lattice(grid=g))
    assert whole.dim == (6, 5) and whole.y0 == 10.0 and whole.x0 == -4.0 or whole.x0 == -2.0
    only, _ = snap.snap(pts, snap.Lattice(grid=g), crop_from=True)
    rows = only.cells.collect()
    assert only.dim == g.dim and len(rows) == 1 and rows[0]["v"] == 5.0 and (rows[0]["i"], rows[0]["j"]) == (4, 1)  # ties go low, first point wins
    r = report.first()
    assert (r["n_points"], r["n_duplicates"]) == (3, 1)
    single, _ = snap.snap(pts.where("pt_id = 1"), snap.Lattice(grid=g))
    assert single.cells.count() == 1
    order, _ = snap.snap(pts.drop("v"), snap.Lattice(dim=(3, 3)))
    assert sorted(x["v"] for x in order.cells.collect())[0] == 1.0
    with pytest.raises(ValueError):
        snap.snap(pts.where("pt_id > 9"))


def test_order_numbers(spark):
    from gridloom.plans.ordering import numbered

    keys = [int(k) for k in np.random.default_rng(0).permutation(500) * 3 - 40] + [5, 5]
    df = spark.createDataFrame([(k,) for k in keys], "pt_id long").repartition(7)
    for ranges in (1, 3, 16):
        got = sorted((r["n"], r["pt_id"]) for r in numbered(df, "pt_id", "n", ranges).collect())
        assert [n for n, _ in got] == list(range(1, 503)) and [k for _, k in got] == sorted(keys)
    assert numbered(df.where("pt_id > 9999"), "pt_id", "n").count() == 0


# -- variograms


def test_bins(spark):
    df = spark.createDataFrame([(float(k),) for k in range(11)], "d double")
    got = {r["d"]: r["bin"] for r in variogram.add_bins(df, 5).collect()}
    assert got[0.0] == 1 and got[2.0] == 2 and got[9.9 // 1] == 5 and got[10.0] == 6  # the greatest lies beyond the last break
    assert {r["bin"] for r in variogram.add_bins(df, 1).collect()} == {1}
    assert max(r["bin"] for r in variogram.add_bins(df, 50).collect()) == 12
    assert {r["bin"] for r in variogram.add_bins(df, 5, probs=[0.0, 0.5]).collect()} == {1, 2}
    assert max(r["bin"] for r in variogram.add_bins(df, 5, width=True).collect()) == 5


def test_samples(spark, z):
    g = grid_of(spark, np.random.default_rng(1).standard_normal((30, 30)))
    a, b = (variogram.sample_cells(g, 20, seed=s).collect() for s in (1, 1))
    assert a == b and len({(r["i"], r["j"]) for r in a}) == 20
    near = variogram.neighbourhoods(spark, g, 4, 4, up=1, seed=2)
    assert near.count() == 4 * 25 and near.select("i", "j").distinct().count() == 100  # no overlap
    with pytest.raises(ValueError):
        variogram.neighbourhoods(spark, g, 4, 5, up=1)
    with pytest.raises(ValueError):
        variogram.neighbourhoods(spark, g, 4, 16, up=1)
    assert variogram.points_for_pairs(10_000, 10**6) == 141


def test_standard_variogram_is_twice_the_part(spark):
    row = spark.range(1).select(variogram.model(P, F.lit(2.0), F.lit(0.0)).alias("a"), variogram.model(P, F.lit(2.0), F.lit(0.0), standard=True).alias("b")).first()
    assert math.isclose(row["b"] - 1.0, 2 * (row["a"] - 1.0))


# -- kernels and covariance


def test_matern_and_limits():
    d = np.linspace(0, 20, 41)
    for kap, closed in ((0.5, lambda u: np.exp(-u)), (1.5, lambda u: (1 + u) * np.exp(-u)), (2.5, lambda u: (1 + u + u * u / 3) * np.exp(-u))):
        u = 2 * math.sqrt(kap) * d / 3.0
        assert np.allclose(kernels.correlation(Axis("mat", 3.0, kap), d), closed(u), rtol=1e-12, atol=1e-15)
    assert Axis("gex", 2.0, 1.0).k == "gxp"
    with pytest.raises(ValueError):
        Axis("cubic")


def test_kronecker_and_blocks():
    g = Grid(5, 4, 1.0, 2.0)
    i, j = np.tile(np.arange(1, 6), 4), np.repeat(np.arange(1, 5), 5)
    assert np.allclose(linalg.kronecker(MAT, g), linalg.covariance(MAT, g, i, j))
    assert np.allclose(linalg.covariance(MAT, g, i, j, scaled=True) * MAT.psill, linalg.covariance(MAT, g, i, j))
    assert np.allclose(kernels.matrix(MAT.y, 10, 1.0, np.arange(2, 5), np.arange(2, 5)), kernels.matrix(MAT.y, 10)[1:4, 1:4])


@pytest.mark.parametrize("p", [-1.0, -0.5, 0.5, 2.0])
def test_powers(spark, z, p):
    g = grid_of(spark, z)
    v = linalg.kronecker(MAT, g)
    w, u = np.linalg.eigh(v)
    want = u @ (w**p * (u.T @ z.T.ravel()))
    assert np.allclose(linalg.Separable(MAT, g).power(z.T.ravel(), p), want)
    assert np.allclose(linalg.Dense(v, "eigen").power(z.T.ravel(), p), want)
    if p == -1.0:
        assert np.allclose(linalg.Dense(v).power(z.T.ravel()), want)
        assert np.allclose(matrix_of(g, cells=linalg.separable_power(g.cells, MAT, g, p)).T.ravel(), want)
    else:
        with pytest.raises(ValueError):
            linalg.Dense(v).power(z.T.ravel(), p)


def test_log_determinants_agree(spark, z):
    g = grid_of(spark, z)
    v = linalg.kronecker(MAT, g)
    assert np.allclose([linalg.Dense(v).log_det(), linalg.Dense(v, "eigen").log_det(), linalg.Separable(MAT, g).log_det()], np.linalg.slogdet(v)[1])


def test_toeplitz():
    s = np.arange(1, 11)
    y, x = np.exp(1 - s), np.exp(2 * (1 - s))
    m = np.zeros((10, 10))
    m.flat[np.random.default_rng(0).choice(100, 10, replace=False)] = np.arange(10) + 1
    t = lambda r: r[np.abs(np.subtract.outer(np.arange(10), np.arange(10)))]
    assert np.allclose(linalg.toeplitz(y, m), t(y) @ m) and np.allclose(linalg.toeplitz(y, m, x), t(y) @ m @ t(x))


# -- kriging against dense algebra


def brute(z: np.ndarray, params: Params, res=(1.0, 1.0), x: np.ndarray | None = None, known: float | None = None):
    ny, nx = z.shape
    g = Grid(ny, nx, *res)
    i, j = np.tile(np.arange(1, ny + 1), nx), np.repeat(np.arange(1, nx + 1), ny)
    seen = ~np.isnan(z.T.ravel())
    c = linalg.covariance(Params(params.y, params.x, params.psill, 0.0), g, i, j)[:, seen]
    vi = np.linalg.inv(linalg.covariance(params, g, i[seen], j[seen]))
    y = z.T.ravel()[seen]
    if known is not None:
        return known + c @ vi @ (y - known), params.psill - np.einsum("ab,bc,ac->a", c, vi, c)
    d = np.ones((len(i), 1)) if x is None else np.column_stack([np.ones(len(i)), x.T.ravel()])
    do = d[seen]
    q = np.linalg.inv(do.T @ vi @ do)
    b = q @ do.T @ vi @ y
    r = d - c @ vi @ do
    return d @ b + c @ vi @ (y - do @ b), params.psill + np.einsum("ab,bc,ac->a", r, q, r) - np.einsum("ab,bc,ac->a", c, vi, c)


def _check(grid, out, want):
    p, v = want
    assert np.allclose(matrix_of(grid, "p", out).T.ravel(), p) and np.allclose(matrix_of(grid, "v", out).T.ravel(), v)


@pytest.mark.parametrize("method", ["chol", "eigen"])
def test_kriging_listed_cells(spark, holes, method):
    g = grid_of(spark, holes, res=(1.0, 1.0))
    _check(g, kriging.krige(spark, g, MAT, variance=True, method=method), brute(holes, MAT))
    _check(g, kriging.krige(spark, g, MAT, Mean.known(0.7), variance=True, detrend=True, method=method), brute(holes, MAT, known=0.7))


def test_simple_kriging_expects_detrended_data(spark, holes):
    g = grid_of(spark, holes)
    plain = matrix_of(g, "p", kriging.krige(spark, g, P, Mean.known(2.0)))
    zero = matrix_of(g, "p", kriging.krige(spark, g, P, Mean.known(0.0)))
    assert np.allclose(plain, zero + 2.0)


def test_universal_kriging(spark, holes):
    x = np.random.default_rng(8).standard_normal(holes.shape)
    cov = spark.createDataFrame([(i + 1, j + 1, [float(x[i, j])]) for i in range(9) for j in range(7)], "i int, j int, x array<double>")
    g = grid_of(spark, holes)
    _check(g, kriging.krige(spark, g, MAT, Mean.covariates(cov), variance=True), brute(holes, MAT, x=x))
    with pytest.raises(ValueError):
        kriging.krige(spark, g, MAT, Mean.covariates(cov.where("i > 4")))


def test_lattice_path_equals_dense_path(spark, z):
    m = np.full((17, 13), np.nan)
    m[::2, ::2] = z
    g = grid_of(spark, m, res=(1.5, 0.5))
    assert collect(g).lattice is not None
    a = kriging.krige(spark, g, P, variance=True)
    b = kriging.krige(spark, g, P, variance=True, separable=False)
    for c in "pv":
        assert np.allclose(matrix_of(g, c, a), matrix_of(g, c, b))
    v = matrix_of(g, "v", kriging.krige(spark, g, P, Mean.known(0.0), variance=True))
    assert v.min() >= -1e-9 and v.max() <= P.psill + 1e-9


def test_small_nugget_reproduces_the_data(spark, z):
    g = grid_of(spark, z)
    tiny = Params(Axis("exp", 2.0), Axis("exp", 2.0), 1.0, 1e-9)
    assert np.allclose(matrix_of(g, "p", kriging.krige(spark, g, tiny)), z, atol=1e-6)


def test_layers_match_single_grids(spark, holes):
    seen = ~np.isnan(holes)
    rows = [(int(i) + 1, int(j) + 1, [float(holes[i, j]), float(holes[i, j]) ** 2]) for i, j in zip(*np.nonzero(seen))]
    g = create(spark.createDataFrame(rows, "i int, j int, v array<double>"), dim=holes.shape)
    both = {(r["i"], r["j"]): r["p"] for r in kriging.krige(spark, g, P).collect()}
    for k in (1, 2):
        one = matrix_of(g, "p", kriging.krige(spark, index.layer(g, k), P))
        assert all(math.isclose(both[i + 1, j + 1][k - 1], one[i, j], abs_tol=1e-9) for i in range(9) for j in range(7))


def test_too_many_listed_cells_are_refused(spark, holes):
    with pytest.raises(ValueError, match="bound"):
        kriging.krige(spark, grid_of(spark, holes), P, variance=True, n_max=3)


def test_gls_by_solve(spark, holes):
    g = grid_of(spark, holes)
    obs = collect(g)
    vi = np.linalg.inv(linalg.covariance(P, g, obs.i, obs.j))
    one = np.ones(len(obs.i))
    assert np.allclose(kriging.gls_coefficients(g, P), (one @ vi @ obs.z[:, 0]) / (one @ vi @ one))
    assert abs(kriging.gls_coefficients(kriging.detrended(spark, g, P), P)[0]) < 1e-9
    with pytest.raises(ValueError):
        kriging.gls_coefficients(g.with_cells(g.cells.limit(1)), P)


# -- likelihood and fits


def test_likelihood_direct(spark, holes, z):
    for m in (holes, z):
        g = grid_of(spark, m)
        obs = collect(g)
        v = linalg.covariance(MAT, g, obs.i, obs.j)
        r = obs.z[:, 0] - 0.3
        want = -0.5 * (len(r) * math.log(2 * math.pi) + np.linalg.slogdet(v)[1] + r @ np.linalg.solve(v, r))
        for method in ("chol", "eigen"):
            lik = likelihood.log_likelihood(g, MAT, Mean.known(0.3), method)
            assert math.isclose(lik.log_lik, want) and lik.n_pars == 5
    iso = Params(Axis("gau", 2.0), Axis("gau", 2.0), 1.0, 0.1)
    assert likelihood.log_likelihood(g, iso, Mean.constant()).n_pars == 4


def test_fit_recovers_and_improves(spark):
    true = Params(Axis("gau", 4.0), Axis("gau", 4.0), 2.0, 0.1)
    g = simulate.simulate(spark, Grid(25, 24), true, seed=5)
    f = likelihood.fit(g, "gau", Mean.constant(), iso=True)
    assert f.improved and f.nll <= f.initial_nll and 2.5 < f.params.y.rho < 6.5 and f.params.y.rho == f.params.x.rho
    assert f.nll <= -likelihood.log_likelihood(g, true, Mean.constant()).log_lik + 1e-6
    held = likelihood.fit(g, {"y": {"k": "gau", "rho": None}, "psill": 2.0, "eps": 0.1}, Mean.constant())
    assert held.params.psill == 2.0 and 3.0 < held.params.y.rho < 5.0


def test_parameters():
    p = make_params(("mat", "gau"))
    assert p.names == ["eps", "psill", "y.rho", "y.kap", "x.rho"] and p.missing() == p.names
    full = p.update([1, 2, 3, 4, 5])
    assert full.vector() == [1, 2, 3, 4, 5] and "nugget = 1" in full.text()
    assert make_params({"y": "exp", "psill": 2.0}).x.k == "exp"
    with pytest.raises(ValueError):
        make_params({"z": 1})
    with pytest.raises(ValueError):
        p.update([1, 2])
    assert P.update([9.0], na_omit=True) if P.missing() else True


def test_simulation_moments(spark):
    p = Params(Axis("exp", 0.3), Axis("exp", 0.3), 1.0, 0.5)
    g = simulate.simulate(spark, Grid(60, 50), p, n_layer=2, seed=2)
    a = np.array([r["v"] for r in g.cells.collect()])
    assert abs(a.mean()) < 0.1 and abs(a[:, 0].var() - 1.5) < 0.15 and abs(np.corrcoef(a.T)[0, 1]) < 0.1
    again = simulate.simulate(spark, Grid(60, 50), p, n_layer=2, seed=2).cells
    assert sorted(again.collect()) == sorted(g.cells.collect())


def test_cross_validation_is_honest(spark, holes):
    """A test value must not change its own prediction: doubling it changes its error by its own change only."""
    g = grid_of(spark, holes)
    f = simulate.folds(g, 5, 1, seed=0)
    per = {r["fold"]: r["n"] for r in f.groupBy("fold").agg(F.count("*").alias("n")).collect()}
    n = int((~np.isnan(holes)).sum())
    assert all(per[k] == n // 5 for k in range(1, 6)) and per.get(0, 0) == n - 5 * (n // 5)
    s = simulate.cross_validate(g, {"a": P}, 5, 1, seed=0).first()
    rows = f.collect()
    want = []
    for k in range(1, 6):
        train = holes.copy()
        for r in rows:
            if r["fold"] == k:
                train[r["i"] - 1, r["j"] - 1] = np.nan
        p = brute(train, P)[0].reshape(7, 9).T
        want.append(np.mean([(r["v"] - p[r["i"] - 1, r["j"] - 1]) ** 2 for r in rows if r["fold"] == k]))
    assert math.isclose(s["mspe"], np.mean(want), rel_tol=1e-9)


# -- summaries and displays


def test_summaries(spark, holes, z):
    full, part = grid_of(spark, z), grid_of(spark, holes)
    assert math.isclose(aggregate.summarise(full, ["mean"]).first()[0], z.mean())
    assert aggregate.summarise(part, ["sum"]).first()[0] is None
    assert math.isclose(aggregate.summarise(part, ["sum"], na_rm=True).first()[0], np.nansum(holes))
    assert aggregate.describe(part).first()["completeness"] == "incomplete"
    assert "9 x 7 complete" in aggregate.line(full)


def test_display(spark, z):
    g, cells, legend = display.heatmap(grid_of(spark, z), px_max=4)
    assert g.dim == (3, 4) and cells.agg(F.max("level")).first()[0] == 1000 and len(legend) > 2
    logical = create(spark.createDataFrame([(1, 1, True), (2, 2, False)], "i int, j int, v boolean"), dim=(2, 2))
    assert display.heatmap(logical)[2] == [False, True]
    names = create(spark.createDataFrame([(1, 1, "b"), (2, 2, "a")], "i int, j int, v string"), dim=(2, 2))
    assert display.heatmap(names)[2] == ["a", "b"]
    same = create(spark.createDataFrame([(1, 1, 3.0)], "i int, j int, v double"), dim=(2, 2))
    assert display.heatmap(same)[2] == [3.0]
    f = display.footprint(spark, P)
    assert f.count() == 101 * 101


def test_stream_snap(spark, tmp_path):
    from gridloom.streaming.snap import snap_stream, snap_windows

    pts = spark.createDataFrame([(1, 10.1, 0.2, 5.0, "2024-01-01 00:00:00"), (2, 10.2, 0.1, 6.0, "2024-01-01 00:00:05"), (3, 12.0, 4.0, 7.0, "2024-01-01 00:01:00")], "pt_id long, y double, x double, v double, t string").withColumn("t", F.col("t").cast("timestamp"))
    pts.write.parquet(str(tmp_path / "in"))
    g = create(dim=(4, 3), res=(1.0, 2.0), origin=(10.0, 0.0))
    stream = lambda: spark.readStream.schema(pts.schema).parquet(str(tmp_path / "in"))
    for df, mode, n in ((snap_stream(stream(), g, "t"), "append", 2), (snap_windows(stream(), g, "t", "1 minute"), "complete", 2)):
        q = df.writeStream.outputMode(mode).format("memory").queryName(f"snapped_{mode}").option("checkpointLocation", str(tmp_path / mode)).start()
        q.processAllAvailable()
        q.stop()
        assert spark.table(f"snapped_{mode}").count() == n


def test_trim_in_batches(spark):
    rng = np.random.default_rng(4)
    for k in range(4):
        m = np.where(rng.random((12, 15)) < 0.04 * (k + 1), np.nan, 1.0)
        m[5:8, 6:10] = 1.0
        found = [index.trim(spark, grid_of(spark, m), batch=b) for b in (128, 3, 1)]
        assert found[0] == found[1] == found[2]
        (a, b), (c, d) = found[0]["i"], found[0]["j"]
        assert not np.isnan(m[a - 1 : b, c - 1 : d]).any()


def test_listed_cells_over_the_bound_are_solved_distributed(spark):


    rng = np.random.default_rng(6)
    m = np.where(rng.random((9, 11)) < 0.5, np.nan, rng.standard_normal((9, 11)))
    g, p = grid_of(spark, m), Params(Axis("gau", 2.0), Axis("exp", 3.0), 2.0, 0.4)
    for mean in (Mean.constant(), Mean.known(0.5)):
        a = {(r.i, r.j): r.p for r in kriging.krige(spark, g, p, mean, detrend=True).collect()}
        b = {(r.i, r.j): r.p for r in kriging.krige(spark, g, p, mean, detrend=True, n_max=5).collect()}
        assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-6 for k in a)
    with pytest.raises(ValueError, match="over the bound"):
        kriging.krige(spark, g, p, variance=True, n_max=5)


def test_folds_do_not_depend_on_their_ranges(spark):


    g = grid_of(spark, np.arange(200.0).reshape(10, 20))
    one, many = (sorted((r.rep, r.i, r.j, r.fold) for r in simulate.folds(g, 5, 3, 1, bucket_rows=n).collect()) for n in (50_000, 20))
    assert one == many and sorted({f for *_, f in one}) == [1, 2, 3, 4, 5]
