"""Queries of grid construction, index operations, cell functions, summaries and snapping, with their DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import scalar
from gridloom.model import Grid, create
from gridloom.operators import aggregate, display, index, snap
from gridloom.plans import linalg
from gridloom.queries.grids import GAU, T1, T2, T3, T4, T6, T8, rounded, t1, t2, t3, t4, t6, t8, table
from gridloom.sources import tables

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query by name, with its SQL where there is one; doubles are rounded to six digits."""

    def put(f):
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql:
            SQL[name] = sql.replace("+ 0.0", "+ 0e0")  # a double zero; 0.0 is a decimal
        return f

    return put


def six(*columns: str) -> str:
    return ", ".join(f"round({c}, 6) + 0.0 {c.split('.')[-1]}" for c in columns)


CELLS = "(select unnest(range(1, 51)) i) a, (select unnest(range(1, 12)) j) b"
YX = "round(10.0 + (50 - i), 6) + 0.0 y, round(100.0 + (j - 1) * 2.0, 6) + 0.0 x"


# -- sources and sinks


@query("io1_grid", "select cast(i + 12 * (j - 1) as bigint) k, round(0.5 + (12 - i) * 2.0, 6) + 0.0 y, round((j - 1) * 3.0, 6) + 0.0 x from (select unnest(range(1, 13)) i) a, (select unnest(range(1, 11)) j) b")
def _(spark: SparkSession, d: str) -> DataFrame:
    return tables.coordinates(spark, create(dim=(12, 10), res=(2.0, 3.0), origin=(0.5, 0.0)))


@query("io2_sparse", f"with {T1} select i, j, {six('v')} from t1 where v > 38")
def _(spark, d):
    g = t1(spark, d)
    return create(g.cells.withColumn("v", F.when(F.col("v") > 38, F.col("v")).otherwise(F.lit(float("nan")))), dim=g.dim).cells


@query("io3_validate", f"with {T3} select count(*) n, count(distinct i + 50 * (j - 1)) n_distinct, cast(min(i) as int) i_from, cast(max(i) as int) i_to, cast(min(j) as int) j_from, cast(max(j) as int) j_to from t3")
def _(spark, d):
    g = t3(spark, d).validate()
    return g.cells.agg(F.count("*").alias("n"), F.count_distinct(g.k()).alias("n_distinct"), F.min("i").alias("i_from"), F.max("i").alias("i_to"), F.min("j").alias("j_from"), F.max("j").alias("j_to"))


@query("io4_raster", f"with {T1} select i, j, {six('v')} from t1")
def _(spark, d):
    g = t1(spark, d)
    return tables.from_raster(g.cells.select(g.y_of().alias("y"), g.x_of().alias("x"), "v"), 1.0, 2.0).cells


@query("io5_matrix", "select * from (values (1, 1, 1.5::double), (1, 2, 2.0), (2, 1, 4.0), (2, 3, 6.25), (3, 1, 7.0), (3, 2, 8.0), (3, 3, 9.0)) t(i, j, v)")
def _(spark, d):
    return tables.from_matrix(spark, [[1.5, 2.0, None], [4.0, float("nan"), 6.25], [7.0, 8.0, 9.0]]).cells


@query("io5_vector", f"with {T1} select i, j, {six('v')} from t1")
def _(spark, d):
    g = t1(spark, d)
    return tables.from_vector(g.cells.select(g.k().alias("k"), "v"), g.dim).cells


@query("io6_modify", f"with {T3} select i, j, {six('v')}, round(5.0 + (50 - i) * 4.0, 6) + 0.0 y from (select i, j, v * 2 as v from t3)")
def _(spark, d):
    from dataclasses import replace

    g = t3(spark, d)
    new = replace(g, dy=4.0, y0=5.0).with_cells(g.cells.withColumn("v", F.col("v") * 2))
    return new.cells.withColumn("y", new.y_of())


@query("io7_export", f"with {T2} select cast(b.j + 21 * (a.i - 1) as bigint) as \"row\", round(13.0 - a.i, 6) + 0.0 y, round(b.j - 1.0, 6) + 0.0 x, {six('t2.v')} from (select unnest(range(1, 14)) i) a cross join (select unnest(range(1, 22)) j) b left join t2 on t2.i = a.i and t2.j = b.j")
def _(spark, d):
    return tables.export(spark, t2(spark, d))


@query("io7_layer", f"with {T4} select cast(j + 9 * (i - 1) as bigint) as \"row\", (50 - i) + 0.0 y, j - 1 + 0.0 x, round(v2, 6) + 0.0 v from t4")
def _(spark, d):
    return tables.export(spark, t4(spark, d), layer=2)


def _folder(spark: SparkSession) -> str:
    """A new folder beside the checkpoints, which driver and executors share."""
    linalg.checkpoints(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/points-{uuid.uuid4().hex}"


@query("io9_points", f"with {T6} select pt_id, {six('y', 'x')}, case when v > 20 then null else round(v, 6) + 0.0 end v from pts")
def _(spark, d):
    """Points written as parquet with NaN for what is missing, and read again in the reference system that all inputs share."""
    path, crs = _folder(spark), tables.require_crs("local", None, "local")
    tables.write(t6(spark, d).withColumn("v", F.when(F.col("v") > 20, float("nan")).otherwise(F.col("v"))), path, "parquet", ("pt_id",))
    return tables.read_points(spark, path).where(F.lit(crs) == "local")


@query("io10_csv", f"with {T1} select cast(j + 11 * (i - 1) as bigint) as \"row\", {YX}, {six('v')} from t1")
def _(spark, d):
    """A grid's cells in raster order, written as CSV and read again."""
    path = _folder(spark)
    tables.write(tables.export(spark, t1(spark, d)), path, "csv")
    return tables.read_points(spark, path, "csv", '`row` long, y double, x double, v double')


@query("io8_coords", f"with {T3} select cast(i + 50 * (j - 1) as bigint) k, {YX}, {six('v')} from t3")
def _(spark, d):
    return tables.coordinates(spark, t3(spark, d), na_omit=True)


@query("io8_corners", "select * from (values ('top_left', 59.0::double, 100.0::double), ('top_right', 59.0, 120.0), ('bottom_left', 10.0, 100.0), ('bottom_right', 10.0, 120.0)) t(corner, y, x)")
def _(spark, d):
    return tables.coordinates(spark, t1(spark, d), corner=True)


# -- index


@query("ix1_to_k", f"with {T3} select i, j, cast(i + 50 * (j - 1) as bigint) k from t3")
def _(spark, d):
    return t3(spark, d).cells.select("i", "j", index.to_k(50).alias("k"))


@query("ix2_to_ij", "select cast(k as bigint) k, cast(k - 50 * (cast(ceil(k / 50.0) as bigint) - 1) as bigint) i, cast(ceil(k / 50.0) as bigint) j from (select unnest(range(1, 551)) k)")
def _(spark, d):
    i, j = index.to_ij(50)
    return spark.range(1, 551).select(F.col("id").alias("k")).select("k", i.alias("i"), j.alias("j"))


@query("ix3_lines", "select cast(i + 50 * (j - 1) as bigint) k, cast(pi + 3 * (pj - 1) as bigint) pos from (values (7, 1), (3, 2), (20, 3)) a(i, pi), (values (9, 1), (2, 2)) b(j, pj)")
def _(spark, d):
    return index.sub_index(spark, t1(spark, d), [7, 3, 20], [9, 2], nosort=True)


@query("ix3_mask", f"select cast(i + 50 * (j - 1) as bigint) k, i in (3, 7, 20) and j in (2, 9) inside from {CELLS}")
def _(spark, d):
    return index.sub_index(spark, t1(spark, d), [7, 3, 20], [9, 2], mask=True)


@query("ix4_keep", f"with {T1} select cast((i - 4) / 3 + 1 as int) i, cast((j - 2) / 2 + 1 as int) j, {six('v')}, round(10.0 + (50 - i), 6) + 0.0 y from t1 where i between 4 and 40 and (i - 4) % 3 = 0 and j between 2 and 10 and j % 2 = 0")
def _(spark, d):
    g = index.sub_grid(spark, t1(spark, d), keep={"i": list(range(4, 41, 3)), "j": [2, 4, 6, 8, 10]})
    return g.cells.withColumn("y", g.y_of())


@query("ix4_remove", f"with {T1} select cast(i - 2 as int) i, cast(j - 1 as int) j, {six('v')} from t1 where i between 3 and 48 and j between 2 and 10")
def _(spark, d):
    return index.sub_grid(spark, t1(spark, d), rem={"i": [1, 2], "j": [1]}, mirror=True).cells


@query("ix5_trim", "select 'i' axis, 3 first, 50 last union all select 'j', 1, 10")
def _(spark, d):
    g = t1(spark, d)
    holes = g.with_cells(g.cells.where("not (i = 1 and j > 2) and not (i = 2 and j in (3, 4, 5, 7)) and not (j = 11 and i in (4, 9, 30))"))
    return spark.createDataFrame([(a, *ends) for a, ends in index.trim(spark, holes).items()], "axis string, first int, last int")


@query("ix6_find", f"with {T2} select count(*) n, list(distinct i order by i) lines_i, list(distinct j order by j) lines_j, 2 step_i, 2 step_j from t2")
def _(spark, d):
    f = index.find_sub_grid(t2(spark, d))
    return spark.createDataFrame([(f["n"], f["ij"]["i"], f["ij"]["j"], int(f["step"]["i"]), int(f["step"]["j"]))], "n long, lines_i array<int>, lines_j array<int>, step_i int, step_j int")


@query("ix6_none", f"with {T3} select count(*) = count(distinct i) * count(distinct j) found from t3")
def _(spark, d):
    return spark.createDataFrame([(index.find_sub_grid(t3(spark, d)) is not None,)], "found boolean")


@query("ix7_up", f"with {T1} select cast((i - 1) // 4 + 1 as int) i, cast((j - 1) // 3 + 1 as int) j, {six('v')}, round(10.0 + (50 - i), 6) + 0.0 y from t1 where (i - 1) % 4 = 0 and (j - 1) % 3 = 0")
def _(spark, d):
    g = index.up_scale(t1(spark, d), (4, 3))
    return g.cells.withColumn("y", g.y_of())


@query("ix8_down", f"with {T1}, f as (select (i - 1) * 2 + 1 i, (j - 1) * 3 + 1 j, v from t1) select cast(a.i + 99 * (b.j - 1) as bigint) k, cast(a.i as int) i, cast(b.j as int) j, {six('f.v')} from (select unnest(range(1, 100)) i) a cross join (select unnest(range(1, 32)) j) b left join f on f.i = a.i and f.j = b.j")
def _(spark, d):
    return index.dense(spark, index.down_scale(t1(spark, d), (2, 3)))


@query("ix9_layers", f"with {T4} select cast((i - 1) // 7 + 1 as int) i, cast((j - 1) // 2 + 1 as int) j, {six('v1', 'v2', 'v3')} from t4 where (i - 1) % 7 = 0 and (j - 1) % 2 = 0")
def _(spark, d):
    g = index.up_scale(t4(spark, d), (7, 2))
    return g.cells.select("i", "j", *(F.element_at("v", k).alias(f"v{k}") for k in (1, 2, 3)))


@query("ix10_at", f"with {T3} select cast(q.k as bigint) k, {six('v')} from (select unnest(range(1, 551, 7)) k) q left join t3 on t3.i + 50 * (t3.j - 1) = q.k")
def _(spark, d):
    return index.at(t3(spark, d), spark.range(1, 551, 7).select(F.col("id").alias("k")))


@query("ix10_mask", f"with {T1} select cast(i + 50 * (j - 1) as bigint) k, {six('v')} from t1 where v > 40")
def _(spark, d):
    g = t1(spark, d)
    return index.where(g, scalar.combine(g, ">", 40.0))


@query("ix10_layer", f"with {T4} select i, j, round(v2, 6) + 0.0 v from t4")
def _(spark, d):
    return index.layer(t4(spark, d), 2).cells


@query("ix11_assign", f"with {T1} select i, j, round(case when i = j then -v else v end, 6) + 0.0 v from t1")
def _(spark, d):
    g = t1(spark, d)
    return index.assign(g, g.cells.where("i = j").withColumn("v", -F.col("v"))).cells


@query("ix11_mask", f"with {T1} select i, j, round(case when v > 40 then 0 else v end, 6) + 0.0 v from t1")
def _(spark, d):
    g = t1(spark, d)
    return index.assign_where(g, scalar.combine(g, ">", 40.0), 0.0).cells


@query("ix11_layer", f"with {T4} select i, j, {six('v1')}, round(case when i = 1 then 9.0 else v2 end, 6) + 0.0 v2 from t4")
def _(spark, d):
    g = t4(spark, d)
    new = g.cells.where("i = 1").select("i", "j", F.lit(9.0).alias("v"))
    return index.assign_layer(g, 2, new).cells.select("i", "j", F.element_at("v", 1).alias("v1"), F.element_at("v", 2).alias("v2"))


@query("ix12_replace", "select cast(50 as int) ny, cast(11 as int) nx, 3.0::double dy, 2.0::double dx, 'local' crs")
def _(spark, d):
    from dataclasses import replace

    g = replace(t1(spark, d), dy=3.0, crs="local")
    return spark.createDataFrame([(g.ny, g.nx, g.dy, g.dx, g.crs)], "ny int, nx int, dy double, dx double, crs string")


@query("ix13_missing", f"with {T3} select cast(a.i as int) i, cast(b.j as int) j, t3.v is null missing from (select unnest(range(1, 51)) i) a cross join (select unnest(range(1, 12)) j) b left join t3 on t3.i = a.i and t3.j = b.j")
def _(spark, d):
    return index.missing(spark, t3(spark, d))


@query("ix13_any", f"with {T3} select (select count(*) from t1) < 550 complete_any, (select count(*) from t3) < 550 incomplete_any")
def _(spark, d):
    return spark.createDataFrame([(index.any_missing(t1(spark, d)), index.any_missing(t3(spark, d)))], "complete_any boolean, incomplete_any boolean")


@query("ix14_shape", "select 550::bigint n, 50::int ny, 11::int nx")
def _(spark, d):
    g = t1(spark, d)
    return spark.createDataFrame([(len(g), *g.dim)], "n long, ny int, nx int")


@query("ix15_rows", f"with {T1} select i, list(round(v, 6) order by j) as \"row\" from t1 group by i")
def _(spark, d):
    return index.rows_as_arrays(t1(spark, d)).withColumn("row", F.transform("row", lambda x: F.round(x, 6)))


@query("ix16_vector", f"with {T3} select cast(a.i + 50 * (b.j - 1) as bigint) k, {six('t3.v')} from (select unnest(range(1, 51)) i) a cross join (select unnest(range(1, 12)) j) b left join t3 on t3.i = a.i and t3.j = b.j")
def _(spark, d):
    return index.vector(spark, t3(spark, d))


# -- cell functions

_FN = {
    "abs": "abs(u)", "sign": "sign(u) + 0.0", "sqrt": "case when u < 0 then null else sqrt(abs(u)) end", "floor": "floor(u)", "ceiling": "ceil(u)", "trunc": "trunc(u)", "round": "round_even(u, 0)",
    "exp": "exp(u)", "expm1": "exp(u) - 1", "cos": "cos(u)", "sin": "sin(u)", "tan": "tan(u)", "cospi": "cos(u * pi())", "sinpi": "sin(u * pi())", "tanpi": "tan(u * pi())",
    "atan": "atan(u)", "log": "case when u <= 0 then null else ln(abs(u) + case when u = 0 then 1 else 0 end) end", "log1p": "case when u <= -1 then null else ln(1 + greatest(u, -0.999)) end",
    "acos": "case when abs(u) > 1 then null else acos(greatest(-1, least(1, u))) end", "asin": "case when abs(u) > 1 then null else asin(greatest(-1, least(1, u))) end",
}
_U = f"{T1}, u as (select i, j, (v - 38.5) / 10 u from t1)"


def _centred(spark, d) -> Grid:
    g = t1(spark, d)
    return g.with_cells(g.cells.withColumn("v", (F.col("v") - 38.5) / 10))


@query("fn1_math", f"with {_U} select i, j, {', '.join(f'round({e}, 6) + 0.0 f_{n}' for n, e in _FN.items())} from u")
def _(spark, d):
    g = _centred(spark, d)
    out = g.cells.select("i", "j", *(scalar.MATH[n](F.col("v")).alias(f"f_{n}") for n in _FN))
    return out.select("i", "j", *(F.when(~F.isnan(c) & (F.abs(c) < 1e300), F.col(c)).alias(c) for c in out.columns[2:]))


@query("fn1_gamma", f"with {_U} select i, j, round(lgamma(1 + abs(u)), 6) + 0.0 f_lgamma, round(gamma(1 + abs(u)), 6) + 0.0 f_gamma, round(lgamma(1 + abs(u) + 1e-4) / 2e-4 - lgamma(1 + abs(u) - 1e-4) / 2e-4, 5) + 0.0 f_digamma from u")
def _(spark, d):
    x = 1 + F.abs("v")
    return _centred(spark, d).cells.select("i", "j", scalar.lgamma(x).alias("f_lgamma"), scalar.gamma(x).alias("f_gamma"), F.round(scalar.digamma(x), 5).alias("f_digamma"))


_Y = "(1 + abs(u) + 20)"


@query("fn1_trigamma", f"with {_U} select i, j, round(list_sum(list_transform(range(0, 20), lambda k: 1 / pow(1 + abs(u) + k, 2))) + 1 / {_Y} + 1 / (2 * pow({_Y}, 2)) + 1 / (6 * pow({_Y}, 3)) - 1 / (30 * pow({_Y}, 5)) + 1 / (42 * pow({_Y}, 7)), 6) + 0.0 f_trigamma from u")
def _(spark, d):
    x = 1 + F.abs("v")
    return _centred(spark, d).cells.select("i", "j", scalar.trigamma(x).alias("f_trigamma"))


@query("fn1_signif", f"with {_U} select i, j, round(case when u = 0 then 0 else round_even(u * pow(10, 2 - floor(log10(abs(u)))), 0) / pow(10, 2 - floor(log10(abs(u)))) end, 6) + 0.0 v from u")
def _(spark, d):
    return scalar.math_function(_centred(spark, d), "signif", 3).cells


@query("fn2_scalar", f"with {_U} select i, j, round(u + 2, 6) + 0.0 a, round(u - 2, 6) + 0.0 b, round(u * 2, 6) + 0.0 c, round(u / 2, 6) + 0.0 d, round(pow(u, 2), 6) + 0.0 e, round(u - 0.3 * floor(u / 0.3), 6) + 0.0 f, floor(u / 0.3) + 0.0 g from u")
def _(spark, d):
    g = _centred(spark, d)
    ops = {"a": ("+", 2.0), "b": ("-", 2.0), "c": ("*", 2.0), "d": ("/", 2.0), "e": ("^", 2.0), "f": ("%%", 0.3), "g": ("%/%", 0.3)}
    return g.cells.select("i", "j", *(scalar.BINARY[o](F.col("v"), F.lit(x)).alias(n) for n, (o, x) in ops.items()))


@query("fn2_grids", f"with {T3} select t1.i, t1.j, round(t1.v * t3.v, 6) + 0.0 v from t1 join t3 using (i, j)")
def _(spark, d):
    return scalar.combine(t1(spark, d), "*", t3(spark, d)).cells


@query("fn3_compare", f"with {T1} select i, j, v >= 38.5 v from t1")
def _(spark, d):
    return scalar.combine(t1(spark, d), ">=", 38.5).cells


@query("fn4_logic", f"with {T3}, a as (select i, j, v > 38.5 v from t1), b as (select i, j, v < 40 v from t3) select i, j, a.v and b.v v from a full join b using (i, j) where (a.v and b.v) is not null")
def _(spark, d):
    return scalar.combine(scalar.combine(t1(spark, d), ">", 38.5), "&", scalar.combine(t3(spark, d), "<", 40.0)).cells


@query("fn4_not", f"with {T1} select i, j, not (v > 38.5) v, round(0 - v, 6) + 0.0 w from t1")
def _(spark, d):
    g = t1(spark, d)
    return scalar.logical_not(scalar.combine(g, ">", 38.5)).cells.join(scalar.negate(g).cells.withColumnRenamed("v", "w"), ["i", "j"])


@query("fn5_cast", f"with {_U} select i, j, cast(trunc(u * 10) as int) a, u <> 0 b from u")
def _(spark, d):
    g = _centred(spark, d)
    ten = scalar.combine(g, "*", 10.0)
    return scalar.cast(ten, "int").cells.withColumnRenamed("v", "a").join(scalar.cast(g, "boolean").cells.withColumnRenamed("v", "b"), ["i", "j"])


@query("fn6_back", f"with {_U} select i, j, round(exp(u + 0.25 / 2), 6) + 0.0 m from u")
def _(spark, d):
    return _centred(spark, d).cells.select("i", "j", F.col("v").alias("p"), F.lit(0.25).alias("v")).select("i", "j", scalar.back_transform().alias("m"))


@query("fn7_standard", f"with {T1} select i, j, round((v - (select avg(v) from t1)) / (select stddev_samp(v) from t1), 6) + 0.0 v from t1")
def _(spark, d):
    return scalar.standardise(t1(spark, d).cells, "v")


@query("fn8_text", "select 'gau x gau kernel (nugget = 0.5, partial sill = 4), y: gau(rho = 6), x: gau(rho = 5)' t")
def _(spark, d):
    return spark.createDataFrame([(GAU.text(),)], "t string")


# -- summaries


@query("ag1_summary", f"with {T1} select round(max(v), 6) + 0.0 as max, round(min(v), 6) + 0.0 as min, round(sum(v), 6) + 0.0 as sum, round(min(v), 6) + 0.0 range_min, round(max(v), 6) + 0.0 range_max from t1")
def _(spark, d):
    return aggregate.summarise(t1(spark, d), ["max", "min", "sum", "range"])


@query("ag1_prod", f"with {T2} select round(product(v / 50), 6) + 0.0 prod from t2")
def _(spark, d):
    g = t2(spark, d)
    return aggregate.summarise(g.with_cells(g.cells.withColumn("v", F.col("v") / 50)), ["prod"], na_rm=True)


@query("ag1_missing", f"with {T3} select null::double as sum, null::double as mean, bool_or(v > 40) or null as any, bool_and(v > 40) and null as all from t3")
def _(spark, d):
    g = t3(spark, d)
    return aggregate.summarise(g, ["sum", "mean"]).crossJoin(aggregate.summarise(scalar.combine(g, ">", 40.0), ["any", "all"]))


@query("ag2_mean", f"with {T4} select round((sum(v1) + sum(v2) + sum(v3)) / (3 * count(*)), 6) + 0.0 mean from t4")
def _(spark, d):
    return aggregate.summarise(t4(spark, d), ["mean"])


@query("ag3_describe", f"with {T3} select 'incomplete' completeness, count(*) n_observed, 550 n, round(min(v), 6) + 0.0 least, round(max(v), 6) + 0.0 greatest from t3")
def _(spark, d):
    return aggregate.describe(t3(spark, d)).select("completeness", "n_observed", "n", "least", "greatest")


@query("ag4_line", f"with {T3} select '50 x 11 ' || case when count(v) = 550 then 'complete' else 'incomplete' end || ' grid of double' line from t3")
def _(spark, d):
    return spark.createDataFrame([(aggregate.line(t3(spark, d)),)], "line string")


@query("ag5_variance", f"with {T3} select round(var_samp(v), 6) + 0.0 v from t3")
def _(spark, d):
    return spark.createDataFrame([(aggregate.sample_variance(t3(spark, d)),)], "v double")


@query("ag7_occupancy", f"with {T8} select cast((i - 1) // 4 + 1 as int) i, cast((j - 1) // 4 + 1 as int) j, bool_or(v) v from t8 where (i - 1) // 4 < 12 and (j - 1) // 4 < 6 group by 1, 2")
def _(spark, d):
    return aggregate.occupancy(t8(spark, d), 4).cells


@query("ag8_bias", f"with {T8}, f as (select unnest([1, 2, 5]) factor), b as (select distinct factor, (i - 1) // factor bi, (j - 1) // factor bj from t8, f where v and (i - 1) // factor < 50 // factor and (j - 1) // factor < 25 // factor) select cast(factor as int) factor, count(bi) n_occupied, round((count(bi) * factor * factor - 100.0) / 100.0, 6) + 0.0 bias from f left join b using (factor) group by factor")
def _(spark, d):
    return aggregate.occupancy_bias(t8(spark, d), [1, 2, 5], 100.0)


@query("ag10_median", "select l_returnflag flag, round(median(l_extendedprice), 6) + 0.0 m from lineitem group by 1")
def _(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(F.median("l_extendedprice").alias("m"))


# -- joins, sorts, sets

_SNAP_GRID = dict(dim=(40, 30), res=(10.0, 20.0), origin=(20.0, 60.0))


def _target() -> Grid:
    return create(**_SNAP_GRID)


def _iy(n: str, y0: str) -> str:
    return f"cast(greatest(0, least({n} - 1, ceil((y - {y0}) / 10.0 - 0.5))) as int)"


def _jx(n: str, x0: str) -> str:
    return f"cast(greatest(0, least({n} - 1, ceil((x - {x0}) / 20.0 - 0.5))) as int)"


def _snap_sql(crop_from: bool, crop_g: bool) -> str:
    inside = "where y between 20 and 410 and x between 60 and 640" if crop_from else ""
    fixed = crop_from and not crop_g
    low = (lambda e, n: "0") if fixed else (lambda e, n: e if crop_g else f"least({e}, 0)")
    high = (lambda e, n: str(n - 1)) if fixed else (lambda e, n: e if crop_g else f"greatest({e}, {n - 1})")
    a = [f"cast(ceil(({f}({c}) - {o}) / {r} - 0.5) as int)" for f, c, o, r in (("min", "y", 20.0, 10.0), ("max", "y", 20.0, 10.0), ("min", "x", 60.0, 20.0), ("max", "x", 60.0, 20.0))]
    return f"""with {T6}, p as (select * from pts {inside}), b as (select {low(a[0], 40)} ya, {high(a[1], 40)} yb, {low(a[2], 30)} xa, {high(a[3], 30)} xb from p),
 q as (select pt_id, v, yb - ya + 1 ny, {_iy('(yb - ya + 1)', '(20.0 + ya * 10.0)')} iy, {_jx('(xb - xa + 1)', '(60.0 + xa * 20.0)')} jx from p, b)
 select cast(ny - iy as int) i, cast(jx + 1 as int) j, round(arg_min(v, pt_id), 6) + 0.0 v from q group by 1, 2"""


@query("jn1_nearest", f"with {T6} select pt_id, {_iy('40', '20.0')} iy, {_jx('30', '60.0')} jx from pts")
def _(spark, d):
    g = _target()
    return t6(spark, d).select("pt_id", snap.nearest(F.col("y"), g.y0, g.dy, g.ny).alias("iy"), snap.nearest(F.col("x"), g.x0, g.dx, g.nx).alias("jx"))


def _snap_query(cf: bool, cg: bool):
    name = {(False, False): "jn2_union", (True, False): "jn2_grid", (False, True): "jn2_points", (True, True): "jn2_inside"}[cf, cg]

    @query(name, _snap_sql(cf, cg))
    def _(spark, d):
        return snap.snap(t6(spark, d), snap.Lattice(grid=_target()), cf, cg)[0].cells


for _cf in (False, True):
    for _cg in (False, True):
        _snap_query(_cf, _cg)


@query("jn2_order", f"with {T6}, p as (select *, row_number() over (order by pt_id) n from pts where y between 20 and 410 and x between 60 and 640) select cast(40 - {_iy('40', '20.0')} as int) i, cast({_jx('30', '60.0')} + 1 as int) j, min(n) + 0.0 v from p group by 1, 2")
def _(spark, d):
    """Points without values: a cell holds the order number of its first point."""
    return snap.snap(t6(spark, d).drop("v"), snap.Lattice(grid=_target()), crop_from=True)[0].cells


@query("jn2_dim", f"with {T6}, b as (select min(y) y0, (max(y) - min(y)) / 19 dy, min(x) x0, (max(x) - min(x)) / 9 dx from pts) select cast(20 - greatest(0, least(19, ceil((y - y0) / dy - 0.5))) as int) i, cast(greatest(0, least(9, ceil((x - x0) / dx - 0.5))) + 1 as int) j, round(arg_min(v, pt_id), 6) + 0.0 v from pts, b group by 1, 2")
def _(spark, d):
    return snap.snap(t6(spark, d), snap.Lattice(dim=(20, 10)))[0].cells


@query("jn2_res", f"with {T6}, b as (select cast(floor((max(y) - min(y)) / 25) as int) ny, min(y) + fmod(max(y) - min(y), 25) / 2 y0, cast(floor((max(x) - min(x)) / 48) as int) nx, min(x) + fmod(max(x) - min(x), 48) / 2 x0 from pts) select cast(ny + 1 - greatest(0, least(ny, ceil((y - y0) / 25 - 0.5))) as int) i, cast(greatest(0, least(nx, ceil((x - x0) / 48 - 0.5))) + 1 as int) j, round(arg_min(v, pt_id), 6) + 0.0 v from pts, b group by 1, 2")
def _(spark, d):
    return snap.snap(t6(spark, d), snap.Lattice(res=(25.0, 48.0)))[0].cells


@query("jn3_report", f"with {T6}, q as (select *, {_iy('40', '20.0')} iy, {_jx('30', '60.0')} jx from pts where y between 20 and 410 and x between 60 and 640), c as (select count(*) n, max(greatest(abs(y - (20 + iy * 10)), abs(x - (60 + jx * 20)))) off from q group by iy, jx) select cast(sum(n) as bigint) n_points, count(*) n_cells, cast(sum(n) - count(*) as bigint) n_duplicates, round(max(off), 6) + 0.0 max_distance from c")
def _(spark, d):
    return snap.snap(t6(spark, d), snap.Lattice(grid=_target()), crop_from=True)[1]


@query("jn4_dense", f"with {T6}, q as (select *, 40 - {_iy('40', '20.0')} i, {_jx('30', '60.0')} + 1 j from pts where y between 20 and 410 and x between 60 and 640), c as (select i, j, arg_min(v, pt_id) v from q group by i, j) select cast(a.i as int) i, cast(b.j as int) j, round(c.v, 6) + 0.0 v from (select unnest(range(1, 41)) i) a cross join (select unnest(range(1, 31)) j) b left join c on c.i = a.i and c.j = b.j")
def _(spark, d):
    return snap.all_cells(t6(spark, d), snap.Lattice(grid=_target()), crop_from=True)


@query("jn5_crop", f"with {T6} select pt_id, {six('y', 'x')} from pts where y between 20 and 410 and x between 60 and 640")
def _(spark, d):
    return snap.crop(t6(spark, d), _target()).select("pt_id", "y", "x")


@query("jn8_covariates", f"with {T3} select t3.i, t3.j, {six('t3.v')}, round(t1.v / 10, 6) + 0.0 x from t3 join t1 using (i, j)")
def _(spark, d):
    return t3(spark, d).cells.join(t1(spark, d).cells.select("i", "j", (F.col("v") / 10).alias("x")), ["i", "j"])


@query("jn9_mask", f"with {T3} select i, j, {six('v')} from t1 where i between 5 and 46 and j between 3 and 9 and not exists (select 1 from t3 where t3.i = t1.i and t3.j = t1.j)")
def _(spark, d):
    return t1(spark, d).cells.where("i between 5 and 46 and j between 3 and 9").join(t3(spark, d).cells.select("i", "j"), ["i", "j"], "left_anti")


@query("st1_order", f"with {T1} select cast(i + 50 * (j - 1) as bigint) k, {six('v')} from t1 order by v desc, k limit 10")
def _(spark, d):
    g = t1(spark, d)
    return g.cells.select(g.k().alias("k"), "v").orderBy(F.desc("v"), "k").limit(10)


@query("se1_complement", "select cast(i as int) i from (select unnest(range(1, 51)) i) where i not in (3, 7, 20)")
def _(spark, d):
    return spark.range(1, 51).select(F.col("id").cast("int").alias("i")).exceptAll(spark.createDataFrame([(3,), (7,), (20,)], "i int"))


@query("pl1_levels", f"with {T1}, r as (select min(v) lo, max(v) hi from t1) select i, j, {six('v')}, cast(least(floor((v - lo) / (hi - lo) * 1000) + 1, 1000) as int) as level from t1, r")
def _(spark, d):
    return display.heatmap(t1(spark, d))[1]

