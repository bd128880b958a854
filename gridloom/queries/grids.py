"""Grids built from the driver's tables, in Spark and in DuckDB SQL, for the queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.model import Axis, Grid, Params, create
from gridloom.operators.index import down_scale
from gridloom.sources.tables import aggregate


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles at a fixed number of digits, without a negative zero, so that two engines can be compared."""
    return df.select(*((F.round(f"`{f.name}`", digits) + F.lit(0.0)).alias(f.name) if f.dataType.typeName() == "double" else F.col(f"`{f.name}`") for f in df.schema))


def t1(spark: SparkSession, sf_dir: str) -> Grid:
    """Mean price by quantity (1 to 50) and discount (0 to 10 %): a complete 50 x 11 grid."""
    return aggregate(table(spark, sf_dir, "lineitem"), F.col("l_quantity"), F.rint(F.col("l_discount") * 100) + 1, F.round(F.avg("l_extendedprice") / 1000, 3), (50, 11), res=(1.0, 2.0), origin=(10.0, 100.0))


T1 = "t1 as (select cast(l_quantity as int) i, cast(round(l_discount * 100) as int) + 1 j, round(avg(l_extendedprice) / 1000, 3) v from lineitem group by 1, 2)"


def t3(spark: SparkSession, sf_dir: str) -> Grid:
    """The cells of t1 with more items than the mean cell has: about half of them, without a pattern."""
    both = aggregate(table(spark, sf_dir, "lineitem"), F.col("l_quantity"), F.rint(F.col("l_discount") * 100) + 1, F.array(F.round(F.avg("l_extendedprice") / 1000, 3), F.count("*").cast("double")), (50, 11), res=(1.0, 2.0), origin=(10.0, 100.0))
    cells = both.cells.select("i", "j", F.get("v", F.lit(0)).alias("v"), F.get("v", F.lit(1)).alias("n"))
    mean = F.broadcast(cells.agg(F.avg("n").alias("mean")))  # one row
    return both.with_cells(cells.crossJoin(mean).where("n > mean").select("i", "j", "v"))


T3 = T1 + """, t3 as (select i, j, v from (select cast(l_quantity as int) i, cast(round(l_discount * 100) as int) + 1 j, round(avg(l_extendedprice) / 1000, 3) v, count(*) n, avg(count(*)) over () mean
 from lineitem group by 1, 2) where n > mean)"""


def t4(spark: SparkSession, sf_dir: str) -> Grid:
    """Three layers by quantity and tax: a complete 50 x 9 grid."""
    layers = F.array(F.round(F.avg("l_extendedprice") / 1000, 3), F.round(F.avg(F.col("l_quantity") * F.col("l_discount")), 6), F.count("*").cast("double"))
    return aggregate(table(spark, sf_dir, "lineitem"), F.col("l_quantity"), F.rint(F.col("l_tax") * 100) + 1, layers, (50, 9))


T4 = """t4 as (select cast(l_quantity as int) i, cast(round(l_tax * 100) as int) + 1 j, round(avg(l_extendedprice) / 1000, 3) v1, round(avg(l_quantity * l_discount), 6) v2, cast(count(*) as double) v3
 from lineitem group by 1, 2)"""


def t6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as points: y the value, x the hours since 2024."""
    hours = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit("2024-01-01").cast("timestamp"))) / 3.6e9
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("pt_id"), F.col("value").alias("y"), hours.alias("x"), F.col("value").alias("v"))


T6 = "pts as (select event_id pt_id, value y, (epoch_us(ts) - epoch_us(timestamp '2024-01-01')) / 3.6e9 x, value v from events)"


def t8(spark: SparkSession, sf_dir: str) -> Grid:
    """Whether a size (1 to 50) and brand (1 to 25) have an expensive part."""
    part = table(spark, sf_dir, "part")
    brands = part.select("p_brand").distinct()
    from pyspark.sql import Window

    ranked = brands.withColumn("b", F.dense_rank().over(Window.orderBy("p_brand")))  # a row a brand
    return aggregate(part.join(ranked, "p_brand"), F.col("p_size"), F.col("b"), F.max("p_retailprice") > 1400, (50, 25))


T8 = "t8 as (select p_size i, b j, max(p_retailprice) > 1400 v from (select *, dense_rank() over (order by p_brand) b from part) group by 1, 2)"

#: Parameters of the queries.
GAU = Params(Axis("gau", 6.0), Axis("gau", 5.0), 4.0, 0.5)
MIXED = Params(Axis("mat", 4.0, 1.5), Axis("exp", 6.0), 3.0, 0.25)


def t5(spark: SparkSession, sf_dir: str) -> Grid:
    """Mean price by line number (1 to 7) and discount (0 to 10 %): a complete 7 x 11 grid."""
    return aggregate(table(spark, sf_dir, "lineitem"), F.col("l_linenumber"), F.rint(F.col("l_discount") * 100) + 1, F.round(F.avg("l_extendedprice") / 1000, 3), (7, 11), res=(2.0, 2.0))


T5 = "t5 as (select l_linenumber i, cast(round(l_discount * 100) as int) + 1 j, round(avg(l_extendedprice) / 1000, 3) v from lineitem group by 1, 2)"


def t2(spark: SparkSession, sf_dir: str) -> Grid:
    """t5 as every other line of a 13 x 21 grid: a complete sub-grid of 77 cells."""
    return down_scale(t5(spark, sf_dir), 2)


T2 = T5 + ", t2 as (select cast(2 * i - 1 as int) i, cast(2 * j - 1 as int) j, v from t5)"


def empty(spark: SparkSession, ny: int, nx: int, **meta) -> Grid:
    return create(dim=(ny, nx), **meta)
