"""Order numbers of rows without gathering them in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, key: str, name: str, ranges: int | None = None) -> DataFrame:
    """df with the rank (from 1) of each row by a key of whole numbers; ties in an order of their own.

    Bounds that split the keys into ranges of about equal size, and the ranges' counts, come from the key column
    alone; then each range numbers its rows and adds what lies before it.
    """
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    low = df.select(key).repartitionByRange(n, key).groupBy(F.spark_partition_id()).agg(F.min(key).alias("k")).collect()  # a row a range
    bounds = sorted({r.k for r in low if r.k is not None})
    steps = [1 << k for k in range(max(1, len(bounds).bit_length()) - 1, -1, -1)]
    table = F.lit(bounds).cast("array<long>") if bounds else F.array(F.lit(0).cast("long"))
    at = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda lo, s: F.when(F.coalesce(F.get(table, lo + s) <= F.col(key), F.lit(False)), lo + s).otherwise(lo))
    placed = df.withColumn("_range", at)
    before, base = 0, []
    for r in placed.groupBy("_range").count().orderBy("_range").collect():
        base += [before] * (r["_range"] - len(base) + 1)
        before += r["count"]
    nth = F.row_number().over(Window.partitionBy("_range").orderBy(key))
    return placed.withColumn(name, nth + F.get(F.lit(base or [0]), F.col("_range"))).drop("_range")
