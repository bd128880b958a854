from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import common


def test_stored_tables_and_clearing(spark):
    df = common.stored(spark.range(5), "numbers")
    assert df.count() == 5 and common.stored(spark.range(0), "none").count() == 0
    common.clear(spark)
    with pytest.raises(Exception, match="does not exist|FILE_NOT_EXIST|PATH_NOT_FOUND"):
        df.count()


def test_groups_agree_between_spark_and_numpy(spark):
    ids = np.array([0, 1, -5, 2**62, -(2**63), 123456789])
    rows = spark.createDataFrame([(int(i),) for i in ids], "doc_id long").select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(37)).cast("int").alias("g")).collect()
    assert [r.g for r in rows] == common.group_of_ids(ids, 37).tolist()


def test_ranges(spark):
    bounds = [-10, 0, 7, 8, 1000]
    df = spark.createDataFrame([(v,) for v in (-10, -1, 0, 6, 7, 8, 999, 1000, 5000)], "doc_id long")
    got = [r.p for r in df.select(common.range_of(F.col("doc_id"), bounds).alias("p")).collect()]
    assert got == [0, 0, 1, 1, 2, 3, 3, 4, 4]
    found = common.id_bounds(spark.range(100).withColumnRenamed("id", "doc_id"), 4)
    assert found[0] == 0 and 3 <= len(found) <= 4 and common.id_bounds(df.where("doc_id > 9999"), 4) == []


def test_pack_round_trip():
    arrays = [np.arange(5, dtype="<u8"), np.zeros(0, "<i8"), common.narrow(np.array([1, 300])), common.narrow(np.array([], int))]
    back = common.unpack(common.pack(*arrays))
    assert all(a.dtype == b.dtype and a.tolist() == b.tolist() for a, b in zip(arrays, back))
    assert list(common.runs(np.array([3, 3, 5, 9, 9, 9]))) == [(3, 0, 2), (5, 2, 3), (9, 3, 6)] and not list(common.runs(np.array([])))
