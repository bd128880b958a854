"""Every query against its SQL, on the smallest tables; those without SQL must run and keep their schema."""

from __future__ import annotations

import math

import pytest
from conftest import SF

from gridloom.queries import relational, statistical  # noqa: F401  (both register)

ALL = relational.QUERIES
SQL = relational.SQL


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(_plain, v))
    if v is None or isinstance(v, (str, int, bool)):
        return v
    return round(float(v), 6) + 0.0


def _sorted(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    df = ALL[name](spark, SF)
    columns = sorted(df.columns)
    got = [tuple(_plain(r[c]) for c in columns) for r in df.collect()]
    result = duck.execute(SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = [tuple(_plain(r[names.index(c)]) for c in columns) for r in result.fetchall()]
    assert _sorted(got) == _sorted(want)


@pytest.mark.parametrize("name", sorted(set(ALL) - set(SQL)))
def test_runs(spark, name):
    df = ALL[name](spark, SF)
    assert df.columns and df.collect()


@pytest.mark.parametrize("often", [[(i, j) for i in (2, 3, 4, 5) for j in (3, 5, 7)], [(2, 3), (3, 3)], [(4, 6)], []], ids=["lattice", "line", "cell", "none"])
def test_factor_of_cells_that_form_a_lattice(spark, tmp_path, often):
    """F1: the cells over the mean can form a complete lattice, as they do on sf0.1; the factor is that of listed cells then too."""
    import duckdb

    cells = [(i, j) for i in range(1, 7) for j in range(1, 8)]
    rows = [(float(i), (j - 1) / 100, 1000.0 * i + j) for i, j in cells for _ in range(1 + 2 * ((i, j) in often))]
    spark.createDataFrame(rows, "l_quantity double, l_discount double, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    df = ALL["cv3_factor"](spark, str(tmp_path))
    assert df.columns == ["a", "b", "l"]
    got = [tuple(_plain(x) for x in r) for r in df.collect()]
    c = duckdb.connect()
    c.execute(f"create view lineitem as select * from read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    assert _sorted(got) == _sorted([tuple(_plain(x) for x in r) for r in c.execute(SQL["cv3_factor"]).fetchall()])
    assert len(got) == len(often) * (len(often) + 1) // 2


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["i", "j", "p", "v"] and df.count() == 13 * 21
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
