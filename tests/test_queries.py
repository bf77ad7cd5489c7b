"""Every query with SQL against DuckDB on the smallest tables, where they exist."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NAMES = sorted(k for k in entry.oracle_sql() if k in entry.queries())


def norm(v):
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.skipif(not os.path.exists(SF), reason="no test tables here")
@pytest.mark.parametrize("name", NAMES)
def test_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr(norm(tuple(r))) for r in df.select(*columns).collect())
    want = sorted(repr(norm(r)) for r in duck.sql(f"select {', '.join(chr(34) + c + chr(34) for c in columns)} from ({entry.oracle_sql()[name]})").fetchall())
    assert got == want


@pytest.mark.skipif(not os.path.exists(SF), reason="no test tables here")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
