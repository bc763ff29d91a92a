"""Every query with SQL gives DuckDB's rows on the smallest data; the others run."""

import glob
import os

import duckdb
import pytest

from tidewise.queries import ALL

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in glob.glob(f"{DIR}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    return con


def plain(value):
    return f"{value:.6g}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", ALL)
def test_query(spark, db, name):
    query, sql = ALL[name]
    df = query(spark, DIR)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if sql is None:
        return
    want = db.sql(sql)
    assert sorted(want.columns) == columns
    assert got == sorted(tuple(plain(r[want.columns.index(c)]) for c in columns) for r in want.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())
