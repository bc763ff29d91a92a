"""Every query with SQL gives DuckDB's rows."""

import duckdb
import pytest

from tidewise.llm.queries import ORACLE, QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ORACLE)
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for table in ("documents", "conversations", "labels"):
        db.sql(f"create view {table} as select * from read_parquet('{DIR}/{table}.parquet')")
    got, want = QUERIES[name](spark, DIR), db.sql(ORACLE[name])
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns
    plain = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in got.collect())
    assert rows == sorted(tuple(plain(r[want.columns.index(c)]) for c in columns) for r in want.fetchall()) and rows
