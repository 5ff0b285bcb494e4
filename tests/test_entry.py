"""The driver contract, and every query with SQL against DuckDB on the smallest data where it is there."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import rows

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")


def test_names():
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names)
    assert {f"p{n}_found" for n in range(1, 7)} <= set(names)


@needs_data
@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    sql = entry.oracle_sql()[name]
    df = entry.queries()[name](spark, DATA)
    rel = con.sql(sql)
    assert sorted(df.columns) == sorted(rel.columns)
    want = sorted((tuple(str(x) for x in r) for r in con.sql(f"select {', '.join(chr(34) + c + chr(34) for c in df.columns)} from ({sql})").fetchall()), key=repr)
    assert [tuple(str(x) for x in r) for r in sorted(rows(df), key=lambda r: repr(tuple(str(x) for x in r)))] == want
