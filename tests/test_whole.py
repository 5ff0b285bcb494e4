"""Queries over every mapped table, on a small hand-made data set and against their SQL."""

from datetime import date, datetime

import duckdb
import pytest

import __spark_entry__ as entry
from quadloom.plans import compiler
from tests.conftest import rows

TABLES = {
    "region": ("r_regionkey int, r_name string", [(1, "AMERICA"), (2, "ASIA")]),
    "nation": ("n_nationkey int, n_name string, n_regionkey int", [(3, "CANADA", 1), (8, "INDIA", 2)]),
    "customer": ("c_custkey long, c_name string, c_nationkey int, c_mktsegment string", [(1, "Ann", 3, "BUILDING"), (2, "Bob", 8, "ASIA")]),
    "supplier": ("s_suppkey long, s_name string, s_nationkey int", [(5, "Sup", 3)]),
    "part": ("p_partkey long, p_name string, p_brand string, p_type string, p_size int", [(9, "blue bolt", "B#1", "TIN", 7)]),
    "orders": ("o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string, o_orderdate date", [(7, 1, "O", "1-URGENT", date(1995, 2, 3))]),
    "lineitem": ("l_orderkey long, l_partkey long, l_suppkey long, l_shipdate date", [(7, 9, 5, date(1995, 3, 1)), (7, 9, 5, date(1995, 4, 1))]),
    "documents": ("doc_id long, lang string, source string", [(1, "en", "web"), (2, " ", "web"), (3, None, None)]),
    "events": ("event_id long, ts timestamp, user_id long, event_type string", [(4, datetime(2024, 1, 2, 3), 6, "click"), (5, datetime(2024, 1, 2), 6, "other")]),
}
PREDICATES = {
    "r_name", "n_name", "n_region", "c_name", "c_mktsegment", "c_nation", "s_name", "s_nation", "p_name", "p_brand", "p_type", "p_size", "o_status",
    "o_priority", "o_customer", "contains", "supplied_by", "located_in", "lang", "source", "click",
}


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    for name, (schema, values) in TABLES.items():
        spark.createDataFrame(values, schema).coalesce(1).write.parquet(f"{d}/{name}.parquet")
    return d


def against_sql(spark, d, name):
    got = entry.queries()[name](spark, d)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet/*.parquet'")
    columns = ", ".join(f'"{c}"' for c in got.columns)
    found = rows(got)
    assert found == sorted(con.execute(f"select {columns} from ({entry.oracle_sql()[name]})").fetchall(), key=repr)
    return found


def test_scans_read_every_table(spark, data):
    facts = against_sql(spark, data, "scan_all")
    # A part that an order holds twice is one fact of the pattern.
    assert {p for _, p, _ in facts} == PREDICATES and len(facts) == len(set(facts)) == 32
    assert against_sql(spark, data, "scan_s") == sorted([(s,) for s, _, _ in facts], key=repr)
    assert against_sql(spark, data, "scan_p") == sorted([(p,) for _, p, _ in facts], key=repr)


def test_variable_predicate_joins_every_edge(spark, data):
    want = [("customer/1", "c_nation", "nation/3"), ("customer/1", "located_in", "nation/3"), ("supplier/5", "located_in", "nation/3"), ("supplier/5", "s_nation", "nation/3")]
    assert against_sql(spark, data, "join_variable_predicate") == want


UPDATED = {
    "insert_data": (35, {"region/9"}),
    "delete_data": (33, set()),
    "delete_where": (33, set()),
    "update_pattern": (34, {"ORIENT"}),
    "text_roundtrip": (34, set()),
}


@pytest.mark.parametrize("name", UPDATED)
def test_updates_keep_every_other_fact(spark, data, name):
    n, new = UPDATED[name]
    found = against_sql(spark, data, name)
    # The facts with their times: a part shipped twice is two, and supplied twice.
    assert len(found) == n and {r[1] for r in found} == PREDICATES and new <= {x for r in found for x in r}
    assert ("customer/2", "c_mktsegment", "ASIA", "no") in found


def test_two_patterns_are_counted(spark, data, monkeypatch):
    monkeypatch.setattr(compiler, "FAN_OUT", 0, raising=False)
    monkeypatch.setattr(compiler, "ROWS_A_TASK", 0.1, raising=False)
    assert against_sql(spark, data, "join_star_oo") == [("customer/1", "supplier/5", "nation/3")]
    # One row is expected, by two customers, one supplier and two nations.
    assert entry.queries()["join_star_oo"](spark, data).rdd.getNumPartitions() == 10
