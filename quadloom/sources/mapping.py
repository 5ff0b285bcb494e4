"""Relational tables as facts and hyperedges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.plans.compiler import Size
from quadloom.session import table


def _term(prefix: str, column: str) -> Column:
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def _day(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd")


#: What the objects of a predicate refer to; those of all others are plain values.
REFERENCES = {
    "n_region": "region", "c_nation": "nation", "s_nation": "nation", "o_customer": "customer", "contains": "part", "supplied_by": "supplier", "located_in": "nation",
    **dict.fromkeys(("click", "view", "purchase", "signup", "error"), "events"),
}
#: Predicates of line items, which have no key, so that a fact may occur more than once; the table of their subjects.
REPEATED = {"contains": "orders", "supplied_by": "part"}


def _rows() -> list[tuple[str, str, Column, Column, Column | None, Column | None]]:
    """(table, predicate, s, o, t or none, condition or none)."""
    region, nation = _term("region/", "r_regionkey"), _term("nation/", "n_nationkey")
    customer, supplier = _term("customer/", "c_custkey"), _term("supplier/", "s_suppkey")
    part, order, doc = _term("part/", "p_partkey"), _term("order/", "o_orderkey"), _term("doc/", "doc_id")
    out = [
        ("region", "r_name", region, F.col("r_name"), None, None),
        ("nation", "n_name", nation, F.col("n_name"), None, None),
        ("nation", "n_region", nation, _term("region/", "n_regionkey"), None, None),
        ("customer", "c_name", customer, F.col("c_name"), None, None),
        ("customer", "c_mktsegment", customer, F.col("c_mktsegment"), None, None),
        ("customer", "c_nation", customer, _term("nation/", "c_nationkey"), None, None),
        ("supplier", "s_name", supplier, F.col("s_name"), None, None),
        ("supplier", "s_nation", supplier, _term("nation/", "s_nationkey"), None, None),
        ("part", "p_name", part, F.col("p_name"), None, None),
        ("part", "p_brand", part, F.col("p_brand"), None, None),
        ("part", "p_type", part, F.col("p_type"), None, None),
        ("part", "p_size", part, F.col("p_size").cast("string"), None, None),
        ("orders", "o_status", order, F.col("o_orderstatus"), None, None),
        ("orders", "o_priority", order, F.col("o_orderpriority"), None, None),
        ("orders", "o_customer", order, _term("customer/", "o_custkey"), _day("o_orderdate"), None),
        ("lineitem", "contains", _term("order/", "l_orderkey"), _term("part/", "l_partkey"), _day("l_shipdate"), None),
        ("lineitem", "supplied_by", _term("part/", "l_partkey"), _term("supplier/", "l_suppkey"), None, None),
        ("customer", "located_in", customer, _term("nation/", "c_nationkey"), None, None),
        ("supplier", "located_in", supplier, _term("nation/", "s_nationkey"), None, None),
        ("nation", "located_in", nation, _term("region/", "n_regionkey"), None, None),
        ("documents", "lang", doc, F.col("lang"), None, F.col("lang").isNotNull() & (F.trim("lang") != "")),
        ("documents", "source", doc, F.col("source"), None, F.col("source").isNotNull()),
    ]
    for kind in ("click", "view", "purchase", "signup", "error"):
        out.append(("events", kind, _term("user/", "user_id"), _term("event/", "event_id"), _day("ts"), F.col("event_type") == kind))
    return out


def mapped_facts(spark: SparkSession, sf_dir: str, *predicates: str) -> DataFrame:
    """(s, p, o, t) of the driver's tables, all predicates or the given ones.

    A union of selections with literal predicates: a filter on p folds the other branches away before anything is read.
    """
    tables: dict[str, DataFrame] = {}
    parts = []
    for name, predicate, s, o, t, due in _rows():
        if predicates and predicate not in predicates:
            continue
        if name not in tables:
            tables[name] = table(spark, sf_dir, name)
        rows = tables[name] if due is None else tables[name].where(due)
        parts.append(rows.select(s.alias("s"), F.lit(predicate).alias("p"), o.alias("o"), (F.lit("no") if t is None else t).alias("t")))
    return reduce(DataFrame.unionByName, parts)


def mapped_sizes(spark: SparkSession, sf_dir: str, predicates: set[str] | None = None, counted: bool = True) -> dict[str | None, Size]:
    """Sizes of the predicates, or of all facts, by the rows of their tables and the keys that the mapping knows of.

    Rows are counted from the footers of the files. Without `counted`, only whether facts repeat is told.
    """
    sources: dict[str, list[str]] = {}
    for name, predicate, *_ in _rows():
        if predicates is None or predicate in predicates:
            sources.setdefault(predicate, []).append(name)
    count: dict[str, float] = {}
    if counted:
        names = {x for v in sources.values() for x in v} | {REFERENCES[p] for p in sources if p in REFERENCES} | {REPEATED[p] for p in sources if p in REPEATED}
        parts = [table(spark, sf_dir, n).select(F.lit(n).alias("n")) for n in sorted(names)]
        count = {r.n: float(r["count"]) for r in reduce(DataFrame.unionByName, parts).groupBy("n").count().collect()} if parts else {}
    out: dict[str | None, Size] = {}
    for predicate, tables in sources.items():
        n = max(sum(count.get(t, 1e9) for t in tables), 1.0)
        subjects = min(n, count.get(REPEATED[predicate], n)) if predicate in REPEATED else n
        objects = min(n, count.get(REFERENCES[predicate], n)) if predicate in REFERENCES else n**0.5
        out[predicate] = Size(n, max(subjects, 1.0), max(objects, 1.0), predicate in REPEATED)
    if predicates is None:
        out[None] = Size(sum(x.facts for x in out.values()), max(x.subjects for x in out.values()), max(x.objects for x in out.values()))
    return out


def mapped_hyper(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hyperedge per order with line items: who placed it, from the order to the last shipment, and its parts.

    Orders and line items meet by the order key once; line items are reduced to one row per order before the join.
    """
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.sort_array(F.collect_set(_term("part/", "l_partkey"))).alias("objects"), F.max("l_shipdate").alias("last")
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus")
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.concat(F.lit("hid"), F.col("o_orderkey").cast("string")).alias("hid"),
        _term("customer/", "o_custkey").alias("subject"),
        F.lit("placed").alias("predicate"),
        "objects",
        _day("o_orderdate").alias("stime"),
        F.when(F.col("o_orderstatus") == "O", "null").otherwise(_day("last")).alias("etime"),
    )


def fact_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(s, p, o, t) of the table `facts`: predicates in one spelling, missing times as 'no', facts without object left out."""
    rows = table(spark, sf_dir, "facts").where(F.col("s").isNotNull() & F.col("p").isNotNull() & F.col("o").isNotNull())
    rows = rows.select("s", F.lower(F.trim("p")).alias("p"), F.trim("o").alias("o"), F.coalesce("t", F.lit("no")).alias("t"))
    return rows.where((F.col("s") != "") & (F.col("p") != "") & (F.col("o") != ""))
