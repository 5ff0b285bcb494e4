"""Queries of the graph engine over the mapped tables and the table of facts, and the same results in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom import cli, store
from quadloom.model import RESERVED, assembled, grouped, hyper_rows, reified
from quadloom.operators.graph import merged, reduce_all, scan, semi_reduce, within_range
from quadloom.plans import compiler
from quadloom.plans.query import RDF_TYPE, Const, Pattern, QueryError, Var, parse
from quadloom.session import ensure_checkpoint_dir, table
from quadloom.sources.mapping import fact_table, mapped_facts, mapped_hyper, mapped_sizes
from quadloom.sources.text import checked_facts, export_lines, facts_of, hyper_line, hyper_of, key_values
from quadloom.sources.turtle import read_turtle
from quadloom.streaming.append import append_stream

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Run] = {}
ORACLES: dict[str, str] = {}


def _ask(name: str, text: str, sql: str) -> None:
    """A query text over the mapped facts; tables of predicates that it cannot read are not opened."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        query = parse(text)
        names = compiler.predicates_read(query)
        # The order of joins and the size of their results matter; a store has these sizes in its statistics.
        sizes = mapped_sizes(spark, d, names, counted=len(compiler.all_patterns(query)) > 1)
        matched = None if query.kind == "select" else mapped_facts(spark, d, *(compiler.predicates_matched(query) or ()))
        return compiler.run(mapped_facts(spark, d, *(names or ())), text, sizes, matched=matched)

    QUERIES[name] = run
    ORACLES[name] = sql


def _call(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    def add(f: Run) -> Run:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


C = "'customer/' || c_custkey"
N = "'nation/' || n_nationkey"
_NATION_FACTS = f"""
    select {N} as s, 'n_name' as p, n_name as o from nation
    union all select {N}, 'n_region', 'region/' || n_regionkey from nation
    union all select {N}, 'located_in', 'region/' || n_regionkey from nation"""
#: Every mapped fact with its time, over all tables.
_MAPPED = f"""(
    select 'region/' || r_regionkey as s, 'r_name' as p, r_name as o, 'no' as t from region
    union all select s, p, o, 'no' from ({_NATION_FACTS})
    union all select {C}, 'c_name', c_name, 'no' from customer
    union all select {C}, 'c_mktsegment', c_mktsegment, 'no' from customer
    union all select {C}, unnest(['c_nation', 'located_in']), 'nation/' || c_nationkey, 'no' from customer
    union all select 'supplier/' || s_suppkey, 's_name', s_name, 'no' from supplier
    union all select 'supplier/' || s_suppkey, unnest(['s_nation', 'located_in']), 'nation/' || s_nationkey, 'no' from supplier
    union all select 'part/' || p_partkey, 'p_name', p_name, 'no' from part
    union all select 'part/' || p_partkey, 'p_brand', p_brand, 'no' from part
    union all select 'part/' || p_partkey, 'p_type', p_type, 'no' from part
    union all select 'part/' || p_partkey, 'p_size', p_size::varchar, 'no' from part
    union all select 'order/' || o_orderkey, 'o_status', o_orderstatus, 'no' from orders
    union all select 'order/' || o_orderkey, 'o_priority', o_orderpriority, 'no' from orders
    union all select 'order/' || o_orderkey, 'o_customer', 'customer/' || o_custkey, strftime(o_orderdate, '%Y-%m-%d') from orders
    union all select 'order/' || l_orderkey, 'contains', 'part/' || l_partkey, strftime(l_shipdate, '%Y-%m-%d') from lineitem
    union all select 'part/' || l_partkey, 'supplied_by', 'supplier/' || l_suppkey, 'no' from lineitem
    union all select 'doc/' || doc_id, 'lang', lang, 'no' from documents where trim(lang) <> ''
    union all select 'doc/' || doc_id, 'source', source, 'no' from documents where source is not null
    union all select 'user/' || user_id, event_type, 'event/' || event_id, strftime(ts, '%Y-%m-%d') from events
              where event_type in ('click', 'view', 'purchase', 'signup', 'error'))"""
_DISTINCT = f"(select distinct s, p, o from {_MAPPED})"

# --- scans ---------------------------------------------------------------------------------------------------------
_ask("scan_s_by_po", "select ?x where { ?x <c_mktsegment> <BUILDING> }", f"select {C} as x from customer where c_mktsegment = 'BUILDING'")
_ask("scan_o_by_sp", "select ?o where { <customer/1> <c_nation> ?o }", "select 'nation/' || c_nationkey as o from customer where c_custkey = 1")
_ask("scan_so_by_p", "select ?s ?o where { ?s <c_nation> ?o }", f"select {C} as s, 'nation/' || c_nationkey as o from customer")
_ask("scan_os_by_p", "select ?o ?s where { ?s <s_nation> ?o }", "select 'nation/' || s_nationkey as o, 'supplier/' || s_suppkey as s from supplier")
_ask("scan_s_by_p", "select ?s where { ?s <contains> ?o }", "select s from (select distinct 'order/' || l_orderkey as s, l_partkey from lineitem)")
_ask("scan_o_by_p", "select ?o where { ?s <contains> ?o }", "select o from (select distinct l_orderkey, 'part/' || l_partkey as o from lineitem)")
_ask("scan_po_by_s", "select ?p ?o where { <nation/3> ?p ?o }", f"select p, o from ({_NATION_FACTS}) where s = 'nation/3'")
_ask("scan_sp_by_o", "select ?s ?p where { ?s ?p <region/1> }", f"select s, p from ({_NATION_FACTS}) where o = 'region/1'")
_ask("scan_p_by_so", "select ?p where { <nation/3> ?p <region/3> }", f"select p from ({_NATION_FACTS}) where s = 'nation/3' and o = 'region/3'")
_ask("scan_p_by_s", "select ?p where { <nation/3> ?p ?o }", f"select p from ({_NATION_FACTS}) where s = 'nation/3'")
_ask("scan_p_by_o", "select ?p where { ?s ?p <region/1> }", f"select p from ({_NATION_FACTS}) where o = 'region/1'")
_ask("scan_o_by_s", "select ?o where { <nation/3> ?p ?o }", f"select o from ({_NATION_FACTS}) where s = 'nation/3'")
_ask("scan_s_by_o", "select ?s where { ?s ?p <region/1> }", f"select s from ({_NATION_FACTS}) where o = 'region/1'")
_ask("scan_s", "select ?s where { ?s ?p ?o }", f"select s from {_DISTINCT}")
_ask("scan_all", "select ?s ?p ?o where { ?s ?p ?o }", f"select s, p, o from {_DISTINCT}")
_ask("scan_p", "select ?p where { ?s ?p ?o }", f"select p from {_DISTINCT}")


@_call("scan_exists", "select 'nation/3' as x where exists (select 1 from nation where n_nationkey = 3 and n_regionkey = 3)")
def _(spark: SparkSession, d: str) -> DataFrame:
    there = scan(mapped_facts(spark, d, "n_region"), Pattern(Const("nation/3"), Const("n_region"), Const("region/3")))
    return there.select(F.lit("nation/3").alias("x"))


@_call("scan_subjects_between", f"select distinct s from {_MAPPED} where s >= 'nation/1' and s <= 'part/15'")
def _(spark: SparkSession, d: str) -> DataFrame:
    return store.subjects_between(mapped_facts(spark, d), "nation/1", "part/15")


@_call("scan_predicates_of", f"select distinct p from ({_NATION_FACTS}) where s = 'nation/3'")
def _(spark: SparkSession, d: str) -> DataFrame:
    return store.predicates_of(mapped_facts(spark, d), "nation/3")


@_call("lookup_ot", "select distinct 'order/7' as s, 'contains' as p, 'part/' || l_partkey as o, strftime(l_shipdate, '%Y-%m-%d') as t from lineitem where l_orderkey = 7")
def _(spark: SparkSession, d: str) -> DataFrame:
    return store.search(mapped_facts(spark, d, "contains"), "order/7", "contains")


@_call("lookup_st", "select distinct 'order/' || l_orderkey as s, 'contains' as p, 'part/5' as o, strftime(l_shipdate, '%Y-%m-%d') as t from lineitem where l_partkey = 5")
def _(spark: SparkSession, d: str) -> DataFrame:
    return store.search(mapped_facts(spark, d, "contains"), "", "contains", "part/5")


@_call("lookup_text", "select distinct 'order/7-?-contains-?-part/' || l_partkey || '-?-' || strftime(l_shipdate, '%Y-%m-%d') as line from lineitem where l_orderkey = 7")
def _(spark: SparkSession, d: str) -> DataFrame:
    return store.delimited(store.search(mapped_facts(spark, d, "contains"), "order/7", "contains"))


_ask("query_gene", store.query_gene("", "c_nation", "nation/3"), f"select {C} as x from customer where c_nationkey = 3")

# --- joins ---------------------------------------------------------------------------------------------------------
_ask(
    "join_star_ss",
    "select ?x ?n ?g ?k where { ?x <c_name> ?n . ?x <c_mktsegment> ?g . ?x <c_nation> ?k }",
    f"select {C} as x, c_name as n, c_mktsegment as g, 'nation/' || c_nationkey as k from customer",
)
_ask(
    "join_star_oo",
    "select ?c ?s ?n where { ?c <c_nation> ?n . ?s <s_nation> ?n }",
    f"select {C} as c, 'supplier/' || s_suppkey as s, 'nation/' || c_nationkey as n from customer join supplier on c_nationkey = s_nationkey",
)
_CHAIN = "?o <o_customer> ?c . ?c <c_nation> ?n . ?n <n_region> ?r"
_ask(
    "join_chain_so",
    f"select ?o ?c ?n ?r where {{ {_CHAIN} }}",
    f"""select 'order/' || o_orderkey as o, {C} as c, {N} as n, 'region/' || n_regionkey as r
        from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey""",
)
_ask(
    "join_chain_hidden",
    f"select ?o ?r where {{ {_CHAIN} }}",
    """select 'order/' || o_orderkey as o, 'region/' || n_regionkey as r
       from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey""",
)
_CYCLE = "select ?o ?c ?n ?s ?p where { ?o <o_customer> ?c . ?c <c_nation> ?n . ?s <s_nation> ?n . ?p <supplied_by> ?s . ?o <contains> ?p }"
_ask(
    "join_cycle",
    _CYCLE,
    f"""select 'order/' || o_orderkey as o, {C} as c, 'nation/' || c_nationkey as n, 'supplier/' || s_suppkey as s, 'part/' || cp as p
        from (select distinct l_orderkey co, l_partkey cp from lineitem)
        join orders on co = o_orderkey join customer on o_custkey = c_custkey
        join (select distinct l_partkey sp, l_suppkey sk from lineitem) on sp = cp
        join supplier on sk = s_suppkey and s_nationkey = c_nationkey""",
)
_ask("join_two_vars_same", "select ?x where { ?x <located_in> ?x }", "select 'nation/0' as x where false")
_ask(
    "join_cross",
    "select ?a ?b where { ?a <r_name> ?x . ?b <r_name> ?y }",
    "select 'region/' || a.r_regionkey as a, 'region/' || b.r_regionkey as b from region a, region b",
)
_ask(
    "pattern_exists",
    "select ?r where { ?x <r_name> ?r . <nation/3> <n_region> <region/3> }",
    "select r_name as r from region where exists (select 1 from nation where n_nationkey = 3 and n_regionkey = 3)",
)
_ask(
    "join_optional",
    "select ?c ?o where { ?c <c_mktsegment> <MACHINERY> . optional { ?o <o_customer> ?c } }",
    f"select {C} as c, case when o_orderkey is not null then 'order/' || o_orderkey end as o from customer left join orders on o_custkey = c_custkey where c_mktsegment = 'MACHINERY'",
)
_ask(
    "join_variable_predicate",
    "select ?x ?p ?n where { ?x ?p ?n . ?n <n_region> <region/1> }",
    f"select s as x, p, o as n from {_DISTINCT} where o in (select {N} from nation where n_regionkey = 1)",
)


def _supplied(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    facts = mapped_facts(spark, d, "supplied_by", "s_nation")
    parts = scan(facts, Pattern(Var("p"), Const("supplied_by"), Var("s")))
    return parts, scan(facts, Pattern(Var("s"), Const("s_nation"), Const("nation/3")))


_SUPPLIED = """select distinct 'part/' || l_partkey as p, 'supplier/' || l_suppkey as s from lineitem
               where l_suppkey in (select s_suppkey from supplier where s_nationkey = 3)"""


@_call("semijoin_hash", _SUPPLIED)
def _(spark: SparkSession, d: str) -> DataFrame:
    return semi_reduce(*_supplied(spark, d), ["s"], "shuffle_hash")


@_call("semijoin_merge", _SUPPLIED)
def _(spark: SparkSession, d: str) -> DataFrame:
    return semi_reduce(*_supplied(spark, d), ["s"], "merge")


@_call(
    "semijoin_both",
    f"""select 'left' as side, p, s from ({_SUPPLIED}) union all
        select 'right', null, 'supplier/' || s_suppkey from supplier where s_nationkey = 3 and s_suppkey in (select l_suppkey from lineitem)""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    left, right = semi_reduce(*_supplied(spark, d), ["s"], "merge", both=True)
    none = F.lit(None).cast("string").alias("p")
    return left.select(F.lit("left").alias("side"), "p", "s").unionByName(right.select(F.lit("right").alias("side"), none, "s"))


@_call(
    "bitmap_reduce",
    """select distinct 'order/' || o_orderkey as o, 'customer/' || o_custkey as c from orders
       where o_custkey in (select c_custkey from customer where c_nationkey in (select n_nationkey from nation where n_regionkey = 1))""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    facts = mapped_facts(spark, d, "o_customer", "c_nation", "n_region")
    patterns = [
        Pattern(Var("n"), Const("n_region"), Const("region/1")),
        Pattern(Var("c"), Const("c_nation"), Var("n")),
        Pattern(Var("o"), Const("o_customer"), Var("c")),
    ]
    return reduce_all([scan(facts, p) for p in patterns])[2].select("o", "c")


@_call("range_minmax", "select 'nation/' || min(c_nationkey::varchar) as lo, 'nation/' || max(c_nationkey::varchar) as hi, count(*)::bigint as n from customer")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = compiler.run(mapped_facts(spark, d, "c_nation"), "select ?n where { ?x <c_nation> ?n }")
    return rows.agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.count(F.lit(1)).alias("n"))


@_call(
    "join_range",
    f"""select {C} as x, 'nation/' || c_nationkey as n from customer where c_nationkey in (select n_nationkey from nation where n_regionkey = 1)""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    """The range of the nations found bounds the scan of the customers before they are joined."""
    facts = mapped_facts(spark, d, "c_nation", "n_region")
    nations = scan(facts, Pattern(Var("n"), Const("n_region"), Const("region/1")))
    customers = within_range(scan(facts, Pattern(Var("x"), Const("c_nation"), Var("n")), repeats=False), "n", nations)
    return customers.join(nations, "n").select("x", "n")


@_call("set_union", "select 'nation/' || c_nationkey as n from customer union select 'nation/' || s_nationkey from supplier")
def _(spark: SparkSession, d: str) -> DataFrame:
    facts = mapped_facts(spark, d, "c_nation", "s_nation")
    return merged([compiler.run(facts, f"select ?n where {{ ?x <{p}> ?n }}") for p in ("c_nation", "s_nation")])


# --- projection, filters, modifiers, unions ------------------------------------------------------------------------
_SEGMENT = f"select {C} as x, c_mktsegment as g from customer"
_ask("proj_star", "select * where { ?x <c_mktsegment> ?g }", f"select c_mktsegment as g, {C} as x from customer")
for _name, _filter, _where in (
    ("filter_eq", "?g = <BUILDING>", "c_mktsegment = 'BUILDING'"),
    ("filter_ne", "?g != <BUILDING>", "c_mktsegment <> 'BUILDING'"),
    ("filter_in", "?g in <BUILDING>, <MACHINERY>", "c_mktsegment in ('BUILDING', 'MACHINERY')"),
    ("filter_unknown_eq", "?g = <nowhere>", "false"),
    ("filter_unknown_ne", "?g != <nowhere>", "true"),
    ("filter_unbound", "?q = <BUILDING>", "false"),
):
    _ask(_name, f"select ?x ?g where {{ ?x <c_mktsegment> ?g filter({_filter}) }}", f"{_SEGMENT} where {_where}")
for _name, _op, _sql_op in (("filter_var_eq", "=", "="), ("filter_var_ne", "!=", "<>")):
    _ask(
        _name,
        f"select ?c ?s where {{ ?c <c_nation> ?n . ?s <s_nation> ?m . ?n <n_region> ?r . ?m <n_region> ?r filter(?n {_op} ?m) }}",
        f"""select {C} as c, 'supplier/' || s_suppkey as s from customer join nation a on c_nationkey = a.n_nationkey
            join nation b on a.n_regionkey = b.n_regionkey join supplier on s_nationkey = b.n_nationkey where c_nationkey {_sql_op} s_nationkey""",
    )
_ask(
    "filter_reaches",
    "select distinct ?x where { ?x <located_in> ?y filter(?x reaches <region/0> via <located_in>) }",
    f"""with recursive e as (
          select {C} as a, 'nation/' || c_nationkey as b from customer
          union select 'supplier/' || s_suppkey, 'nation/' || s_nationkey from supplier
          union select {N}, 'region/' || n_regionkey from nation),
        r as (select 'region/0' as x union select a from e join r on b = x)
        select x from r where x <> 'region/0'""",
)
_DEEP = "(select distinct s, trim(o) as o from facts where lower(trim(p)) = 'holds_share_in' and s <> '' and trim(o) <> '')"


@_call(
    "filter_reaches_deep",
    f"""with recursive r as (select 'company/1' as x union select e.s from {_DEEP} e join r on e.o = r.x)
        select distinct s as x from {_DEEP} where s in (select x from r)""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return compiler.run(fact_table(spark, d), "select distinct ?x where { ?x <holds_share_in> ?y filter(?x reaches <company/1> via <holds_share_in>) }")


_ask("sel_distinct", "select distinct ?g where { ?x <c_mktsegment> ?g }", "select distinct c_mktsegment as g from customer")
_ask("sel_reduced", "select reduced ?g where { ?x <c_mktsegment> ?g }", "select distinct c_mktsegment as g from customer")
_ask("sel_count", "select count ?g where { ?x <c_mktsegment> ?g }", 'select c_mktsegment as g, count(*)::bigint as "count" from customer group by 1')
_ask("sel_duplicates", "select duplicates ?o where { ?x <p_name> ?o }", "select p_name as o from part group by 1 having count(*) > 1")


@_call("limit_n", "select least(7, count(*))::bigint as n from customer")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = compiler.run(mapped_facts(spark, d, "c_name"), "select ?x where { ?x <c_name> ?n } limit 7")
    return rows.agg(F.count(F.lit(1)).alias("n"))


_ask(
    "union_two",
    "select ?x where { { ?x <c_nation> <nation/3> } union { ?x <s_nation> <nation/3> } }",
    f"select {C} as x from customer where c_nationkey = 3 union all select 'supplier/' || s_suppkey from supplier where s_nationkey = 3",
)
_ask(
    "union_three",
    "select ?x where { { ?x <c_nation> <nation/3> } union { ?x <s_nation> <nation/3> } union { ?x <n_region> <region/1> } }",
    f"""select {C} as x from customer where c_nationkey = 3 union all select 'supplier/' || s_suppkey from supplier where s_nationkey = 3
        union all select {N} from nation where n_regionkey = 1""",
)
_ask(
    "union_missing_var",
    "select ?x ?g where { { ?x <c_mktsegment> ?g } union { ?x <s_nation> <nation/3> } }",
    f"{_SEGMENT} union all select 'supplier/' || s_suppkey, null from supplier where s_nationkey = 3",
)
_ask(
    "union_joined",
    "select ?x ?r where { ?n <n_region> ?r . { ?x <c_nation> ?n } union { ?x <s_nation> ?n } }",
    f"""select {C} as x, 'region/' || n_regionkey as r from customer join nation on c_nationkey = n_nationkey
        union all select 'supplier/' || s_suppkey, 'region/' || n_regionkey from supplier join nation on s_nationkey = n_nationkey""",
)
_ask(
    "group_nested",
    "select ?x ?r where { { ?x <c_nation> ?n } ?n <n_region> ?r }",
    f"select {C} as x, 'region/' || n_regionkey as r from customer join nation on c_nationkey = n_nationkey",
)
_NAMED = f"select {C} as x, c_name as n, 'nation/' || c_nationkey as k from customer"
_ask("syntax_prefix", "prefix c: <c_> # comment\nselect ?x ?n ?k where { $x c:name ?n . ?x c:nation ?k }", _NAMED)
_ask("syntax_lists", "SELECT ?x ?n ?k WHERE { ?x <c_name> ?n ; <c_nation> ?k . }", _NAMED)
_ask(
    "syntax_blank",
    "select ?x ?r where { ?x <c_nation> [ <n_region> ?r ] . ?x <c_name> _:n }",
    f"select {C} as x, 'region/' || n_regionkey as r from customer join nation on c_nationkey = n_nationkey",
)
_ask(
    "syntax_objects",
    "select ?x where { ?x <n_region> <region/1>, ?r . ?r <r_name> 'AMERICA' }",
    f"select {N} as x from nation join region on n_regionkey = r_regionkey where n_regionkey = 1 and r_name = 'AMERICA'",
)
_ask("syntax_colon", "prefix : <c_> select ?x ?n ?k where { ?x :name ?n ; :nation ?k }", _NAMED)
_ask("syntax_last_where", "select ?x where { ?x <s_nation> ?n } where { ?x <c_nation> <nation/3> }", f"select {C} as x from customer where c_nationkey = 3")
_ask("temporal_mode", "-t select ?o ?p where { ?o <contains> ?p }", "select distinct 'order/' || l_orderkey as o, 'part/' || l_partkey as p, strftime(l_shipdate, '%Y-%m-%d') as t from lineitem")


@_call("syntax_type", f"select {C} as x from customer where c_mktsegment = 'BUILDING'")
def _(spark: SparkSession, d: str) -> DataFrame:
    typed = mapped_facts(spark, d, "c_mktsegment").withColumn("p", F.lit(RDF_TYPE))
    return compiler.run(typed, "select ?x where { ?x a <BUILDING> }")


#: Texts that are no queries, and one that is.
_TEXTS = (
    "ask { ?x <p> ?y }", "construct { ?x <p> ?y } where { ?x <p> ?y }", "describe <a>", "select ?x from <g> where { ?x <p> ?y }", "select where { ?x <p> ?y }",
    "select ?x where { ?x <p> ?y", "select ?x where { ?x q:z ?y }", "prefix a: <x> prefix a: <y> select ?x where { ?x <p> ?y }", "select ?x where { ?x <p> ?y } limit 0",
    "select ?x where { ?x <p> ?y } order", "insert data { ?x <p> <y> }", "select ?x where { ?x <p> ?y }",
)


@_call("syntax_errors", "select i::int as n, i < 11 as refused from range(12) t(i)")
def _(spark: SparkSession, d: str) -> DataFrame:
    def refused(text: str) -> bool:
        try:
            parse(text)
        except QueryError:
            return True
        return False

    return spark.createDataFrame([(i, refused(t)) for i, t in enumerate(_TEXTS)], "n int, refused boolean")


@_call("key_values", f"select s, p, trim(o) as value from {_MAPPED} where o <> ''")
def _(spark: SparkSession, d: str) -> DataFrame:
    lines = mapped_facts(spark, d).where("o <> ''").select(F.concat_ws("=", "s", "p", "o").alias("value"))
    return key_values(lines)


_ask("empty_unknown_const", "select ?x where { ?x <c_nation> <nation/999> }", "select '' as x where false")
_ask(
    "temporal_events",
    "select ?u ?e where { ?u <click> ?e }",
    "select 'user/' || user_id as u, 'event/' || event_id as e from events where event_type = 'click'",
)


@_call(
    "temporal_lookup",
    "select distinct 'user/' || user_id as s, 'purchase' as p, 'event/' || event_id as o, strftime(ts, '%Y-%m-%d') as t from events where event_type = 'purchase'",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return mapped_facts(spark, d, "purchase").distinct()


# --- hyperedges ----------------------------------------------------------------------------------------------------
_HYPER = """
    select 'hid' || o_orderkey as hid, 'customer/' || o_custkey as subject, 'placed' as predicate, object,
           strftime(o_orderdate, '%Y-%m-%d') as stime, case when o_orderstatus = 'O' then 'null' else strftime(last, '%Y-%m-%d') end as etime
    from orders
    join (select distinct l_orderkey k, 'part/' || l_partkey as object from lineitem) on k = o_orderkey
    join (select l_orderkey k2, max(l_shipdate) as last from lineitem group by 1) on k2 = o_orderkey"""


@_call("hyper_all", _HYPER)
def _(spark: SparkSession, d: str) -> DataFrame:
    return hyper_rows(mapped_hyper(spark, d))


for _name, _args in {
    "hyper_s": ("customer/1328", "", ""), "hyper_p": ("", "placed", ""), "hyper_o": ("", "", "part/209"), "hyper_sp": ("customer/1328", "placed", ""),
    "hyper_so": ("customer/1328", "", "part/209"), "hyper_po": ("", "placed", "part/209"), "hyper_spo": ("customer/1328", "placed", "part/209"),
}.items():
    QUERIES[_name] = lambda spark, d, a=_args: store.search_hyper(mapped_hyper(spark, d), *a)
    _terms = [f"{c} = '{v}'" for c, v in zip(("subject", "predicate"), _args[:2], strict=True) if v]
    _terms += [f"hid in (select hid from ({_HYPER}) where object = '{_args[2]}')"] if _args[2] else []
    _due = " and ".join(_terms)
    ORACLES[_name] = f"select * from ({_HYPER}) where {_due}"

_RENAMED = "select hid as h, subject as x, predicate as y, object as z, stime as k, etime as m"


@_call("hyper_assembly", f"{_RENAMED} from ({_HYPER}) where subject = 'customer/1328'")
def _(spark: SparkSession, d: str) -> DataFrame:
    """The six patterns are answered from the hyperedges, not by joining their reified facts with themselves."""
    hyper = mapped_hyper(spark, d)
    return compiler.run(reified(hyper), store.query_gene_hyper("customer/1328"), hyper=hyper)


_GROUPED = f"""select hid, subject, predicate, stime, etime, count(*)::bigint as n_objects, string_agg(object, ',' order by object) as objects
               from ({_HYPER}) group by hid, subject, predicate, stime, etime"""


def _listed(rows: DataFrame) -> DataFrame:
    n, text = F.size("objects").cast("bigint").alias("n_objects"), F.concat_ws(",", F.sort_array("objects")).alias("objects")
    return rows.select("hid", "subject", "predicate", "stime", "etime", n, text)


@_call("hyper_grouped", _GROUPED)
def _(spark: SparkSession, d: str) -> DataFrame:
    return _listed(grouped(hyper_rows(mapped_hyper(spark, d))))


@_call("hyper_reassembled", _GROUPED)
def _(spark: SparkSession, d: str) -> DataFrame:
    return _listed(assembled(reified(mapped_hyper(spark, d))))


# --- statistics over the table of facts ----------------------------------------------------------------------------
_FACTS = """(select s, lower(trim(p)) as p, trim(o) as o, coalesce(t, 'no') as t from facts
             where s <> '' and p is not null and trim(p) <> '' and o is not null and trim(o) <> '')"""
for _kind, _keys in {"s": ("s",), "o": ("o",), "sp": ("s", "p"), "op": ("o", "p"), "p": ("p",)}.items():
    QUERIES[f"stats_{_kind}"] = lambda spark, d, k=_kind: store.stats(fact_table(spark, d), k)
    _second = _keys[1] if len(_keys) > 1 else "cast(null as varchar)"
    ORACLES[f"stats_{_kind}"] = f"select {_keys[0]} as k1, {_second} as k2, count(*)::bigint as n from {_FACTS} group by 1, 2"
QUERIES["stats_total"] = lambda spark, d: store.stats(fact_table(spark, d), "total")
ORACLES["stats_total"] = f"select cast(null as varchar) as k1, cast(null as varchar) as k2, count(*)::bigint as n from {_FACTS}"
QUERIES["stats_distinct"] = lambda spark, d: store.stats(fact_table(spark, d), "distinct")
ORACLES["stats_distinct"] = f"""select cast(null as varchar) as k1, cast(null as varchar) as k2, count(*)::bigint as n
                                from (select s from {_FACTS} union select o from {_FACTS})"""


@_call("facts_star", f"""with f as (select distinct s, p, o from {_FACTS})
    select a.s as x, a.o as n, b.o as g from f a join f b on a.s = b.s where a.p = 'std_name' and b.p = 'reg_status'""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return compiler.run(fact_table(spark, d), "select ?x ?n ?g where { ?x <std_name> ?n . ?x <reg_status> ?g }")


# --- writing -------------------------------------------------------------------------------------------------------
@_call("build_dedup", f"select distinct s, p, o, t from {_FACTS}")
def _(spark: SparkSession, d: str) -> DataFrame:
    return store.build_rows(fact_table(spark, d))


@_call(
    "append_dedup",
    f"""with old as (select 'customer/' || c_custkey as s, 'c_nation' as p, 'nation/' || c_nationkey as o, 'no' as t from customer),
        new as (select 'customer/' || c_custkey as s, 'c_nation' as p, 'nation/' || c_nationkey as o, '2020-01-01' as t from customer
                union all select 'supplier/' || s_suppkey, 'c_nation', 'nation/' || s_nationkey, '2020-01-01' from supplier)
        select * from old union all select * from new where (s, p, o) not in (select s, p, o from old)""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    facts = mapped_facts(spark, d, "c_nation", "s_nation")
    new = facts.select("s", F.lit("c_nation").alias("p"), "o", F.lit("2020-01-01").alias("t"))
    return compiler.insert_facts(facts.where("p = 'c_nation'"), new)


# Over every mapped fact; those of other predicates pass unchanged.
for _name, _text, _sql in (
    (
        "insert_data",
        "insert data { <region/9> <r_name> 'NOWHERE' . <region/1> <r_name> 'AMERICA' }",
        f"""select * from {_MAPPED} union all
            select * from (select 'region/9' as s, 'r_name' as p, 'NOWHERE' as o, 'no' as t union all select 'region/1', 'r_name', 'AMERICA', 'no')
            where (s, p, o) not in (select s, p, o from {_MAPPED} where p = 'r_name')""",
    ),
    (
        "delete_data",
        "delete data { <region/1> <r_name> 'AMERICA' . <region/2> <r_name> 'NOWHERE' }",
        f"select * from {_MAPPED} where not (p = 'r_name' and ((s = 'region/1' and o = 'AMERICA') or (s = 'region/2' and o = 'NOWHERE')))",
    ),
    ("delete_where", "delete { ?x <r_name> 'ASIA' }", f"select * from {_MAPPED} where not (p = 'r_name' and o = 'ASIA')"),
    (
        "update_pattern",
        "delete { ?x <r_name> 'ASIA' } insert { ?x <r_name> 'ORIENT' }",
        f"select s, p, case when p = 'r_name' and o = 'ASIA' then 'ORIENT' else o end as o, t from {_MAPPED}",
    ),
    (
        "delete_filtered",
        "delete { ?x <c_mktsegment> ?g filter(?g in ('BUILDING', 'MACHINERY')) }",
        f"select * from {_MAPPED} where not (p = 'c_mktsegment' and o in ('BUILDING', 'MACHINERY'))",
    ),
    (
        "delete_joined",
        "delete { ?c <c_nation> ?n . ?n <n_region> <region/1> }",
        f"""select * from {_MAPPED} where not (p = 'n_region' and o = 'region/1' and s in (select 'nation/' || c_nationkey from customer))
            and not (p = 'c_nation' and o in (select {N} from nation where n_regionkey = 1))""",
    ),
    (
        "delete_branches",
        "delete { { ?x <c_nation> <nation/3> } union { ?x <s_nation> ?n filter(?n != <nation/3>) } }",
        f"select * from {_MAPPED} where not (p = 'c_nation' and o = 'nation/3') and not (p = 's_nation' and o <> 'nation/3')",
    ),
    (
        "update_filtered",
        "delete { ?o <o_customer> ?c . ?c <c_mktsegment> ?g filter(?g = 'BUILDING') } insert { ?o <was_ordered_by> ?c . ?c <builds> ?g }",
        f"""select s, case when p = 'o_customer' and b then 'was_ordered_by' when p = 'c_mktsegment' and o = 'BUILDING' and d then 'builds' else p end as p, o, t
            from (select *, p = 'o_customer' and o in (select {C} from customer where c_mktsegment = 'BUILDING') as b,
                         p = 'c_mktsegment' and s in (select 'customer/' || o_custkey from orders) as d from {_MAPPED})""",
    ),
):
    _ask(_name, _text, _sql)


@_call("export_triples", f"select '<' || s || '> <' || p || '> <' || o || '> <' || t || '>.' as line from (select distinct s, p, o, t from {_FACTS}) where p not in ('rdfp', 'rdfs', 'rdfst', 'rdfet', 'rdfo')")
def _(spark: SparkSession, d: str) -> DataFrame:
    return export_lines(store.build_rows(fact_table(spark, d)), reserved=False)


@_call("export_hyper", f"""select '<' || s || '> <' || p || '> <' || o || '> <no>.' as line from (
    select hid as s, 'rdfp' as p, predicate as o from ({_HYPER}) union select hid, 'rdfs', subject from ({_HYPER})
    union select hid, 'rdfst', stime from ({_HYPER}) union select hid, 'rdfet', etime from ({_HYPER}) union select hid, 'rdfo', object from ({_HYPER}))""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return export_lines(reified(mapped_hyper(spark, d)), reserved=True)


@_call("text_roundtrip", f"select * from {_MAPPED} where o <> ''")
def _(spark: SparkSession, d: str) -> DataFrame:
    return facts_of(export_lines(mapped_facts(spark, d), reserved=False), "line")


@_call("hyper_roundtrip", f"select subject, predicate, stime, etime, count(*)::bigint as n_objects, string_agg(object, ',' order by object) as objects from ({_HYPER}) group by hid, subject, predicate, stime, etime")
def _(spark: SparkSession, d: str) -> DataFrame:
    lines = mapped_hyper(spark, d).select(hyper_line().alias("line"))
    return _listed(hyper_of(lines, text="line")).drop("hid")


# --- a store that is built from every mapped fact and hyperedge, written, and read again ----------------------------
def _built(spark: SparkSession, d: str) -> store.GraphStore:
    """A new store in the shared folder of the cluster."""
    db = store.GraphStore(spark, f"{ensure_checkpoint_dir(spark)}/store-{uuid.uuid4().hex}")
    db.build(mapped_facts(spark, d), mapped_hyper(spark, d))
    return db


_STORED = f"""(select distinct s, p, o, t from {_MAPPED} union all
    select distinct h.hid as s, u.p as p, u.o as o, 'no' as t from ({_HYPER}) h,
      lateral (select unnest(['rdfp', 'rdfs', 'rdfst', 'rdfet', 'rdfo']) as p, unnest([h.predicate, h.subject, h.stime, h.etime, h.object]) as o) u)"""


@_call("store_scan", f"select s, p, o, t from {_STORED}")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _built(spark, d).facts().select("s", "p", "o", "t")


@_call("store_patterns", f"select distinct s, p, o from {_STORED}")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _built(spark, d).sparql("select ?s ?p ?o where { ?s ?p ?o }")


@_call("store_join", ORACLES["join_cycle"])
def _(spark: SparkSession, d: str) -> DataFrame:
    return _built(spark, d).sparql(_CYCLE)


@_call("store_assembly", ORACLES["hyper_assembly"])
def _(spark: SparkSession, d: str) -> DataFrame:
    return _built(spark, d).sparql(store.query_gene_hyper("customer/1328"))


@_call(
    "store_append",
    f"""select * from {_STORED} union all
        select 'supplier/' || s_suppkey, 'c_nation', 'nation/' || s_nationkey, '2020-01-01' from supplier union all
        select 'customer/' || c_custkey, 'seen', 'nation/' || c_nationkey, '2021-01-01' from customer""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    """Facts that are there already, new ones under an old predicate, and a new predicate, as two parts."""
    db, facts = _built(spark, d), mapped_facts(spark, d, "c_nation", "s_nation")
    db.append(facts.select("s", F.lit("c_nation").alias("p"), "o", F.lit("2020-01-01").alias("t")))
    db.append(facts.where("p = 'c_nation'").select("s", F.lit("seen").alias("p"), "o", F.explode(F.array(F.lit("2021-01-01"), F.lit("2022-01-01"))).alias("t")))
    return db.facts().select("s", "p", "o", "t")


@_call(
    "store_update",
    f"""select s, case when p = 'c_mktsegment' and o = 'BUILDING' then 'builds' else p end as p, o, t from {_STORED}
        where not (p = 'r_name' and o = 'ASIA') union all select 'region/9', 'r_name', 'NOWHERE', 'no'""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    db = _built(spark, d)
    db.sparql("delete { ?c <c_mktsegment> ?g filter(?g = 'BUILDING') } insert { ?c <builds> ?g }")
    db.sparql("delete data { <region/2> <r_name> 'ASIA' }")
    db.sparql("insert data { <region/9> <r_name> 'NOWHERE' . <region/1> <r_name> 'AMERICA' }")
    return db.facts().select("s", "p", "o", "t")


@_call("store_compact", f"""select s, p, o, t from {_STORED} where p <> 'p_brand' union all select 'supplier/' || s_suppkey, 'c_nation', 'nation/' || s_nationkey, 'no' from supplier""")
def _(spark: SparkSession, d: str) -> DataFrame:
    db = _built(spark, d)
    db.append(mapped_facts(spark, d, "s_nation").select("s", F.lit("c_nation").alias("p"), "o", "t"))
    db.sparql("delete { ?x <p_brand> ?y }")
    db.compact()
    db.vacuum()
    return db.facts().select("s", "p", "o", "t")


@_call("store_export", f"select '<' || s || '> <' || p || '> <' || o || '> <' || t || '>.' as line from {_STORED}")
def _(spark: SparkSession, d: str) -> DataFrame:
    db = _built(spark, d)
    db.export(f"{db.path}/export")
    return spark.read.text(f"{db.path}/export/*").withColumnRenamed("value", "line")


@_call("store_lookup", "select distinct 'order/7' as s, 'contains' as p, 'part/' || l_partkey as o, strftime(l_shipdate, '%Y-%m-%d') as t from lineitem where l_orderkey = 7")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _built(spark, d).search("order/7", "contains").select("s", "p", "o", "t")


def _folder(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark)}/files-{uuid.uuid4().hex}"


@_call("store_load", f"select distinct s, p, o, t from {_MAPPED} where o <> '' union all select hid, 'rdfo', object, 'no' from ({_HYPER})")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Facts and hyperedges as text files, loaded by the command line; the hids are new, so the objects keep the old ones in theirs."""
    folder = _folder(spark)
    export_lines(mapped_facts(spark, d), reserved=False).write.text(f"{folder}/facts")
    named = mapped_hyper(spark, d).withColumn("subject", F.col("hid"))
    named.select(hyper_line().alias("line")).write.text(f"{folder}/hyper")
    cli.run(spark, ["build", f"{folder}/db", f"{folder}/{{facts,hyper}}"])
    db = store.GraphStore(spark, f"{folder}/db")
    held = db.search_hyper(p="placed").select(F.col("subject").alias("s"), F.lit("rdfo").alias("p"), F.col("object").alias("o"), F.lit("no").alias("t"))
    return db.facts().where(~F.col("p").isin(*RESERVED)).select("s", "p", "o", "t").unionByName(held)


_SEEN = f"""(select distinct s, p, o, t from {_MAPPED}) union all
    select 'supplier/' || s_suppkey, 'c_nation', 'nation/' || s_nationkey, 'no' from supplier"""


def _arrivals(spark: SparkSession, d: str) -> tuple[store.GraphStore, str]:
    """A store of every mapped fact, and files of facts that are partly there: nations of customers, and of suppliers as such."""
    folder = _folder(spark)
    db = store.GraphStore(spark, f"{folder}/db")
    db.build(mapped_facts(spark, d))
    export_lines(mapped_facts(spark, d, "c_nation", "s_nation").withColumn("p", F.lit("c_nation")), reserved=False).write.text(f"{folder}/new")
    return db, f"{folder}/new"


@_call("store_append_file", _SEEN)
def _(spark: SparkSession, d: str) -> DataFrame:
    db, new = _arrivals(spark, d)
    cli.run(spark, ["insert", db.path, new])
    return db.facts().select("s", "p", "o", "t")


@_call("stream_append", _SEEN)
def _(spark: SparkSession, d: str) -> DataFrame:
    db, new = _arrivals(spark, d)
    for _ in range(2):  # the second run finds no new file
        append_stream(spark, new, db, f"{db.path}-stream").awaitTermination()
    return db.facts().select("s", "p", "o", "t")


@_call("query_file", f"select {C} || '-?-' || c_name as line from customer where c_nationkey = 3")
def _(spark: SparkSession, d: str) -> DataFrame:
    """A query text of several lines in a file, asked by the command line, its result written to a file."""
    folder = _folder(spark)
    db = store.GraphStore(spark, f"{folder}/db")
    db.build(mapped_facts(spark, d, "c_nation", "c_name"))
    spark.createDataFrame([("select ?x ?n\nwhere {\n ?x <c_nation> <nation/3> ;\n <c_name> ?n . }",)], "value string").coalesce(1).write.text(f"{folder}/ask")
    found = cli.run(spark, ["query", db.path, f"{folder}/ask/*.txt", "--file"])
    store.delimited(found).write.text(f"{folder}/result")
    return spark.read.text(f"{folder}/result").withColumnRenamed("value", "line")


@_call("turtle_roundtrip", f"select distinct s, p, o, 'no' as t from {_MAPPED}")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Facts written as Turtle, a statement each, and read again."""
    folder = _folder(spark)
    text = F.concat(F.lit('"'), F.regexp_replace("o", r'([\\"])', r"\\$1"), F.lit('"@en .'))
    facts = mapped_facts(spark, d).select("s", "p", "o").distinct()
    facts.select(F.concat(F.lit("<"), F.col("s"), F.lit("> <"), F.col("p"), F.lit("> "), text)).write.text(f"{folder}/ttl")
    return read_turtle(spark, f"{folder}/ttl")


@_call("store_predicates", f"select p, count(*)::bigint as n, count(distinct (s, o))::bigint as firsts from {_STORED} group by p")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _built(spark, d).predicates().select("p", "n", "firsts")


@_call("lines_loaded")
def _(spark: SparkSession, d: str) -> DataFrame:
    return checked_facts(table(spark, d, "raw_lines"))
