"""Query texts, the compiler against a naive evaluator, hyperedges, the store and the stream."""

import itertools
import random
import re
from collections import Counter

import pytest

from quadloom import model, store
from quadloom.operators.graph import reaches, reduce_all, scan, semi_reduce, within_range
from quadloom.plans import compiler
from quadloom.plans.query import RDF_TYPE, Const, Filter, Pattern, QueryError, Var, parse
from quadloom.sources import text
from quadloom.store import GraphStore
from quadloom.streaming.append import append_stream
from tests.conftest import rows

FACTS = [
    ("a", "p", "b", "no"), ("b", "p", "c", "no"), ("c", "p", "a", "no"), ("d", "p", "e", "no"), ("e", "p", "d", "no"), ("a", "p", "a", "no"),
    ("a", "q", "x", "2001-01-01"), ("a", "q", "x", "2002-02-02"), ("b", "q", "x", "no"), ("b", "q", "x", "no"), ("b", "r", "two words", "no"), ("é漢", "r", "b", "no"),
    ("f", "s", "g", "no"), ("x", "t", "b", "no"), ("c", "q", "y", "no"), ("g", "q", "y", "no"), ("y", "t", "a", "no"), ("b", "u", "b", "no"), ("c", "r", "d", "no"), ("d", "r", "f", "no"),
]


@pytest.fixture(scope="module")
def facts(spark):
    return spark.createDataFrame(FACTS, model.FACTS).cache()


def naive(patterns, data=FACTS):
    out = [{}]
    distinct = {f[:3] for f in data}
    for p in patterns:
        new = []
        for b, f in itertools.product(out, distinct):
            c = dict(b)
            if all((t.value == v) if isinstance(t, Const) else c.setdefault(t.name, v) == v for t, v in zip(p.terms(), f, strict=True)):
                new.append(c)
        out = new
    return out


def test_random_patterns_against_naive_evaluation(facts):
    random.seed(7)
    terms = sorted({x for f in FACTS for x in (f[0], f[2])})
    for _ in range(12):
        n = random.randint(1, 3)
        pick = lambda: Var(random.choice("vwz")) if random.random() < 0.75 else Const(random.choice(terms))
        patterns = [Pattern(pick(), Var("k") if random.random() < 0.2 else Const(random.choice("pqrt")), pick()) for _ in range(n)]
        names = sorted({v for p in patterns for v in p.variables()})
        if not names:
            continue
        got = compiler.eval_bgp(facts, patterns).select(*names)
        want = Counter(tuple(b[v] for v in names) for b in naive(patterns))
        assert Counter(tuple(r) for r in got.collect()) == want, patterns


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ("select ?o where { <a> <q> ?o }", [("x",)]),
        ("select ?x where { ?x <p> ?x }", [("a",)]),
        ("select ?x where { ?x <q> ?o }", [("a",), ("b",), ("c",), ("g",)]),
        ("select distinct ?o where { ?x <q> ?o }", [("x",), ("y",)]),
        ("select reduced ?o where { ?x <q> ?o }", [("x",), ("y",)]),
        ("select count ?o where { ?x <q> ?o }", [("x", 2), ("y", 2)]),
        ("select duplicates ?o where { ?x <q> ?o filter(?x != <g>) }", [("x",)]),
        ("select ?x where { ?x <q> ?o filter(?o = <y>) }", [("c",), ("g",)]),
        ("select ?x where { ?x <q> ?o filter(?x in <a>, <g>) }", [("a",), ("g",)]),
        ("select ?x ?z where { ?x <p> ?y . ?y <p> ?z filter(?x = ?z) }", [("a", "a"), ("d", "d"), ("e", "e")]),
        ("select ?x where { ?x <q> ?o filter(?none = <y>) }", []),
        ("select ?x where { ?x <q> <nothing> }", []),
        ("select ?x where { { ?x <s> ?y } union { ?x <t> ?y } }", [("f",), ("x",), ("y",)]),
        ("select ?x ?w where { { ?x <s> ?y } union { ?w <u> ?x } }", [("b", "b"), ("f", None)]),
        ("select ?x ?y where { ?x <s> ?z . optional { ?x <q> ?y } }", [("f", None)]),
        ("select * where { ?y <s> ?x }", [("g", "f")]),
        ("select ?x where { ?x <s> ?y . <a> <p> <b> }", [("f",)]),
        ("select ?x where { ?x <s> ?y . <a> <p> <nope> }", []),
        ("select ?x ?p where { ?x ?p <g> }", [("f", "s")]),
        ("select distinct ?x where { ?x <p> ?y filter(?x reaches <a> via <p>) }", [("a",), ("b",), ("c",)]),
        ("prefix n: <t> select ?x where { ?x <r> 'two words' ; <q> _:o }", [("b",)]),
        ("select ?x ?none where { ?x <s> ?y }", [("f", None)]),
    ],
)
def test_queries(facts, query, want):
    assert rows(compiler.run(facts, query)) == sorted(want, key=repr)


@pytest.mark.parametrize(
    "query",
    ["", "ask { ?x <p> ?y }", "select where { }", "select ?x from <g> where { ?x <p> ?y }", "select ?x where { ?x <p> ?y } limit 0", "select ?x where { ?x <p> ?y } limit x",
     "select ?x where { ?x q:z ?y }", "prefix a: <x> prefix a: <y> select ?x where { ?x <p> ?y }", "select ?x where { ?x <p> ?y } order", "select ?x where { ?x <p> ",
     "select ?x where { ?x <p> ?y filter(?x < <a>) }", "insert data { ?x <p> <y> }", "delete { ?x <p> ?y } insert { }"],
)
def test_texts_that_are_no_queries(query):
    with pytest.raises(QueryError):
        parse(query)


def test_parser_details():
    q = parse("select ?x where { ?x a <c> ; <p> 'it\\'s', \"b\" . [ <q> ?x ] filter(?x in (<a>, <b>)) } LIMIT 3 # end")
    assert q.limit == 3 and q.where.patterns[0].p == Const(RDF_TYPE) and q.where.patterns[1].o == Const("it\\'s")
    assert q.where.patterns[3].s.hidden and q.where.filters == [Filter("x", "in", (Const("a"), Const("b")))]
    assert parse("select * where { ?b <p> ?a . _:n <p> ?a }").columns == ["a", "b"]
    with pytest.raises(QueryError):
        compiler.run(None, "select ?x where { ?x ?p ?y }", strict=True)


def test_shapes_and_order():
    v = lambda s, p, o: Pattern(Var(s), Const(p), Var(o))
    assert compiler.shape([v("x", "p", "y")]) == "single"
    assert compiler.shape([v("x", "p", "y"), v("x", "q", "z")]) == "star"
    assert compiler.shape([v("x", "p", "y"), v("y", "q", "z"), v("z", "r", "w")]) == "acyclic"
    assert compiler.shape([v("x", "p", "y"), v("y", "q", "z"), v("z", "r", "x")]) == "cyclic"
    assert compiler.join_classes([v("x", "p", "y"), v("x", "q", "z"), v("w", "r", "y")]) == {"SS", "OO"}
    sizes = {"big": compiler.Size(1e6, 1e3, 1e3), "small": compiler.Size(10, 10, 10), "far": compiler.Size(5, 5, 5)}
    patterns = [v("a", "big", "b"), v("c", "far", "d"), v("a", "small", "c")]
    assert compiler.join_tree([(p, compiler.estimate(p, sizes)) for p in patterns]) == (patterns[0], (patterns[1], patterns[2]))
    # Both arms of a ring are joined on their own.
    sizes = {"oc": compiler.Size(1.5e5, 1.5e5, 1.5e4), "cn": compiler.Size(1.5e4, 1.5e4, 25), "sn": compiler.Size(1e3, 1e3, 25), "ps": compiler.Size(6e5, 2e4, 1e3), "op": compiler.Size(6e5, 1.5e5, 2e4)}
    ring = {k: v(*t) for k, t in {"oc": ("o", "oc", "c"), "cn": ("c", "cn", "n"), "sn": ("s", "sn", "n"), "ps": ("p", "ps", "s"), "op": ("o", "op", "p")}.items()}
    tree = compiler.join_tree([(p, compiler.estimate(p, sizes)) for p in ring.values()])
    assert {frozenset(_leaves(t)) for t in tree} == {frozenset({"sn", "ps"}), frozenset({"op", "oc", "cn"})}


def _leaves(tree):
    return [tree.p.value] if isinstance(tree, Pattern) else [x for t in tree for x in _leaves(t)]


#: Sizes that are claimed for few facts, so that a join is dealt out as if it were large.
CLAIMED = {"cn": compiler.Size(9e5, 9e5, 25, False), "sn": compiler.Size(6e4, 6e4, 25, False), "nr": compiler.Size(25, 25, 5, False)}
PAIRS = "select ?c ?s where {{ ?c <cn> ?n . ?s <sn> ?m . ?n <nr> ?r . ?m <nr> ?r filter(?n {} ?m) }}"


def pairs(spark):
    customers, suppliers, nations = [(f"c{i}", f"n{i % 5}") for i in range(40)] + [("c0", "n1")], [(f"s{i}", f"n{i % 4}") for i in range(12)], [(f"n{i}", f"r{i % 2}") for i in range(5)]
    data = [(s, p, o, "no") for p, found in (("cn", customers), ("sn", suppliers), ("nr", nations)) for s, o in found]
    return customers, suppliers, dict(nations), spark.createDataFrame(data, model.FACTS)


@pytest.mark.parametrize(("op", "same"), [("=", True), ("!=", False)])
def test_pairs_of_few_keys_are_dealt_out_by_their_number(spark, monkeypatch, op, same):
    monkeypatch.setattr(compiler, "FAN_TASKS", 24, raising=False)
    customers, suppliers, region, facts = pairs(spark)
    got = compiler.run(facts, PAIRS.format(op), CLAIMED)
    want = Counter((c, s) for c, n in customers for s, m in suppliers if region[n] == region[m] and (n == m) == same)
    assert Counter(tuple(r) for r in got.collect()) == want
    # By its five keys alone it had as many tasks at most, and fewer where they were put together for their small input.
    assert got.rdd.getNumPartitions() == 24


@pytest.mark.parametrize("claimed", [6e4, 9e5])
def test_pairs_meet_in_a_grid_whose_copies_many_tasks_make(spark, monkeypatch, claimed):
    monkeypatch.setattr(compiler, "FAN_TASKS", 120)
    customers, suppliers, region, facts = pairs(spark)
    got = compiler.run(facts, PAIRS.format("!="), CLAIMED | {"sn": compiler.Size(claimed, claimed, 25, False)})
    want = Counter((c, s) for c, n in customers for s, m in suppliers if region[n] == region[m] and n != m)
    assert Counter(tuple(r) for r in got.collect()) == want
    # One task made every copy of the smaller side, and held them in memory until they were dealt out.
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Repartition [2-9], true", plan)) == 2


def test_updates(facts):
    def after(text):
        return Counter(tuple(r) for r in compiler.run(facts, text).collect())

    before = Counter(FACTS)
    assert after("insert data { <a> <p> <b> . <n> <p> <m> }") == before + Counter([("n", "p", "m", "no")])
    assert after("delete data { <a> <q> <x> . <n> <p> <m> }") == Counter(f for f in FACTS if f[:3] != ("a", "q", "x"))
    assert after("delete { ?x <p> ?x }") == Counter(f for f in FACTS if f[:3] != ("a", "p", "a"))
    assert after("delete { ?x <s> ?y } insert { ?y <s> ?x }") == before - Counter([("f", "s", "g", "no")]) + Counter([("g", "s", "f", "no")])


def test_updates_by_whole_groups(spark):
    """Filters, all patterns, branches and options decide what an update removes and puts in."""
    facts = spark.createDataFrame([("a", "p", "x", "1"), ("b", "p", "y", "2"), ("c", "q", "x", "3"), ("x", "r", "z", "4")], model.FACTS)

    def after(text):
        return rows(compiler.run(facts, text))

    a, b, c, d = rows(facts)
    assert after("delete { ?s <p> ?o filter(?o = <x>) }") == [b, c, d]
    assert after("delete { ?s <p> ?o filter(?none = <x>) }") == [a, b, c, d]
    assert after("delete { ?s <p> ?o . ?s <q> ?z }") == [a, b, c, d]
    assert after("delete { ?s <p> ?o . ?o <r> ?z }") == [b, c]
    assert after("delete { ?s <p> ?o . ?t <q> ?o filter(?s != ?t) }") == [b, d]
    assert after("delete { { ?s <p> ?o filter(?o = <y>) } union { ?s <q> ?o } }") == [a, d]
    assert after("delete { ?s <p> ?o . optional { ?o <r> ?z } filter(?s = <b>) }") == [a, c, d]
    assert after("delete { ?s <p> ?o . optional { ?o <r> ?z } }") == [c]
    assert after("delete { ?s ?v <x> }") == [b, d]
    assert after("delete { ?s <p> ?o . ?o <r> ?z } insert { ?s <n> ?z . ?z <m> ?s }") == sorted([b, c, ("a", "n", "z", "1"), ("z", "m", "a", "4")])
    assert after("delete { ?s <p> ?o filter(?o in (<x>, <y>)) } insert { ?o <p> ?s . <k> <l> ?o }") == sorted(
        [c, d, ("x", "p", "a", "1"), ("y", "p", "b", "2"), ("k", "l", "x", "no"), ("k", "l", "y", "no")]
    )
    assert after("delete { { ?s <p> ?o } union { ?s <q> ?w } } insert { ?s <had> ?w }") == sorted([d, ("c", "had", "x", "no")])
    assert after("delete { ?s <p> ?o filter(?s reaches <z> via <r>) }") == [a, b, c, d]
    for text in ("delete { ?s <p> ?o } insert { ?n <p> ?o }", "delete { ?s <p> ?o } insert { ?s <p> ?o filter(?s = <a>) }", "insert data { <a> <p> <b> . optional { <a> <p> <c> } }", "delete { filter(?x = <a>) }"):
        with pytest.raises(QueryError):
            parse(text)


def test_labels_and_strictness_in_all_groups(facts):
    for text in ("select ?x where { ?x <p> _:n . { ?x <q> ?y } _:n <r> ?z }", "select ?x where { ?x <p> _:n . optional { _:n <q> ?y } }", "select ?x where { { ?x <p> _:n } union { ?x <q> _:n } }"):
        with pytest.raises(QueryError):
            parse(text)
    assert len(parse("select ?x where { ?x <p> _:n . filter(?x = <a>) . _:n <r> ?z }").where.variables()) == 3
    for text in ("select ?x where { { ?s ?p <x> } union { ?s <p> ?x } }", "select ?x where { ?x <p> ?y optional { ?x ?q ?z } }", "delete { ?x ?p ?y }"):
        with pytest.raises(QueryError):
            compiler.run(facts, text, strict=True)


def test_reaches_and_semi_joins(facts):
    assert rows(reaches(facts, "a", "p")) == [("a",), ("b",), ("c",)]
    assert rows(reaches(facts, "nowhere", "p")) == [("nowhere",)]
    chain = facts.sparkSession.createDataFrame([(f"n{i:02}", "next", f"n{i + 1:02}", "no") for i in range(11)], model.FACTS)
    assert rows(reaches(chain, "n11", "next")) == [(f"n{i:02}",) for i in range(12)]
    assert rows(within_range(chain, "o", chain.where("s in ('n03', 'n05')").select("o")).select("s")) == [("n03",), ("n04",), ("n05",)]
    assert rows(within_range(chain, "o", chain.where("false"))) == []
    left, right = (scan(facts, Pattern(Var("x"), Const(p), Var(o))) for p, o in (("q", "y"), ("p", "z")))
    for hint in ("", "shuffle_hash", "merge"):
        assert rows(semi_reduce(left, right, ["x"], hint)) == [("a", "x"), ("b", "x"), ("c", "y")]
    assert rows(semi_reduce(left, right, ["x"], both=True)[1].select("x").distinct()) == [("a",), ("b",), ("c",)]
    reduced = reduce_all([left, right, scan(facts, Pattern(Var("x"), Const("r"), Var("w")))])
    assert [rows(r.select("x").distinct()) for r in reduced] == [[("b",), ("c",)]] * 3


HYPER = [
    ("hid1", "S1", "P1", ["o1", "o2"], "2001-01-01", "null"), ("hid2", "S2", "P1", ["o1"], "2002-01-01", "2003-01-01"), ("hid3", "S1", "P2", ["o3", "o3"], "2004-01-01", "no"),
    ("hid4", "S1", "P1", [], "2005-01-01", "null"), ("hid5", "S1", "P1", None, "2005-01-01", "null"),
]


def test_hyperedge_search_equals_assembly(spark):
    hyper = spark.createDataFrame(HYPER, model.HYPER)
    facts = model.reified(hyper)
    for s, p, o in itertools.product(("", "S1"), ("", "P1"), ("", "o1")):
        direct = rows(model.hyper_rows(hyper, s, p, o))
        assert rows(compiler.run(facts, store.query_gene_hyper(s, p, o)).select("h", "x", "y", "z", "k", "m")) == direct
        assert rows(compiler.run(facts, store.query_gene_hyper(s, p, o), hyper=hyper)) == direct
    joined = "select ?h ?n where { ?h <rdfs> ?x . ?h <rdfp> ?y . ?h <rdfo> ?z . ?h <rdfst> ?k . ?h <rdfet> ?m . ?x <named> ?n }"
    more = facts.union(spark.createDataFrame([("S1", "named", "one", "no")], model.FACTS))
    assert rows(compiler.run(more, joined, hyper=hyper)) == rows(compiler.run(more, joined))
    assert len(rows(model.hyper_rows(hyper))) == 4
    assert [r.objects for r in model.assembled(facts).orderBy("hid").collect()] == [["o1", "o2"], ["o1"], ["o3"], [], []]
    assert rows(model.grouped(model.hyper_rows(hyper)).select("hid")) == [("hid1",), ("hid2",), ("hid3",)]
    with pytest.raises(QueryError):
        store.search_hyper(hyper)


def test_assembly_of_one_subject_among_decoys(spark):
    """35 hyperedges of one subject and predicate with 309 objects, 14 of them under open ends, beside two others."""
    sizes = [14, *[8] * 15, *[9] * 15, *[10] * 4]
    hyper = [(f"hid{i}", "S", "member", [f"o{i}-{k}" for k in range(n)], f"2006-10-{i % 28 + 1:02}", "null" if i == 0 else f"2010-{i % 12 + 1:02}-01") for i, n in enumerate(sizes)]
    table = spark.createDataFrame([*hyper, ("hid90", "Other", "member", ["x"], "2000-01-01", "null"), ("hid91", "S", "owner", ["x"], "2000-01-01", "null")], model.HYPER)
    want = sorted(((h, s, p, o, a, b) for h, s, p, os, a, b in hyper for o in os), key=repr)
    assert len(want) == 309 and sum(w[5] == "null" for w in want) == 14
    ask = store.query_gene_hyper("S", "member")
    for found in (compiler.run(model.reified(table), ask), compiler.run(model.reified(table), ask, hyper=table), model.hyper_rows(table, "S", "member")):
        assert rows(found.toDF("h", "x", "y", "z", "k", "m")) == want


def test_point_lookup_rules(facts):
    assert rows(store.search(facts, "a", "q", "ignored")) == [("a", "q", "x", "2001-01-01"), ("a", "q", "x", "2002-02-02")]
    assert rows(store.search(facts, "", "q", "y")) == [("c", "q", "y", "no"), ("g", "q", "y", "no")]
    for args in (("", "", "x"), ("", "q", "")):
        with pytest.raises(QueryError):
            store.search(facts, *args)
    assert store.query_gene("", "q", "y") == "select ?x where { ?x <q> <y> . }"


def test_store_life(spark, facts, tmp_path):
    db = GraphStore(spark, str(tmp_path / "db"))
    with pytest.raises(FileNotFoundError):
        db.facts()
    hyper = spark.createDataFrame(HYPER[:3], model.HYPER)
    assert db.build(facts, hyper) == 1
    plain = len(set(FACTS))
    assert db.facts().count() == plain + 4 * 3 + 4
    assert rows(db.predicates().where("p = 'q'").select("n")) == [(5,)]
    assert rows(db.search("a", "q")) == [("a", "q", "x", "2001-01-01"), ("a", "q", "x", "2002-02-02")]
    assert rows(db.search_hyper(o="o1").select("hid").distinct()) == [("hid1",), ("hid2",)]
    plan = db.sparql("select ?o where { <a> <q> ?o }")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(p" in plan and "EqualTo(s,a)" in plan
    assert rows(db.explain("select ?x where { ?x <s> ?y . ?y <q> ?z . { ?x <p> ?v } union { ?x <p> ?w . ?w <r> ?x } }")) == [
        ("cyclic", "SO", "(?x <p> ?w * ?w <r> ?x)"), ("single", "", "?x <p> ?v"), ("star", "SO", "(?x <s> ?y * ?y <q> ?z)"),
    ]
    new = spark.createDataFrame([("a", "q", "x", "2009-09-09"), ("n", "q", "x", "2009-09-09"), ("n", "q", "x", "2008-08-08"), ("", "q", "x", "no")], model.FACTS)
    assert db.append(new) == 1
    assert rows(db.search("n", "q")) == [("n", "q", "x", "2008-08-08")]
    assert db.sparql("delete { ?x <q> ?y }") == 3 and db.facts().where("p = 'q'").count() == 0
    assert [db.facts(v).where("p = 'q'").count() for v in (1, 2)] == [5, 6]  # an append is a version too
    assert {r.n for r in db.stats("total").collect()} == {db.facts().count()}
    for kind in ("s", "o", "sp", "op", "p"):
        assert sum(r.n for r in db.stats(kind).collect()) == db.facts().count()
    db.export(str(tmp_path / "out"))
    assert rows(text.read_facts(spark, str(tmp_path / "out" / "*"))) == rows(db.facts().select("s", "p", "o", "t"))


def files(path):
    return {str(f): f.stat().st_mtime_ns for f in path.rglob("*.parquet")}


def test_store_writes_touch_only_what_changes(spark, facts, tmp_path):
    db = GraphStore(spark, str(tmp_path / "db"))
    db.build(facts, spark.createDataFrame(HYPER[:3], model.HYPER))
    before = files(tmp_path)
    everything = db.facts().count()
    db.sparql("delete { ?x <t> ?y . ?y <p> ?z } insert { ?y <back> ?x }")
    assert rows(db.facts().where("p in ('t', 'back')")) == rows(spark.createDataFrame([("b", "x", "no", "back"), ("a", "y", "no", "back")], "s string, o string, t string, p string").select(*db.facts().columns))
    new = [f for f in files(tmp_path) if f not in before]
    assert before.items() <= files(tmp_path).items()
    assert {f.split("/p=")[1].split("/")[0] for f in new if "/db/facts/" in f} == {"p", "back"}  # p and t are written anew, t is empty now
    assert db.facts().where("p = 'p'").count() == 6 - 3 and db.parts() == 2
    # Variable predicates: what was found decides.
    db.sparql("delete { ?x ?v <g> }")
    assert db.facts().where("o = 'g'").count() == 0
    db.sparql("insert data { <new> <p> <n> . <a> <p> <a> }")
    assert rows(db.facts().where("s = 'new'").select("o")) == [("n",)] and db.facts().where("s = 'a' and o = 'a'").count() <= 1
    assert db.facts(1).count() == everything
    # An update of hyperedge facts changes the hyperedges, and assembly then reads the facts.
    db.sparql("delete { ?h <rdfo> 'o2' } insert { ?h <rdfo> 'o9' }")
    assert rows(db.search_hyper(s="S1").where("hid = 'hid1'").select("object")) == [("o1",), ("o9",)]
    assert rows(db.sparql(store.query_gene_hyper(o="o9")).select("h", "z")) == [("hid1", "o1"), ("hid1", "o9")]
    all_facts, hyper = rows(db.facts().select("s", "p", "o", "t")), rows(db.hyper())
    found = {r.p: (r.n, r.firsts) for r in db.predicates().collect()}
    db.compact(["p", "q"])
    assert rows(db.facts().select("s", "p", "o", "t")) == all_facts
    last = db.compact()
    assert db.parts() == 1 and len(db.vacuum()) >= 4 and db.versions() == [last]
    assert rows(db.facts().select("s", "p", "o", "t")) == all_facts and rows(db.hyper()) == hyper
    assert {r.p: (r.n, r.firsts) for r in db.predicates().collect()} == found
    assert rows(db.sparql("select ?o where { <a> <q> ?o }")) == [("x",)]


def test_store_survives_a_crash_and_refuses_a_second_writer(spark, facts, tmp_path, monkeypatch):
    db = GraphStore(spark, str(tmp_path / "db"))
    db.build(facts)
    before = rows(db.facts())
    new = spark.createDataFrame([("n", "q", "m", "no")], model.FACTS)
    with monkeypatch.context() as m:
        m.setattr(GraphStore, "_commit", lambda *_: 1 / 0)
        for write in (lambda: db.append(new), lambda: db.sparql("delete { ?x <q> ?y }"), lambda: db.compact()):
            with pytest.raises(ZeroDivisionError):
                write()
            assert db.versions() == [1] and rows(db.facts()) == before
    stale = db._manifest()
    assert db.append(new) == 1 and db.versions() == [1, 2]
    with pytest.raises(RuntimeError):
        db._commit(stale)
    assert rows(db.search("n", "q")) == [("n", "q", "m", "no")]


def test_stream_batch_runs_again(spark, facts, tmp_path):
    db = GraphStore(spark, str(tmp_path / "db"))
    db.build(facts)
    lines = spark.createDataFrame([("<a> <k> <b> .",), ("{P,S,2001-01-01,null,{T}}.",)], "value string").coalesce(1)
    for _ in range(2):
        db.append(text.facts_of(lines), text.hyper_of(lines, db.next_hid()).checkpoint(), ("stream", 0))
    assert rows(db.search_hyper(o="T").select("hid")) == [("hid1",)] and db.parts() == 2
    assert db.append(spark.createDataFrame([("u", "k", "v", None)], model.FACTS)) == 1 and rows(db.search("u", "k")) == [("u", "k", "v", "no")]
    assert db.parts() == 3
    db.append(text.facts_of(lines), None, ("stream", 1))
    assert db.append(text.facts_of(lines), None, ("stream", 1)) == 0 and db.parts() == 3


@pytest.mark.parametrize("few", [True, False])
def test_one_row_of_each_fact_is_first(facts, monkeypatch, few):
    monkeypatch.setattr(store, "_is_small", lambda _: few)
    more = facts.unionByName(facts.sparkSession.createDataFrame([("a", "q", "x", None), ("", "q", "x", "no"), ("z", "q", None, "no")], model.FACTS))
    found = rows(store.marked(more))
    assert [r[:4] for r in found] == rows(store.build_rows(more))
    assert sorted(r[:4] for r in found if r[4]) == sorted((*k, min(f[3] for f in FACTS if f[:3] == k)) for k in {f[:3] for f in FACTS})


def test_predicates_share_files_and_large_ones_are_spread(spark, tmp_path):
    many = spark.range(40_000).selectExpr("concat('s', id % 20000) as s", "'big' as p", "concat('o', id) as o", "'no' as t")
    few = spark.range(50).selectExpr("'x' as s", "concat('small', id) as p", "'y' as o", "'no' as t")
    db = GraphStore(spark, str(tmp_path / "db"))
    off = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "40"}
    old = {k: spark.conf.get(k) for k in off}
    try:
        for k, v in off.items():
            spark.conf.set(k, v)
        db.build(many.union(few))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert len(list(tmp_path.rglob("p=big/*.parquet"))) > 32
    assert db.facts().count() == 40_050


def test_text_loading_and_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text('<a> <p> "b c" <2001-01-01> .\n\n# c\n<a> <p> <d.e>\nnonsense\n{P,S.1,2001-01-01,null,{o 1,o2}}.\n{P,S}.\n<a> <p> "5"^^<xsd:int> .\n')
    assert rows(text.read_facts(spark, str(folder))) == [("a", "p", "5", "no"), ("a", "p", "b c", "2001-01-01"), ("a", "p", "d.e", "no")]
    assert rows(text.read_hyper(spark, str(folder), 7)) == [("hid7", "S.1", "P", ["o 1", "o2"], "2001-01-01", "null")]
    assert rows(text.hyper_of(text.lines_of(spark, str(folder)), cut_dots=True).select("subject", "predicate", "objects")) == [("S", "P", ["null", "o 1", "o2"])]
    db = GraphStore(spark, str(tmp_path / "db"))
    assert db.load(str(folder)) == 1 and db.facts().count() == 3 + 6 and db.next_hid() == 2
    stream = tmp_path / "stream"
    stream.mkdir()
    (stream / "b.txt").write_text("<a> <p> <d.e> <2020-01-01> .\n<z> <p> <y> .\n")
    for n in (10, 11):
        q = append_stream(spark, str(stream), db, str(tmp_path / "ckpt"))
        q.awaitTermination(120)
        assert q.exception() is None and db.facts().count() == n
        (stream / f"c{n}.txt").write_text("<z> <p> <w> .\n")
    assert rows(text.read_key_values(spark.createDataFrame([("a=p=1",), ("a=p=2=3",), ("bad",)], "value string"))) == [("a", "p", ["1", "2=3"])]


TURTLE = """@prefix x: <http://x/> . PREFIX : <e_>
@base <http://b/> .
# a comment
x:a a x:Thing ; x:p "l'it \\"q\\" \\u00e9"@en , 'one' , 4.5 , -2e3, true ;
    :q [ x:r <rel> ; x:s _:n ] , _:n .
_:n x:long \"\"\"two
"lines\"\"\"^^x:text .
[] x:p <http://c/d.e> .
[ x:p x:last.one ] .
"""


def test_turtle(spark, tmp_path):
    from quadloom.sources.turtle import read_turtle, triples_of

    a = "http://x/a"
    assert list(triples_of(TURTLE)) == [
        (a, RDF_TYPE, "http://x/Thing"), (a, "http://x/p", "l'it \"q\" é"), (a, "http://x/p", "one"), (a, "http://x/p", "4.5"), (a, "http://x/p", "-2e3"), (a, "http://x/p", "true"),
        ("_:b.1", "http://x/r", "http://b/rel"), ("_:b.1", "http://x/s", "_:b:n"), (a, "e_q", "_:b.1"), (a, "e_q", "_:b:n"), ("_:b:n", "http://x/long", 'two\n"lines'),
        ("_:b.2", "http://x/p", "http://c/d.e"), ("_:b.3", "http://x/p", "http://x/last.one"),
    ]
    for text in ("<a> <b> .", "<a> <b> <c>", "<a> <b> <c> <d> .", "<a> <b> (1 2) .", "<a> y:b <c> .", "'x' <b> ' .", "@prefix x <y> .", "<a> 'b' <c> ."):
        with pytest.raises(QueryError):
            list(triples_of(text))
    for i in range(3):
        (tmp_path / f"{i}.ttl").write_text(f"_:n <p>\n <o{i}> .\n" * 3, encoding="utf-8")
    found = rows(read_turtle(spark, str(tmp_path), batch=2))
    assert len(found) == 9 and len({r[0] for r in found}) == 3 and {r[2] for r in found} == {"o0", "o1", "o2"}
    db = GraphStore(spark, str(tmp_path / "db"))
    assert db.load_turtle(str(tmp_path / "*.ttl")) == 1 and db.facts().count() == 3


def test_temporal_mode(facts):
    assert rows(compiler.run(facts, "-t select ?x where { ?x <q> <x> filter(?x != <b>) }")) == [("a", "2001-01-01"), ("a", "2002-02-02")]
    for text in ("-t select ?x where { ?x <q> ?y . ?y <p> ?z }", "-t select ?t where { ?t <q> ?y }", "-t delete { ?x <q> ?y }", "-tselect ?x where { ?x <q> ?y }"):
        with pytest.raises(QueryError):
            parse(text)


def test_command_line(spark, tmp_path):
    from quadloom import cli

    (tmp_path / "in.txt").write_text("<a> <p> <b> .\n{P,S,2001-01-01,null,{o}}.\n")
    (tmp_path / "q").write_text("select ?x where {\n <a>\n <p> ?x . }")
    db = str(tmp_path / "db")
    assert cli.run(spark, ["build", db, str(tmp_path / "in.txt")]) == "version 1"
    assert rows(cli.run(spark, ["query", db, str(tmp_path / "q"), "--file"])) == [("b",)]
    assert cli.run(spark, ["insert", db, str(tmp_path / "in.txt")]).endswith("facts added")
    assert rows(cli.run(spark, ["search", db, "a", "p", ""])) == [("a", "p", "b", "no")]
    assert rows(cli.run(spark, ["hyper", db, "S", "", ""]).select("object").distinct()) == [("o",)]
    assert cli.run(spark, ["query", db, "delete data { <a> <p> <b> }"]) == "version 3"
    assert rows(cli.run(spark, ["predicates", db]).select("p")) == [("rdfet",), ("rdfo",), ("rdfp",), ("rdfs",), ("rdfst",)]
    assert "exported" in cli.run(spark, ["export", db, str(tmp_path / "out")])
