"""Queries to DataFrame plans: join order, joins, filters, unions, modifiers and update forms."""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping
from dataclasses import dataclass, field
from math import ceil, prod, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadloom.model import RESERVED
from quadloom.operators.graph import reaches, scan
from quadloom.plans.query import Const, Filter, Group, Pattern, Query, QueryError, Term, Var, parse


@dataclass(frozen=True)
class Size:
    """Facts of a predicate, its distinct subjects and objects, and whether an (s, p, o) may occur more than once."""

    facts: float
    subjects: float
    objects: float
    repeats: bool = True


#: Sizes by predicate, and under None that of all facts.
Sizes = Mapping[str | None, Size]
UNKNOWN = Size(1e12, 1e9, 1e9)
#: Distinct predicates where they are not known.
PREDICATES = 100.0
#: A join that is expected to give over FAN_OUT times the rows that it takes is dealt out by its result, in tasks of this many rows.
FAN_OUT = 16
#: What a writer gathers of so few rows is released before the garbage collector takes it for old.
ROWS_A_TASK = 2**22
#: Tasks of such a join at most; beyond that they get more rows.
FAN_TASKS = 4096
#: Copies that a task of such a join makes of its rows before they are dealt out.
COPIES_A_TASK = 2**20


def predicate_sizes(facts: DataFrame, patterns: list[Pattern]) -> dict[str | None, Size]:
    """Sizes of the predicates that `patterns` name, and of all facts where one has a variable; distinct terms are estimates.

    What comes to the driver is bounded by the text of the query.
    """
    figures = (F.count(F.lit(1)).alias("n"), F.approx_count_distinct("s").alias("ds"), F.approx_count_distinct("o").alias("do"))
    named = {p.p.value for p in patterns if isinstance(p.p, Const)}
    found = facts.where(F.col("p").isin(*named)).groupBy("p").agg(*figures).collect() if named else []
    sizes: dict[str | None, Size] = {r.p: Size(float(r.n), float(max(r.ds, 1)), float(max(r.do, 1))) for r in found}
    if any(isinstance(p.p, Var) for p in patterns):
        n, ds, do = facts.agg(*figures).first()
        sizes[None] = Size(float(n), float(max(ds, 1)), float(max(do, 1)))
    return sizes


def size_of(pattern: Pattern, sizes: Sizes) -> Size:
    if isinstance(pattern.p, Const):
        return sizes.get(pattern.p.value, UNKNOWN)
    if None in sizes:
        return sizes[None]
    every = list(sizes.values()) or [UNKNOWN]
    return Size(sum(x.facts for x in every), max(x.subjects for x in every), max(x.objects for x in every))


@dataclass(frozen=True)
class Estimate:
    """Expected rows of a relation and distinct values of its variables."""

    rows: float
    distinct: dict[str, float]


def estimate(pattern: Pattern, sizes: Sizes) -> Estimate:
    size = size_of(pattern, sizes)
    places = ((pattern.s, size.subjects), (pattern.p, 1.0 if isinstance(pattern.p, Const) else PREDICATES), (pattern.o, size.objects))
    rows, distinct = size.facts, {}
    for term, n in places:
        if isinstance(term, Const):
            rows /= n
        elif term.name in distinct:
            rows /= max(n, distinct[term.name])
        else:
            distinct[term.name] = n
    return Estimate(rows, {v: min(n, max(rows, 1.0)) for v, n in distinct.items()})


def _both(a: Estimate, b: Estimate) -> Estimate:
    rows, distinct = a.rows * b.rows, dict(a.distinct)
    for v, n in b.distinct.items():
        if v in distinct:
            rows /= max(n, distinct[v])
        distinct[v] = min(n, distinct.get(v, n))
    return Estimate(rows, {v: min(n, max(rows, 1.0)) for v, n in distinct.items()})


#: A leaf, or two trees to join.
Tree = Pattern | tuple


def join_tree(leaves: list[tuple[Tree, Estimate]]) -> Tree:
    """A bushy tree: always the two relations are joined next whose join is expected to be the smallest.

    So both arms of a ring are reduced on their own and meet on both of their ends, instead of one arm growing round
    it. Relations that share no variable come last, as a product.
    """
    left = list(leaves)
    while len(left) > 1:
        best = None
        for i in range(len(left)):
            for j in range(i + 1, len(left)):
                a, b = left[i][1], left[j][1]
                out = _both(a, b)
                key = (not set(a.distinct) & set(b.distinct), out.rows, a.rows + b.rows)
                if best is None or key < best[0]:
                    best = (key, i, j, out)
        _, i, j, out = best
        joined = ((left[i][0], left[j][0]), out)
        left = [x for k, x in enumerate(left) if k not in (i, j)] + [joined]
    return left[0][0]


def shape(patterns: list[Pattern]) -> str:
    """'single', 'star' (one join variable), 'acyclic' or 'cyclic'."""
    uses = Counter(v for p in patterns for v in p.variables())
    joins = [v for v, n in uses.items() if n > 1]
    if not joins:
        return "single"
    if len(joins) == 1:
        return "star"
    # Cyclic exactly if some pattern or variable closes a ring: edges between patterns and join variables.
    parent: dict[object, object] = {}

    def root(x: object) -> object:
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for i, p in enumerate(patterns):
        for v in p.variables():
            if v in joins:
                a, b = root(i), root(v)
                if a == b:
                    return "cyclic"
                parent[a] = b
    return "acyclic"


def join_classes(patterns: list[Pattern]) -> set[str]:
    """Positions that shared variables join: SS, OO, PP, SO, SP, OP."""
    at: dict[str, list[str]] = {}
    for p in patterns:
        for letter, t in zip("SPO", p.terms(), strict=True):
            if isinstance(t, Var):
                at.setdefault(t.name, []).append(letter)
    rank = "SOP"
    return {"".join(sorted((a, b), key=rank.index)) for places in at.values() for i, a in enumerate(places) for b in places[i + 1 :]}


def _joined(left: DataFrame | None, right: DataFrame, how: str = "inner") -> DataFrame:
    if left is None:
        return right
    shared = [c for c in left.columns if c in right.columns]
    return left.join(right, shared, how) if shared else left.join(right, how="cross" if how == "inner" else how)


def _fanned(many: DataFrame, few: DataFrame, tasks: int, keys: float, sizes: tuple[float, float]) -> DataFrame:
    """The join of two relations that is far larger than both, over `tasks` tasks whatever the number of its `keys`.

    By its keys alone such a join has a few tasks, as few keys make it, and adaptive execution puts those together for
    their small input. So the pairs of a key are dealt out as a grid: its rows in `many` by their hash into lines, those
    in `few` into columns, and each field meets copies of one line and one column, so every pair meets once. Where lines
    and columns are as long, copies are fewest. `sizes` are the expected rows of both.

    Exchanges of a given width are not put together. The merge takes one field after the other and buffers its column
    alone, so a task holds few rows, and the terms it gives fit a dictionary of the file.
    """
    deals = max(1, ceil(2 * tasks / keys))
    lines = min(deals, ceil(sqrt(deals * sizes[0] / max(sizes[1], 1.0))))
    columns = ceil(deals / lines)
    on = [c for c in many.columns if c in few.columns] + ["#deal"]  # no name of a variable
    line, column = F.pmod(F.xxhash64(*many.columns), F.lit(lines)).cast("int"), F.pmod(F.xxhash64(*few.columns), F.lit(columns)).cast("int")
    a = _copied(many, F.sequence(line * columns, line * columns + (columns - 1)), columns, sizes[0])
    b = _copied(few, F.sequence(column, column + (lines - 1) * columns, F.lit(columns)), lines, sizes[1])
    return a.repartition(tasks, *on).join(b.repartition(tasks, *on).hint("merge"), on).drop("#deal")


def _copied(rows: DataFrame, deals: Column, copies: int, expected: float) -> DataFrame:
    """`rows` for each of their `copies` `deals`. A task that shuffles holds what it writes in memory, so many copies are made by many tasks."""
    if copies > 1 and (width := ceil(expected * copies / COPIES_A_TASK)) > 1:
        rows = rows.repartition(min(width, FAN_TASKS))
    return rows.withColumn("#deal", F.explode(deals))


#: Columns of the hyperedge table that hold what a reserved predicate states.
_PARTS = dict(zip(RESERVED, ("predicate", "subject", "stime", "etime", "objects"), strict=True))


def _assembly(patterns: list[Pattern]) -> tuple[list[Pattern], list[Pattern]] | None:
    """Patterns that put hyperedges together (a variable for each of the five parts, and constants), and the others."""
    for name in dict.fromkeys(p.s.name for p in patterns if isinstance(p.s, Var)):
        mine = [p for p in patterns if p.s == Var(name) and isinstance(p.p, Const) and p.p.value in RESERVED]
        free = {p.p.value: p for p in reversed(mine) if isinstance(p.o, Var)}
        if len(free) == len(RESERVED) and len({name, *(p.o.name for p in free.values())}) == len(RESERVED) + 1:
            used = [*free.values(), *[p for p in mine if isinstance(p.o, Const)]]
            return used, [p for p in patterns if p not in used]
    return None


def hyper_scan(hyper: DataFrame, patterns: list[Pattern]) -> DataFrame:
    """The bindings of an assembly from the hyperedges as they are stored, a row per object, instead of a self-join of facts."""
    rows, columns = hyper, [F.col("hid").alias(patterns[0].s.name)]
    for p in patterns:
        part = F.col(_PARTS[p.p.value])
        if isinstance(p.o, Const):
            rows = rows.where(F.array_contains(part, p.o.value) if p.p.value == RESERVED[4] else part == p.o.value)
        else:
            columns.append((F.explode(F.array_distinct(part)) if p.p.value == RESERVED[4] else part).alias(p.o.name))
    names = [p.o.name for p in patterns if isinstance(p.o, Var)]
    out = rows.select(*columns)
    for n in names:  # a part that is missing is no fact
        out = out.where(F.col(n).isNotNull() & (F.col(n) != ""))
    return out


def explained(query: Query, sizes: Sizes | None = None) -> list[tuple[str, str, str]]:
    """(shape, join classes, join tree) of each group of patterns of a query."""
    names = {p: f"{_said(p.s)} {_said(p.p)} {_said(p.o)}" for p in all_patterns(query)}

    def said(tree: Tree) -> str:
        return f"({said(tree[0])} * {said(tree[1])})" if isinstance(tree, tuple) else names[tree]

    groups = [g.patterns for g in query.where.groups() if g.patterns]
    return [(shape(g), " ".join(sorted(join_classes(g))), said(join_tree([(p, estimate(p, sizes or {})) for p in g]))) for g in groups]


def _said(term: Term) -> str:
    return f"<{term.value}>" if isinstance(term, Const) else f"?{term.name}"


def eval_bgp(
    facts: DataFrame, patterns: list[Pattern], sizes: Sizes | None = None, hyper: DataFrame | None = None, filters: list[Filter] | None = None
) -> DataFrame | None:
    """Bindings of all patterns, joined on every variable they share; patterns that share none give a product.

    With `hyper`, the hyperedges that the reserved facts stand for, patterns that put hyperedges together are read from it.
    `filters`, comparisons of variables of the patterns, apply to the first join that binds their variables; above a
    later join, that binds one of them again, each of its rows would be compared.
    """
    sizes = sizes or {}
    leaves: list[tuple[Tree, Estimate]] = []
    ready: dict[Pattern, DataFrame] = {}
    if hyper is not None and (found := _assembly(patterns)):
        used, patterns = found
        ready[used[0]] = hyper_scan(hyper, used)
        parts = [p for p in used if isinstance(p.o, Var)]
        every = estimate(next(p for p in parts if p.p.value == RESERVED[4]), sizes)
        leaves.append((used[0], Estimate(every.rows, {used[0].s.name: every.distinct[used[0].s.name]} | {p.o.name: every.rows for p in parts})))
    leaves += [(p, estimate(p, sizes)) for p in patterns]
    if not leaves:
        return None

    expected = dict(leaves)

    def rows(tree: Tree, left: list[Filter]) -> tuple[DataFrame, Estimate]:
        if not isinstance(tree, tuple):
            out, size = ready[tree] if tree in ready else scan(facts, tree, size_of(tree, sizes).repeats), expected[tree]
            return _filtered(out, left), size
        bound = [_bound(t, expected) for t in tree]
        below = [[f for f in left if set(_filter_names(f)) <= b] for b in bound]
        (a, n), (b, m) = rows(tree[0], below[0]), rows(tree[1], below[1])
        out, shared = _both(n, m), set(n.distinct) & set(m.distinct)
        if not shared or out.rows <= ROWS_A_TASK or out.rows <= FAN_OUT * (n.rows + m.rows) or max(n.rows, m.rows) >= UNKNOWN.facts:
            joined = _joined(a, b)
        else:
            keys = prod(max(1.0, min(n.distinct[v], m.distinct[v])) for v in shared)
            many, few = (a, b) if n.rows >= m.rows else (b, a)
            joined = _fanned(many, few, min(ceil(out.rows / ROWS_A_TASK), FAN_TASKS), keys, (max(n.rows, m.rows), min(n.rows, m.rows)))
        return _filtered(joined, [f for f in left if f not in below[0] and f not in below[1]]), out

    return rows(join_tree(leaves), list(filters or []))[0]


def _bound(tree: Tree, leaves: Mapping[Pattern, Estimate]) -> set[str]:
    return _bound(tree[0], leaves) | _bound(tree[1], leaves) if isinstance(tree, tuple) else set(leaves[tree].distinct)


def _filtered(rows: DataFrame, filters: list[Filter]) -> DataFrame:
    for f in filters:
        rows = rows.where(_comparison(f))
    return rows


def _comparison(f: Filter) -> Column:
    col = F.col(f.var)
    if f.op == "in":
        return col.isin([a.value for a in f.args])
    other = F.col(f.args[0].name) if isinstance(f.args[0], Var) else F.lit(f.args[0].value)
    return col == other if f.op == "=" else col != other


def _filter_names(f: Filter) -> list[str]:
    return [f.var, *[a.name for a in f.args if isinstance(a, Var)]]


def apply_filter(rows: DataFrame, f: Filter, facts: DataFrame) -> DataFrame:
    """A filter on a variable that is not bound keeps nothing."""
    if any(n not in rows.columns for n in _filter_names(f)):
        return rows.where(F.lit(False))
    if f.op == "reaches":
        target, via = f.args
        return rows.join(reaches(facts, target.value, via.value).withColumnRenamed("node", f.var), f.var, "left_semi")
    return rows.where(_comparison(f))


@dataclass
class Trace:
    """Every pattern of a group with the column that is not null where the branch or option that holds it took part."""

    patterns: list[tuple[Pattern, str | None]] = field(default_factory=list)
    marks: int = 0

    def mark(self) -> str:
        self.marks += 1
        return f"_m{self.marks}"


def eval_group(
    facts: DataFrame, group: Group, sizes: Sizes | None = None, hyper: DataFrame | None = None, trace: Trace | None = None, mark: str | None = None
) -> DataFrame:
    def inner(g: Group) -> DataFrame:
        if trace is None:
            return eval_group(facts, g, sizes, hyper)
        own = trace.mark()
        return eval_group(facts, g, sizes, hyper, trace, own).withColumn(own, F.lit(True))

    if trace is not None:
        trace.patterns += [(p, mark) for p in group.patterns]
    named = {v for p in group.patterns for v in p.variables()}
    early = [f for f in group.filters if f.op != "reaches" and set(_filter_names(f)) <= named]
    out = eval_bgp(facts, group.patterns, sizes, hyper, early)
    for branches in group.unions:
        parts = [inner(b) for b in branches]
        union = parts[0]
        for p in parts[1:]:
            union = union.unionByName(p, allowMissingColumns=True)
        out = _joined(out, union)
    if out is None:
        raise QueryError("a group without patterns")
    for g in group.optionals:
        out = _joined(out, inner(g), "left")
    for f in group.filters:
        if f not in early:
            out = apply_filter(out, f, facts)
    return out


def select(facts: DataFrame, query: Query, sizes: Sizes | None = None, hyper: DataFrame | None = None) -> DataFrame:
    """The rows of a SELECT: a bag after projection, as the modifier says.

    DISTINCT and REDUCED drop repetitions, COUNT gives each distinct row with its number as `count`, DUPLICATES the
    distinct rows that occur more than once. A projected variable that no pattern binds is null.
    """
    if query.temporal:
        rows = scan(facts, query.where.patterns[0], times=True)
        for f in query.where.filters:
            rows = apply_filter(rows, f, facts)
    else:
        rows = eval_group(facts, query.where, sizes, hyper)
    rows = rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in query.columns])
    if query.modifier in ("distinct", "reduced"):
        rows = rows.distinct()
    elif query.modifier == "count":
        rows = rows.groupBy(*query.columns).agg(F.count(F.lit(1)).alias("count"))
    elif query.modifier == "duplicates":
        rows = rows.groupBy(*query.columns).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    return rows.limit(query.limit) if query.limit is not None else rows


def all_patterns(query: Query) -> list[Pattern]:
    return [p for g in query.where.groups() for p in g.patterns] + query.new


def predicates_matched(query: Query) -> set[str] | None:
    """Predicates whose facts decide what a query finds or changes; null for all of them, as where one has a variable."""
    if (named := _named(all_patterns(query))) is None:
        return None
    return named | {f.args[1].value for g in query.where.groups() for f in g.filters if f.op == "reaches"}


def predicates_read(query: Query) -> set[str] | None:
    """Predicates whose facts the result is made of; null for all of them, as in the facts after an update."""
    return predicates_matched(query) if query.kind == "select" else None


def checked(text: str, strict: bool) -> Query:
    """The query of a text. strict: predicates must be constants, in every group."""
    query = parse(text)
    if strict and any(isinstance(p.p, Var) for p in all_patterns(query)):
        raise QueryError("the predicate should be constant")
    return query


def run(
    facts: DataFrame, text: str, sizes: Sizes | None = None, strict: bool = False, hyper: DataFrame | None = None, matched: DataFrame | None = None
) -> DataFrame:
    """A SELECT gives its rows, an update form the facts after it.

    `matched`, the facts of predicates_matched alone, keeps the plan of an update small where `facts` has a large one.
    """
    query = checked(text, strict)
    if query.kind == "select":
        return select(facts, query, sizes, hyper)
    removed, added = changes(facts if matched is None else matched, query, sizes)
    due = None if query.kind in ("insert", "delete") else _row_condition(query.where)
    kept = facts if query.kind == "insert" else facts.where(~due) if due is not None else _without(facts, removed, query)
    return applied(kept.select("s", "p", "o", "t"), added, query)


def _without(facts: DataFrame, removed: DataFrame, query: Query) -> DataFrame:
    """The facts but for `removed`; facts of predicates that an update form removes nothing of pass by the join."""
    names = predicates_removed(query)
    if query.kind == "delete":
        removed = F.broadcast(removed)  # it stands in the query text
    if names is None:
        return facts.join(removed, ["s", "p", "o"], "left_anti")
    mine = F.col("p").isin(*names)
    left = facts.where(mine).join(removed, ["s", "p", "o"], "left_anti")
    return facts.where(~mine).select("s", "p", "o", "t").unionByName(left.select("s", "p", "o", "t"))


def _as_rows(facts: DataFrame, patterns: list[Pattern]) -> DataFrame:
    return facts.sparkSession.createDataFrame([(p.s.value, p.p.value, p.o.value) for p in patterns], "s string, p string, o string").distinct()


def insert_facts(facts: DataFrame, new: DataFrame) -> DataFrame:
    """`facts` and those of `new` whose (s, p, o) is not there; stored times stay, and of a new fact the least time."""
    return facts.select("s", "p", "o", "t").unionByName(fresh_facts(facts, new))


def fresh_facts(facts: DataFrame, new: DataFrame, small: bool = False) -> DataFrame:
    """Those of `new` whose (s, p, o) is not in `facts`, with their least time, 'no' if they have none; facts with an empty term are left out.

    small: `new` was counted or stands in a query text, so it is sent to the facts instead of the facts being moved to it.
    """
    there = facts.select("s", "p", "o")
    if small:
        there = there.join(F.broadcast(new.select("s", "p", "o")), ["s", "p", "o"], "left_semi")
    rows = new.where("s is not null and p is not null and o is not null and s <> '' and p <> '' and o <> ''").groupBy("s", "p", "o").agg(F.coalesce(F.min("t"), F.lit("no")).alias("t"))
    return rows.join(there, ["s", "p", "o"], "left_anti").select("s", "p", "o", "t")


def _match(pattern: Pattern) -> tuple[Column, dict[str, str]]:
    """Whether a fact matches a pattern, and the column that binds each variable."""
    due, seen = F.lit(True), {}
    for column, term in zip(("s", "p", "o"), pattern.terms(), strict=True):
        if isinstance(term, Const):
            due &= F.col(column) == term.value
        elif term.name in seen:
            due &= F.col(column) == F.col(seen[term.name])
        else:
            seen[term.name] = column
    return due, seen


def _row_condition(group: Group) -> Column | None:
    """Whether a fact is matched by a group of one pattern and comparisons; null for other groups, which need joins."""
    if len(group.patterns) != 1 or group.unions or group.optionals or any(f.op == "reaches" for f in group.filters):
        return None
    due, bound = _match(group.patterns[0])
    for f in group.filters:
        if any(n not in bound for n in _filter_names(f)):
            return F.lit(False)
        args = tuple(Var(bound[a.name]) if isinstance(a, Var) else a for a in f.args)
        due &= _comparison(Filter(bound[f.var], f.op, args))
    return F.coalesce(due, F.lit(False))


def _term(term: Term, bound: Mapping[str, str] | None = None) -> Column:
    if isinstance(term, Const):
        return F.lit(term.value)
    return F.col(term.name if bound is None else bound[term.name])


def changes(facts: DataFrame, query: Query, sizes: Sizes | None = None) -> tuple[DataFrame, DataFrame]:
    """(s, p, o) that an update form removes and (s, p, o, t) that it adds, from the facts before it.

    The whole group decides: its filters, unions, options and all patterns. Every fact that a pattern of the group
    matched in some solution is removed; patterns of a branch or option only where that took part. Each solution puts in
    the new patterns; the n-th takes the times of the facts that the n-th pattern of the group matched, all others
    have none. Facts with a null or empty term are never put in.
    """
    none = facts.sparkSession.createDataFrame([], "s string, p string, o string, t string")
    if query.kind in ("insert", "delete"):
        rows = _as_rows(facts, query.where.patterns)
        return (none.drop("t"), rows.withColumn("t", F.lit("no"))) if query.kind == "insert" else (rows, none)
    if (due := _row_condition(query.where)) is not None:
        _, bound = _match(query.where.patterns[0])
        rows = facts.where(due)
        made = [rows.select(*[_term(t, bound).alias(c) for c, t in zip("spo", p.terms(), strict=True)], (F.lit("no") if i else F.col("t")).alias("t")) for i, p in enumerate(query.new)]
        return rows.select("s", "p", "o").distinct(), _union(made, none)
    trace = Trace()
    solutions = eval_group(facts, query.where, sizes, None, trace)
    gone = []
    for p, mark in trace.patterns:
        rows = solutions if mark is None else solutions.where(F.col(mark))
        gone.append(rows.select(*[_term(t).alias(c) for c, t in zip("spo", p.terms(), strict=True)]).where("s is not null and p is not null and o is not null"))
    made = []
    for i, p in enumerate(query.new):
        rows = solutions
        terms = [_term(t).alias(f"_{c}") for c, t in zip("spo", p.terms(), strict=True)]
        if i < len(trace.patterns):
            old, mark = trace.patterns[i]
            there = [(_term(t) if mark is None else F.when(F.col(mark), _term(t))).alias(c) for c, t in zip("spo", old.terms(), strict=True)]
            rows = rows.select(*terms, *there).distinct().join(facts.select("s", "p", "o", "t"), ["s", "p", "o"], "left").withColumn("t", F.coalesce("t", F.lit("no")))
        else:
            rows = rows.select(*terms).distinct().withColumn("t", F.lit("no"))
        made.append(rows.select(*[F.col(f"_{c}").alias(c) for c in "spo"], "t"))
    return _union(gone, none.drop("t")).distinct(), _union(made, none)


def _union(parts: list[DataFrame], empty: DataFrame) -> DataFrame:
    out = empty if not parts else parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def applied(kept: DataFrame, added: DataFrame, query: Query) -> DataFrame:
    """`kept`, what an update form leaves, and those facts it adds that are not there; looked for under their predicates only."""
    if query.kind in ("delete", "delete_where"):
        return kept
    into = predicates_added(query)
    rest = kept if into is None else kept.where(F.col("p").isin(*into))
    return kept.unionByName(fresh_facts(rest, added, small=query.kind == "insert"))


def _named(patterns: list[Pattern]) -> set[str] | None:
    return None if any(isinstance(p.p, Var) for p in patterns) else {p.p.value for p in patterns}


def predicates_added(query: Query) -> set[str] | None:
    """Predicates that an update form adds facts to; null where a variable stands for one."""
    return _named(query.where.patterns if query.kind == "insert" else query.new)


def predicates_removed(query: Query) -> set[str] | None:
    """Predicates that an update form can remove facts of; null where a variable stands for one."""
    return set() if query.kind == "insert" else _named([p for g in query.where.groups() for p in g.patterns])
