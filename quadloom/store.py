"""A store of facts and hyperedges in a directory of immutable parts and small version files, and the calls on it.

    <path>/facts/part=<name>/p=.../*.parquet   sorted by p, s, o; a file holds a range of them
    <path>/hyper/part=<name>/*.parquet
    <path>/stats/part=<name>/*.parquet         facts and sketches of the terms per predicate
    <path>/versions/000001.json                which parts make up a version

Every write puts down a new part and then a version file, by a rename that is the commit: what breaks off before leaves
the version before as it was. An append adds a part of new facts. An update rewrites the predicates that it removes
facts of into a part and names them as no longer valid in the older parts. compact() joins parts. Writers must take
turns; of two that commit the same version the later one is refused.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.model import FACTS, HYPER, RESERVED, assembled, hyper_rows, reified
from quadloom.plans import compiler
from quadloom.plans.query import Const, Query, QueryError
from quadloom.session import BROADCAST_ROWS, broadcast_if_small, cut_lineage
from quadloom.sources.text import export_lines, facts_of, hyper_of, lines_of
from quadloom.sources.turtle import read_turtle

#: Facts as they are stored: `first` marks one row of each (s, p, o), so that patterns need no distinct.
STORED = f"{FACTS}, first boolean"
#: Predicates that are listed on the driver so that only their files are read or rewritten; beyond, all are.
LISTED = 10_000

STATS = {"s": ("s",), "o": ("o",), "sp": ("s", "p"), "op": ("o", "p"), "p": ("p",)}


def _whole(facts: DataFrame) -> DataFrame:
    """(s, p, o, t) of the facts without empty terms; no time is 'no'."""
    rows = facts.select("s", "p", "o", F.coalesce("t", F.lit("no")).alias("t"))
    return rows.where("s is not null and p is not null and o is not null and s <> '' and p <> '' and o <> ''")


def build_rows(facts: DataFrame) -> DataFrame:
    """Distinct (s, p, o, t) without empty terms."""
    return _whole(facts).dropDuplicates()


def marked(facts: DataFrame) -> DataFrame:
    """Distinct (s, p, o, t) without empty terms, with `first`, true in the row of least t of each (s, p, o).

    Facts of several times are found first. Where they are few, as is usual, they are sent to the others, which are
    shuffled for nothing but their distinction; else the rows of least time are merged into them. All steps combine
    before they shuffle, so that a fact with a third of all rows is no burden.
    """
    rows = _whole(facts)
    several = rows.groupBy("s", "p", "o").agg(F.min("t").alias("_least"), F.max("t").alias("_last")).where("_least <> _last").drop("_last")
    several = cut_lineage(several)
    if _is_small(several):
        found = rows.dropDuplicates().join(F.broadcast(several), ["s", "p", "o"], "left")
        return found.select("s", "p", "o", "t", F.coalesce(F.col("t") == F.col("_least"), F.lit(True)).alias("first"))
    least = rows.groupBy("s", "p", "o").agg(F.min("t").alias("t")).withColumn("first", F.lit(True))
    return rows.withColumn("first", F.lit(False)).unionByName(least).groupBy("s", "p", "o", "t").agg(F.max("first").alias("first"))


def stats(facts: DataFrame, kind: str) -> DataFrame:
    """(k1, k2, n BIGINT): facts per s, o, (s, p), (o, p) or p; 'total' all of them, 'distinct' the number of terms."""
    none = F.lit(None).cast("string")
    if kind == "total":
        return facts.agg(F.count(F.lit(1)).alias("n")).select(none.alias("k1"), none.alias("k2"), "n")
    if kind == "distinct":
        terms = facts.select(F.explode(F.array("s", "o")).alias("x")).distinct()
        return terms.agg(F.count(F.lit(1)).alias("n")).select(none.alias("k1"), none.alias("k2"), "n")
    keys = STATS[kind]
    counted = facts.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col(keys[0]).alias("k1"), (F.col(keys[1]) if len(keys) > 1 else none).alias("k2"), "n")


def search(facts: DataFrame, head: str = "", rel: str = "", tail: str = "") -> DataFrame:
    """(s, p, o, t): the facts of a relation for a head, or else for a tail; one row per time.

    A relation is required; if a head is given the tail is ignored; neither is an error.
    """
    if not rel or not (head or tail):
        raise QueryError("a relation and a head or a tail are needed")
    rows = facts.where(F.col("p") == rel)
    return (rows.where(F.col("s") == head) if head else rows.where(F.col("o") == tail)).select("s", "p", "o", "t").distinct()


def search_hyper(hyper: DataFrame, s: str = "", p: str = "", o: str = "") -> DataFrame:
    if not (s or p or o):
        raise QueryError("a subject, a predicate or an object is needed")
    return hyper_rows(hyper, s, p, o)


def subjects_between(facts: DataFrame, low: str, high: str) -> DataFrame:
    return facts.where(F.col("s").between(low, high)).select("s").distinct()


def predicates_of(facts: DataFrame, term: str) -> DataFrame:
    return facts.where(F.col("s") == term).select("p").distinct()


def query_gene(head: str = "", rel: str = "", tail: str = "") -> str:
    """The text of a query of one pattern; empty parts are the variables x, y, z."""
    terms = [f"<{v}>" if v else f"?{n}" for v, n in ((head, "x"), (rel, "y"), (tail, "z"))]
    columns = [t for t in terms if t[0] == "?"]
    return f"select {' '.join(columns) or '*'} where {{ {' '.join(terms)} . }}"


def query_gene_hyper(s: str = "", p: str = "", o: str = "") -> str:
    """The text of the assembly of hyperedges, with the given parts as further patterns."""
    parts = [("rdfs", "x", s), ("rdfp", "y", p), ("rdfo", "z", o), ("rdfst", "k", ""), ("rdfet", "m", "")]
    patterns = [f"?h <{r}> ?{v} ." for r, v, _ in parts] + [f"?h <{r}> <{c}> ." for r, _, c in parts if c]
    return f"select ?h ?x ?y ?z ?k ?m where {{ {' '.join(patterns)} }}"


def delimited(rows: DataFrame, mark: str = "-?-") -> DataFrame:
    """(line): the columns of each row joined by a mark."""
    return rows.select(F.concat_ws(mark, *[F.col(f"`{c}`").cast("string") for c in rows.columns]).alias("line"))


def _is_small(rows: DataFrame) -> bool:
    """Whether checkpointed rows are few enough to be sent to the stored facts instead of those being moved to them."""
    return rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


class GraphStore:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    # --- versions ---
    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _names(self, folder: str) -> list[str]:
        fs, path = self._fs()
        place = path(f"{self.path}/{folder}")
        return sorted(x.getPath().getName() for x in fs.listStatus(place)) if fs.exists(place) else []

    def versions(self) -> list[int]:
        """Versions that were committed."""
        return [int(n[:-5]) for n in self._names("versions") if n.endswith(".json") and n[:-5].isdigit()]

    def _manifest(self, version: int | None = None) -> dict:
        if version is None:
            known = self.versions()
            if not known:
                raise FileNotFoundError(f"no store at {self.path}")
            version = known[-1]
        fs, path = self._fs()
        stream = fs.open(path(f"{self.path}/versions/{version:06d}.json"))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, manifest: dict) -> int:
        """Make `manifest` the version after the one it was made from."""
        version = manifest["version"] + 1
        fs, path = self._fs()
        target, draft = path(f"{self.path}/versions/{version:06d}.json"), path(f"{self.path}/drafts/{uuid.uuid4().hex}")
        fs.mkdirs(target.getParent())
        out = fs.create(draft, False)
        out.writeBytes(json.dumps(manifest | {"version": version}))
        out.close()
        if fs.exists(target) or not fs.rename(draft, target):
            fs.delete(draft, False)
            raise RuntimeError(f"version {version} was committed by another writer")
        return version

    # --- parts ---
    def _write_part(self, facts: DataFrame, hyper: DataFrame | None = None) -> str:
        """Write stored facts (with `first`), hyperedges and statistics as a new part; its name.

        Facts are dealt out by ranges of (p, s, o), so that a predicate with most facts is written by many tasks, one
        with few shares a task with others, and each file holds a narrow range of subjects.
        """
        name = uuid.uuid4().hex
        to = f"part={name}"
        order = ["p", "s", "o", "t"]
        facts.select("s", "o", "t", "first", "p").repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy("p").parquet(f"{self.path}/facts/{to}")
        if hyper is not None:
            hyper.select("hid", "subject", "predicate", "objects", "stime", "etime").write.parquet(f"{self.path}/hyper/{to}")
        sketches = [F.hll_sketch_agg(c).alias(n) for c, n in (("s", "subjects"), ("o", "objects"))]
        stored = self._part("facts", STORED, [name])
        stored.groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.count_if("first").alias("firsts"), *sketches).write.parquet(f"{self.path}/stats/{to}")
        return name

    def _part(self, what: str, schema: str, names: list[str]) -> DataFrame:
        """Rows of some parts with the column `part`."""
        if not names:
            return self.spark.createDataFrame([], f"{schema}, part string")
        paths = [f"{self.path}/{what}/part={n}" for n in names]
        return self.spark.read.schema(f"{schema}, part string").option("basePath", f"{self.path}/{what}").parquet(*paths)

    def _read(self, manifest: dict, what: str, schema: str) -> DataFrame:
        """Rows of all parts of a version, each without the predicates that a later part holds anew."""
        rows = self._part(what, schema, [x["name"] for x in manifest["parts"]])
        for x in manifest["parts"]:
            if x["without"]:
                rows = rows.where(~((F.col("part") == x["name"]) & F.col("p").isin(*x["without"])))
        return rows.drop("part")

    def parts(self) -> int:
        return len(self._manifest()["parts"])

    def _stored(self, manifest: dict | None = None) -> DataFrame:
        return self._read(manifest or self._manifest(), "facts", STORED)

    def facts(self, version: int | None = None) -> DataFrame:
        return self._stored(self._manifest(version)).drop("first")

    def hyper(self, version: int | None = None) -> DataFrame:
        return self._part("hyper", HYPER, self._manifest(version)["hyper"]).drop("part")

    def predicates(self, version: int | None = None) -> DataFrame:
        """(p, n, firsts, subjects, objects): the predicates, their facts with and without times, and estimates of their distinct terms."""
        rows = self._read(self._manifest(version), "stats", "p string, n bigint, firsts bigint, subjects binary, objects binary")
        terms = [F.hll_sketch_estimate(F.hll_union_agg(c)).alias(c) for c in ("subjects", "objects")]
        return rows.groupBy("p").agg(F.sum("n").alias("n"), F.sum("firsts").alias("firsts"), *terms)

    def sizes(self, query: Query) -> dict[str | None, compiler.Size]:
        """Sizes of the predicates that a query names, and of all facts if it has a variable predicate, from the statistics."""
        patterns = compiler.all_patterns(query)
        named = {p.p.value for p in patterns if isinstance(p.p, Const)}
        size = lambda r: compiler.Size(float(r.firsts), float(max(r.subjects, 1)), float(max(r.objects, 1)), False)
        rows = self.predicates()
        out: dict[str | None, compiler.Size] = {n: compiler.Size(0.0, 1.0, 1.0, False) for n in named}
        out |= {r.p: size(r) for r in rows.where(F.col("p").isin(*named)).collect()} if named else {}
        if len(named) < len({p.p for p in patterns}):
            total = rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("firsts", "subjects", "objects")]).first()
            out[None] = size(total)
        return out

    # --- writing ---
    def _listed(self, *rows: DataFrame) -> list[str] | None:
        """The predicates of rows, null if there are more than LISTED."""
        names: set[str] = set()
        for r in rows:
            names |= {x.p for x in r.select("p").distinct().limit(LISTED + 1).collect()}
        return sorted(names) if len(names) <= LISTED else None

    def build(self, facts: DataFrame, hyper: DataFrame | None = None) -> int:
        """A new version of these facts and hyperedges alone; hyperedges are stored as facts too."""
        versions = self.versions()
        rows = facts.select("s", "p", "o", "t")
        rows = rows if hyper is None else rows.unionByName(reified(hyper))
        part = self._write_part(marked(rows), hyper)
        hypers = [] if hyper is None else [part]
        batches = self._manifest()["batches"] if versions else {}
        base = {"version": versions[-1] if versions else 0, "parts": [{"name": part, "without": []}], "hyper": hypers, "exact": True, "batches": batches}
        return self._commit(base | {"next_hid": self._after(1, hypers)})

    def _after(self, hid: int, parts: list[str]) -> int:
        """The least number from `hid` on that is beyond the hids of some parts."""
        for p in parts:
            rows = self._part("hyper", HYPER, [p])
            hid = max(hid, (rows.agg(F.max(F.regexp_extract("hid", r"^hid(\d+)$", 1).try_cast("bigint"))).first()[0] or 0) + 1)
        return hid

    def load(self, path: str, cut_dots: bool = False) -> int:
        """Build from text files of both kinds of lines."""
        lines = lines_of(self.spark, path)
        return self.build(facts_of(lines), cut_lineage(hyper_of(lines, cut_dots=cut_dots)))

    def load_turtle(self, path: str) -> int:
        """Build from Turtle files."""
        return self.build(read_turtle(self.spark, path))

    def next_hid(self) -> int:
        return self._manifest()["next_hid"]

    def append(self, source: str | DataFrame, hyper: DataFrame | None = None, batch: tuple[str, int] | None = None) -> int:
        """Add facts (a path of text files, or rows) that are not there yet, as a new version; the number of facts added.

        Stored facts are looked at under the predicates of the new ones only. A `batch` (of a stream, number) that the
        store holds already is passed over, hyperedges included.
        """
        m = self._manifest()
        if batch and m["batches"].get(batch[0], -1) >= batch[1]:
            return 0
        if isinstance(source, str):
            lines = lines_of(self.spark, source)
            source, hyper = facts_of(lines), cut_lineage(hyper_of(lines, m["next_hid"]))
        new = source.select("s", "p", "o", "t")
        new = cut_lineage(new if hyper is None else new.unionByName(reified(hyper)))
        names = self._listed(new)
        stored = self._stored(m).where("first")
        stored = stored if names is None else stored.where(F.col("p").isin(*names))
        fresh = cut_lineage(compiler.fresh_facts(stored, new, small=_is_small(new)))
        n = fresh.count()
        if n or hyper is not None:
            part = self._write_part(fresh.withColumn("first", F.lit(True)), hyper)
            m["parts"].append({"name": part, "without": []})
            if hyper is not None:
                m["hyper"].append(part)
                m["next_hid"] = self._after(m["next_hid"], [part])
        if batch:
            m["batches"][batch[0]] = batch[1]
        if n or hyper is not None or batch:
            self._commit(m)
        return n

    def _replace(self, m: dict, names: list[str] | None, facts: DataFrame, hyper: DataFrame | None = None) -> str:
        """A part in `m` with `facts`, which stand for all facts of `names` (of every predicate if null) in the parts before."""
        part = self._write_part(facts, hyper)
        old = [] if names is None else [x | {"without": sorted({*x["without"], *names})} for x in m["parts"]]
        m["parts"] = [*old, {"name": part, "without": []}]
        return part

    def update(self, query: Query) -> int:
        """Commit an update form as a new version; files of predicates that it removes nothing of stay as they are."""
        m = self._manifest()
        stored = self._stored(m)
        removed, added = map(cut_lineage, compiler.changes(stored.where("first"), query, self.sizes(query)))
        names = compiler.predicates_removed(query)
        names = self._listed(removed) if names is None else sorted(names)
        into = self._listed(added)
        of = lambda rows, some: rows if some is None else rows.where(F.col("p").isin(*some))
        gone = broadcast_if_small(removed)  # so that what stays is not moved for a few facts that go
        left = lambda rows: rows.join(gone, ["s", "p", "o"], "left_anti").select("s", "p", "o", "t", "first")
        new = cut_lineage(compiler.fresh_facts(left(of(stored.where("first"), into)), added, small=_is_small(added)).withColumn("first", F.lit(True)))
        hyper = None
        changed = None if names is None or into is None else {*names, *into}
        if changed is None or changed & set(RESERVED):
            m["exact"] = False
            hyper = cut_lineage(assembled(left(of(stored, RESERVED)).unionByName(new)))
        if names == []:
            part = self._write_part(new, hyper)
            m["parts"].append({"name": part, "without": []})
        else:
            part = self._replace(m, names, left(of(stored, names)).unionByName(new), hyper)
        if hyper is not None:
            m["hyper"] = [part]
        return self._commit(m)

    def compact(self, predicates: list[str] | None = None) -> int:
        """A new version with the facts of all parts, or of some predicates, in one part, sorted as a whole."""
        m = self._manifest()
        rows = self._stored(m)
        part = self._replace(m, predicates, rows if predicates is None else rows.where(F.col("p").isin(*predicates)), self.hyper() if predicates is None else None)
        if predicates is None:
            m["hyper"] = [part]
        return self._commit(m)

    def vacuum(self, keep: int = 1) -> list[str]:
        """Delete all but the last `keep` versions, and the parts that none of those holds; the names of those parts.

        Not while a writer is at work: its part has no version yet.
        """
        versions = self.versions()
        live = {x for v in versions[-keep:] for m in [self._manifest(v)] for x in [*[p["name"] for p in m["parts"]], *m["hyper"]]}
        fs, path = self._fs()
        for v in versions[:-keep]:
            fs.delete(path(f"{self.path}/versions/{v:06d}.json"), False)
        there = {n.removeprefix("part=") for what in ("facts", "hyper", "stats") for n in self._names(what)}
        for n in there - live:
            for what in ("facts", "hyper", "stats"):
                fs.delete(path(f"{self.path}/{what}/part={n}"), True)
        return sorted(there - live)

    # --- reading ---
    def export(self, path: str) -> None:
        """Text lines of all facts: reserved predicates under hyperedge, all others under tripleedge."""
        for name, reserved in (("hyperedge", True), ("tripleedge", False)):
            export_lines(self.facts(), reserved).write.mode("overwrite").text(f"{path}/{name}")

    def sparql(self, text: str, strict: bool = False) -> DataFrame | int:
        """Rows of a SELECT; an update form commits a new version and gives its number.

        Patterns read one row of each (s, p, o), so they need no distinct. Patterns that put hyperedges together are
        answered from the hyperedges as long as no update form changed their facts.
        """
        query = compiler.checked(text, strict)
        if query.kind != "select":
            return self.update(query)
        m = self._manifest()
        facts = self._stored(m).where(F.lit(query.temporal) | F.col("first")).select("s", "p", "o", "t")
        return compiler.select(facts, query, self.sizes(query), self.hyper() if m["exact"] and m["hyper"] else None)

    def explain(self, text: str) -> DataFrame:
        """(shape, joins, tree): how the patterns of each group of a query are joined, by the statistics of the store."""
        query = compiler.checked(text, False)
        return self.spark.createDataFrame(compiler.explained(query, self.sizes(query)), "shape string, joins string, tree string")

    def search(self, head: str = "", rel: str = "", tail: str = "") -> DataFrame:
        return search(self.facts(), head, rel, tail)

    def search_hyper(self, s: str = "", p: str = "", o: str = "") -> DataFrame:
        return search_hyper(self.hyper(), s, p, o)

    def stats(self, kind: str) -> DataFrame:
        return stats(self.facts(), kind)
