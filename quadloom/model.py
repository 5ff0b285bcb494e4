"""The two tables of a store: facts (s, p, o, t) and hyperedges, and how one becomes the other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FACTS = "s string, p string, o string, t string"
HYPER = "hid string, subject string, predicate string, objects array<string>, stime string, etime string"

#: Time of a fact that has none, and end of a hyperedge that is open.
NO_TIME, OPEN_END = "no", "null"

#: Predicates that a hyperedge is stored under (fixed values): predicate, subject, start, end, object.
RESERVED = ("rdfp", "rdfs", "rdfst", "rdfet", "rdfo")


def reified(hyper: DataFrame) -> DataFrame:
    """Facts of hyperedges: one per reserved predicate and hyperedge, and one rdfo per object; null parts have none."""
    single = [F.struct(F.lit(p).alias("p"), F.col(c).alias("o")) for p, c in zip(RESERVED[:4], ("predicate", "subject", "stime", "etime"), strict=True)]
    objects = F.transform(F.coalesce("objects", F.array().cast("array<string>")), lambda x: F.struct(F.lit(RESERVED[4]).alias("p"), x.alias("o")))
    rows = hyper.select(F.col("hid").alias("s"), F.explode(F.concat(F.array(*single), objects)).alias("x"))
    return rows.select("s", "x.p", "x.o", F.lit(NO_TIME).alias("t")).where(F.col("o").isNotNull() & (F.col("o") != ""))


def assembled(facts: DataFrame) -> DataFrame:
    """Hyperedges from their facts, in one aggregation by hid; those without objects have an empty array."""
    pick = {p: F.max(F.when(F.col("p") == p, F.col("o"))) for p in RESERVED[:4]}
    return (
        facts.where(F.col("p").isin(*RESERVED))
        .groupBy(F.col("s").alias("hid"))
        .agg(
            pick["rdfs"].alias("subject"),
            pick["rdfp"].alias("predicate"),
            F.sort_array(F.collect_set(F.when(F.col("p") == RESERVED[4], F.col("o")))).alias("objects"),
            pick["rdfst"].alias("stime"),
            pick["rdfet"].alias("etime"),
        )
    )


def hyper_rows(hyper: DataFrame, s: str = "", p: str = "", o: str = "") -> DataFrame:
    """(hid, subject, predicate, object, stime, etime): a row per object; hyperedges without objects have none.

    An object selects the hyperedges that hold it, with all of their objects. All parts are matched before the objects
    are expanded.
    """
    rows = hyper
    if s:
        rows = rows.where(F.col("subject") == s)
    if p:
        rows = rows.where(F.col("predicate") == p)
    if o:
        rows = rows.where(F.array_contains("objects", o))
    return rows.select("hid", "subject", "predicate", F.explode(F.array_distinct("objects")).alias("object"), "stime", "etime")


def grouped(rows: DataFrame) -> DataFrame:
    """Rows of one hyperedge collapsed into one record with its objects in order."""
    return rows.groupBy("hid", "subject", "predicate", "stime", "etime").agg(F.sort_array(F.collect_set("object")).alias("objects"))
