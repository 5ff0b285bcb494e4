"""Scans of single patterns, semi-joins of bindings, and reachability."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.plans.query import Const, Pattern, Var
from quadloom.session import cut_lineage


def scan(facts: DataFrame, pattern: Pattern, repeats: bool = True, times: bool = False) -> DataFrame:
    """The bindings of one pattern over the distinct (s, p, o) of `facts`, columns named after its variables.

    Constants become filters that reach the Parquet scan, and p prunes partitions. A variable that occurs twice must
    bind equal terms. Time is not part of the match. A pattern without variables has one row without columns if the
    fact exists. Where each (s, p, o) is known to occur once (`repeats` false), the bindings need no shuffle, as the
    variables and constants of a pattern name the fact. With `times` the distinct (s, p, o, t) are matched, and t is a column.
    """
    rows = facts
    places: dict[str, list[str]] = {}
    for column, term in zip(("s", "p", "o"), pattern.terms(), strict=True):
        if isinstance(term, Const):
            rows = rows.where(F.col(column) == term.value)
        else:
            places.setdefault(term.name, []).append(column)
    for columns in places.values():
        for other in columns[1:]:
            rows = rows.where(F.col(columns[0]) == F.col(other))
    if times:
        return rows.select(*[F.col(columns[0]).alias(name) for name, columns in places.items()], "t").distinct()
    if not places:
        return rows.select(F.lit(1).alias("_there")).limit(1).select()
    found = rows.select(*[F.col(columns[0]).alias(name) for name, columns in places.items()])
    return found.distinct() if repeats else found


def semi_reduce(left: DataFrame, right: DataFrame, on: list[str], hint: str = "", both: bool = False) -> DataFrame | tuple[DataFrame, DataFrame]:
    """Rows of `left` with a partner in `right`; with `both` the reduced right side too. `hint`: shuffle_hash or merge."""
    keys = right.select(*on)
    kept = left.join(keys.hint(hint) if hint else keys, on, "left_semi")
    if not both:
        return kept
    keys = left.select(*on)
    return kept, right.join(keys.hint(hint) if hint else keys, on, "left_semi")


def reduce_all(bindings: list[DataFrame]) -> list[DataFrame]:
    """Reduce each relation by those before it, then by those after it, on the variables that they share."""
    out = list(bindings)
    order = [(i, j) for i in range(len(out)) for j in range(i)] + [(i, j) for i in reversed(range(len(out))) for j in range(i + 1, len(out))]
    for i, j in order:
        shared = [c for c in out[i].columns if c in out[j].columns]
        if shared:
            out[i] = semi_reduce(out[i], out[j], shared)
    return out


def merged(parts: list[DataFrame]) -> DataFrame:
    """Set union of relations with the same columns."""
    return reduce(DataFrame.unionByName, parts).distinct()


def within_range(rows: DataFrame, column: str, binding: DataFrame) -> DataFrame:
    """Rows whose `column` lies between its least and greatest value in `binding`: a range that reaches the scan of `rows`
    and skips the files and row groups outside it. No row with a partner in `binding` is lost. Two values come to the driver.
    """
    low, high = binding.agg(F.min(column), F.max(column)).first()
    return rows.where(F.lit(False)) if low is None else rows.where(F.col(column).between(low, high))


def reaches(facts: DataFrame, target: str, via: str) -> DataFrame:
    """(node): every term with a path of `via` facts to `target`, and `target` itself. Cycles are allowed.

    A breadth-first loop against the direction of the edges. Each round joins the newest nodes with the edges and drops
    those seen before; its result is cut from its lineage in the shared checkpoint folder, so plans stay small and a
    lost executor costs no earlier round. Nodes seen are kept in parts of doubling numbers of rounds, so that over a
    path of n steps each node is written some log n times. Only whether there were new nodes comes to the driver.
    """
    edges = cut_lineage(facts.where(F.col("p") == via).select(F.col("s").alias("node"), F.col("o").alias("next")).distinct())
    frontier = facts.sparkSession.createDataFrame([(target,)], "node string")
    seen: list[tuple[int, DataFrame]] = [(1, frontier)]  # rounds, nodes
    while True:
        found = edges.join(frontier.withColumnRenamed("node", "next"), "next").select("node").distinct()
        for _, nodes in seen:
            found = found.join(nodes, "node", "left_anti")
        frontier = cut_lineage(found)
        if frontier.isEmpty():
            return reduce(DataFrame.unionByName, [nodes for _, nodes in seen])
        seen.append((1, frontier))
        while len(seen) > 1 and seen[-1][0] == seen[-2][0]:
            (n, a), (m, b) = seen.pop(), seen.pop()
            seen.append((n + m, cut_lineage(a.unionByName(b))))


__all__ = ["Pattern", "Var", "merged", "reaches", "reduce_all", "scan", "semi_reduce", "within_range"]
