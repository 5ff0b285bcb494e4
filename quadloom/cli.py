"""Command line of a store: python -m quadloom.cli build|insert|query|search|hyper|export|predicates|compact|explain ..."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession

from quadloom.plans.query import QueryError
from quadloom.store import GraphStore, delimited


def query_file(spark: SparkSession, path: str) -> str:
    """The text of a query file on any file system that Spark reads, as one line; of any length."""
    found = spark.read.text(path, wholetext=True).first()
    return " ".join(found.value.splitlines()) if found else ""


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quadloom")
    sub = p.add_subparsers(dest="command", required=True)
    for name, *args in (
        ("build", "db", "files"), ("insert", "db", "files"), ("query", "db", "text"), ("search", "db", "head", "rel", "tail"),
        ("hyper", "db", "subject", "predicate", "object"), ("export", "db", "out"), ("predicates", "db"), ("compact", "db"), ("explain", "db", "text"),
    ):
        s = sub.add_parser(name)
        for a in args:
            s.add_argument(a)
        if name == "query":
            s.add_argument("--file", action="store_true", help="text names a file")
            s.add_argument("--strict", action="store_true", help="predicates must be constants")
    return p


def run(spark: SparkSession, argv: list[str]) -> DataFrame | str:
    a = _parser().parse_args(argv)
    db = GraphStore(spark, a.db)
    if a.command == "build":
        return f"version {db.load(a.files)}"
    if a.command == "insert":
        return f"{db.append(a.files)} facts added"
    if a.command == "query":
        out = db.sparql(query_file(spark, a.text) if a.file else a.text, a.strict)
        return out if isinstance(out, DataFrame) else f"version {out}"
    if a.command == "search":
        return db.search(a.head, a.rel, a.tail)
    if a.command == "hyper":
        return db.search_hyper(a.subject, a.predicate, a.object)
    if a.command == "export":
        db.export(a.out)
        return f"exported to {a.out}"
    if a.command == "explain":
        return db.explain(a.text)
    if a.command == "compact":
        return f"version {db.compact()}"
    return db.predicates()


def main() -> int:
    spark = SparkSession.builder.appName("quadloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        out = run(spark, sys.argv[1:])
    except (QueryError, FileNotFoundError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    if isinstance(out, str):
        print(out)
    else:
        for row in delimited(out).toLocalIterator():  # partition by partition, as output of any size is printed
            print(row.line)
    return 0


if __name__ == "__main__":
    sys.exit(main())
