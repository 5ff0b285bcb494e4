"""Facts of Turtle files: prefixes, lists with ; and , , blank nodes, literals with language or type, numbers, booleans.

A file is one piece of work, as its prefixes hold to its end; give large data as many files.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.model import NO_TIME
from quadloom.plans.query import RDF_TYPE, QueryError

_TOKEN = re.compile(
    r"""(?P<blank>\s+|\#[^\n]*)
      |(?P<iri><[^>]*>)
      |(?P<string>\"{3}(?:[^"\\]|\\.|"(?!""))*\"{3}|'{3}(?:[^'\\]|\\.|'(?!''))*'{3}|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
      |(?P<directive>@prefix\b|@base\b)
      |(?P<tag>@[A-Za-z]+(?:-[A-Za-z0-9]+)*|\^\^)
      |(?P<node>_:[\w.-]*\w)
      |(?P<number>[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?(?<!\.))
      |(?P<name>(?:[^\W\d_](?:[\w.-]*[\w-])?)?:(?:[\w:%-](?:[\w:.%-]*[\w:%-])?)?)
      |(?P<word>[A-Za-z]+)
      |(?P<sign>[\[\](){}.;,])""",
    re.VERBOSE | re.DOTALL,
)
_ESCAPES = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f"}


def _unescaped(text: str) -> str:
    def one(m: re.Match) -> str:
        return chr(int(m[1][1:], 16)) if m[1][0] in "uU" else _ESCAPES.get(m[1], m[1])

    return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", one, text, flags=re.DOTALL) if "\\" in text else text


class _Reader:
    """The triples of one text; `scope` keeps its blank nodes apart from those of other texts."""

    def __init__(self, text: str, scope: str) -> None:
        self.text, self.at, self.scope, self.fresh = text, 0, scope, 0
        self.prefixes: dict[str, str] = {}
        self.base = ""
        self.out: list[tuple[str, str, str]] = []
        self.kind, self.value = "", ""
        self.step()

    def step(self) -> tuple[str, str]:
        """Go on to the next token; the one before."""
        before = self.kind, self.value
        while True:
            if self.at >= len(self.text):
                self.kind, self.value = "end", ""
                return before
            m = _TOKEN.match(self.text, self.at)
            if not m:
                raise QueryError(f"unexpected character {self.text[self.at]!r} at {self.at}")
            self.at = m.end()
            if m.lastgroup != "blank":
                self.kind, self.value = m.lastgroup, m.group()
                return before

    def sign(self, sign: str) -> None:
        if (self.kind, self.value) != ("sign", sign):
            raise QueryError(f"{sign!r} expected, found {self.value!r} before {self.at}")
        self.step()

    def triples(self) -> Iterator[tuple[str, str, str]]:
        """All triples, handed out statement by statement."""
        while self.kind != "end":
            if self.kind == "directive" or (self.kind == "word" and self.value.lower() in ("prefix", "base")):
                self.directive()
            else:
                lone = self.value == "["
                subject = self.term()
                if not (lone and self.value == "."):
                    self.predicates(subject)
                self.sign(".")
            yield from self.out
            self.out.clear()

    def directive(self) -> None:
        word = self.step()[1]
        name = ""
        if word.lower().endswith("prefix"):
            kind, name = self.step()
            if kind != "name" or not name.endswith(":"):
                raise QueryError(f"a prefix was expected, found {name!r}")
        kind, iri = self.step()
        if kind != "iri":
            raise QueryError(f"an IRI was expected, found {iri!r}")
        if name:
            self.prefixes[name[:-1]] = self.base + iri[1:-1] if ":" not in iri else iri[1:-1]
        else:
            self.base = iri[1:-1]
        if word[0] == "@":
            self.sign(".")

    def predicates(self, subject: str) -> None:
        while True:
            verb = self.term(verb=True)
            while True:
                self.out.append((subject, verb, self.term()))
                if self.value != "," or self.kind != "sign":
                    break
                self.step()
            if self.kind != "sign" or self.value != ";":
                return
            while self.kind == "sign" and self.value == ";":
                self.step()
            if self.kind == "sign" and self.value in ".]":
                return

    def node(self) -> str:
        self.fresh += 1
        return f"_:{self.scope}.{self.fresh}"

    def term(self, verb: bool = False) -> str:
        kind, text = self.step()
        if kind == "iri":
            inner = _unescaped(text[1:-1])
            return inner if ":" in inner or not self.base else self.base + inner
        if kind == "name":
            prefix, _, local = text.partition(":")
            if prefix not in self.prefixes:
                raise QueryError(f"unknown prefix {prefix!r}")
            return self.prefixes[prefix] + local
        if kind == "word" and verb and text == "a":
            return RDF_TYPE
        if not verb:
            if kind == "node":
                return f"_:{self.scope}{text[1:]}"
            if kind == "number" or (kind == "word" and text in ("true", "false")):
                return text
            if kind == "string":
                marks = 3 if text[:3] in ('"""', "'''") else 1
                if self.kind == "tag" and self.step()[1] == "^^":
                    self.term()
                return _unescaped(text[marks:-marks])
            if (kind, text) == ("sign", "["):
                node = self.node()
                if self.value != "]":
                    self.predicates(node)
                self.sign("]")
                return node
        raise QueryError(f"a term was expected, found {text!r} before {self.at}")


def triples_of(text: str, scope: str = "b") -> Iterator[tuple[str, str, str]]:
    """(s, p, o) of a Turtle text. Languages and types of literals are read and left out; collections are an error."""
    return _Reader(text, scope).triples()


def read_turtle(spark: SparkSession, path: str, batch: int = 20_000) -> DataFrame:
    """(s, p, o, t) of Turtle files, without time. A text that is no Turtle is an error that names its file."""

    def read(files: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows: list[tuple[str, str, str]]) -> pa.RecordBatch:
            columns = [pa.array(c, pa.string()) for c in zip(*rows, strict=True)]
            return pa.RecordBatch.from_arrays([*columns, pa.array([NO_TIME] * len(rows))], names=["s", "p", "o", "t"])

        for b in files:
            for name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows: list[tuple[str, str, str]] = []
                try:
                    for row in triples_of(text, f"f{zlib.crc32(name.encode()):08x}"):
                        rows.append(row)
                        if len(rows) == batch:
                            yield made(rows)
                            rows = []
                except QueryError as e:
                    raise QueryError(f"{name}: {e}") from None
                if rows:
                    yield made(rows)

    files = spark.read.text(path, wholetext=True)
    return files.select(F.input_file_name().alias("name"), "value").mapInArrow(read, "s string, p string, o string, t string")
