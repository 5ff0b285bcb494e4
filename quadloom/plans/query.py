"""Query texts: tokens, grammar and the tree of a query."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"


class QueryError(ValueError):
    """A text that is no query, or one that is not supported."""


@dataclass(frozen=True)
class Var:
    name: str
    hidden: bool = False  # blank nodes


@dataclass(frozen=True)
class Const:
    value: str


Term = Var | Const


@dataclass(frozen=True)
class Pattern:
    s: Term
    p: Term
    o: Term

    def terms(self) -> tuple[Term, Term, Term]:
        return self.s, self.p, self.o

    def variables(self) -> list[str]:
        return list(dict.fromkeys(t.name for t in self.terms() if isinstance(t, Var)))


@dataclass(frozen=True)
class Filter:
    """op: '=', '!=', 'in' or 'reaches'; args: constants, one variable, or (target, via)."""

    var: str
    op: str
    args: tuple[Term, ...]


@dataclass
class Group:
    patterns: list[Pattern] = field(default_factory=list)
    filters: list[Filter] = field(default_factory=list)
    unions: list[list[Group]] = field(default_factory=list)
    optionals: list[Group] = field(default_factory=list)

    def variables(self) -> list[Var]:
        out = [t for p in self.patterns for t in p.terms() if isinstance(t, Var)]
        for g in [*[b for u in self.unions for b in u], *self.optionals]:
            out += g.variables()
        return list(dict.fromkeys(out))


    def groups(self) -> list[Group]:
        """This group and all inside it."""
        return [self, *[x for g in [*[b for u in self.unions for b in u], *self.optionals] for x in g.groups()]]

    def is_plain(self) -> bool:
        return not (self.filters or self.unions or self.optionals)


@dataclass
class Query:
    kind: str  # select, insert, delete, delete_where, update
    where: Group
    columns: list[str] = field(default_factory=list)
    modifier: str = ""  # distinct, reduced, count, duplicates
    limit: int | None = None
    temporal: bool = False  # each row with the time of its fact
    new: list[Pattern] = field(default_factory=list)  # what an update puts in place of the facts it removes


_TOKEN = re.compile(
    r"""(?P<blank>\s+|\#[^\n]*)
      |(?P<iri><[^>]*>)
      |(?P<string>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')
      |(?P<var>[?$][0-9A-Za-z]+)
      |(?P<node>_:[0-9A-Za-z]+)
      |(?P<name>[0-9A-Za-z_](?:[0-9A-Za-z_.-]*[0-9A-Za-z_-])?)
      |(?P<sign>!=|[{}()\[\].;,:=*])""",
    re.VERBOSE | re.DOTALL,
)


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise QueryError(f"unexpected character {text[at]!r} at {at}")
        if m.lastgroup != "blank":
            out.append((m.lastgroup, m.group()))
        at = m.end()
    return [*out, ("end", "")]


class _Parser:
    def __init__(self, text: str) -> None:
        self.tokens, self.at, self.fresh = tokens(text), 0, 0
        self.prefixes: dict[str, str] = {}
        self.nodes: dict[str, tuple[int, Var]] = {}
        self.block = self.blocks = 0

    @property
    def token(self) -> tuple[str, str]:
        return self.tokens[self.at]

    def take(self) -> tuple[str, str]:
        self.at += 1
        return self.tokens[self.at - 1]

    def is_sign(self, sign: str) -> bool:
        return self.token == ("sign", sign)

    def sign(self, sign: str) -> None:
        if not self.is_sign(sign):
            raise QueryError(f"{sign!r} expected, found {self.token[1]!r}")
        self.at += 1

    def is_word(self, *words: str) -> bool:
        return self.token[0] == "name" and self.token[1].lower() in words

    def word(self, *words: str) -> str:
        if not self.is_word(*words):
            raise QueryError(f"{' or '.join(words)} expected, found {self.token[1]!r}")
        return self.take()[1].lower()

    def query(self) -> Query:
        while self.is_word("prefix"):
            self.take()
            name = self.take()[1] if self.token[0] == "name" else ""
            self.sign(":")
            kind, iri = self.take()
            if kind != "iri":
                raise QueryError("an IRI must follow the prefix")
            if name in self.prefixes:
                raise QueryError(f"prefix {name!r} is declared twice")
            self.prefixes[name] = iri[1:-1]
        verb = self.word("select", "insert", "delete")
        if verb == "select":
            return self.select()
        if verb == "insert":
            self.word("data")
            q = Query("insert", self.group())
        elif self.is_word("data"):
            self.take()
            q = Query("delete", self.group())
        else:
            q = Query("delete_where", self.group())
            if self.is_word("insert"):
                self.take()
                new = self.group()
                if not new.is_plain():
                    raise QueryError("what is inserted must be plain patterns")
                q = Query("update", q.where, new=new.patterns)
        self.ended()
        self.check_update(q)
        return q

    def check_update(self, q: Query) -> None:
        if not any(g.patterns for g in q.where.groups()) or (q.kind == "update" and not q.new):
            raise QueryError("an update form needs patterns")
        if q.kind in ("insert", "delete"):
            if not q.where.is_plain():
                raise QueryError("data must be plain facts")
            if any(isinstance(t, Var) for p in q.where.patterns for t in p.terms()):
                raise QueryError("data must not hold variables")
        bound = {v.name for v in q.where.variables()}
        for name in (v for p in q.new for v in p.variables()):
            if name not in bound:
                raise QueryError(f"?{name} is not bound by the patterns to delete")

    def ended(self) -> None:
        if self.token[0] != "end":
            raise QueryError(f"end expected, found {self.token[1]!r}")

    def select(self) -> Query:
        modifier = self.take()[1].lower() if self.is_word("distinct", "reduced", "count", "duplicates") else ""
        columns: list[str] = []
        every = self.is_sign("*")
        if every:
            self.take()
        while self.token[0] == "var":
            columns.append(self.take()[1][1:])
        if not every and not columns:
            raise QueryError("variables or * expected")
        if self.is_word("from"):
            raise QueryError("FROM is not implemented")
        where = Group()
        self.word("where")
        where = self.group()
        while self.is_word("where"):  # the last one counts
            self.take()
            where = self.group()
        limit = None
        if self.is_word("limit"):
            self.take()
            kind, text = self.take()
            if kind != "name" or not text.isdigit() or int(text) == 0:
                raise QueryError("LIMIT needs a number above 0")
            limit = int(text)
        self.ended()
        if every:
            columns = sorted({v.name for v in where.variables() if not v.hidden})
        return Query("select", where, columns, modifier, limit)

    def next_block(self) -> None:
        """A group or a part of it that another group interrupts: labels of blank nodes hold inside one only."""
        self.blocks += 1
        self.block = self.blocks

    def group(self) -> Group:
        self.sign("{")
        g = Group()
        self.next_block()
        while not self.is_sign("}"):
            if self.token[0] == "end":
                raise QueryError("'}' is missing")
            if self.is_sign("{"):
                branches = [self.group()]
                while self.is_word("union"):
                    self.take()
                    branches.append(self.group())
                if len(branches) > 1:
                    g.unions.append(branches)
                else:  # a nested group is part of its parent
                    inner = branches[0]
                    g.patterns += inner.patterns
                    g.filters += inner.filters
                    g.unions += inner.unions
                    g.optionals += inner.optionals
                self.next_block()
            elif self.is_word("filter"):
                self.take()
                g.filters.append(self.filter())
            elif self.is_word("optional"):
                self.take()
                g.optionals.append(self.group())
                self.next_block()
            else:
                self.triples(g)
            if self.is_sign("."):
                self.take()
        self.sign("}")
        return g

    def triples(self, g: Group) -> None:
        if self.is_sign("["):
            subject = self.bracket(g)
            if self.is_sign(".") or self.is_sign("}") or self.is_sign("{") or self.is_word("filter", "optional"):
                return
        else:
            subject = self.term(g)
        self.predicates(g, subject)

    def predicates(self, g: Group, subject: Term) -> None:
        while True:
            verb = self.term(g, verb=True)
            while True:
                g.patterns.append(Pattern(subject, verb, self.term(g)))
                if not self.is_sign(","):
                    break
                self.take()
            if not self.is_sign(";"):
                return
            self.take()
            if self.is_sign(".") or self.is_sign("}") or self.is_sign("]"):
                return

    def hidden(self) -> Var:
        self.fresh += 1
        return Var(f"_b{self.fresh}", hidden=True)

    def bracket(self, g: Group) -> Var:
        self.sign("[")
        node = self.hidden()
        if not self.is_sign("]"):
            self.predicates(g, node)
        self.sign("]")
        return node

    def term(self, g: Group, verb: bool = False) -> Term:
        if self.is_sign("["):
            return self.bracket(g)
        if self.is_sign(":"):
            self.take()
            return Const(self.prefixes.get("", "") + self.take()[1])
        kind, text = self.take()
        if kind == "var":
            return Var(text[1:])
        if kind == "node":
            block, node = self.nodes.setdefault(text, (self.block, self.hidden()))
            if block != self.block:
                raise QueryError(f"{text} is used in two groups of patterns; a variable can be")
            return node
        if kind in ("iri", "string"):
            return Const(text[1:-1])
        if kind == "name":
            if self.is_sign(":"):
                self.take()
                if text not in self.prefixes:
                    raise QueryError(f"unknown prefix {text!r}")
                return Const(self.prefixes[text] + self.take()[1])
            if verb and text == "a":
                return Const(RDF_TYPE)
        raise QueryError(f"a term was expected, found {text!r}")

    def constant(self) -> Const:
        t = self.term(Group())
        if not isinstance(t, Const):
            raise QueryError("a constant was expected")
        return t

    def filter(self) -> Filter:
        self.sign("(")
        kind, text = self.take()
        if kind != "var":
            raise QueryError("a filter begins with a variable")
        var = text[1:]
        if self.is_word("in"):
            self.take()
            paren = self.is_sign("(")
            if paren:
                self.take()
            values = [self.constant()]
            while self.is_sign(","):
                self.take()
                values.append(self.constant())
            if paren:
                self.sign(")")
            f = Filter(var, "in", tuple(values))
        elif self.is_word("reaches"):
            self.take()
            target = self.constant()
            self.word("via")
            f = Filter(var, "reaches", (target, self.constant()))
        else:
            op = "!=" if self.is_sign("!=") else "="
            self.sign(op)
            f = Filter(var, op, (self.term(Group()),))
        self.sign(")")
        return f


def parse(text: str) -> Query:
    """The query of a text; QueryError says what is wrong.

    After the mark -t a SELECT of one pattern has a row for each time of a fact, with the column t.
    """
    body = text.lstrip()
    temporal = body[:2] == "-t" and body[2:3].isspace()
    query = _Parser(body[2:] if temporal else text).query()
    if temporal:
        if query.kind != "select" or len(query.where.patterns) != 1 or query.where.unions or query.where.optionals:
            raise QueryError("-t needs a SELECT of one pattern")
        if "t" in query.columns or query.modifier in ("count", "duplicates"):
            raise QueryError("the column t is that of the time")
        query.temporal, query.columns = True, [*query.columns, "t"]
    return query
