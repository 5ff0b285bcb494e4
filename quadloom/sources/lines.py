"""Load files of triple and hyperedge lines: good lines become typed rows, bad lines keep their text and get a reason.

Reading is permissive: each line is matched against the explicit layout of its kind in one pass. A line that does not
fit, or holds a value that cannot be cast, has null fields and its raw text in `corrupt`. Only those lines are then
looked at again, for quoting, then count, then values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadloom.session import computed_once

_SEP = "\u0001"
_W = r"[ \t]*+"
_IRI = r"<[^<>]*+>"
_QUOTED = r'"(?:[^"\\]|\\.)*+"'
_LANG = r"@[A-Za-z]++(?:-[A-Za-z0-9]++)*+"
#: Any term, well typed or not.
_TERM = rf"{_IRI}|{_QUOTED}(?:{_LANG}|\^\^{_IRI})?+"
_TRIPLE = rf"^{_W}({_IRI}){_W}({_IRI}){_W}(?:({_IRI})|({_QUOTED})(?:({_LANG})|\^\^<xsd:(integer|decimal|date|boolean)>)?+){_W}({_IRI})?+{_W}\.?+{_W}$"
_HYPER = rf"^{_W}\{{([^{{}},]*+),([^{{}},]*+),([^{{}},]*+),([^{{}},]*+),{_W}\{{([^{{}}]*+)\}}{_W}\}}{_W}\.?+{_W}$"
_DAY = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"

#: Fields of a loaded line: a triple has s, p, o, o_kind, lang, type, t; a hyperedge p, s, t (start), t_end, objects.
FIELDS = "kind string, s string, p string, o string, o_kind string, lang string, type string, t string, t_end string, objects array<string>"


def is_day(text: Column) -> Column:
    """True for a real calendar date written yyyy-MM-dd, else false."""
    return F.coalesce(text.rlike(_DAY) & ~text.startswith("0000") & F.try_to_date(F.when(text.rlike(_DAY), text), "yyyy-MM-dd").isNotNull(), F.lit(False))


def is_time(text: Column) -> Column:
    return text.isin("no", "null") | is_day(text)


def fits_type(value: Column, kind: Column) -> Column:
    return (
        F.when(kind == "integer", value.rlike(r"^[+-]?[0-9]+$"))
        .when(kind == "decimal", value.rlike(r"^[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)$"))
        .when(kind == "date", is_day(value))
        .when(kind == "boolean", value.isin("true", "false", "1", "0"))
        .otherwise(F.lit(True))
    )


def _inner(term: Column) -> Column:
    """A bracketed or quoted term without its marks; null for a missing one."""
    return F.when(term != "", F.substring(term, F.lit(2), F.length(term) - 2))


def _filled(text: Column) -> Column:
    return F.coalesce(F.trim(F.translate(text, "\t", " ")) != "", F.lit(False))


def _fields(text: Column, layout: str, groups: int) -> Column:
    """The groups of `layout` as an array, from a single match; null if the text does not fit."""
    shaped = F.regexp_replace(text, layout, _SEP + _SEP.join(f"${i}" for i in range(1, groups + 1)))
    return F.when(~text.contains(_SEP) & shaped.startswith(_SEP), F.split(shaped, _SEP))


def read_lines(lines: DataFrame, text: str = "line_text") -> DataFrame:
    """`lines` with the struct column `rec` (FIELDS) and the column `corrupt`.

    Null and blank texts and lines that start with # carry nothing: kind is null and corrupt is null. Lines that do not
    fit have a null kind and their text in `corrupt`. Columns of other names are kept, so `lines` may have any except
    rec and corrupt.
    """
    raw, head = F.col(text), F.col("_head")
    # The first character that is no blank, of which an empty text has none.
    df = lines.withColumn("_head", F.substring(F.ltrim(F.translate(raw, "\t", " ")), 1, 1))
    carries = ~head.isin("", "#")
    df = df.withColumn("_t", computed_once(F.when(carries & (head != "{"), _fields(raw, _TRIPLE, 7))))
    df = df.withColumn("_h", computed_once(F.when(head == "{", _fields(raw, _HYPER, 5))))
    t, h = F.col("_t"), F.col("_h")
    s, p, iri, lit, lang, kind, time = (t[i] for i in range(1, 8))
    o = F.when(iri != "", _inner(iri)).otherwise(_inner(lit))
    good_triple = (
        t.isNotNull()
        & _filled(_inner(s))
        & _filled(_inner(p))
        & ((iri == "") | _filled(_inner(iri)))
        & ((time == "") | is_time(_inner(time)))
        & fits_type(_inner(lit), kind)
    )
    hp, hs, start, end = (F.trim(F.translate(h[i], "\t", " ")) for i in range(1, 5))
    objects = F.transform(F.split(h[5], ","), lambda x: F.trim(F.translate(x, "\t", " ")))
    good_hyper = h.isNotNull() & (hp != "") & (hs != "") & is_time(start) & is_time(end) & F.forall(objects, lambda x: x != "")
    unescaped = F.regexp_replace(o, r"\\(.)", "$1")
    triple = F.struct(
        F.lit("triple").alias("kind"),
        _inner(s).alias("s"),
        _inner(p).alias("p"),
        F.when(iri != "", o).otherwise(unescaped).alias("o"),
        F.when(iri != "", "term").otherwise("literal").alias("o_kind"),
        F.when(lang != "", F.substring(lang, 2, 1000)).alias("lang"),
        F.when(kind != "", kind).alias("type"),
        F.coalesce(_inner(time), F.lit("no")).alias("t"),
        F.lit(None).cast("string").alias("t_end"),
        F.lit(None).cast("array<string>").alias("objects"),
    )
    none = F.lit(None).cast("string")
    hyper = F.struct(
        F.lit("hyper").alias("kind"), hs.alias("s"), hp.alias("p"), none.alias("o"), none.alias("o_kind"), none.alias("lang"),
        none.alias("type"), start.alias("t"), end.alias("t_end"), objects.alias("objects"),
    )
    # What is good is told before anything is built, so that a reader of the bad lines alone builds nothing.
    df = df.withColumn("_good", F.when(F.coalesce(good_triple, F.lit(False)), 1).when(F.coalesce(good_hyper, F.lit(False)), 2).otherwise(0))
    good = F.col("_good")
    df = df.withColumn("rec", F.when(good == 1, triple).when(good == 2, hyper).cast(f"struct<{FIELDS}>")).withColumn("corrupt", F.when(carries & (good == 0), raw))
    return df.drop("_head", "_t", "_h", "_good")


def _times(text: Column, mark: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))


def reason_of(corrupt: Column) -> Column:
    """Why a text that read_lines set apart does not fit: 'quoting', 'columns' or 'value', the first that applies.

    quoting: after all whole terms are taken out, a quote, bracket or brace is left over, or the quotes that no
    backslash escapes are odd in number; for hyperedges, braces do not balance. columns: not three or four terms, a
    dot between terms (more than one record), or bare words; for hyperedges, not four fields and an object set.
    value: all else.
    """
    rest = F.regexp_replace(corrupt, _TERM, _SEP)
    odd = _times(F.regexp_replace(corrupt, r"\\.", ""), '"') % 2 == 1
    triple = (
        F.when(F.regexp_replace(rest, f"[{_SEP} \t.]", "").rlike(r'[<>"{}\\]') | odd, "quoting")
        .when(~rest.rlike(rf"^[ \t]*(?:{_SEP}[ \t]*){{3,4}}\.?[ \t]*$"), "columns")
        .otherwise("value")
    )
    set_ok = rf"^{_W}\{{[^{{}},]*+,[^{{}},]*+,[^{{}},]*+,[^{{}},]*+,{_W}\{{[ \t]*[^{{}} \t][^{{}}]*+\}}{_W}\}}{_W}\.?+{_W}$"
    hyper = F.when(_times(corrupt, "{") != _times(corrupt, "}"), "quoting").when(~corrupt.rlike(set_ok), "columns").otherwise("value")
    return F.when(F.ltrim(F.translate(corrupt, "\t", " ")).startswith("{"), hyper).otherwise(triple)


def bad_lines(lines: DataFrame, text: str = "line_text") -> DataFrame:
    """`lines` that carry something and do not fit, with `corrupt` (their text) and `reason`."""
    return read_lines(lines, text).where(F.col("corrupt").isNotNull()).drop("rec").withColumn("reason", reason_of(F.col("corrupt")))


def good_lines(lines: DataFrame, text: str = "line_text") -> DataFrame:
    """`lines` that fit, without their text, with the fields of FIELDS as columns (they replace columns of such names)."""
    loaded = read_lines(lines, text).where(F.col("rec").isNotNull())
    names = [f.name for f in loaded.schema["rec"].dataType.fields]
    keep = [c for c in loaded.columns if c not in (*names, text, "rec", "corrupt")]
    return loaded.select(*[f"`{c}`" for c in keep], *[F.col(f"rec.{n}").alias(n) for n in names])
