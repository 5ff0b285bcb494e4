"""Text files of facts and hyperedges: reading, and the lines of an export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.model import RESERVED
from quadloom.session import computed_once
from quadloom.sources.lines import good_lines

_FACT = r'^\s*<([^>]*)>\s*<([^>]*)>\s*(?:<([^>]*)>|"((?:[^"\\]|\\.)*+)"(?:@[\w-]+|\^\^<[^>]*>)?)\s*(?:<([^>]*)>)?\s*\.?\s*$'


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def facts_of(lines: DataFrame, text: str = "value") -> DataFrame:
    """(s, p, o, t) of the lines that begin with <; a missing time is 'no'. Lines of no such form and facts with an
    empty term are left out; see sources.lines for telling why.
    """
    shaped = F.regexp_replace(F.col(text), _FACT, "\u0001$1\u0001$2\u0001$3$4\u0001$5")
    parts = F.split(shaped, "\u0001")
    rows = lines.where(F.ltrim(text).startswith("<")).select(computed_once(parts).alias("x")).where(F.size("x") == 5)
    rows = rows.select(F.col("x")[1].alias("s"), F.col("x")[2].alias("p"), F.col("x")[3].alias("o"), F.when(F.col("x")[4] != "", F.col("x")[4]).otherwise("no").alias("t"))
    return rows.where("s <> '' and p <> '' and o <> ''")


def hyper_of(lines: DataFrame, first_hid: int = 1, text: str = "value", cut_dots: bool = False) -> DataFrame:
    """(hid, subject, predicate, objects, stime, etime) of the lines that begin with {.

    Fields are cut at commas and braces, so terms may hold dots; with `cut_dots` they are cut at dots too, for files
    that were written for readers that do so. hids count up from `first_hid` in no given order, with gaps between
    partitions; lines with fewer than four fields are left out.
    """
    cut = "[{},.\r]" if cut_dots else "[{},]"
    parts = F.filter(F.transform(F.split(F.regexp_replace(F.col(text), r"[.\s]*$", ""), cut), lambda x: F.trim(x)), lambda x: x != "")
    rows = lines.where(F.ltrim(text).startswith("{")).select(computed_once(parts).alias("x")).where(F.size("x") >= 4)
    return rows.select(
        F.concat(F.lit("hid"), (F.monotonically_increasing_id() + first_hid).cast("string")).alias("hid"),
        F.col("x")[1].alias("subject"),
        F.col("x")[0].alias("predicate"),
        F.expr("slice(x, 5, greatest(size(x) - 4, 0))").alias("objects"),
        F.col("x")[2].alias("stime"),
        F.col("x")[3].alias("etime"),
    )


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    return facts_of(lines_of(spark, path))


def read_hyper(spark: SparkSession, path: str, first_hid: int = 1) -> DataFrame:
    return hyper_of(lines_of(spark, path), first_hid)


def checked_facts(lines: DataFrame, text: str = "line_text") -> DataFrame:
    """(s, p, o, t) of the well-formed triple lines only."""
    return good_lines(lines, text).where(F.col("kind") == "triple").select("s", "p", "o", "t")


def fact_line() -> Column:
    return F.format_string("<%s> <%s> <%s> <%s>.", "s", "p", "o", "t")


def hyper_line() -> Column:
    return F.concat(
        F.lit("{"), F.concat_ws(",", "predicate", "subject", "stime", "etime"), F.lit(",{"), F.concat_ws(",", F.sort_array("objects")), F.lit("}}.")
    )


def export_lines(facts: DataFrame, reserved: bool) -> DataFrame:
    """(line): facts under the reserved predicates, or all others."""
    due = F.col("p").isin(*RESERVED)
    return facts.where(due if reserved else ~due).select(fact_line().alias("line"))


def key_values(lines: DataFrame, text: str = "value") -> DataFrame:
    """(s, p, value) of lines s=p=value; the value may hold further signs. Lines of no such form are left out."""
    x = computed_once(F.split(F.col(text), "=", 3))
    rows = lines.select(x.alias("x")).where(F.size("x") == 3)
    return rows.select(*[F.trim(F.col("x")[i]).alias(n) for i, n in enumerate(("s", "p", "value"))])


def read_key_values(lines: DataFrame, text: str = "value") -> DataFrame:
    """(s, p, values ARRAY<STRING>) of lines s=p=value, for subjects whose values fit into one row."""
    return key_values(lines, text).groupBy("s", "p").agg(F.sort_array(F.collect_list("value")).alias("values"))
