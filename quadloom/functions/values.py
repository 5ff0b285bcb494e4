"""Typed values from free text: integers, decimals, dates, booleans and strings in one plain spelling."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Every character that counts as blank, by rule.
BLANKS = "".join(chr(i) for i in range(sys.maxunicode + 1) if chr(i).isspace())
#: Every decimal digit of every script and its ASCII digit, by rule.
_DIGITS = [chr(i) for i in range(128, sys.maxunicode + 1) if unicodedata.category(chr(i)) == "Nd"]
#: Signs, points and commas of other scripts and their ASCII forms (fixed values).
_SIGNS = {"−": "-", "－": "-", "﹣": "-", "＋": "+", "﹢": "+", "．": ".", "，": ",", "٫": ".", "٬": ",", "’": "'", " ": " ", " ": " ", " ": " ", "　": " "}
_FROM = "".join(_DIGITS) + "".join(_SIGNS)
_TO = "".join(str(unicodedata.digit(c)) for c in _DIGITS) + "".join(_SIGNS.values())

#: Words and letters for truth values, in lower case (fixed values).
TRUE_WORDS = ("true", "t", "yes", "y", "1", "是", "真", "on", "ja", "oui", "sí", "si", "sim", "да", "はい")
FALSE_WORDS = ("false", "f", "no", "n", "0", "否", "假", "off", "nein", "non", "não", "нет", "いいえ")
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
_MONTH_WORDS = {w: f"{i:02d}" for i, m in enumerate(MONTHS, 1) for w in (m, m[:3])} | {"sept": "09"}

# One grouping mark throughout (comma, blank, apostrophe or underscore) between groups of three digits, or none.
_NUMBER = r"^[+-]?(?:(?:[0-9]{1,3}([, '_])[0-9]{3}(?:\1[0-9]{3})*|[0-9]+)(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]{1,3})?$"
# Points as grouping marks are unmistakable beside a decimal comma or when there are two of them.
_POINTED = r"^[+-]?[0-9]{1,3}(?:(?:\.[0-9]{3})+,[0-9]+|(?:\.[0-9]{3}){2,})$"
_YMD = r"^([0-9]{4})(?:([-/.])([0-9]{1,2})\2([0-9]{1,2})|年([0-9]{1,2})月([0-9]{1,2})日|([0-9]{2})([0-9]{2}))$"
_DMY = r"^([0-9]{1,2})(?:st|nd|rd|th)?\.?[ -]([A-Za-z]{3,9})\.?,?[ -]([0-9]{4})$"
_MDY = r"^([A-Za-z]{3,9})\.? ([0-9]{1,2})(?:st|nd|rd|th)?,? ([0-9]{4})$"


def stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def ascii_digits(text: Column) -> Column:
    """Digits, signs and marks of any script as their ASCII forms."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, _FROM, _TO)).otherwise(text)


def with_plain_text(df: DataFrame, raw: str, value_type: str, out: str) -> DataFrame:
    """`df` with the column `out`: the value that `raw` states under `value_type`, in the one spelling of that type.

    integer: plain digits; decimal: two decimals, halves rounded away from zero; date: yyyy-MM-dd; boolean: true or
    false; string: without outer blanks. Null if unreadable, which an empty text and any other type always is.

    Numbers: an optional sign, digits of any script, one kind of grouping mark in groups of three, a fraction, an
    exponent; at most 38 digits of an integer, and 36 before the point of a decimal. Dates put the year first or name the month, and must exist.
    The steps are columns of their own, each used more than once, so that no step is computed twice.
    """
    v = F.col(value_type)
    t = F.col("_text")
    df = df.withColumn("_strip", stripped(F.col(raw)))
    df = df.withColumn("_text", F.when(v.isin("integer", "decimal", "date"), ascii_digits(F.col("_strip"))))
    number = F.when(t.rlike(_NUMBER), F.translate(t, ", '_", "")).when(t.rlike(_POINTED), F.translate(F.replace(t, F.lit("."), F.lit("")), ",", "."))
    shaped = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, _YMD, "$1|$3$5$7|$4$6$8"), _DMY, "$3|$2|$1"), _MDY, "$3|$1|$2")
    df = df.withColumns(
        {
            "_num": F.when(v != "date", number),
            "_ymd": F.when(v == "date", F.split(shaped, r"\|")),
        }
    )
    n, ymd = F.col("_num"), F.col("_ymd")
    month = F.coalesce(F.create_map(*[F.lit(x) for pair in _MONTH_WORDS.items() for x in pair])[F.lower(ymd[1])], F.lpad(ymd[1], 2, "0"))
    df = df.withColumn("_day", F.when((F.size(ymd) == 3) & (ymd[0] != "0000"), F.try_to_date(F.concat_ws("-", ymd[0], month, F.lpad(ymd[2], 2, "0")), "yyyy-MM-dd")))
    # An integer has no digit but zero behind the point, once the exponent has moved it.
    whole = F.regexp_extract(n, "^[+-]?([0-9]*)", 1)
    digits = F.regexp_replace(F.concat(whole, F.regexp_extract(n, r"\.([0-9]*)", 1)), "0+$", "")
    power = F.coalesce(F.regexp_extract(n, "[eE]([+-]?[0-9]+)$", 1).try_cast("int"), F.lit(0))
    even = (digits == "") | (F.length(digits) <= F.length(whole) + power)
    word = F.lower(F.col("_strip"))
    value = (
        F.when(v == "string", F.when(F.col("_strip") != "", F.col("_strip")))
        .when(v == "integer", F.when(even, n.try_cast("decimal(38,0)").cast("string")))
        .when(v == "decimal", n.try_cast("decimal(38,2)").cast("string"))
        .when(v == "date", F.date_format(F.col("_day"), "yyyy-MM-dd"))
        .when(v == "boolean", F.when(word.isin(*TRUE_WORDS), "true").when(word.isin(*FALSE_WORDS), "false"))
    )
    return df.withColumn(out, value).drop("_strip", "_text", "_num", "_ymd", "_day")


#: Column type of each value type in a wide table.
SPARK_TYPES = {"string": "string", "integer": "decimal(38,0)", "decimal": "decimal(38,2)", "date": "date", "boolean": "boolean"}
