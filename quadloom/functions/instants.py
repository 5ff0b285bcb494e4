"""Instants in UTC from timestamp texts of mixed formats, precisions and zones.

Each text is reduced to a shape mask: digits become 9, letters become a, all else stays. A mask is mapped once to a
parser, a list of slices for the parts of the timestamp, and all texts of a batch that share the mask are converted
together on a matrix of characters. Wall-clock times go through the transition tables of functions.zones.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadloom.functions.values import MONTHS
from quadloom.functions.zones import ZoneTables, load_tables
from quadloom.session import broadcast_if_small

#: Parsers kept per Python worker; further masks push out those unused for longest.
PARSERS = 4096

#: Offsets in minutes of zone abbreviations, where the feed's own zone does not use them (fixed values).
ABBREVIATIONS = {
    "UTC": 0, "GMT": 0, "UT": 0, "Z": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "MSK": 180,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600,
    "IST": 330, "HKT": 480, "SGT": 480, "AWST": 480, "JST": 540, "KST": 540, "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780,
}

_CLOCK = r"(?P<H>99?):(?P<M>99)(?::(?P<S>99)(?:[.,](?P<f>9+))?)?(?: ?(?P<ap>aa|a\.a\.)(?!a))?"
_ZONE = r"(?: ?(?:(?P<abbr>a{1,5})(?P<sh>[+-]99?)(?::?(?P<sm>99))?|(?P<zn>a{1,5})|(?P<oh>[+-]99)(?::?(?P<om>99))?))?(?: ?\[(?P<region>[^\]]+)\])?"
_LAYOUTS = [
    re.compile(x)
    for x in (
        rf"(?P<y>9999)-(?P<m>99?)-(?P<d>99?)(?P<T>a| ){_CLOCK}{_ZONE}",
        rf"(?P<y>9999)(?P<m>99)(?P<d>99)(?P<T>a)(?P<H>99)(?P<M>99)(?:(?P<S>99)(?:[.,](?P<f>9+))?)?{_ZONE}",
        rf"(?P<d>99?)\.(?P<m>99?)\.(?P<y>9999),? {_CLOCK}{_ZONE}",
        rf"(?P<a>99?)/(?P<b>99?)/(?P<y>9999),? {_CLOCK}{_ZONE}",
        rf"(?P<y>9999)/(?P<m>99?)/(?P<d>99?),? {_CLOCK}{_ZONE}",
        rf"(?:aaa,? )?(?P<d>99?) (?P<month>a{{3,9}}) (?P<y>9999),? {_CLOCK}{_ZONE}",
        rf"(?:aaa,? )?(?P<month>a{{3,9}}) (?P<d>99?),? (?P<y>9999),? {_CLOCK}{_ZONE}",
        rf"(?P<y>9999)(?P<c1>a)(?P<m>99?)(?P<c2>a)(?P<d>99?)(?P<c3>a) ?(?P<H>99?)(?P<c4>a)(?P<M>99?)(?P<c5>a)(?:(?P<S>99?)(?P<c6>a))?{_ZONE}",
        r"(?P<sign>-?)(?P<n>9{1,19})(?:\.(?P<nf>9+))?",
    )
]
#: Letters that must stand at the places c1 to c6 (fixed values).
_CJK = {"c1": "年", "c2": "月", "c3": "日", "c4": "时時", "c5": "分", "c6": "秒"}


@dataclass(frozen=True)
class Parser:
    """Slices of the parts of a text, by part."""

    parts: dict[str, tuple[int, int]]


@lru_cache(maxsize=PARSERS)
def parser_of(mask: str) -> Parser | None:
    for layout in _LAYOUTS:
        if m := layout.fullmatch(mask):
            return Parser({k: m.span(k) for k, v in m.groupdict().items() if v is not None and v != ""})
    return None


def shape_mask(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\p{L}", "a"), "[0-9]", "9")


def _texts(chars: np.ndarray, span: tuple[int, int]) -> np.ndarray:
    a, b = span
    return np.ascontiguousarray(chars[:, a:b]).view(f"<U{b - a}").ravel()


def _number(chars: np.ndarray, span: tuple[int, int] | None, default: int = 0) -> np.ndarray:
    if span is None:
        return np.full(len(chars), default, dtype=np.int64)
    digits = chars[:, span[0] : span[1]].astype(np.int64) - 48
    return digits @ (10 ** np.arange(span[1] - span[0] - 1, -1, -1, dtype=np.int64))


def _micros(chars: np.ndarray, span: tuple[int, int] | None) -> np.ndarray:
    """A fraction of a second in microseconds; further digits are cut."""
    if span is None:
        return np.zeros(len(chars), dtype=np.int64)
    n = min(span[1] - span[0], 6)
    return _number(chars, (span[0], span[0] + n)) * 10 ** (6 - n)


def _signed(chars: np.ndarray, span: tuple[int, int] | None) -> np.ndarray:
    if span is None:
        return np.zeros(len(chars), dtype=np.int64)
    return _number(chars, (span[0] + 1, span[1]))


def _is_offset(hours: np.ndarray, minutes: np.ndarray) -> np.ndarray:
    """Offsets reach to 18 hours, and an hour has 60 minutes."""
    return (minutes <= 59) & (hours * 60 + minutes <= 18 * 60)


def _by_text(texts: np.ndarray, value) -> np.ndarray:
    """value(text) for each, computed once per distinct text; NaN where it gives none."""
    distinct, at = np.unique(texts, return_inverse=True)
    return np.array([np.nan if (v := value(str(x))) is None else v for x in distinct], dtype=float)[at]


def _convert(parser: Parser, texts: list[str], zone: np.ndarray, day_first: np.ndarray, tables: ZoneTables) -> tuple[np.ndarray, np.ndarray]:
    """Microseconds since 1970 UTC, and which of them are moments."""
    n, width = len(texts), len(texts[0])
    chars = np.array(texts, dtype=f"<U{width}").view(np.uint32).reshape(n, width)
    p = parser.parts
    ok = np.ones(n, dtype=bool)
    if "n" in p:
        digits = p["n"][1] - p["n"][0]
        unit = 10**6 if digits <= 11 else 10**3 if digits <= 14 else 1 if digits <= 17 else None
        whole = _number(chars, p["n"]) if unit else None
        # Fractions of a second only; a fraction of a smaller unit is cut to whole microseconds.
        if unit is None:  # the last three digits of nanoseconds are not read, so that 19 digits fit
            micros = _number(chars, (p["n"][0], p["n"][1] - 3))
        else:
            micros = whole * unit + (_micros(chars, p.get("nf")) * unit) // 10**6
        return (-micros if "sign" in p else micros), ok
    year, day = _number(chars, p["y"]), _number(chars, p.get("d"))
    month = _number(chars, p.get("m"))
    if "a" in p:
        a, b = _number(chars, p["a"]), _number(chars, p["b"])
        day, month = np.where(day_first, a, b), np.where(day_first, b, a)
    if "month" in p:
        by_name = {w: i for i, m in enumerate(MONTHS, 1) for w in (m, m[:3])} | {"sept": 9}
        named = _by_text(_texts(chars, p["month"]), lambda w: by_name.get(w.lower()))
        ok &= ~np.isnan(named)
        month = np.nan_to_num(named).astype(np.int64)
    if "T" in p:
        ok &= np.isin(_texts(chars, p["T"]), ["T", "t", " "])
    for part, letters in _CJK.items():
        if part in p:
            ok &= np.isin(_texts(chars, p[part]), list(letters))
    hour, minute, second = _number(chars, p.get("H")), _number(chars, p.get("M")), _number(chars, p.get("S"))
    if "ap" in p:
        half = _by_text(_texts(chars, p["ap"]), lambda w: {"am": 0, "pm": 12}.get(w.lower().replace(".", "")))
        ok &= ~np.isnan(half) & (hour >= 1) & (hour <= 12)
        hour = hour % 12 + np.nan_to_num(half).astype(np.int64)
    ok &= (month >= 1) & (month <= 12) & (day >= 1) & (year >= 1) & (hour <= 23) & (minute <= 59) & (second <= 59)
    months = np.where(ok, (year - 1970) * 12 + month - 1, 0).astype("M8[M]")
    ok &= day <= ((months + 1).astype("M8[D]") - months.astype("M8[D]")).astype(np.int64)
    days = months.astype("M8[D]").astype(np.int64) + day - 1
    wall = days * 86400 + hour * 3600 + minute * 60 + second

    offset = np.zeros(n)
    utc = {"UTC", "GMT", "UT", "Z"}
    if "oh" in p:
        sign = np.where(chars[:, p["oh"][0]] == ord("-"), -1, 1)
        hours, minutes = _signed(chars, p["oh"]), _number(chars, p.get("om"))
        ok &= _is_offset(hours, minutes)
        offset = sign * (hours * 3600 + minutes * 60.0)
    elif "abbr" in p:
        sign = np.where(chars[:, p["sh"][0]] == ord("-"), -1, 1)
        hours, minutes = _signed(chars, p["sh"]), _number(chars, p.get("sm"))
        ok &= _is_offset(hours, minutes)
        offset = sign * (hours * 3600 + minutes * 60.0)
        ok &= _by_text(_texts(chars, p["abbr"]), lambda w: float(w.upper() in utc)) == 1
    elif "zn" in p:
        names = _texts(chars, p["zn"])
        pairs, at = np.unique(np.array([f"{z}\0{w}" for z, w in zip(zone, names, strict=True)], dtype=object).astype(str), return_inverse=True)
        found = []
        for pair in pairs:
            z, _, w = str(pair).partition("\0")
            w = w.upper()
            own = tables.zones[z].names.get(w) if z in tables.zones and w not in utc else None
            found.append(own if own is not None else ABBREVIATIONS[w] * 60 if w in ABBREVIATIONS else np.nan)
        offset = np.array(found, dtype=float)[at]
    else:
        regions = _texts(chars, p["region"]) if "region" in p else zone
        codes, distinct = pd.factorize(np.asarray(regions, dtype=object))
        offset = np.full(n, np.nan)
        for i, key in enumerate(distinct):
            if table := tables.zones.get(str(key)):
                mine = codes == i
                offset[mine] = table.offset_at(wall[mine])
    ok &= ~np.isnan(offset)
    return (wall - np.nan_to_num(offset).astype(np.int64)) * 10**6 + _micros(chars, p.get("f")), ok


def convert_batch(texts: pd.Series, masks: pd.Series, zones: pd.Series, day_first: pd.Series, tables: ZoneTables) -> pd.Series:
    """yyyy-MM-ddTHH:mm:ss.SSSSSSZ of each text, null where it states no moment."""
    out = np.full(len(texts), None, dtype=object)
    text, zone = texts.to_numpy(dtype=object), zones.fillna("UTC").to_numpy(dtype=object)
    first = day_first.fillna(True).to_numpy(dtype=bool)
    codes, distinct = pd.factorize(masks)
    order = np.argsort(codes, kind="stable")
    ends = np.searchsorted(codes[order], np.arange(len(distinct) + 1))
    for i, mask in enumerate(distinct):
        parser = parser_of(mask)
        rows = order[ends[i] : ends[i + 1]]
        if parser is None:
            continue
        micros, ok = _convert(parser, list(text[rows]), zone[rows], first[rows], tables)
        said = np.char.add(np.datetime_as_string(micros[ok].astype("M8[us]"), unit="us"), "Z")
        out[rows[ok]] = said.astype(object)
    return pd.Series(out)


def states_moment(text: Column) -> Column:
    """False for null, 'no', 'null' and bare days, which need no conversion."""
    return text.isNotNull() & ~text.isin("no", "null", "") & ~text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$")


def utc_instants(facts: DataFrame, feeds: DataFrame, tzdata: str | None = None) -> DataFrame:
    """(fact_id, t_utc): one row per fact whose `t` states a moment.

    A time without zone is in the zone of the fact's feed, UTC if the feed is unknown; slashed dates put the day first
    unless the feed says otherwise. A wall-clock time that occurs twice means the first, one that the clock skips takes
    the offset before the change. Missing digits are 0, digits past microseconds are cut. Bare numbers count from 1970
    UTC in seconds (up to 11 digits), milliseconds (up to 14), microseconds (up to 17) or nanoseconds. Texts of no known
    layout, impossible dates and offsets and unknown zones state no moment. Repeated facts have a row each.

    The driver reads the zone tables once and sends them to all workers, so one version of the database decides;
    `tzdata` (such as "2025b") makes any other version an error.
    """
    spark = facts.sparkSession
    tables = spark.sparkContext.broadcast(load_tables(tzdata))

    @F.pandas_udf("string")
    def convert(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        known = tables.value
        for text, mask, zone, first in parts:
            yield convert_batch(text, mask, zone, first, known)

    convert = convert.asNondeterministic()  # or the filter on its result would run it a second time
    rows = facts.select("fact_id", F.trim("t").alias("t"), "src").where(states_moment(F.col("t")))
    by_feed = feeds.where(F.col("src").isNotNull()).groupBy("src").agg(F.max("zone_id").alias("zone_id"), F.max("day_first").alias("day_first"))
    joined = rows.join(broadcast_if_small(by_feed), "src", "left").withColumn("mask", shape_mask(F.col("t")))
    return joined.select("fact_id", convert("t", "mask", "zone_id", "day_first").alias("t_utc")).where(F.col("t_utc").isNotNull())
