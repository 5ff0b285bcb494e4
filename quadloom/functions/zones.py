"""Versioned transition tables of all zones of the time zone database, for vectorised conversion of wall-clock times."""

from __future__ import annotations

import os
import re
import struct
import zoneinfo
from dataclasses import dataclass, field
from datetime import date, timedelta
from functools import lru_cache

import numpy as np

#: Transitions that a zone's rule for the future yields are listed up to the end of this year. The calendar repeats
#: itself, weekdays included, every 400 years, so a later time is looked up by as many such cycles before; the last 400
#: years listed hold nothing but rules.
LAST_YEAR = 2499
CYCLE = 146_097 * 86_400
_END = (date(LAST_YEAR + 1, 1, 1) - date(1970, 1, 1)).days * 86_400


@dataclass
class Zone:
    """`offset[i]` (seconds east of UTC) holds from the wall-clock second `wall[i - 1]` on, `offset[0]` before all.

    Around a change the wall clock shows some times twice or never. `wall` is the later of the two readings of the
    clock at the change, so that a time shown twice means the first and a skipped time takes the offset before.
    """

    wall: np.ndarray
    offset: np.ndarray
    names: dict[str, int] = field(default_factory=dict)

    def offset_at(self, wall: np.ndarray) -> np.ndarray:
        """Seconds east of UTC at wall-clock seconds since 1970, for any year."""
        late = wall >= _END
        if late.any():
            wall = np.where(late, wall - ((wall - _END) // CYCLE + 1) * CYCLE, wall)
        return self.offset[np.searchsorted(self.wall, wall, side="right")]


def _posix_offset(text: str) -> int:
    m = re.fullmatch(r"([+-]?)(\d+)(?::(\d+))?(?::(\d+))?", text)
    seconds = int(m[2]) * 3600 + int(m[3] or 0) * 60 + int(m[4] or 0)
    return -seconds if m[1] == "-" else seconds


def _rule_day(rule: str, year: int) -> tuple[date, int]:
    day, _, at = rule.partition("/")
    seconds = _posix_offset(at) if at else 7200
    if day[0] == "M":
        month, week, weekday = map(int, day[1:].split("."))
        first = date(year, month, 1)
        d = first + timedelta((weekday - first.isoweekday()) % 7 + 7 * (week - 1))
        while d.month != month:
            d -= timedelta(7)
        return d, seconds
    if day[0] == "J":
        n = int(day[1:])
        leap = year % 4 == 0 and (year % 100 != 0 or year % 400 == 0)
        return date(year, 1, 1) + timedelta(n - 1 + (leap and n >= 60)), seconds
    return date(year, 1, 1) + timedelta(int(day)), seconds


@lru_cache(maxsize=1024)
def _future(rule: str) -> tuple[tuple[int, int, str], ...]:
    """(UTC second, offset, name) of the changes from 1970 to LAST_YEAR that a POSIX rule yields."""
    part = r"(<[^>]+>|[A-Za-z]+)"
    m = re.fullmatch(rf"{part}([+-]?[\d:]+)(?:{part}([+-]?[\d:]+)?,([^,]+),([^,]+))?", rule)
    if not m or not m[3]:
        return ()
    std, dst = -_posix_offset(m[2]), -_posix_offset(m[4]) if m[4] else -_posix_offset(m[2]) + 3600
    out = []
    for year in range(1970, LAST_YEAR + 1):
        for when, before, then, name in ((m[5], std, dst, m[3]), (m[6], dst, std, m[1])):
            d, seconds = _rule_day(when, year)
            out.append(((d - date(1970, 1, 1)).days * 86_400 + seconds - before, then, name.strip("<>")))
    return tuple(sorted(out))


def read_zone(data: bytes) -> Zone:
    """A zone from the bytes of its compiled file (version 2 or later)."""

    def header(at: int) -> tuple[int, ...]:
        return struct.unpack(">6l", data[at + 20 : at + 44])

    isut, isstd, leap, times, types, chars = header(0)
    at = 44 + times * 5 + types * 6 + chars + leap * 8 + isstd + isut
    isut, isstd, leap, times, types, chars = header(at)
    at += 44
    utc = list(struct.unpack(f">{times}q", data[at : at + 8 * times]))
    index = list(data[at + 8 * times : at + 9 * times])
    at += 9 * times
    infos = [struct.unpack(">lBB", data[at + 6 * i : at + 6 * i + 6]) for i in range(types)]
    at += 6 * types
    text = data[at : at + chars]
    name_at = lambda i: text[i : text.index(b"\0", i)].decode()
    at += chars + leap * 12 + isstd + isut
    rule = data[at:].decode().strip("\n")
    changes = [(t, infos[i][0], name_at(infos[i][2])) for t, i in zip(utc, index, strict=True)]
    changes += [x for x in _future(rule) if not utc or x[0] > utc[-1]]
    first = next((x[0] for x in infos if not x[1]), infos[0][0])
    offsets = np.array([first, *[o for _, o, _ in changes]], dtype=np.int64)
    moments = np.array([t for t, _, _ in changes], dtype=np.int64)
    wall = moments + np.maximum(offsets[:-1], offsets[1:])
    names = {name_at(infos[0][2]): infos[0][0]} | {n: o for _, o, n in changes}
    return Zone(np.maximum.accumulate(wall) if len(wall) else wall, offsets, names)


@dataclass
class ZoneTables:
    version: str
    zones: dict[str, Zone]


def _version(root: str) -> str:
    path = os.path.join(root, "tzdata.zi")
    if os.path.exists(path):
        with open(path) as f:
            return f.readline().replace("# version", "").strip()
    return "unknown"


def load_tables(version: str | None = None) -> ZoneTables:
    """All zones of the database that is installed where this runs, and the version of the database.

    Their number and size are those of the public database: about 600 zones, some 10 MB. Tables of another `version` than
    the one asked for are an error, so that a result can be made again with the rules it was made with.
    """
    tables = _installed()
    if version is not None and tables.version != version:
        raise ValueError(f"time zone database {tables.version} is installed, {version} is wanted")
    return tables


@lru_cache(maxsize=1)
def _installed() -> ZoneTables:
    root = next((p for p in zoneinfo.TZPATH if os.path.exists(os.path.join(p, "UTC"))), None)
    version = _version(root) if root else "unknown"
    if root is None:
        import tzdata

        root, version = os.path.join(os.path.dirname(tzdata.__file__), "zoneinfo"), tzdata.IANA_VERSION
    zones = {}
    for key in zoneinfo.available_timezones():
        path = os.path.join(root, key)
        if os.path.exists(path):
            with open(path, "rb") as f:
                data = f.read()
            if data[:4] == b"TZif" and data[4:5] >= b"2":
                zones[key] = read_zone(data)
    return ZoneTables(version, zones)
