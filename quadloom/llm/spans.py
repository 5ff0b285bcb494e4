"""Spans of code points, such as words and pieces: hashes of many at once, and places by exact spelling."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd

_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


@lru_cache(maxsize=4)
def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def span_hashes(cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of code points, from one running sum over all of them.

    Equal spans have equal hashes. Different ones can have too, and some texts make it happen at will, so a hash alone
    tells no spelling; see Spelled.
    """
    h = (cp.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(29)
    room = 1 << max(16, (len(cp) + 1).bit_length())
    sums = np.zeros(len(cp) + 1, dtype=np.uint64)
    np.cumsum(h * _powers(room, _BASE)[: len(cp)], out=sums[1:])
    out = (sums[ends] - sums[starts]) * _powers(room, _BASE_INVERSE)[starts]
    out ^= out >> np.uint64(32)
    return out + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)


class Spelled:
    """Numbers spellings in the order they come. The hash of a span finds its number, its code points confirm it."""

    def __init__(self, most: int) -> None:
        self.most = most
        self.forget()

    def forget(self) -> None:
        self.known: dict[int, int] = {}  # number by hash
        self.others: dict[bytes, int] = {}  # number of spellings whose hash another one came with first
        self.points = np.zeros(1 << 16, dtype=np.uint32)
        self.used = self.count = 0
        self.start = np.zeros(1 << 12, dtype=np.int64)
        self.size = np.zeros(1 << 12, dtype=np.int64)

    def _add(self, cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Numbers of new spellings."""
        size = ends - starts
        total, n = int(size.sum()), len(starts)
        if self.used + total > len(self.points):
            self.points = np.concatenate([self.points[: self.used], np.zeros(max(self.used, total) + total, dtype=np.uint32)])
        if self.count + n > len(self.start):
            more = np.zeros(max(self.count, n) + n, dtype=np.int64)
            self.start, self.size = (np.concatenate([x[: self.count], more]) for x in (self.start, self.size))
        before = np.cumsum(size) - size
        self.points[self.used : self.used + total] = cp[np.repeat(starts - before, size) + np.arange(total)]
        numbers = np.arange(self.count, self.count + n)
        self.start[numbers], self.size[numbers] = self.used + before, size
        self.used, self.count = self.used + total, self.count + n
        return numbers

    def numbers(self, cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
        """The number of each span (none is empty), the spans whose spelling is new in the order of their numbers, and
        whether all numbers given before were forgotten, as happens beyond `most` spellings.
        """
        codes, distinct = pd.factorize(span_hashes(cp, starts, ends))
        hashes = distinct.tolist()
        forgotten = self.count + len(hashes) > self.most
        if forgotten:
            self.forget()
        number = np.fromiter((self.known.get(h, -1) for h in hashes), dtype=np.int64, count=len(hashes))
        new = np.flatnonzero(number < 0)
        if len(new):
            first = np.empty(len(hashes), dtype=np.int64)
            first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
            fresh = first[new]
            number[new] = self._add(cp, starts[fresh], ends[fresh])
            self.known.update((hashes[i], int(number[i])) for i in new)
        else:
            fresh = new
        out = number[codes]
        # Every code point is held against that of the spelling.
        size = ends - starts
        before = np.cumsum(size) - size
        gap = starts - before
        mine = cp[gap[0] : gap[0] + before[-1] + size[-1]] if len(gap) and gap[0] == gap[-1] else None
        place = np.repeat(self.start[out] - before, size)
        place += np.arange(len(place))
        if mine is None:  # spans with something between them
            mine = cp[np.repeat(gap, size) + np.arange(len(place))]
        same = self.points.take(place, mode="clip") == mine
        if not same.all() or (self.size[out] != size).any():
            wrong = np.flatnonzero((self.size[out] != size) | ~np.logical_and.reduceat(same, before))
            more = []
            for i in wrong:
                key = cp[starts[i] : ends[i]].tobytes()
                if key not in self.others:
                    self.others[key] = int(self._add(cp, starts[i : i + 1], ends[i : i + 1])[0])
                    more.append(i)
                out[i] = self.others[key]
            fresh = np.concatenate([fresh, np.array(more, dtype=np.int64)])
        return out, fresh, forgotten
