"""Token ids and token counts of whole corpora by a public byte-level BPE vocabulary.

A text is cut into pieces by the vocabulary's pattern, and each distinct piece is encoded once per worker. Pieces are
encoded many at a time: pieces of similar length form a padded matrix of token ids, one piece a row. In each round every
row merges its leftmost pair of least rank; ranks come from an open-addressing hash table of pairs, only the two pairs
beside a merge are looked up again, and rows without a pair left drop out.
"""

from __future__ import annotations

import base64
import heapq
import os
import sys
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame

from quadloom.llm.spans import Spelled
from quadloom.session import spread

#: Folder of the public vocabularies; set QUADLOOM_TOKENIZERS or pass a path.
TOKENIZERS = os.environ.get("QUADLOOM_TOKENIZERS", "/opt/tokenizers")
#: Pattern of the pieces of byte_bpe_50k (fixed value of that vocabulary).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_NONE = np.int32(2**31 - 1)
#: Longest piece in bytes that goes into a matrix; a longer one would be shifted too often and merges over a heap.
LONGEST_ROW = 1024
#: Cells of one matrix.
MATRIX_CELLS = 1 << 20
#: Pieces that a worker remembers; beyond that it starts anew.
REMEMBERED = 400_000
#: Characters handled at once.
CHUNK = 1 << 20


class PairTable:
    """Merged id of a pair of ids, by hashing with linear probing. An id is its rank."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        keys, values = [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    values.append(rank)
        bits = max(4, (len(keys) * 4).bit_length())
        self.shift = np.uint64(64 - bits)
        self.mask = (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, dtype=np.int64)
        self.values = np.full(1 << bits, _NONE, dtype=np.int32)
        left = np.array(keys, dtype=np.int64)
        value = np.array(values, dtype=np.int32)
        slot = self._slot(left)
        while len(left):
            free = self.keys[slot] == -1
            _, first = np.unique(np.where(free, slot, -1 - np.arange(len(slot))), return_index=True)
            won = np.zeros(len(slot), dtype=bool)
            won[first] = True
            won &= free
            self.keys[slot[won]], self.values[slot[won]] = left[won], value[won]
            left, value, slot = left[~won], value[~won], (slot[~won] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merged id of each pair, _NONE where there is none; ids below 0 are padding."""
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        out = np.full(keys.shape, _NONE, dtype=np.int32)
        flat, at = out.reshape(-1), np.flatnonzero((left.reshape(-1) >= 0) & (right.reshape(-1) >= 0))
        want = keys.reshape(-1)[at]
        slot = self._slot(want)
        while len(at):
            seen = self.keys[slot]
            hit = seen == want
            flat[at[hit]] = self.values[slot[hit]]
            on = ~hit & (seen != -1)
            at, want, slot = at[on], want[on], (slot[on] + 1) & self.mask
        return out


_OTHER, _LETTER, _DIGIT, _BLANK = range(4)


@lru_cache(maxsize=1)
def char_classes() -> np.ndarray:
    """The class of every code point, by the classes that PATTERN names."""
    out = np.zeros(sys.maxunicode + 1, dtype=np.uint8)
    every = "".join(map(chr, range(0xD800))) + "".join(map(chr, range(0xE000, sys.maxunicode + 1)))
    for kind, name in ((_LETTER, r"\p{L}+"), (_DIGIT, r"\p{N}+"), (_BLANK, r"\s+")):
        for m in regex.finditer(name, every):
            a, b = ord(every[m.start()]), ord(every[m.end() - 1])
            out[a : b + 1] = kind
    return out


def piece_starts(cp: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Where the pieces of PATTERN begin in code points `cp`; `docs` are the beginnings of texts.

    Pieces are runs of one class. The last blank before a non-blank is split from the blanks before it, and joins what
    follows if it is a space. A quote that begins a piece and is followed by one of the endings is cut behind them.
    """
    kind = char_classes()[cp]
    n = len(cp)
    first = np.zeros(n + 1, dtype=bool)
    first[docs] = True
    start = np.ones(n, dtype=bool)
    start[1:] = kind[1:] != kind[:-1]
    start |= first[:n]
    blank = kind == _BLANK
    # The last blank of a run that is followed by a non-blank of the same text.
    last = np.zeros(n, dtype=bool)
    last[:-1] = blank[:-1] & ~blank[1:] & ~first[1:n]
    start |= last
    joins = last & (cp == 32)
    start[1:] &= ~joins[:-1]
    quote = np.flatnonzero(cp == 39)
    if len(quote):
        before = np.where(first[quote], -1, cp[np.maximum(quote, 1) - 1].astype(np.int64))
        kind_before = np.where(first[quote], _BLANK, kind[np.maximum(quote, 1) - 1])
        quote = quote[(kind_before != _OTHER) & (before != 32)]
        ends = np.append(np.searchsorted(docs, quote, side="right"), 0)[:-1]
        limit = np.append(docs, n)[ends]
        at = lambda k: np.where(quote + k < limit, cp[np.minimum(quote + k, n - 1)], 0)
        one, two = at(1), at(2)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        size = np.where(short, 2, np.where(long, 3, 0))
        quote, size = quote[size > 0], size[size > 0]
        start[quote + 1] = False
        after = quote + size
        start[after[after < n]] = True
    return np.flatnonzero(start)


class Vocabulary:
    """A byte-level BPE vocabulary whose ids are the ranks of its tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN) -> None:
        if pattern != PATTERN:
            raise ValueError("piece_starts cuts by PATTERN only")
        self.whole = ranks
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.pairs = PairTable(ranks)
        self.spelled = Spelled(REMEMBERED)
        self._forget()

    def _forget(self) -> None:
        """The ids of the piece with number i are flat[at[i] : at[i] + size[i]]."""
        self.flat = np.zeros(0, dtype=np.int32)
        self.at = np.zeros(0, dtype=np.int64)
        self.size = np.zeros(0, dtype=np.int64)

    @classmethod
    def read(cls, path: str, pattern: str = PATTERN) -> Vocabulary:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}, pattern)

    def _merge_matrix(self, ids: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
        """The tokens of each row of `ids`, of which the first `lengths` cells are filled and the rest is -1."""
        done: list[np.ndarray] = [ids[0, :0]] * len(ids)
        row = np.arange(len(ids))
        lengths = lengths.copy()
        ranks = self.pairs.rank(ids[:, :-1], ids[:, 1:])
        while len(row):
            at = ranks.argmin(axis=1)
            here = np.arange(len(row))
            best = ranks[here, at]
            over = best == _NONE
            for i in np.flatnonzero(over):
                done[row[i]] = ids[i, : lengths[i]].copy()
            on = ~over
            row, lengths, at, best = row[on], lengths[on] - 1, at[on], best[on]
            if not len(row):
                break
            ids, ranks, here = ids[on], ranks[on], np.arange(len(row))
            # Close the gap behind each merge; the matrix loses its last column.
            cols = np.arange(ids.shape[1] - 1)
            ids[here, at] = best
            ids = np.take_along_axis(ids, cols + (cols > at[:, None]), axis=1)
            if ids.shape[1] == 1:
                for i, r in enumerate(row):
                    done[r] = ids[i].copy()
                break
            cols = np.arange(ids.shape[1] - 1)
            ranks = np.take_along_axis(ranks, np.minimum(cols + (cols >= at[:, None]), ranks.shape[1] - 1), axis=1)
            for beside in (at - 1, at):
                fit = np.flatnonzero((beside >= 0) & (beside < ids.shape[1] - 1))
                b = beside[fit]
                ranks[fit, b] = self.pairs.rank(ids[fit, b], ids[fit, b + 1])
            width = int(lengths.max())
            if width < ids.shape[1] and width >= 2:
                ids, ranks = ids[:, :width], ranks[:, : width - 1]
        return done

    def _merge_long(self, data: bytes) -> np.ndarray:
        """The same merges on one long piece, with a heap of (rank, place) over a linked list."""
        ids = self.bytes[np.frombuffer(data, dtype=np.uint8)]
        n = len(ids)
        ranks = self.pairs.rank(ids[:-1], ids[1:])
        tok, nxt, prv = ids.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        rank = [*ranks.tolist(), int(_NONE)]
        heap = [(r, i) for i, r in enumerate(rank) if r != _NONE]
        heapq.heapify(heap)
        pair = lambda a, b: int(self.pairs.rank(np.array([a], np.int32), np.array([b], np.int32))[0])
        while heap:
            r, i = heapq.heappop(heap)
            if rank[i] != r:
                continue
            j = nxt[i]
            tok[i], nxt[i], rank[j] = r, nxt[j], -1
            if nxt[i] < n:
                prv[nxt[i]] = i
            for k in (prv[i], i):
                if k >= 0:
                    rank[k] = pair(tok[k], tok[nxt[k]]) if nxt[k] < n else int(_NONE)
                    if rank[k] != _NONE:
                        heapq.heappush(heap, (rank[k], k))
        out, i = [], 0
        while i < n:
            out.append(tok[i])
            i = nxt[i]
        return np.array(out, dtype=np.int32)

    def encode_pieces(self, pieces: Iterable[str]) -> dict[str, tuple[int, ...]]:
        """The ids of each piece."""
        out: dict[str, tuple[int, ...]] = {}
        rest: list[tuple[int, str, bytes]] = []
        for p in pieces:
            data = p.encode("utf-8", "replace")
            if (one := self.whole.get(data)) is not None:
                out[p] = (one,)
            elif len(data) > LONGEST_ROW:
                out[p] = tuple(self._merge_long(data).tolist())
            elif data:
                rest.append((len(data), p, data))
        rest.sort(key=lambda x: x[0])
        start = 0
        while start < len(rest):
            # Rows of similar length: at most a quarter longer than the first, and as many as the matrix takes.
            least, end = rest[start][0], start
            while end < len(rest) and rest[end][0] <= least + least // 4 and (end - start + 1) * rest[end][0] <= MATRIX_CELLS:
                end += 1
            end = max(end, start + 1)
            part = rest[start:end]
            lengths = np.array([x[0] for x in part])
            ids = np.full((len(part), int(lengths.max())), -1, dtype=np.int32)
            ids[np.arange(ids.shape[1]) < lengths[:, None]] = self.bytes[np.frombuffer(b"".join(x[2] for x in part), dtype=np.uint8)]
            for (_, p, _), row in zip(part, self._merge_matrix(ids, lengths), strict=True):
                out[p] = tuple(row.tolist())
            start = end
        return out

    def _look_up(self, text: str, cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each piece in `at` and `size`; new pieces are encoded."""
        place, new, forgotten = self.spelled.numbers(cp, starts, ends)
        if forgotten:
            self._forget()
        if len(new):
            pieces = [text[starts[i] : ends[i]] for i in new]
            found = self.encode_pieces(pieces)
            rows = [found[p] for p in pieces]
            size = np.array([len(r) for r in rows], dtype=np.int64)
            self.at = np.concatenate([self.at, len(self.flat) + np.cumsum(size) - size])
            self.size = np.concatenate([self.size, size])
            self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(rows), dtype=np.int32)])
        return place

    def _places(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The place of every piece, and the number of pieces before each text and at the end."""
        text = "".join(texts)
        cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        doc = np.concatenate([[0], np.cumsum(lengths)])
        if not len(cp):
            return np.zeros(0, dtype=np.int64), np.zeros(len(texts) + 1, dtype=np.int64)
        starts = piece_starts(cp, doc[:-1][lengths > 0])
        ends = np.append(starts[1:], len(cp))
        return self._look_up(text, cp, starts, ends), np.searchsorted(starts, doc)

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and the number of ids of each text."""
        places, doc = self._places(texts)
        size = self.size[places]
        before = np.concatenate([[0], np.cumsum(size)])
        flat = self.flat[np.repeat(self.at[places] - before[:-1], size) + np.arange(before[-1])]
        return flat, np.diff(before[doc])

    def counts(self, texts: list[str]) -> np.ndarray:
        places, doc = self._places(texts)
        return np.diff(np.concatenate([[0], np.cumsum(self.size[places])])[doc])


def vocabulary_path(name: str, folder: str | None = None) -> str:
    return os.path.join(folder or TOKENIZERS, f"{name}.tiktoken")


_OPEN: dict[int, Vocabulary] = {}


def share(df: DataFrame, name: str, folder: str | None = None) -> Broadcast:
    """The ranks of a public vocabulary for the workers: fixed in size, 50,256 tokens for byte_bpe_50k."""
    with open(vocabulary_path(name, folder), "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def opened(shared: Broadcast) -> Vocabulary:
    """The vocabulary, built once per Python worker."""
    data = shared.value
    key = hash(data)
    if key not in _OPEN:
        _OPEN[key] = Vocabulary({base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())})
    return _OPEN[key]


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Stretches of about CHUNK characters; a longer text is one of its own."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHUNK:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def token_ids(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """(key, ids ARRAY<INT>): the ids of every text, without special tokens.

    Null and empty texts have the empty list. Strings of special tokens in a text are ordinary text. Every row is kept,
    also repeated ones and those with a null key; other columns are dropped.
    """
    shared = share(df, vocabulary, folder)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = opened(shared)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            for lo, hi in _chunks(texts):
                flat, counts = v.ids(texts[lo:hi])
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), lists], names=[key, "ids"])

    rows = spread(df.select(key, text))
    return rows.mapInArrow(encode, f"`{key}` {rows.dtypes[0][1]}, ids array<int>")


def token_counts(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """(key, n_tokens BIGINT): the number of ids of every text; 0 for null and empty texts."""
    shared = share(df, vocabulary, folder)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = opened(shared)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            counts = [v.counts(texts[lo:hi]) for lo, hi in _chunks(texts)]
            n = np.concatenate(counts) if counts else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n)], names=[key, "n_tokens"])

    rows = spread(df.select(key, text))
    return rows.mapInArrow(count, f"`{key}` {rows.dtypes[0][1]}, n_tokens bigint")


__all__ = ["PATTERN", "PairTable", "Vocabulary", "token_counts", "token_ids", "vocabulary_path"]
