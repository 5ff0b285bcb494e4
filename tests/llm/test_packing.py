"""Packing: nothing lost, nothing too full, little left empty."""

import random
from collections import Counter

import numpy as np
import pytest

from quadloom.llm import packing as P

KINDS = [("small", 64), ("large", 1000), ("tiny", 3), (None, 10), ("none", 0), ("large", 1000)]


def check(spark, lengths, kinds=KINDS):
    df = spark.createDataFrame(lengths, "doc_id long, n_tokens long")
    cont = spark.createDataFrame(kinds, "container_kind string, capacity_tokens int")
    out = P.pack(df, cont).collect()
    caps = {k: c for k, c in kinds if k and c}
    for kind, cap in caps.items():
        mine = [r for r in out if r.container_kind == kind]
        want = Counter()
        for d, n in lengths:
            n = n or 0
            for i in range(max(1, -(-n // cap))):
                want[(d, i, i * cap, min(cap, n - i * cap) if n > 0 else 0)] += 1
        assert Counter((r.doc_id, r.piece_no, r.first_token, r.n_tokens) for r in mine) == want
        load, slots = Counter(), set()
        for r in mine:
            assert (r.container_id is None) == (r.n_tokens == 0)
            if r.container_id is not None:
                load[r.container_id] += r.n_tokens
                assert (r.container_id, r.slot) not in slots
                slots.add((r.container_id, r.slot))
        assert all(v <= cap for v in load.values())
        assert sorted(load) == list(range(len(load)))
        yield kind, sum(load.values()), len(load) * cap


def test_pack_small(spark):
    lengths = [(1, 0), (2, None), (3, 1), (4, 64), (5, 65), (6, 1000), (7, 100_000), (8, 3), (8, 3), (None, 5)]
    assert {k for k, *_ in check(spark, lengths)} == {"small", "large", "tiny"}


def test_pack_fill(spark, monkeypatch):
    monkeypatch.setattr(P, "CHUNK_ITEMS", 300)
    random.seed(1)
    lengths = [(i, int(random.lognormvariate(5, 0.8))) for i in range(3000)] + [(i + 3000, 40) for i in range(1500)]
    fills = {k: used / room for k, used, room in check(spark, lengths)}
    # 40s fit only with remainders of at most 24 in the small kind, and there are fewer of those than 40s.
    assert fills["large"] > 0.97 and fills["small"] > 0.93


def test_nothing_to_pack(spark):
    assert list(check(spark, [(1, 0)])) != []
    df = spark.createDataFrame([], "doc_id long, n_tokens long")
    assert P.pack(df, spark.createDataFrame(KINDS, "container_kind string, capacity_tokens int")).collect() == []


def test_patterns_fill_exactly():
    h = np.zeros(33, dtype=np.int64)
    h[[3, 5, 8, 16, 32, 27]] = 10
    cols = P.patterns(h)
    assert len(cols) == len({tuple(sorted([a] * k + [b, c])) for a, k, b, c in cols.tolist()})
    assert ((cols[:, 0] * cols[:, 1] + cols[:, 2] + cols[:, 3]) == 32).all()
    assert (32, 1, 0, 0) in set(map(tuple, cols.tolist())) and (16, 2, 0, 0) in set(map(tuple, cols.tolist()))


def test_least_squares_is_optimal():
    rng = np.random.default_rng(3)
    h = np.zeros(25, dtype=np.int64)
    h[1:] = rng.integers(0, 50, 24)
    cols = P.patterns(h)
    x = P.least_squares(cols, h)
    a = np.zeros((25, len(cols)))
    for j, (s, k, b, c) in enumerate(cols.tolist()):
        a[s, j] += k
        for t in (b, c):
            if t:
                a[t, j] += 1
    gradient = a.T @ (h - a @ x)
    assert (x >= 0).all() and gradient.max() < 1e-4 and np.abs(gradient[x > 0]).max() < 1e-4


@pytest.mark.parametrize("seed", range(3))
def test_plan_uses_every_item_once(seed):
    rng = np.random.default_rng(seed)
    h = np.concatenate([[0], rng.integers(0, 200, 64)])
    plan = P.make_plan(h)
    load = np.zeros(plan.containers, dtype=np.int64)
    for step, n in enumerate(h):
        if n:
            start, first, times, _ = plan.slots[step]
            r = np.arange(n)
            at = np.searchsorted(start, r, side="right") - 1
            np.add.at(load, first[at] + (r - start[at]) // times[at], step)
    assert load.max() <= 64 and load.min() > 0 and load.sum() == (h * np.arange(65)).sum()


def test_short_texts_fill_large_containers(spark):
    # A step of 1/384 is 21.3 tokens here.
    for n in (1, 22):
        lengths = [(i, n) for i in range(3 * 8192 // n)]
        [(_, used, room)] = check(spark, lengths, [("large", 8192)])
        assert used / room > 0.7
    random.seed(4)
    lengths = [(i, random.randint(1, 60)) for i in range(5000)]
    [(_, used, room)] = check(spark, lengths, [("large", 8192)])
    assert used / room > 0.9
