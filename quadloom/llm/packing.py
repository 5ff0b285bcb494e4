"""Filling containers of fixed capacity with texts, by patterns of few lengths.

Lengths are rounded up to BINS steps of the capacity, and the histogram of steps (bounded, whatever the corpus) goes to
the driver. There, patterns that fill a container exactly (one length up to MOST_EQUAL times and up to two others) get
repeat counts by non-negative least squares against the histogram; the counts are rounded down, and what they leave is
packed largest first, in bulk, by the same steps. The plan is a table of a few hundred patterns. Every text then finds
its place from its rank among the texts of its step; ranks are counted in hashed chunks, so that a step which holds a
third of all texts is not one task.

Where a step is more than a token, short texts are also packed the same way, by finer steps, into bundles of a twelfth
of the capacity, which then take part by their true lengths; a kind keeps the bundles if they save containers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadloom.session import cut_lineage

#: Steps of length that a capacity is divided into, at most.
BINS = 384
#: Times that the first length of a pattern may repeat.
MOST_EQUAL = 12
#: Bundles of short texts that a container holds. A text is short if two fit into a bundle.
BUNDLES = 12
#: Items counted by one task, on average.
CHUNK_ITEMS = 100_000


@dataclass
class Plan:
    """`slots[step]` = (first rank, first container, items per container, first slot) of every stretch of ranks."""

    containers: int
    slots: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def step_of(tokens: np.ndarray | int, capacity: int) -> np.ndarray:
    bins = min(BINS, capacity)
    return -(-np.asarray(tokens, dtype=np.int64) * bins // capacity)


def patterns(histogram: np.ndarray) -> np.ndarray:
    """(a, k, b, c) with k * a + b + c = bins, of steps that occur; 0 is none. b >= c, and a > b where k is 1."""
    bins = len(histogram) - 1
    present = np.flatnonzero(histogram > 0)
    present = present[present > 0]
    there = np.zeros(bins + 1, dtype=bool)
    there[present] = True
    there[0] = True
    out = []
    for k in range(1, MOST_EQUAL + 1):
        a = present[present * k <= bins]
        if not len(a):
            break
        rest = bins - k * a
        b = np.concatenate([[0], present])
        grid_a, grid_b = np.meshgrid(a, b, indexing="ij")
        grid_c = (bins - k * grid_a) - grid_b
        ok = (grid_c >= 0) & (grid_c <= grid_b)
        ok &= there[np.where(ok, grid_c, 0)]
        if k == 1:
            ok &= grid_b < grid_a + (rest[:, None] == 0)
        x = np.stack([grid_a[ok], np.full(ok.sum(), k), grid_b[ok], grid_c[ok]], axis=1)
        out.append(x)
    return np.concatenate(out) if out else np.zeros((0, 4), dtype=np.int64)


def solved(dense: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The least-squares solution by the normal equations; by singular values where those are not to be trusted."""
    try:
        z = np.linalg.solve(dense.T @ dense, dense.T @ h)
        right = np.abs(dense.T @ (h - dense @ z)).max() <= 1e-8 * max(1.0, np.abs(h).max())
    except np.linalg.LinAlgError:
        right = False
    return z if right else np.linalg.lstsq(dense, h, rcond=None)[0]


def least_squares(cols: np.ndarray, histogram: np.ndarray) -> np.ndarray:
    """x >= 0 minimising |A x - histogram|, by the active-set method; A has the patterns `cols` as its columns."""
    h = histogram.astype(float)
    n, size = len(cols), len(h)
    a, k, b, c = cols.T
    length = np.sqrt(k.astype(float) ** 2 + (b > 0) + (c > 0))
    x = np.zeros(n)
    active: list[int] = []
    dense = np.zeros((size, 0))
    residual = h.copy()
    tolerance = 1e-7 * max(1.0, np.abs(h).max())
    banned = np.zeros(n, dtype=bool)

    def column(j: int) -> np.ndarray:
        v = np.zeros(size)
        v[a[j]] += k[j]
        for s in (b[j], c[j]):
            if s:
                v[s] += 1
        return v

    for _ in range(4 * size):
        r = residual.copy()
        r[0] = 0.0
        gain = (k * r[a] + r[b] + r[c]) / length
        gain[active] = -np.inf
        gain[banned] = -np.inf
        j = int(gain.argmax())
        if gain[j] <= tolerance:
            break
        active.append(j)
        dense = np.column_stack([dense, column(j)])
        while True:
            z = solved(dense, h)
            if (z > 0).all():
                x[active] = z
                break
            # Step towards z as far as all stay non-negative, then drop those at zero.
            old = x[active]
            low = z <= 0
            share = min(old[low] / np.maximum(old[low] - z[low], 1e-300))
            now = old + share * (z - old)
            stay = now > 1e-9 * max(1.0, now.max())
            if not stay[-1] and share == 0:
                banned[j] = True
            x[active] = 0.0
            active = [i for i, s in zip(active, stay, strict=True) if s]
            dense = dense[:, stay]
            x[active] = now[stay]
            if not active:
                break
        residual = h - dense @ x[active] if active else h.copy()
        if not banned[j]:
            banned[:] = False
    return x


def largest_first(left: np.ndarray) -> list[tuple[list[tuple[int, int]], int]]:
    """([(step, times)], repeats) for what is left: each container takes the largest that fits, again and again."""
    left, bins, out = left.copy(), len(left) - 1, []
    while left.any():
        room, used = bins, []
        step = bins
        while room > 0:
            there = np.flatnonzero(left[1 : min(step, room) + 1]) + 1
            if not len(there):
                break
            step = int(there[-1])
            times = int(min(room // step, left[step]))
            used.append((step, times))
            room -= times * step
            step -= 1
        repeats = int(min(left[s] // t for s, t in used))
        for s, t in used:
            left[s] -= t * repeats
        out.append((used, repeats))
    return out


def make_plan(histogram: np.ndarray) -> Plan:
    """The plan for counts of items by step (index 0 unused)."""
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    cols = patterns(left)
    chosen: list[tuple[list[tuple[int, int]], int]] = []
    if len(cols):
        x = least_squares(cols, left)
        for j in np.argsort(-x, kind="stable"):
            if x[j] < 1:
                break
            need: dict[int, int] = {}
            a, k, b, c = cols[j].tolist()
            for s, t in ((a, k), (b, 1), (c, 1)):
                if s:
                    need[s] = need.get(s, 0) + t
            repeats = min(int(x[j] + 1e-6), *(int(left[s]) // t for s, t in need.items()))
            if repeats:
                for s, t in need.items():
                    left[s] -= t * repeats
                chosen.append((list(need.items()), repeats))
    chosen += largest_first(left)
    parts: dict[int, list[tuple[int, int, int, int]]] = {}
    rank, container = np.zeros(len(left), dtype=np.int64), 0
    for need, repeats in chosen:
        slot = 0
        for s, t in need:
            parts.setdefault(s, []).append((int(rank[s]), container, t, slot))
            rank[s] += t * repeats
            slot += t
        container += repeats
    return Plan(container, {s: tuple(np.array(v, dtype=np.int64) for v in zip(*rows, strict=True)) for s, rows in parts.items()})


def items(lengths: DataFrame, containers: DataFrame) -> DataFrame:
    """(kind, capacity, doc_id, piece_no INT, first_token BIGINT, n_tokens BIGINT): what is to be packed.

    A text no longer than the container is one item; a longer one is cut into whole containers and the rest. Texts
    without tokens are no items.
    """
    kinds = containers.select(F.col("container_kind").alias("kind"), F.col("capacity_tokens").cast("bigint").alias("capacity"))
    kinds = kinds.where((F.col("capacity") > 0) & F.col("kind").isNotNull()).groupBy("kind").agg(F.max("capacity").alias("capacity"))
    rows = lengths.where(F.col("n_tokens") > 0).crossJoin(F.broadcast(kinds))  # fixed: a row per kind of container
    pieces = F.sequence(F.lit(0).cast("bigint"), F.expr("(n_tokens - 1) div capacity"))
    out = rows.select("kind", "capacity", "doc_id", F.col("n_tokens").alias("all"), F.explode(pieces).alias("i"))
    first = F.col("i") * F.col("capacity")
    return out.select(
        "kind", "capacity", "doc_id", F.col("i").cast("int").alias("piece_no"), first.alias("first_token"),
        F.least("capacity", F.col("all") - first).alias("n_tokens"),
    )


def stepped(todo: DataFrame) -> DataFrame:
    return todo.withColumn("step", F.expr("(n_tokens * {b} + capacity - 1) div capacity".format(b=f"least({BINS}L, capacity)")).cast("int"))


def plans_of(todo: DataFrame) -> tuple[dict[str, Plan], int]:
    """A plan for every kind of `todo` (kind, capacity, n_tokens), and the number of its rows."""
    bins = F.least(F.lit(BINS).cast("bigint"), F.col("capacity"))
    # At most one row per kind and step: bounded by the number of kinds times BINS.
    counted = stepped(todo).groupBy("kind", bins.alias("bins"), "step").agg(F.count(F.lit(1)).alias("n")).collect()
    histograms: dict[str, np.ndarray] = {}
    for r in counted:
        histograms.setdefault(r.kind, np.zeros(r.bins + 1, dtype=np.int64))[r.step] = r.n
    return {kind: make_plan(h) for kind, h in histograms.items()}, sum(r.n for r in counted)


def placed(todo: DataFrame, plans: dict[str, Plan], n: int, ids: list[str]) -> DataFrame:
    """The `n` rows of `todo` (kind, capacity, n_tokens, `ids`) with `at` (container BIGINT, slot INT), by the plans."""
    todo = stepped(todo)
    shared = todo.sparkSession.sparkContext.broadcast({k: p.slots for k, p in plans.items()})
    chunks = max(1, n // CHUNK_ITEMS)
    group = ["kind", "step", "chunk"]
    todo = todo.withColumn("chunk", F.pmod(F.xxhash64(*ids), F.lit(chunks)).cast("int"))
    sizes = todo.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("kind", "step").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(*group, F.coalesce(before, F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy(*group).orderBy(*ids, "n_tokens")) - 1
    ranked = todo.withColumn("own", own).join(sizes, group).withColumn("rank", F.col("own") + F.col("before"))

    @F.pandas_udf("struct<container:bigint,slot:int>")
    def place(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for kind, step, rank in parts:
            container, slot = np.zeros(len(rank), dtype=np.int64), np.zeros(len(rank), dtype=np.int32)
            r = rank.to_numpy(dtype=np.int64)
            for (k, s), rows in pd.DataFrame({"k": kind, "s": step}).groupby(["k", "s"], sort=False).indices.items():
                start, first, times, base = shared.value[k][int(s)]
                at = np.searchsorted(start, r[rows], side="right") - 1
                more = r[rows] - start[at]
                container[rows] = first[at] + more // times[at]
                slot[rows] = base[at] + more % times[at]
            yield pd.DataFrame({"container": container, "slot": slot})

    return ranked.withColumn("at", place("kind", "step", "rank")).drop("step", *group[2:], "own", "before", "rank")


def pack(lengths: DataFrame, containers: DataFrame) -> DataFrame:
    """(container_kind, container_id BIGINT, slot INT, doc_id, piece_no INT, first_token, n_tokens BIGINT).

    Every item (see items) is in exactly one container of each kind, and no container holds more than its capacity.
    Texts without tokens have one row for each kind, with null container_id and slot and n_tokens 0. `lengths` is
    (doc_id, n_tokens), read several times; give it from files or a checkpoint. Rows with the same doc_id are items of
    their own.
    """
    todo = items(lengths, containers)
    plans, n = plans_of(todo)
    last = ["doc_id", "piece_no", "first_token", "n_tokens"]
    unit = F.expr(f"capacity div {BUNDLES}")
    short = (F.col("capacity") > BINS) & (2 * F.col("n_tokens") <= unit)
    few = todo.where(short).withColumns({"whole": F.col("capacity"), "capacity": unit})
    inner, n_few = plans_of(few)
    better: dict[str, Plan] = {}
    if inner:
        inside = cut_lineage(placed(few, inner, n_few, ["doc_id", "piece_no"]).withColumn("bundle", F.col("at.container")))  # read twice
        bundles = inside.groupBy("kind", F.col("whole").alias("capacity"), "bundle").agg(F.sum("n_tokens").alias("n_tokens"))
        bundles = cut_lineage(bundles)
        fine, _ = plans_of(todo.where(~short & F.col("kind").isin(*inner)).select("kind", "capacity", "n_tokens").unionByName(bundles.drop("bundle")))
        better = {k: p for k, p in fine.items() if p.containers < plans[k].containers}
    if better:
        short &= F.col("kind").isin(*better)
        inside, bundles = (x.where(F.col("kind").isin(*better)) for x in (inside, bundles))
        outer = todo.where(~short).withColumn("bundle", F.lit(None).cast("bigint")).unionByName(bundles, allowMissingColumns=True)
        outer = cut_lineage(placed(outer, plans | better, n, ["doc_id", "piece_no", "bundle"]))  # read twice
        to = outer.where(F.col("bundle").isNotNull()).select("kind", "bundle", F.col("at").alias("to"))
        bundled = inside.join(to, ["kind", "bundle"]).select("kind", "to", F.col("at.slot").alias("in"), *last)
        out = outer.where(F.col("bundle").isNull()).select("kind", F.col("at").alias("to"), F.lit(0).alias("in"), *last).unionByName(bundled)
        slot = F.row_number().over(Window.partitionBy("kind", "to.container").orderBy("to.slot", "in")) - 1
    else:
        out, slot = placed(todo, plans, n, ["doc_id", "piece_no"]).withColumn("to", F.col("at")), F.col("to.slot")
    packed = out.select(F.col("kind").alias("container_kind"), F.col("to.container").alias("container_id"), slot.alias("slot"), *last)
    kinds = containers.where((F.col("capacity_tokens") > 0) & F.col("container_kind").isNotNull()).select("container_kind").distinct()
    empty = lengths.where(F.coalesce(F.col("n_tokens"), F.lit(0)) <= 0).crossJoin(F.broadcast(kinds))
    zero = F.lit(0).cast("bigint")
    return packed.unionByName(
        empty.select(
            "container_kind", F.lit(None).cast("bigint").alias("container_id"), F.lit(None).cast("int").alias("slot"),
            "doc_id", F.lit(0).alias("piece_no"), zero.alias("first_token"), zero.alias("n_tokens"),
        )
    )


def fill_report(packed: DataFrame, containers: DataFrame) -> DataFrame:
    """(container_kind, n_containers, n_items, n_tokens, least_containers BIGINT, fill DOUBLE) of a packing."""
    sums = packed.where(F.col("container_id").isNotNull()).groupBy("container_kind").agg(
        (F.max("container_id") + 1).alias("n_containers"), F.count(F.lit(1)).alias("n_items"), F.sum("n_tokens").alias("n_tokens")
    )
    caps = containers.groupBy("container_kind").agg(F.max("capacity_tokens").cast("bigint").alias("capacity"))
    return sums.join(F.broadcast(caps), "container_kind").select(
        "container_kind", "n_containers", "n_items", "n_tokens",
        F.ceil(F.col("n_tokens") / F.col("capacity")).alias("least_containers"),
        (F.col("n_tokens") / (F.col("n_containers") * F.col("capacity"))).alias("fill"),
    )


def measured(documents: DataFrame) -> DataFrame:
    """(doc_id, n_tokens) by byte_bpe_50k, written once to the shared checkpoint folder."""
    from quadloom.llm.tokenizer import token_counts

    return cut_lineage(token_counts(documents))
