"""Coverage of integer intervals per entity by canonical dyadic blocks.

A block (level, index) stands for the points index * 2**level .. (index + 1) * 2**level - 1. Every interval is the
disjoint union of at most 2 * bits blocks, whatever its length, and the union of an entity's intervals is the union of
their blocks. Blocks below level 6 that lie in one block of that level, a word, are held together as a bit mask of their
points, and blocks of levels 6 to 11 in one block of level 12, a tile, as a bit mask of words: there a union of sets of
blocks is a union of bits, which merges siblings at once. Masks and blocks of one entity number less than
2**(bits - 5), however many rows it has: they meet in the map-side combine, so an entity that holds a third of all rows
reaches the later stages already reduced.

Stages: within (entity, tile), where there are at most 64 words, words that are full become bits of their tile, and words
that the tile covers are dropped; what is left is lifted to the upper levels and reduced within the entity: blocks that
an ancestor covers are dropped, siblings merged level by level, and blocks that touch coalesced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The domain is 0 .. 2**BITS - 1.
BITS = 22
#: Level of the blocks whose points are the bits of a BIGINT, and levels of the tree that one aggregation merges.
WORD_BITS = 6
#: Level of the blocks whose words are the bits of a BIGINT.
TILE_BITS = 2 * WORD_BITS
#: The last point of the domain, standing for an open end.
OPEN = (1 << BITS) - 1


def dyadic_blocks(rows: DataFrame, keep: list[str]) -> DataFrame:
    """(keep, level INT, idx BIGINT, mask BIGINT): the canonical blocks of each row's lo..hi (both included, lo <= hi).

    At level l the part not yet covered runs from ceil(lo / 2**l) to floor((hi + 1) / 2**l), and a block is due at its
    left end if that is odd and at its right end if that is odd. From TILE_BITS up, every row meets each level up to that
    of its length twice, once for either end, and each block is a row with a full mask. The blocks below WORD_BITS are
    those of the first and the last word, and those from there to TILE_BITS of the first and the last tile: one row of
    level WORD_BITS or TILE_BITS each, whose mask has a bit for each point or each word. Plain columns keep this inside
    generated code.
    """
    w, full = WORD_BITS, (1 << WORD_BITS) - 1
    up = lambda c: F.expr(f"shiftright({c} + {full}, {w})")
    down = lambda c: F.expr(f"shiftright({c}, {w})")
    part = rows.select(*keep, F.col("lo").alias("_x0"), (F.col("hi") + 1).alias("_y0"))
    part = part.select("*", up("_x0").alias("_x1"), down("_y0").alias("_y1"))
    part = part.select("*", up("_x1").alias("_x2"), down("_y1").alias("_y2"))
    # Steps: -4 and -3 are the ends in points, -2 and -1 those in words, from 0 on two for each level of tiles.
    steps = F.when(F.col("_x2") < F.col("_y2"), F.length(F.bin(F.col("_y2") - F.col("_x2"))) * 2 - 1).otherwise(F.when(F.col("_x1") < F.col("_y1"), -1).otherwise(-3))
    part = part.select("*", F.explode(F.sequence(F.lit(-4), steps)).alias("_c"))
    level, points = F.expr("greatest(shiftright(_c, 1), 0)"), F.col("_c") < -2
    x, y = (F.when(points, F.col(f"{n}0")).when(F.col("_c") < 0, F.col(f"{n}1")).otherwise(F.col(f"{n}2")) for n in ("_x", "_y"))
    part = part.select(*keep, "_c", level.alias("_l"), x.alias("_x"), y.alias("_y"), points.alias("_points"))
    left, word, alone = F.col("_c") % 2 == 0, F.col("_c") < 0, F.expr(f"shiftright(_x, {w}) = shiftright(_y - 1, {w})")
    a, e = F.expr("shiftright(_x + shiftleft(1L, _l) - 1, _l)"), F.expr("shiftright(_y, _l)")
    from_left, to_right = F.expr(f"shiftleft(-1L, cast(_x & {full} as int))"), F.expr(f"shiftrightunsigned(-1L, cast({full} - ((_y - 1) & {full}) as int))")
    begins, ends = F.expr(f"_x & {full}") != 0, F.expr(f"_y & {full}") != 0
    due = F.when(word, F.when(left, begins | (alone & ends)).otherwise(~alone & ends) & (F.col("_x") < F.col("_y"))).otherwise((a < e) & (F.when(left, a).otherwise(e) % 2 == 1))
    idx = F.when(word, F.when(left, down("_x")).otherwise(down("_y - 1"))).otherwise(F.when(left, a).otherwise(e - 1))
    mask = F.when(word, F.when(left, F.when(alone, from_left.bitwiseAND(to_right)).otherwise(from_left)).otherwise(to_right)).otherwise(F.lit(-1).cast("bigint"))
    return part.where(due).select(*keep, F.when(F.col("_points"), w).otherwise(F.col("_l") + TILE_BITS).alias("level"), idx.alias("idx"), mask.alias("mask"))


def _tile_runs(blocks: DataFrame, key: str) -> DataFrame:
    """(key, first, last): the runs of every tile, and larger blocks as they are; runs of one tile may touch.

    A word that is full is a bit of its tile. Words under a set bit are covered and dropped.
    """
    w = WORD_BITS
    tile, large = F.expr(f"shiftright(idx, {w})"), F.col("level") > TILE_BITS
    group = F.when(F.col("level") == w, tile).when(large, -1 - F.expr("shiftleft(idx, level)")).otherwise(F.col("idx"))
    point_word, place = F.col("level") == w, F.expr(f"cast(idx & {(1 << w) - 1} as int)")
    bits = F.when(~point_word, F.col("mask")).when(F.col("mask") == -1, F.call_function("shiftleft", F.lit(1).cast("bigint"), place))
    words = F.collect_list(F.when(point_word & (F.col("mask") != -1), F.struct(place.alias("at"), F.col("mask").alias("mask"))))  # at most 64
    tiles = blocks.groupBy(key, group.alias("_tile")).agg(F.coalesce(F.bit_or(bits), F.lit(0).cast("bigint")).alias("_bits"), words.alias("_words"), F.max(F.when(large, F.col("level"))).alias("_level"))
    base = f"shiftleft(_tile, {TILE_BITS})"
    whole = F.expr("array(struct(-1 - _tile as o, -1 - _tile + shiftleft(1L, _level) - 1 as n))")
    full = F.expr(f"array(struct({base} as o, {base} + {(1 << TILE_BITS) - 1} as n))")
    loose = F.filter("_words", lambda x: F.call_function("getbit", F.col("_bits"), x["at"]) == 0)
    of_words = F.flatten(F.transform(loose, lambda x: _bit_runs(x["mask"], F.expr(base) + x["at"] * (1 << w), 1)))
    of_tile = F.when(F.col("_bits") == 0, F.array().cast("array<struct<o:bigint,n:bigint>>")).otherwise(_bit_runs(F.col("_bits"), F.expr(base), 1 << w))
    spans = F.when(F.col("_level").isNotNull(), whole).when(F.col("_bits") == -1, full).otherwise(F.concat(of_tile, of_words))
    return tiles.select(key, F.explode(spans).alias("_x")).select(key, F.col("_x.o").alias("first"), F.col("_x.n").alias("last"))


def _uncovered(df: DataFrame, keys: list[str]) -> DataFrame:
    """Drop the blocks and runs that lie in a larger block of the same group.

    Blocks nest or are disjoint, so in the order of their start, larger first, a block is covered exactly if some
    block before it ends beyond its start.
    """
    w = Window.partitionBy(*keys).orderBy("first", F.desc("last")).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.withColumn("_reach", F.max("last").over(w))
        .where(F.col("_reach").isNull() | (F.col("_reach") < F.col("first")))
        .drop("_reach")
    )


def _bit_runs(bits: Column, base: Column, unit: int) -> Column:
    """ARRAY<STRUCT<o, n>>: first and last point of each run of set bits, each of `unit` points from `base` on.

    A mask of one run, as most are, needs no search.
    """
    starts, ends = (bits.bitwiseAND(F.bitwise_not(f(bits, F.lit(1)))) for f in (lambda x, n: F.call_function("shiftleft", x, n), lambda x, n: F.call_function("shiftrightunsigned", x, n)))
    only = lambda c: F.length(F.bin(c)) - 1
    places = lambda c: F.filter(F.sequence(F.lit(0), F.lit((1 << WORD_BITS) - 1)), lambda i: F.call_function("getbit", c, i) == 1)
    run = lambda a, b: F.struct((base + a * F.lit(unit).cast("bigint")).alias("o"), (base + (b + 1) * F.lit(unit).cast("bigint") - 1).alias("n"))
    return F.when(F.bit_count(starts) == 1, F.array(run(only(starts), only(ends)))).otherwise(F.zip_with(places(starts), places(ends), run))


def _merge_siblings(df: DataFrame, keys: list[str], low: int, high: int) -> DataFrame:
    """Replace sibling blocks by their ancestors, from level `low` up to `high`; other rows pass unchanged.

    WORD_BITS levels are merged in one aggregation: the blocks below one ancestor are marked as bits of its leaves. If
    all are set it is the ancestor, which goes on to the next levels; else no block of a higher level can come of them,
    and they are given as runs of set bits. Grouping by a superset of the keys that the rows are already partitioned by
    needs no exchange. No block may be covered by another.
    """
    out = df
    for level in range(low, high, WORD_BITS):
        levels = min(WORD_BITS, high - level)
        top = level + levels
        size = F.col("last") - F.col("first") + 1
        block = (size >= 1 << level) & (size < 1 << top) & (size.bitwiseAND(size - 1) == 0) & (F.col("first") % size == 0)
        bits = F.expr(f"shiftleft(shiftleft(1L, cast(shiftright(last - first + 1, {level}) as int)) - 1, cast(shiftright(first, {level}) & {(1 << levels) - 1} as int))")
        grouped = out.groupBy(*keys, F.when(block, F.expr(f"shiftright(first, {top})")).otherwise(-1 - F.col("first")).alias("_at")).agg(
            F.bit_or(F.when(block, bits).otherwise(0)).alias("_bits"), F.min("first").alias("first"), F.max("last").alias("last")
        )
        # Rows that passed, single blocks and full sets are one span themselves.
        whole = F.array(F.struct(F.col("first").alias("o"), F.col("last").alias("n")))
        simple = (F.col("_at") < 0) | (F.bit_count("_bits") * (1 << level) == F.col("last") - F.col("first") + 1)
        spans = F.when(simple, whole).otherwise(_bit_runs(F.col("_bits"), F.expr(f"shiftleft(_at, {top})"), 1 << level))
        out = grouped.select(*keys, F.explode(spans).alias("_x")).select(*keys, F.col("_x.o").alias("first"), F.col("_x.n").alias("last"))
    return out


def _coalesce(df: DataFrame, keys: list[str]) -> DataFrame:
    """Join spans that touch or overlap into the longest runs of each group."""
    w = Window.partitionBy(*keys).orderBy("first", "last")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max("last").over(before)
    return (
        df.withColumn("_new", F.when(reach.isNull() | (F.col("first") > reach + 1), 1).otherwise(0))
        .withColumn("_run", F.sum("_new").over(w))
        .groupBy(*keys, "_run")
        .agg(F.min("first").alias("first"), F.max("last").alias("last"))
        .drop("_run")
    )


def covered_runs(df: DataFrame, key: str, lo: str, hi: str, bits: int | None = BITS) -> DataFrame:
    """(key, first BIGINT, last BIGINT): the longest runs of covered points of each key.

    Rows with a null key, null bounds or lo > hi count for nothing. Intervals that meet on consecutive points form one
    run. Bounds outside 0 .. 2**bits - 1 are an error; with `bits` null the domain is measured first, negative points
    included. Other columns of `df` are ignored, whatever their names.
    """
    rows = df.select(F.col(key).alias("key"), F.col(lo).cast("bigint").alias("lo"), F.col(hi).cast("bigint").alias("hi"))
    rows = rows.where(F.col("key").isNotNull() & (F.col("lo") <= F.col("hi")))
    origin = 0
    if bits is None:
        low, high = rows.agg(F.min("lo"), F.max("hi")).first()
        origin, bits = low or 0, max(((high or 0) - (low or 0)).bit_length(), TILE_BITS + 1)
        rows = rows.select("key", (F.col("lo") - origin).alias("lo"), (F.col("hi") - origin).alias("hi"))
    else:
        outside = (F.col("lo") < 0) | (F.col("hi") > (1 << bits) - 1)
        error = F.raise_error(F.format_string(f"%s..%s is outside of 0..2**{bits} - 1", "lo", "hi")).cast("bigint")
        rows = rows.select("key", F.when(outside, error).otherwise(F.col("lo")).alias("lo"), "hi")
    blocks = dyadic_blocks(rows, ["key"]).groupBy("key", "level", "idx").agg(F.bit_or("mask").alias("mask"))
    # A run that fills its tile is a block of level TILE_BITS; from there on within the key.
    upper = _merge_siblings(_uncovered(_tile_runs(blocks, "key"), ["key"]), ["key"], TILE_BITS, bits)
    out = _coalesce(upper, ["key"])
    return out.select(F.col("key").alias(key), *[(F.col(c) + origin).alias(c) if origin else F.col(c) for c in ("first", "last")])


def runs_and_gaps(runs: DataFrame, key: str) -> DataFrame:
    """(key, kind, first, last): the runs as 'period', and each stretch between two runs of a key as 'gap'."""
    w = Window.partitionBy(key).orderBy("first")
    nxt = F.lead("first").over(w)
    return (
        runs.withColumn("_next", nxt)
        .select(
            key,
            F.explode(
                F.filter(
                    F.array(
                        F.struct(F.lit("period").alias("kind"), F.col("first").alias("first"), F.col("last").alias("last")),
                        F.struct(F.lit("gap").alias("kind"), (F.col("last") + 1).alias("first"), (F.col("_next") - 1).alias("last")),
                    ),
                    lambda x: x["last"].isNotNull(),
                )
            ).alias("x"),
        )
        .select(key, "x.kind", "x.first", "x.last")
    )


#: Day 0 of the domain.
EPOCH_DAY = "0001-01-01"
_DAY = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"


def day_number(text: Column) -> Column:
    """Days since 0001-01-01 of a real calendar date written yyyy-MM-dd; null for any other text."""
    return F.when(text.rlike(_DAY), F.datediff(F.try_to_date(text, "yyyy-MM-dd"), F.lit(EPOCH_DAY).cast("date")))


def day_text(n: Column) -> Column:
    return F.date_format(F.date_add(F.lit(EPOCH_DAY).cast("date"), n.cast("int")), "yyyy-MM-dd")


def periods_and_gaps(app: DataFrame) -> DataFrame:
    """(hid, kind, first_day, last_day) of the rows (hid, stime, etime).

    A row counts if stime is a real day and etime is a real day not before it or the text 'null' (open end); rows with
    a null hid, missing or impossible days or a reversed interval count for nothing. A hid without any countable row
    has no result. An open period has last_day 'null'. Repeated rows change nothing.
    """
    rows = app.select(
        "hid",
        day_number(F.col("stime")).alias("lo"),
        F.when(F.col("etime") == "null", F.lit(OPEN)).otherwise(day_number(F.col("etime"))).alias("hi"),
    )
    out = runs_and_gaps(covered_runs(rows, "hid", "lo", "hi"), "hid")
    return out.select(
        "hid",
        "kind",
        day_text(F.col("first")).alias("first_day"),
        F.when(F.col("last") == OPEN, F.lit("null")).otherwise(day_text(F.when(F.col("last") < OPEN, F.col("last")))).alias("last_day"),
    )
