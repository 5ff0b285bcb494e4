"""Current state of a table from a feed of inserts, updates and deletes that arrives repeated and out of order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def operation(text: Column) -> Column:
    """'insert', 'update' or 'delete' for any spelling that begins with i, u or d; null otherwise."""
    c = F.lower(F.substring(F.ltrim(text), 1, 1))
    return F.when(c == "i", "insert").when(c == "u", "update").when(c == "d", "delete")


def fold_state(
    changes: DataFrame, keys: list[str], seq: Column, op: Column, values: list[str], state: DataFrame | None = None, base: DataFrame | None = None
) -> DataFrame:
    """(keys, _last STRUCT<r, q, in>, _v_<value> STRUCT<r, q, v> for each value): what is known of every key after all changes.

    Per key these maxima of (sequence, ...) are kept: the last insert or delete, and for each value the last insert
    (whatever it sets) or update that is not null. Maxima neither depend on order nor on repetition, and they combine
    before the shuffle, so a key with a third of all changes sends one row per task.

    A deleted key stays as a tombstone with its sequence, and a key of which only updates came stays with those. So the
    result, given as `state` to a later call, is as good as all the changes that it was folded from: any split of a
    feed into batches, folded in any order, ends in the same state, and a change that comes late, from before a
    delete or an update that was folded long ago, changes nothing it must not. Rows of `base` (keys, values), a table
    without sequences, count as inserts before every change. Rows with a null sequence rank before the others, rows
    with an unknown operation count for nothing; null is a key like any other. Of two changes with the same sequence
    an insert wins over a delete, and the greater value over the lesser.
    """
    rows = _single(changes.select(*keys, *values, seq.alias("_seq"), op.alias("_op")), keys, values)
    if base is not None:
        kind = changes.select(seq.alias("_seq")).schema["_seq"].dataType
        rows = rows.unionByName(_single(base.select(*keys, *values, F.lit(None).cast(kind).alias("_seq"), F.lit("base").alias("_op")), keys, values))
    if state is not None:
        rows = rows.unionByName(state.select(*rows.columns))
    return rows.groupBy(*keys).agg(*[F.max(c).alias(c) for c in ("_last", *[f"_v_{v}" for v in values])])


def _single(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """The state of each change by itself."""
    sets = F.col("_op").isin("insert", "base")
    rank, q = F.when(F.col("_op") == "base", 0).otherwise(1).alias("r"), F.col("_seq").alias("q")
    out = [F.when(sets | (F.col("_op") == "delete"), F.struct(rank, q, sets.alias("in"))).alias("_last")]
    for v in values:
        due = sets | ((F.col("_op") == "update") & F.col(v).isNotNull())
        out.append(F.when(due, F.struct(rank, q, F.col(v).alias("v"))).alias(f"_v_{v}"))
    return rows.select(*keys, *out)


def current_rows(state: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """(keys, values) of the keys that are present: those whose last insert or delete is an insert.

    Updates after it win over it, and those before it are lower in sequence, so each value is the payload of its maximum.
    """
    return state.where(F.col("_last.in")).select(*keys, *[F.col(f"_v_{v}.v").alias(v) for v in values])


def fold_changes(changes: DataFrame, keys: list[str], seq: Column, op: Column, values: list[str], base: DataFrame | None = None) -> DataFrame:
    """(keys, values): the current rows after all changes of one feed; see fold_state for feeds in several batches."""
    return current_rows(fold_state(changes, keys, seq, op, values, base=base), keys, values)


def triple_state(change_log: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """The state of every (pid, s) of the log, tombstones included, from nothing or from an earlier `state`.

    Order: min_t, then log_count, then page_no for logs that begin anew at the same moment. A record without min_t takes
    that of its page from the other records; where none has it, it ranks before all others of its pid. Only the few
    records without min_t are joined with their pages; the rest goes straight into the fold. Repeated records
    change nothing; an insert sets o and t even to null.
    """
    cols = ["page_no", "pid", "min_t", "log_count", "operation_type", "s", "o", "t"]
    log = change_log.select(*cols)
    known = log.where(F.col("min_t").isNotNull())
    unknown = log.where(F.col("min_t").isNull()).drop("min_t")
    wanted = unknown.select("page_no").distinct()
    starts = known.join(wanted, "page_no", "left_semi").groupBy("page_no").agg(F.max("min_t").alias("min_t"))
    filled = unknown.join(starts, "page_no", "left").select(*cols)
    sequence = F.struct("min_t", "log_count", "page_no")
    return fold_state(known.unionByName(filled), ["pid", "s"], sequence, operation(F.col("operation_type")), ["o", "t"], state)


def current_triples(change_log: DataFrame) -> DataFrame:
    """(pid, s, o, t) after all changes of the log, starting empty: the present rows of its state."""
    return current_rows(triple_state(change_log), ["pid", "s"], ["o", "t"])
