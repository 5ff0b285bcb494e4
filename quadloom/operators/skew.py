"""Per-key aggregation that stays balanced when a handful of keys hold most rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadloom.session import BROADCAST_ROWS, broadcast_if_small, cut_lineage

#: A key is heavy if it holds more than 1 / HEAVY_SHARE of all rows, so fewer than HEAVY_SHARE keys ever are.
HEAVY_SHARE = 64
#: Groups that the rows of a heavy key are spread over.
SALTS = 64


def heavy_keys(df: DataFrame, key: str, share: int = HEAVY_SHARE) -> DataFrame:
    """(key): the non-null keys with more than 1/share of the rows; by arithmetic fewer than `share` rows."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = df.agg(F.count(F.lit(1)).alias("_total"))
    return counts.where(F.col(key).isNotNull()).join(F.broadcast(total), F.col("_n") * share > F.col("_total"), "inner").select(key)


def salted_aggregate(
    df: DataFrame,
    key: str,
    partial: dict[str, Column],
    final: dict[str, Column],
    salt_on: str,
    salts: int = SALTS,
    share: int = HEAVY_SHARE,
) -> DataFrame:
    """Aggregate `df` by `key` in two stages; `df` is read twice, so it should be a table or a checkpoint.

    Stage one groups by (key, salt) and computes `partial`; stage two groups by key and merges the partials by `final`.
    Rows of heavy keys get one of `salts` salts, all others salt 0. The salt is a hash of `salt_on`, random with
    respect to the key but the same when a lost task runs again. Null keys have no result.
    """
    heavy = heavy_keys(df, key, share).withColumn("_heavy", F.lit(True))
    rows = df.where(F.col(key).isNotNull()).join(F.broadcast(heavy), key, "left")  # fewer than `share` rows
    salt = F.when(F.col("_heavy"), F.pmod(F.xxhash64(salt_on), F.lit(salts))).otherwise(F.lit(0))
    staged = rows.withColumn("_salt", salt).groupBy(key, "_salt").agg(*[c.alias(n) for n, c in partial.items()])
    return staged.groupBy(key).agg(*[c.alias(n) for n, c in final.items()])


def look_up(df: DataFrame, right: DataFrame, key: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Left join of `df` with `right`, which has each `key` once.

    A right side of at most `limit` rows is broadcast. Of a larger one only the rows of heavy keys are (fewer than
    HEAVY_SHARE), so that rows of such a key stay where they are; the others meet by a shuffle, and rows without a key
    meet nothing. `df` is then read more than once, so it should be a table or a checkpoint.
    """
    small = broadcast_if_small(right, limit)
    if small is not right:
        return df.join(small, key, "left")
    heavy = heavy_keys(df, key)
    marked = df.join(F.broadcast(heavy.withColumn("_heavy", F.lit(True))), key, "left")
    hot = marked.where(F.col("_heavy")).drop("_heavy").join(F.broadcast(right.join(F.broadcast(heavy), key, "left_semi")), key, "left")
    rest = marked.where(F.col("_heavy").isNull()).drop("_heavy")
    cold = rest.where(F.col(key).isNotNull()).join(right, key, "left")
    return hot.unionByName(cold).unionByName(rest.where(F.col(key).isNull()), allowMissingColumns=True)


def current_pages(chunk_metas: DataFrame) -> DataFrame:
    """(page_no, pid, triple_count): each page once, by its report with the highest update_count.

    The highest row is found by a maximum over structs, which combines before the shuffle even where one page is
    reported very often. Ties in update_count fall to the greater triple_count, then the greater pid, nulls last.
    Rows with a null page_no cannot be told apart and count for nothing; a null update_count ranks lowest.
    """
    best = F.max(F.struct(F.col("update_count").alias("u"), F.col("triple_count").alias("n"), F.col("pid").alias("pid")))
    return (
        chunk_metas.select("page_no", "update_count", "triple_count", "pid")
        .where(F.col("page_no").isNotNull())
        .groupBy("page_no")
        .agg(best.alias("b"))
        .select("page_no", F.col("b.pid").alias("pid"), F.col("b.n").alias("triple_count"))
    )


def page_figures(chunk_metas: DataFrame) -> DataFrame:
    """(pid INT, n_pages, n_triples, max_triples BIGINT) per non-null pid, over the current pages.

    A null triple_count counts as 0. An empty table gives an empty result.
    """
    pages = current_pages(chunk_metas).select("page_no", "pid", F.coalesce(F.col("triple_count"), F.lit(0)).cast("bigint").alias("n"))
    pages = cut_lineage(pages)  # read twice, for the heavy keys and for the figures
    out = salted_aggregate(
        pages,
        "pid",
        {"c": F.count(F.lit(1)), "s": F.sum("n"), "m": F.max("n")},
        {"n_pages": F.sum("c"), "n_triples": F.sum("s"), "max_triples": F.max("m")},
        salt_on="page_no",
    )
    return out.select(F.col("pid").cast("int").alias("pid"), "n_pages", "n_triples", "max_triples")
