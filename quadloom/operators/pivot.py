"""Entity-attribute-value rows to one wide, typed row per entity, by blocks of columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.functions.values import SPARK_TYPES, stripped, with_plain_text
from quadloom.session import broadcast_if_small

#: Attributes pivoted together. An aggregate has this many columns, whatever the number of attributes.
BLOCK = 8
#: Largest number of attributes; the list of columns lives in the plan.
MAX_ATTRIBUTES = 20_000


@dataclass(frozen=True)
class Attribute:
    name: str
    value_type: str


def single_valued(predicate_map: DataFrame) -> list[Attribute]:
    """The used attributes of which a subject has one value, in the order of their pid."""
    rows = (
        predicate_map.where((F.col("multi") == F.lit(False)) & F.col("value_type").isin(*SPARK_TYPES) & F.col("pred_name").isNotNull())
        .groupBy("pred_name")
        .agg(F.min(F.struct("pid", "value_type")).alias("x"))
        .select("pred_name", "x.pid", "x.value_type")
        .limit(MAX_ATTRIBUTES + 1)
        .collect()
    )
    if len(rows) > MAX_ATTRIBUTES:
        raise ValueError(f"more than {MAX_ATTRIBUTES} attributes")
    return [Attribute(r.pred_name, r.value_type) for r in sorted(rows, key=lambda r: (r.pid is None, r.pid or 0, r.pred_name))]


def wide_rows(
    triples: DataFrame,
    attributes: list[Attribute],
    entity: str = "s",
    attribute: str = "a",
    value: str = "v",
    order: str = "fact_id",
    block: int = BLOCK,
) -> DataFrame:
    """One row per entity, one typed column per attribute: the value of greatest `order` among the readable ones.

    `value` holds plain texts (see functions.values.with_plain_text) or null where unreadable. Columns are pivoted in
    blocks: each attribute has a block and a place in it, so one aggregate of `block` columns serves all blocks.

    1. The best value of each (entity, attribute), combined before its shuffle: even an entity with a third of all rows
       sends one row per attribute and task.
    2. One exchange puts these cells into buckets by entity, of which none has more than one row per attribute.
    3. Within the buckets, each block is pivoted by (entity, block), and the blocks of an entity are put side by side.
       Neither step shuffles.

    The table is read once and shuffled twice however many attributes there are. Entities without any readable value
    have a row of nulls; rows with a null entity count for nothing. Ties in `order` fall to the greater text.
    """
    spark = triples.sparkSession
    places = spark.createDataFrame([(a.name, i // block, i % block) for i, a in enumerate(attributes)], "_a string, _block int, _place int")
    due = F.when(F.col(value).isNotNull(), F.struct(F.col(order).alias("n"), F.col(value).alias("v")))
    rows = triples.where(F.col(entity).isNotNull()).select(F.col(entity).alias("_e"), F.col(attribute).alias("_a"), due.alias("_x"))
    cells = rows.groupBy("_e", "_a").agg(F.max("_x").alias("_x"))
    # At most MAX_ATTRIBUTES rows.
    cells = cells.join(F.broadcast(places), "_a", "left").select("_e", "_block", "_place", F.col("_x.v").alias("_v")).repartition("_e")
    pivoted = cells.groupBy("_e", "_block").agg(*[F.max(F.when(F.col("_place") == i, F.col("_v"))).alias(f"_{i}") for i in range(block)])
    side = F.collect_list(F.when(F.col("_block").isNotNull(), F.struct("_block", F.struct(*[f"_{i}" for i in range(block)]))))
    wide = pivoted.groupBy("_e").agg(F.map_from_entries(side).alias("_blocks"))
    columns = [F.col("_blocks")[i // block][f"_{i % block}"].cast(SPARK_TYPES[a.value_type]).alias(a.name) for i, a in enumerate(attributes)]
    return wide.select(F.col("_e").alias(entity), *columns)


def melted(wide: DataFrame, attributes: list[Attribute], entity: str = "s") -> DataFrame:
    """(entity, p, v): the filled cells of a wide table, each value in its plain text."""
    cells = F.array(*[F.struct(F.lit(a.name).alias("p"), F.col(f"`{a.name}`").cast("string").alias("v")) for a in attributes])
    return wide.select(entity, F.explode(cells).alias("c")).select(entity, "c.p", "c.v").where(F.col("v").isNotNull())


def attribute_facts(facts: DataFrame, predicate_map: DataFrame, prefix: str = "company/") -> tuple[DataFrame, list[Attribute]]:
    """(s, a, v, fact_id): facts of single-valued attributes with their value in plain text, and the attributes.

    A fact matches an attribute regardless of case and outer blanks of its predicate.
    """
    attributes = single_valued(predicate_map)
    types = facts.sparkSession.createDataFrame([(a.name.strip().lower(), a.name, a.value_type) for a in attributes], "k string, a string, value_type string")
    rows = facts.where(F.col("s").startswith(prefix)).select("s", F.lower(stripped(F.col("p"))).alias("k"), "o", "fact_id")
    typed = rows.join(broadcast_if_small(types), "k")
    return with_plain_text(typed, "o", "value_type", "v").select("s", "a", "v", "fact_id"), attributes


def company_table(facts: DataFrame, predicate_map: DataFrame, block: int = BLOCK) -> tuple[DataFrame, list[Attribute]]:
    """One row per company with a typed column for each single-valued attribute, and the attributes."""
    rows, attributes = attribute_facts(facts, predicate_map)
    return wide_rows(rows, attributes, block=block), attributes


def filled_cells(facts: DataFrame, predicate_map: DataFrame, block: int = BLOCK) -> DataFrame:
    """(s, p, v): the filled cells of the company table, in plain texts."""
    wide, attributes = company_table(facts, predicate_map, block)
    if not attributes:
        return facts.sparkSession.createDataFrame([], "s string, p string, v string")
    return melted(wide, attributes)
