"""Queries of the llm operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quadloom.llm import language, packing, tokenizer
from quadloom.session import table


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizer.token_ids(table(spark, sf_dir, "documents"))


def p8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.measured(table(spark, sf_dir, "documents")), table(spark, sf_dir, "containers"))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_report(p8_pack(spark, sf_dir), table(spark, sf_dir, "containers"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_cases(table(spark, sf_dir, "documents")).select("doc_id", "para_no", "lang").distinct()


def p9_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.document_languages(table(spark, sf_dir, "documents")).select("doc_id", "label", "lang", "confidence")


def p9_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = language.language_cases(table(spark, sf_dir, "documents"))
    return cases.where("para_no > 0")


#: SQL can cut no text into tokens and fits no classifier, so these have none; tests/llm holds them against brute force.
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p7_ids": p7_ids,
    "p8_pack": p8_pack,
    "p8_fill": p8_fill,
    "p9_found": p9_found,
    "p9_languages": p9_languages,
    "p9_segments": p9_segments,
}

ORACLES: dict[str, str] = {}
