"""The pN_ queries over a data folder and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import table
from . import boilerplate, leaks, lookalikes, mixing, neardup, oracles, residue, sentences, topn

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topn.top_windows(table(spark, sf_dir, "context_windows")).select("id", "window_id")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.record_units(table(spark, sf_dir, "raw_records"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicate_pairs(table(spark, sf_dir, "raw_records"))


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicate_groups(table(spark, sf_dir, "raw_records"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boilerplate.record_lines(table(spark, sf_dir, "raw_records"))


def p4_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = table(spark, sf_dir, "raw_records")
    return boilerplate.without_lines(records, "record_id", "core_text", boilerplate.record_lines(records, short=True))


def p4_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boilerplate.repeated_blocks(boilerplate.repeated_lines(table(spark, sf_dir, "raw_records"), "record_id", boilerplate.issuers(), "core_text"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalikes.lookalike_pairs(table(spark, sf_dir, "raw_records"))


def p5_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalikes.lookalike_classes(table(spark, sf_dir, "raw_records"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "eval_items")
    return leaks.leak_report(leaks.leaked_items(table(spark, sf_dir, "documents"), items), items)


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = table(spark, sf_dir, "mix_targets")
    return mixing.shares(mixing.mixture(table(spark, sf_dir, "documents"), targets), targets)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.residue(table(spark, sf_dir, "documents"))


def p8_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.residue_labels(table(spark, sf_dir, "documents"))


P1_SQL = """
WITH latest AS (
  SELECT * FROM (SELECT id, window_id, similarity_score, hit_sentence_index, row_number() OVER (PARTITION BY window_id ORDER BY processed_at DESC) AS r FROM context_windows)
  WHERE r = 1 AND id IS NOT NULL AND similarity_score IS NOT NULL AND NOT isnan(similarity_score)),
ranked AS (
  SELECT id, window_id, row_number() OVER (PARTITION BY id ORDER BY similarity_score DESC, hit_sentence_index, window_id) AS k FROM latest)
SELECT id, window_id FROM ranked WHERE k <= 5
"""


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name[:1] == "p" and name[1:2].isdigit() and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1_SQL, **oracles.queries()}
