"""Queries of the problems of this subpackage, and their SQL where SQL can state them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from granary.llm import bpe, canonical, components, copies, leaks, sentences, survivors
from granary.session import spread, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.found_items(*[spread(table(spark, sf_dir, t)) if t == "recipe_nlg" else table(spark, sf_dir, t) for t in ("recipe_nlg", "food_density", "food_category", "canonical_item")])


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.found_groups(table(spark, sf_dir, "duplicate_likert_labels"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies.copies(spread(table(spark, sf_dir, "recipe_nlg")))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors.found_survivors(table(spark, sf_dir, "recipe_nlg"), p2_found(spark, sf_dir), table(spark, sf_dir, "source_registry"))


def p5_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors.voted_survivors(table(spark, sf_dir, "recipe_nlg"), p2_found(spark, sf_dir), table(spark, sf_dir, "source_registry"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.found_ids(table(spark, sf_dir, "documents"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.found_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_item"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.found_sentences(spread(table(spark, sf_dir, "documents")))


QUERIES = {f.__name__: f for f in (p1_found, p2_found, p4_found, p5_found, p5_votes, p8_ids, p9_found, p10_found)}
ORACLES = {
    "p2_found": """WITH RECURSIVE e AS (SELECT recipe_id AS a, match_id AS b FROM duplicate_likert_labels WHERE likert_label IN (4, 5) AND recipe_id <> match_id),
  l AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(id, other) AS (SELECT a, a FROM l UNION SELECT r.id, l.b FROM r JOIN l ON r.other = l.a)
  SELECT id AS recipe_id, min(other) AS group_id FROM r GROUP BY id""",
}
