"""Queries of the general problems 3, 6 and 7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators import quantities, stamps, unpacking
from granary.session import spread, table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unpacking.found_values(spread(table(spark, sf_dir, "recipe_nlg")), table(spark, sf_dir, "open_recipe"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantities.found_quantities(*[spread(table(spark, sf_dir, t)) if t == "recipe_nlg" else table(spark, sf_dir, t) for t in ("recipe_nlg", "food_density", "measure_unit")])


def p6_bare_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most probable unit of each density number without one, by the mixture fitted to all of them."""
    numbers = quantities.bare_densities(table(spark, sf_dir, "food_density"))
    fitted = quantities.fit_unit_mixture(numbers)
    return quantities.assign_units(numbers, "number", fitted).withColumn("posterior", F.round("posterior", 6))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stamps.found_moments(table(spark, sf_dir, "open_recipe"), table(spark, sf_dir, "source_registry"))


QUERIES = {f.__name__: f for f in (p3_found, p6_found, p6_bare_units, p7_found)}
