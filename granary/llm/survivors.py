"""The best representative of each group of duplicates, field by field (problem 5)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.leaves import PLACEHOLDERS, different_values, normal_values
from granary.operators.skew import join_unique
from granary.operators.stamps import source_key, with_registry
from granary.session import cut


def unpivot(df: DataFrame, group: str, record: str, fields: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Long rows group, field, record, value, vote; ``fields`` gives (value, vote) of each field."""
    rows = [F.struct(F.lit(f).alias("field"), v.cast("string").alias("value"), w.cast("double").alias("vote")) for f, (v, w) in fields.items()]
    return df.select(F.col(group).alias("group"), F.col(record).alias("record"), F.explode(F.array(*rows)).alias("x")).select("group", "x.field", "record", "x.value", "x.vote")


def elect(long: DataFrame, fields: list[str]) -> DataFrame:
    """One row per group: for each field the record that supplies the winning value, or null.

    Votes are summed per normalised value, the value with the highest sum wins (max_by), and the smallest
    record that carries it supplies it; ties go to the smallest record. Rows with null value or vote are no
    candidates. Both aggregations combine before they shuffle, so a group may hold any share of the rows.
    """
    sums = long.where("value is not null and vote is not null").groupBy("group", "field", "value").agg(F.sum("vote").alias("votes"), F.min("record").alias("record"))
    order = F.struct("votes", (-F.col("record")).alias("first"))
    winners = [F.max_by(F.when(F.col("field") == f, F.col("record")), F.when(F.col("field") == f, order)).alias(f) for f in fields]
    return sums.groupBy("group").agg(*winners)


def grouped_records(recipes: DataFrame, groups: DataFrame, registry: DataFrame) -> DataFrame:
    """Records of recipe_nlg that belong to a group of at least two of them, with the trust of their source.

    Groups are sized and lonely records dropped on ids alone, a hot group being split; only then are the texts fetched, by
    record, so that no group gathers its texts anywhere.
    """
    there = cut(groups.join(recipes.select(F.col("id").alias("recipe_id")), "recipe_id").select("group_id", "recipe_id"))
    sizes = there.groupBy("group_id").agg(F.count("*").alias("n")).where("n > 1")
    members = join_unique(there, sizes, ["group_id"], "n", there.count()).select("group_id", "recipe_id")
    found = members.join(recipes.select("id", "ingredients", "directions", "source"), F.col("recipe_id") == F.col("id")).drop("recipe_id")
    return with_registry(found, registry)


def found_survivors(recipes: DataFrame, groups: DataFrame, registry: DataFrame) -> DataFrame:
    """The rows of p5_found. A record votes for itself: with the number of different values it kept, or with
    the trust of its registered source. source_from is -1 where no record of the group has one."""
    records = grouped_records(recipes, groups, registry)
    records = records.select("group_id", "id", "reg_trust", different_values(F.col("ingredients")).alias("n_in"), different_values(F.col("directions")).alias("n_di"))
    own = F.col("id")
    long = unpivot(records, "group_id", "id", {"ingredients_from": (own, F.col("n_in")), "directions_from": (own, F.col("n_di")), "source_from": (own, -F.col("reg_trust"))})
    chosen = elect(long, ["ingredients_from", "directions_from", "source_from"])
    return chosen.select(F.col("group").alias("group_id"), "ingredients_from", "directions_from", F.coalesce("source_from", F.lit(-1)).cast("long").alias("source_from"))


def voted_survivors(recipes: DataFrame, groups: DataFrame, registry: DataFrame, half_life: float = 20_000.0) -> DataFrame:
    """The record that supplies each field when records vote for equal contents instead of for themselves.

    A vote weighs 1 / trust of the source (trust 10 where unregistered) times a decay by age, halved every
    ``half_life`` ids before the latest id (recipe_nlg has no date; ids rise with time). Empty contents and
    placeholders are no candidates, nor are null and blank sources; sources are the same whatever their case and outer blanks.
    """
    @F.pandas_udf("string")
    def content(batch: pd.Series) -> pd.Series:
        kept = ["\x1f".join(sorted({x for x in normal_values(v) if x not in PLACEHOLDERS})) for v in batch]
        return pd.Series([k or None for k in kept], dtype=object)

    records = grouped_records(recipes, groups, registry)
    latest = recipes.agg(F.max("id").alias("latest"))
    weight = 1 / F.coalesce("reg_trust", F.lit(10)) * F.pow(F.lit(0.5), (F.col("latest") - F.col("id")) / F.lit(half_life))
    records = records.join(F.broadcast(latest)).select("group_id", "id", content("ingredients").alias("ingredients"), content("directions").alias("directions"), F.nullif(source_key("source"), F.lit("")).alias("source"), weight.alias("w"))
    digest = lambda c: F.md5(F.col(c))
    long = unpivot(records, "group_id", "id", {c: (digest(c), F.col("w")) for c in ("ingredients", "directions", "source")})
    chosen = elect(long, ["ingredients", "directions", "source"])
    return chosen.select(F.col("group").alias("group_id"), F.col("ingredients").alias("ingredients_from"), F.col("directions").alias("directions_from"), F.col("source").alias("source_from"))
