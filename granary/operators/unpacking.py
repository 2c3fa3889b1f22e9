"""One row per packed value (problem 3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.unpack import is_json_list, listed, unpacked


def explode_values(df: DataFrame, keys: dict[str, Column], packed: str, slashes: bool = False, plain_json: bool = True) -> DataFrame:
    """``keys`` and pos, value of each non-blank value of the column ``packed``.

    Nulls, empty and blank texts give no row. With ``plain_json`` false, fields that begin with ``["`` are
    left out before any Python runs. Extra columns, whatever their names, are pruned at the scan. Each row
    is independent: no shuffle, so neither a hot source nor a long text gathers rows in one task.
    """
    column = df[packed]
    rows = df.where(column.isNotNull()) if plain_json else df.where(column.isNotNull() & ~is_json_list(column))
    values = listed(column, slashes) if plain_json else unpacked(column, slashes)
    return (
        rows.select(*[c.alias(k) for k, c in keys.items()], F.posexplode(values).alias("pos", "value"))
        .withColumn("pos", (F.col("pos") + 1).cast("int"))
    )


def found_values(nlg: DataFrame, open_recipe: DataFrame) -> DataFrame:
    """The rows of p3_found: fields of both recipe tables that are not plain JSON, open_recipe rows once."""
    once = open_recipe.where(F.col("id") != "").select("id", "ingredients").where(F.col("ingredients").isNotNull() & ~is_json_list(F.col("ingredients"))).distinct()
    key = lambda name, id_: {"field": F.lit(name), "record_id": id_.cast("string")}
    return (
        explode_values(once, key("open_recipe.ingredients", once["id"]), "ingredients", plain_json=False)
        .unionByName(explode_values(nlg, key("recipe_nlg.ingredients", nlg["id"]), "ingredients", plain_json=False))
        .unionByName(explode_values(nlg, key("recipe_nlg.ner", nlg["id"]), "ner", slashes=True, plain_json=False))
    )
