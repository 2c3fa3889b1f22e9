"""Stamps of several columns as one moment each (problem 7)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions.timestamps import epoch_number, read_stamp, real
from granary.session import broadcast_checked


def source_key(column: str) -> F.Column:
    return F.lower(F.regexp_replace(column, r"^[\s\x{A0}]+|[\s\x{A0}]+$", ""))


def with_registry(df: DataFrame, registry: DataFrame) -> DataFrame:
    """Adds reg_zone, reg_order and reg_trust of the row's source; unregistered and null sources get nulls.

    The registry (60 rows at most) is broadcast behind a count, so a source that holds a third of all rows
    moves nothing.
    """
    known = registry.select(source_key("source").alias("reg_key"), F.col("time_zone").alias("reg_zone"), F.col("date_order").alias("reg_order"), F.col("trust").alias("reg_trust"))
    known = known.where("reg_key is not null").groupBy("reg_key").agg(*[F.min(c).alias(c) for c in ("reg_zone", "reg_order", "reg_trust")])
    return df.join(broadcast_checked(known), source_key("source") == F.col("reg_key"), "left").drop("reg_key")


def found_moments(open_recipe: DataFrame, registry: DataFrame) -> DataFrame:
    """The rows of p7_found: id, field, epoch_ms.

    Rows with null or empty id, and fields without a real moment, give none. Repeated rows count once: the
    smallest moment of an id and field (partial aggregation comes before the only shuffle).
    """
    rows = with_registry(open_recipe.where(F.col("id") != "").select("id", "source", "date_published", "date_modified", "ts_millis"), registry)
    zone = F.coalesce("reg_zone", F.lit("UTC"))
    stamps = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("stamp")) for c in ("date_published", "date_modified")])
    said = rows.select("id", zone.alias("zone"), "reg_order", F.explode(stamps).alias("p")).where("p.stamp is not null")
    long = (
        said.select("id", "p.field", real(read_stamp(F.col("p.stamp"), F.col("zone"), F.col("reg_order"))).alias("epoch_ms"))
        .unionByName(rows.select("id", F.lit("ts_millis").alias("field"), real(epoch_number(F.col("ts_millis"))).alias("epoch_ms")))
        .where("epoch_ms is not null")
    )
    return long.groupBy("id", "field").agg(F.min("epoch_ms").alias("epoch_ms"))
