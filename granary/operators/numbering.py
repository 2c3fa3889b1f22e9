"""Consecutive numbers in a global order without gathering the rows in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.session import cut


def numbered(df: DataFrame, name: str, *order: str) -> DataFrame:
    """``df`` with ``name`` counting from 0 by ``order`` (which must be unique to be reproducible).

    Rows are split into ranges of the order and numbered inside each; only the ranges' sizes, one row per
    partition, are summed up in one place.
    """
    ranged = cut(df.repartitionByRange(*[F.col(c) for c in order]).withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    rows = ranged.withColumn("_k", inside).join(F.broadcast(starts), "_range")
    return rows.select(*df.columns, (F.col("_start") + F.col("_k") - 1).cast("long").alias(name))
