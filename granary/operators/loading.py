"""Incremental loading: insert-or-ignore, resume by high-water mark, key checks, row counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_rows(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by ``order``. An aggregation with partial combining, so that a key repeated
    in a third of the rows gathers in no task. Null keys form one group each."""
    rest = [c for c in df.columns if c not in key]
    row = F.min_by(F.struct(*rest), F.struct(*order)) if order else F.first(F.struct(*rest))
    return df.groupBy(*key).agg(row.alias("_row")).select(*key, *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)


def insert_or_ignore(batch: DataFrame, target: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Rows of ``batch`` to append: the first of each key that ``target`` does not hold (nulls never match)."""
    return first_rows(batch, key, order).join(target.select(*key), key, "left_anti")


def resume_rows(batch: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """Rows above the highest key of ``target``; all rows if it is empty. One row is broadcast."""
    mark = target.agg(F.coalesce(F.max(key), F.lit(-1)).alias("_mark"))
    return batch.join(F.broadcast(mark), F.col(key) > F.col("_mark")).drop("_mark")


def key_violations(df: DataFrame, key: list[str], required: list[str]) -> DataFrame:
    """check, column, n: repeated keys and nulls in required columns; empty if all hold."""
    repeated = df.groupBy(*key).count().where("count > 1").agg(F.count("*").alias("n")).select(F.lit("primary key").alias("check"), F.lit(", ".join(key)).alias("column"), "n")
    return repeated.unionByName(null_counts(df, required)).where("n > 0")


def null_counts(df: DataFrame, required: list[str]) -> DataFrame:
    """check, column, n of the required columns that hold nulls."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in required])
    told = counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n")) for c in required])).alias("x"))
    return told.select(F.lit("not null").alias("check"), "x.column", "x.n").where("n > 0")


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """table_name, n of each table."""
    return reduce(DataFrame.unionAll, [df.agg(F.count("*").cast("long").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in tables.items()])
