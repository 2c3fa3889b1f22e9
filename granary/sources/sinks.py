"""Sinks: overwrite, append without repeats, resumable append, recreation of databases."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators.loading import insert_or_ignore, key_violations, null_counts, resume_rows
from granary.sources.schemas import DATABASES, Table


def overwrite(df: DataFrame, path: str, rows_per_file: int = 5_000_000) -> None:
    df.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, columns in the frame's order, ``"`` as quote and escape."""
    df.write.mode("overwrite").options(header=True, quote='"', escape='"', emptyValue="").csv(path)


def append_new(batch: DataFrame, path: str, key: list[str], order: list[str]) -> int:
    """Append the rows whose key the table does not hold, the first of each key. Returns the number of rows
    submitted, not of those inserted.

    One pass over the batch counts it and finds its lowest and highest first key: of the table only keys between them are read,
    and files outside are skipped by their statistics.
    """
    rows, low, high = batch.agg(F.count(F.lit(1)), F.min(key[0]), F.max(key[0])).first()
    target = _read(batch.sparkSession, path, batch).where(F.col(key[0]).between(low, high))
    insert_or_ignore(batch, target, key, order).write.mode("append").parquet(path)
    return rows


def append_resumed(batch: DataFrame, path: str, key: str) -> int:
    """Append the rows above the highest key of the table; a rerun after a loss appends only what is missing. Returns their number,
    from the sizes in the files' footers."""
    target = _read(batch.sparkSession, path, batch)
    before = target.count()
    resume_rows(batch, target, key).write.mode("append").parquet(path)
    return _read(batch.sparkSession, path, batch).count() - before


def append_checked(batch: DataFrame, path: str, key: list[str], required: list[str]) -> None:
    """Append a batch whose keys are new and single and whose required columns hold no null; else raise and write nothing."""
    target = _read(batch.sparkSession, path, batch)
    check_keys(batch, key, required)
    known = batch.join(target.select(*key), key, "left_semi").limit(1).count()
    if known:
        raise ValueError(f"primary key ({', '.join(key)}): the table holds keys of the batch already")
    batch.write.mode("append").parquet(path)


def overwrite_checked(df: DataFrame, path: str, key: list[str], required: list[str]) -> DataFrame:
    """Write the table anew and return it. It is written beside its place and checked there, so that a batch that breaks a key or a
    required column raises and leaves the old table as it was."""
    spark = df.sparkSession
    beside, place = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (f"{path}.incoming", path))
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    overwrite(df, f"{path}.incoming")
    try:
        check_keys(spark.read.schema(df.schema).parquet(f"{path}.incoming"), key, required)
    except ValueError:
        files.delete(beside, True)
        raise
    files.delete(place, True)
    files.rename(beside, place)
    return spark.read.schema(df.schema).parquet(path)


def check_keys(df: DataFrame, key: list[str], required: list[str]) -> None:
    """Raise where a key is repeated or a required column (key columns are required) holds a null."""
    needed = list(dict.fromkeys([*key, *required]))
    broken = (key_violations(df, key, needed) if key else null_counts(df, needed)).collect() if needed else []  # at most one row per column
    if broken:
        raise ValueError("; ".join(f"{r['check']} ({r['column']}): {r['n']}" for r in broken))


def _read(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.read.schema(like.schema).parquet(path)
    return spark.createDataFrame([], like.schema)


def recreate(spark: SparkSession, database: str) -> None:
    """Drop a database with all its tables and create it empty; a rerun leaves the same state."""
    spark.sql(f"DROP DATABASE IF EXISTS `{database}` CASCADE")
    spark.sql(f"CREATE DATABASE `{database}`")


def database_of(table: str) -> str:
    return next(d for d, tables in DATABASES.items() if table in tables)


def save_table(df: DataFrame, table: Table, buckets: int | None = None) -> None:
    """Save into the table's database, bucketed by its primary key where joins on it are to stay local."""
    writer = df.write.mode("overwrite").format("parquet")
    if buckets:
        writer = writer.bucketBy(buckets, *table.primary_key).sortBy(*table.primary_key)
    writer.saveAsTable(f"`{database_of(table.name)}`.`{table.name}`")
    df.sparkSession.sql(f"ANALYZE TABLE `{database_of(table.name)}`.`{table.name}` COMPUTE STATISTICS FOR ALL COLUMNS")


def append_label(df: DataFrame, path: str) -> None:
    df.withColumn("likert_label", F.col("likert_label").cast("int")).write.mode("append").option("header", True).csv(path)


def write_report(payload: dict, path: str | Path) -> None:
    Path(path).write_text(json.dumps(payload, indent=2) + "\n")
