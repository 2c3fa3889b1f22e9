"""Scans: strict and lenient CSV, JSON lines, PDF tables, label logs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.functions.density_rows import compact_row, parse_data_row
from granary.functions.text import is_json
from granary.sources.schemas import WHOLE_LINES, Table

#: Stands for a quoted empty field while Spark reads: it reads unquoted ones as null.
EMPTY = "\u0001empty\u0001"
# The fields that a lenient scan takes for missing.
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
# JSON names of open_recipe that differ from the column's.
RENAMED = {"recipe_yield": "recipeYield", "recipe_category": "recipeCategory", "cook_time": "cookTime", "prep_time": "prepTime", "total_time": "totalTime", "date_published": "datePublished", "date_modified": "dateModified"}


def read_csv(spark: SparkSession, path: str | list[str], table: Table, columns: list[str] | None = None, mode: str = "FAILFAST", multi_line: bool | None = None) -> DataFrame:
    """Strict bulk scan: header skipped, columns by position (or in the order of ``columns``), quote and escape
    are ``"``. Unquoted empty fields are null, quoted ones the empty string. A row of wrong type or length raises.

    A file that may hold line breaks inside quotes (``multi_line``, by default any table but those of numbers and codes) is read by
    one task; the others are split. Such a break where none is expected makes a row of wrong length, which raises."""
    schema = table.columns(columns)
    multi_line = table.name not in WHOLE_LINES if multi_line is None else multi_line
    rows = (
        spark.read.schema(schema)
        .options(header=True, quote='"', escape='"', multiLine=multi_line, mode=mode, enforceSchema=True, nullValue="", emptyValue=EMPTY)
        .csv(path)
    )
    text = {f.name for f in schema if isinstance(f.dataType, T.StringType)}
    return rows.select(*[F.when(F.col(c) == EMPTY, "").otherwise(F.col(c)).alias(c) if c in text else F.col(c) for c in rows.columns])


def read_csv_lenient(spark: SparkSession, path: str | list[str], schema: T.StructType, na: list[str] = NA_TOKENS, multi_line: bool = True) -> DataFrame:
    """Scan that takes every NA token for null and values that do not fit a type for null."""
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
    rows = spark.read.schema(text).options(header=True, quote='"', escape='"', multiLine=multi_line, mode="PERMISSIVE").csv(path)
    value = lambda f: F.when(~F.trim(F.col(f.name)).isin(na), F.col(f.name))
    return rows.select(*[(value(f) if isinstance(f.dataType, T.StringType) else value(f).try_cast(f.dataType)).alias(f.name) for f in schema])


def read_open_recipes(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """JSON lines in extended form: id from ``_id.$oid``, else ``_id`` as text, else empty; ``ts.$date`` as
    milliseconds or null. Blank lines are skipped, a malformed line raises."""
    texts = ["name", "ingredients", "url", "image", "source", "description", "creator", *RENAMED]
    schema = T.StructType([T.StructField(RENAMED.get(c, c), T.StringType()) for c in ["_id", "ts", *texts]])
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    key = F.coalesce(F.get_json_object("_id", "$.$oid"), F.col("_id"), F.lit(""))
    return rows.select(key.alias("id"), *[F.col(RENAMED.get(c, c)).alias(c) for c in texts], F.get_json_object("ts", "$.$date").try_cast("bigint").alias("ts_millis"))


DENSITY_ROW = "file string, page int, table int, row int, food_group string, food_name string, density_g_per_ml string, specific_gravity string, biblio_id string, updated_version_2 boolean"


def density_rows(tables: list[list[list[str | None]]]) -> Iterator[tuple]:
    """Rows of one page's tables: only tables whose header holds "food name"; three header rows are skipped,
    a row of one cell names the group of those that follow."""
    for number, table in enumerate(tables):
        if not table or "food name" not in " ".join(compact_row(table[0])).lower():
            continue
        for at, raw in enumerate(table[3:], 3):
            cells = compact_row(raw)
            if len(cells) == 1:
                yield number, at, cells[0], None
            elif parsed := parse_data_row(cells):
                yield number, at, None, parsed


def read_density_pdf(spark: SparkSession, path: str, tables_of: Callable[[bytes], list] | None = None) -> DataFrame:
    """Density rows of PDF files. ``tables_of`` turns a file's bytes into its pages' tables; without it
    pdfplumber is needed."""
    reader = tables_of or _pdfplumber_tables

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for file, content in zip(batch["path"], batch["content"], strict=True):
                group = ""
                for page, tables in enumerate(reader(bytes(content))):
                    for number, at, heading, parsed in density_rows(tables):
                        group = heading if heading is not None else group
                        if parsed:
                            name, density, gravity, biblio, updated = parsed
                            rows.append((file, page, number, at, group, name, density, gravity, biblio, updated == "x"))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in DENSITY_ROW.split(", ")])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, DENSITY_ROW)


def _pdfplumber_tables(content: bytes) -> list:
    import io

    import pdfplumber

    with pdfplumber.open(io.BytesIO(content)) as pdf:
        return [page.extract_tables() for page in pdf.pages]


LABELS = "recipe_id long, match_id long, semantic_score double, ingredient_jaccard double, title_similarity double, hybrid_score double, likert_label int, notes string"


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """The label log, or an empty frame of its schema where there is none yet."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.read.schema(LABELS).option("header", True).csv(path)
    return spark.createDataFrame([], LABELS)


def checked_json(column: Column) -> Column:
    """A JSON text as it is, ``[]`` for null and empty; anything else raises."""
    valid = F.when(is_json(column), column).otherwise(F.raise_error(F.concat(F.lit("not JSON: "), F.substring(column, 1, 80))).cast("string"))
    return F.when(F.coalesce(column, F.lit("")) == "", F.lit("[]")).otherwise(valid)


def listed_strictly(column: Column) -> Column:
    """A list literal as ``array<string>``; a malformed one raises, null stays null."""
    parsed = F.from_json(column, "array<string>")
    return F.when(column.isNull() | parsed.isNotNull(), parsed).otherwise(F.raise_error(F.concat(F.lit("not a list: "), F.substring(column, 1, 80))).cast("array<string>"))
