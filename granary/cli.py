"""Command line: ``python -m granary.cli infer|usda|recipes|density ...``."""

from __future__ import annotations

import argparse
import os
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from granary.operators import catalog, loading
from granary.sources import connection, scans, sinks
from granary.sources.schemas import DATABASES, table_of


def infer(spark: SparkSession, args: argparse.Namespace) -> None:
    """Write the catalog with its inferred joins as JSON and print the report."""
    if args.database:
        environment = connection.with_file(os.environ, args.settings)
        told = {n: connection.read_table(spark, environment, n) for n in ("tables", "columns", "table_constraints", "key_column_usage", "constraint_column_usage")}
        columns = catalog.described_columns(told["tables"], told["columns"], told["table_constraints"], told["key_column_usage"], args.schema)
        foreign = catalog.foreign_keys(told["table_constraints"], told["key_column_usage"], told["constraint_column_usage"], args.schema)
    else:
        columns, foreign = catalog.declared_columns(spark, args.schema), None
    content = catalog.payload(columns, catalog.infer_joins(columns, foreign), args.schema, foreign)
    sinks.write_report(content, args.out)
    print(catalog.report(content))


def usda(spark: SparkSession, args: argparse.Namespace) -> None:
    """Load one CSV file per declared table from a folder, keys and required columns enforced; prints the rows of each."""
    loaded = {}
    for name in DATABASES["usda"]:
        t = table_of(name)
        rows = scans.read_csv(spark, f"{args.folder}/{name}.csv", t, multi_line=True if args.multi_line else None)
        loaded[name] = sinks.overwrite_checked(rows, f"{args.target}/{name}", list(t.primary_key), list(t.required))
    for r in loading.row_counts(loaded).orderBy("table_name").collect():
        print(f"{r['table_name']}: {r['n']}")


def recipes(spark: SparkSession, args: argparse.Namespace) -> None:
    """Load JSON-lines recipes (known ids ignored) and CSV recipes (above the highest id only)."""
    if args.open:
        print("open_recipe rows submitted:", sinks.append_new(scans.read_open_recipes(spark, args.open), f"{args.target}/open_recipe", ["id"], ["url", "name"]))
    if args.nlg:
        t = table_of("recipe_nlg")
        rows = scans.read_csv(spark, args.nlg, t)
        rows = rows.withColumns({c: scans.checked_json(F.col(c)) for c in ("ingredients", "directions", "ner")})
        print("recipe_nlg rows appended:", sinks.append_resumed(rows, f"{args.target}/recipe_nlg", "id"))


def density(spark: SparkSession, args: argparse.Namespace) -> None:
    """Extract density tables from PDF files to CSV, load the CSV, or both."""
    names = ["food_group", "food_name", "density_g_per_ml", "specific_gravity", "biblio_id", "updated_version_2"]
    if args.pdf:
        rows = scans.read_density_pdf(spark, args.pdf).select(*names)
        if rows.limit(1).count() == 0:
            raise SystemExit("no density rows found")
        sinks.write_csv(rows, args.csv)
    if not args.extract_only:
        rows = scans.read_csv(spark, args.csv, table_of("food_density"), names)
        t = table_of("food_density")
        stored = sinks.overwrite_checked(rows.withColumn("id", F.monotonically_increasing_id()), f"{args.target}/food_density", list(t.primary_key), list(t.required))
        print(loading.row_counts({"food_density": stored}).first()["n"], "rows")


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="granary", description=__doc__)
    commands = parser.add_subparsers(required=True)
    one = commands.add_parser("infer", help=infer.__doc__)
    one.add_argument("--schema", default="usda")
    one.add_argument("--database", action="store_true", help="read the information schema of the database")
    one.add_argument("--settings", default=".env", help="file of connection settings")
    one.add_argument("--out", default="schema_inferred.json")
    one.set_defaults(run=infer)
    four = commands.add_parser("usda", help=usda.__doc__)
    four.add_argument("--folder", required=True, help="folder of the CSV files, named as the tables")
    four.add_argument("--target", required=True, help="folder of the tables")
    four.add_argument("--multi-line", action="store_true", help="read every file for line breaks inside quotes")
    four.set_defaults(run=usda)
    two = commands.add_parser("recipes", help=recipes.__doc__)
    two.add_argument("--open", help="JSON-lines files")
    two.add_argument("--nlg", help="CSV files")
    two.add_argument("--target", required=True, help="folder of the tables")
    two.set_defaults(run=recipes)
    three = commands.add_parser("density", help=density.__doc__)
    three.add_argument("--pdf")
    three.add_argument("--csv", required=True)
    three.add_argument("--target")
    three.add_argument("--extract-only", action="store_true")
    three.set_defaults(run=density)
    args = parser.parse_args(argv)
    began = time.perf_counter()
    args.run(SparkSession.builder.getOrCreate(), args)
    print(f"{time.perf_counter() - began:.1f} s")


if __name__ == "__main__":
    main()
