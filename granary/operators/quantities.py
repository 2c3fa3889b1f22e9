"""Quantities in the common unit (problem 6), and units for numbers that carry none."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions import measures
from granary.functions.unpack import listed

READERS = {"amount": measures.amount, "unit_name": measures.unit_name, "density": measures.density}
MEASURE = "struct<dim:string,amount_lo:long,amount_hi:long>"


def measured(column: Column, reader: str) -> Column:
    """``struct<dim, amount_lo, amount_hi>`` in thousandths of a ml, g or g/ml; all null where none is stated."""
    read = READERS[reader]

    @F.pandas_udf(MEASURE)
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            rows = [read(t) or (None, None, None) for t in batch]
            yield pd.DataFrame(rows, columns=["dim", "amount_lo", "amount_hi"]).astype({"dim": object, "amount_lo": "Int64", "amount_hi": "Int64"})

    return run(column)


def measured_values(column: Column) -> Column:
    """``array<struct<pos, dim, amount_lo, amount_hi>>`` of a packed field's values that state an amount."""
    @F.pandas_udf("array<struct<pos:int,dim:string,amount_lo:long,amount_hi:long>>")
    def run(lists: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in lists:
            yield pd.Series([[(k, *m) for k, v in enumerate(values, 1) if (m := measures.amount(v))] for values in batch], dtype=object)

    return run(column)


def found_quantities(nlg: DataFrame, density: DataFrame, units: DataFrame) -> DataFrame:
    """The rows of p6_found. Nulls and texts without a measure give no row; no stage shuffles."""

    def single(df: DataFrame, field: str, column: str, reader: str) -> DataFrame:
        rows = df.where(F.col(column).isNotNull()).select(F.col("id").cast("long").alias("record_id"), measured(F.col(column), reader).alias("m"))
        return rows.where("m.dim is not null").select(F.lit(field).alias("field"), "record_id", F.lit(0).alias("pos"), "m.dim", "m.amount_lo", "m.amount_hi")

    lines = nlg.where(F.col("ingredients").isNotNull()).select(F.col("id").alias("record_id"), F.explode(measured_values(listed(F.col("ingredients")))).alias("m"))
    return (
        lines.select(F.lit("recipe_nlg.ingredients").alias("field"), "record_id", "m.pos", "m.dim", "m.amount_lo", "m.amount_hi")
        .unionByName(single(density, "food_density.density_g_per_ml", "density_g_per_ml", "density"))
        .unionByName(single(units, "measure_unit.name", "name", "unit_name"))
    )


#: Log offsets of the units that a bare density may have been written in, from their known factors.
DENSITY_UNITS = {"g/ml": 0.0, "kg/m3": math.log(1000.0), "lb/ft3": -math.log(float(measures.POUND_PER_CUBIC_FOOT)), "oz/cup": -math.log(28.349523125 / 236.5882365)}


def fit_unit_mixture(numbers: DataFrame, offsets: dict[str, float] = DENSITY_UNITS, rounds: int = 25) -> dict[str, float | dict[str, float]]:
    """Mixture of normals on the log scale whose components lie at one centre plus a fixed offset each.

    ``numbers`` has one column ``number``. Values are first pre-aggregated to a histogram of width 0.01 in the
    log, at most 10,000 bins whatever the row count (numbers are cut to 1e-50..1e50, so nothing else reaches
    the driver); expectation-maximisation then runs on the bins. Null, zero and negative numbers are left out;
    no number at all gives centre 0, spread 1 and equal weights.
    """
    import numpy as np

    logs = numbers.where("number > 0").select(F.round(F.ln(F.least(F.greatest("number", F.lit(1e-50)), F.lit(1e50))), 2).alias("x"))
    bins = logs.groupBy("x").agg(F.count("*").alias("n")).toPandas()
    shift = np.array(list(offsets.values()))
    weights = np.full(len(shift), 1 / len(shift))
    centre, spread = 0.0, 1.0
    x, n = bins["x"].to_numpy(float), bins["n"].to_numpy(float)
    # A mixture with free centre has one mode per component; the start is the best of all one-component fits.
    for start in (x.mean() - s for s in shift) if len(x) else ():
        c, sd, w = start, 1.0, np.full(len(shift), 1 / len(shift))
        for _ in range(rounds):
            p = w * np.exp(-0.5 * ((x[:, None] - c - shift) / sd) ** 2) / sd + 1e-300
            r = p / p.sum(1, keepdims=True) * n[:, None]
            c = (r * (x[:, None] - shift)).sum() / r.sum()
            sd = max(0.05, float(np.sqrt((r * (x[:, None] - shift - c) ** 2).sum() / r.sum())))
            w = np.maximum(r.sum(0) / r.sum(), 1e-6)
        # Foods weigh near 1 g/ml: the physical prior that tells modes apart which fit equally well.
        score = (n * np.log((w * np.exp(-0.5 * ((x[:, None] - c - shift) / sd) ** 2) / sd + 1e-300).sum(1))).sum() / n.sum() - 0.5 * c * c
        if start == x.mean() - shift[0] or score > best:
            best, centre, spread, weights = score, float(c), float(sd), w
    return {"centre": centre, "spread": spread, "weights": dict(zip(offsets, map(float, weights), strict=True))}


def assign_units(df: DataFrame, number: str, fitted: dict, offsets: dict[str, float] = DENSITY_UNITS, sure: float = 0.9) -> DataFrame:
    """Adds unit, posterior and uncertain (posterior below ``sure``); numbers not above 0 get nulls."""
    log = F.ln(F.when(F.col(number) > 0, F.col(number)))
    parts = {u: F.lit(fitted["weights"][u]) * F.exp(-0.5 * F.pow((log - F.lit(fitted["centre"] + o)) / F.lit(fitted["spread"]), 2)) for u, o in offsets.items()}
    total = sum(parts.values(), F.lit(1e-300))
    best = F.greatest(*[F.struct((p / total).alias("p"), F.lit(u).alias("u")) for u, p in parts.items()])
    known = F.col(number) > 0
    return df.select("*", F.when(known, best["u"]).alias("unit"), F.when(known, best["p"]).alias("posterior"), F.when(known, best["p"] < sure).alias("uncertain"))


def bare_densities(density: DataFrame) -> DataFrame:
    """record_id, number of the densities that are stated without any unit, in whatever form ``p6_found`` reads them."""
    @F.pandas_udf("double")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([measures.bare_density(t) for t in batch], dtype="float64")

    rows = density.select(F.col("id").alias("record_id"), run(F.col("density_g_per_ml")).alias("number"))
    return rows.where("number is not null")
