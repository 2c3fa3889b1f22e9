"""Descriptive statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.session import cut

QUARTILES = (("25%", 0.25), ("50%", 0.5), ("75%", 0.75))


def describe(df: DataFrame, column: str) -> DataFrame:
    """statistic, value: count, mean, sample deviation, minimum, exact quartiles (interpolated), maximum.
    Nulls are left out; an empty column gives count 0 and nulls.

    Values are counted first, so that a value in a third of the rows is one row, then dealt to ranges. Only the sizes of the
    ranges are summed up in one place; the order statistics are read from the few ranges that hold them.
    """
    c = F.col(column).cast("double")
    counts = df.select(c.alias("x")).where("x is not null").groupBy("x").agg(F.count("*").alias("n"))
    ranged = cut(counts.repartitionByRange("x").withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy("_range").agg(F.sum("n").alias("_size"))
    starts = sizes.select("_range", "_size", (F.sum("_size").over(Window.orderBy("_range")) - F.col("_size")).alias("_start"), F.sum("_size").over(Window.partitionBy(F.lit(1))).alias("_all"))
    spots = F.array(*[F.lit(q) * (F.col("_all") - 1) for _, q in QUARTILES])
    held = F.exists(spots, lambda s: (F.ceil(s) >= F.col("_start")) & (F.floor(s) < F.col("_start") + F.col("_size")))
    near = ranged.join(F.broadcast(starts.where(held)), "_range")  # one row per range
    last = F.col("_start") + F.sum("n").over(Window.partitionBy("_range").orderBy("x"))
    placed = near.select("x", "n", "_all", last.alias("last"))
    covers = lambda s: (s >= F.col("last") - F.col("n")) & (s < F.col("last"))
    spot = lambda q, rounded: rounded(F.lit(q) * (F.col("_all") - 1))
    ends = [F.max(F.when(covers(spot(q, side)), F.col("x"))).alias(f"{name}{k}") for name, q in QUARTILES for k, side in enumerate((F.floor, F.ceil))]
    middle = placed.agg(*ends)
    one = df.agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max")).crossJoin(F.broadcast(middle))  # one row by one row
    share = lambda q: F.lit(q) * (F.col("n") - 1) - F.floor(F.lit(q) * (F.col("n") - 1))
    quartile = lambda name, q: F.col(f"{name}0") + share(q) * (F.col(f"{name}1") - F.col(f"{name}0"))
    values = [("count", F.col("n").cast("double")), *[(s, F.col(s)) for s in ("mean", "std", "min")], *[(name, quartile(name, q)) for name, q in QUARTILES], ("max", F.col("max"))]
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("statistic"), v.alias("value")) for n, v in values])).alias("s")).select("s.statistic", "s.value")


def place(key: list[str], seed: int) -> Column:
    """A place in a seeded order: the digest of the key, the same in any engine and whatever the partitioning. Nulls are told apart
    from texts."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in key]))


def seeded_sample(df: DataFrame, key: list[str], n: int, seed: int) -> DataFrame:
    """``n`` rows by a seeded digest of their key."""
    return df.orderBy(place(key, seed), *key).limit(n)


def seeded_order(df: DataFrame, key: list[str], seed: int) -> DataFrame:
    """All rows with their place in a seeded order."""
    return df.withColumn("place", place(key, seed)).orderBy("place", *key)
