"""Equi-join against a side with unique keys, with the hot keys of the other side split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.session import cut

#: A key is hot if it holds more than this share of all rows, so at most 1 / SHARE keys can be.
SHARE = 1 / 1000
#: No key with fewer rows is worth a split.
LEAST = 20_000


def join_unique(left: DataFrame, right: DataFrame, keys: list[str], rows: str, total: int) -> DataFrame:
    """Inner join of ``left`` with ``right``, whose ``keys`` are unique and whose column ``rows`` counts the
    left rows of the key; ``total`` is the number of left rows.

    The left rows of a hot key are spread over as many parts as it has thousandths of the rows, and its one
    right row is copied to each. The list of hot keys has at most 1,000 rows by its definition, so it is
    broadcast whatever the size of the data. Null keys join nothing.
    """
    most = max(LEAST, int(total * SHARE))
    if total <= most:  # no key can hold more
        return left.join(right, keys)
    parts = F.when(F.col(rows) > most, F.ceil(F.col(rows) / F.lit(most))).otherwise(F.lit(1)).cast("int")
    hot = right.where(F.col(rows) > most).select(*keys, parts.alias("_parts"))
    spread = left.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.pmod(F.xxhash64(*left.columns), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    copied = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1)))
    return spread.join(copied, [*keys, "_salt"]).drop("_salt")


#: A key with more rows than this meets too many partners for one task.
MEETING = 2_000


def self_join(df: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides and the join columns of a join of ``df`` with itself on ``keys``, with hot keys split.

    Rows whose key no other row has are left out first. The left rows of a key with more than MEETING rows are spread over parts
    of that size, and its right rows are copied to each part, so a task meets at most that many left rows with the key's.
    """
    counts = df.groupBy(*keys).agg(F.count("*").alias("_rows")).where("_rows > 1")
    met = cut(join_unique(df, counts, keys, "_rows", df.count()))
    parts = F.ceil(F.col("_rows") / F.lit(MEETING)).cast("int")
    left = met.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), parts).cast("int")).drop("_rows")
    right = met.withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_rows")
    return left, right, [*keys, "_salt"]


def fetched(pairs: DataFrame, records: DataFrame, side: str, columns: list[str], total: int) -> DataFrame:
    """``pairs`` with the ``columns`` of the record (unique id) named by ``side``; a record with many pairs is split."""
    sizes = pairs.groupBy(side).agg(F.count("*").alias("_rows"))
    right = records.select(F.col("id").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in columns]).join(sizes, side)
    return join_unique(pairs, right, [side], "_rows", total).drop("_rows")
