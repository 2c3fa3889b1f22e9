"""The queue of pairs for human labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAIR = ["recipe_id", "match_id"]


def unlabeled(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs that no label names in the same direction. Pairs with a null id stay."""
    return pairs.join(labels.select(*PAIR).distinct(), PAIR, "left_anti")


def hydrated(pairs: DataFrame, recipes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Pairs with the ``columns`` of both records, as ``c_a`` and ``c_b``; null where a record is missing."""
    side = lambda pair_key, mark: recipes.select(F.col(key).alias(pair_key), *[F.col(c).alias(f"{c}_{mark}") for c in columns])
    return pairs.join(side(PAIR[0], "a"), PAIR[0], "left").join(side(PAIR[1], "b"), PAIR[1], "left")


def record_label(pair: DataFrame, label: int, notes: str | None) -> DataFrame:
    """The rows to append to the log; labels go from 1 to 5."""
    if label not in range(1, 6):
        raise ValueError(f"label {label} is not in 1..5")
    return pair.withColumn("likert_label", F.lit(label).cast("int")).withColumn("notes", F.lit(notes).cast("string"))
