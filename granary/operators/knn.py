"""Exact nearest neighbours by inner product: a stated query set against all rows, in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of one block of queries, and of one group of targets where both sides are blocked.
BLOCK, GROUP = 4096, 8192
FOUND = "q long, t long, similarity double"


def nearest(queries: DataFrame, targets: DataFrame, k: int, query_id: str, target_id: str, query_vector: str, target_vector: str, skip_self: bool = False, block: int = BLOCK, group: int = GROUP, digits: int = 15) -> DataFrame:
    """query_id, rank (from 1), match_id, similarity of the ``k`` targets with the highest inner product.

    If there are at most ``block`` queries, they are one matrix that goes to every task, and the targets are scanned where they lie.
    Otherwise both sides are dealt to blocks by a hash, a block of queries meets a group of targets in one task, and each task keeps
    the best k per query: k rows per query and group are shuffled, not a row per pair, and the driver holds no vector. Ties
    go to the smaller match; similarities that agree in ``digits`` decimals are ties. Null and empty vectors take no part. Fewer than k
    targets give fewer rows.
    """
    queries = queries.where(F.size(query_vector) > 0).select(F.col(query_id).cast("long").alias("q"), F.col(query_vector).cast("array<double>").alias("v"))
    targets = targets.where(F.size(target_vector) > 0).select(F.col(target_id).cast("long").alias("t"), F.col(target_vector).cast("array<double>").alias("v"))
    asked = queries.count()
    found = _scanned(queries, targets, k, skip_self, digits) if asked <= block else _blocked(queries, targets, k, skip_self, digits, -(-asked // block), -(-targets.count() // group))
    order = Window.partitionBy("q").orderBy(F.desc("similarity"), "t")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("q").alias("query_id"), F.col("rank").cast("long").alias("rank"), F.col("t").alias("match_id"), "similarity")


def best_of(ids: np.ndarray, vectors: np.ndarray, found: np.ndarray, targets: np.ndarray, k: int, skip_self: bool, digits: int) -> pd.DataFrame:
    """The best k targets of each query, of one block by one batch."""
    scores = np.round(vectors @ targets.T, digits)
    if skip_self:
        scores[ids[:, None] == found[None, :]] = -np.inf
    order = np.lexsort((np.broadcast_to(found, scores.shape), -scores), axis=1)[:, :k]
    best = np.take_along_axis(scores, order, axis=1)
    rows = pd.DataFrame({"q": np.repeat(ids, order.shape[1]), "t": found[order].ravel(), "similarity": best.ravel()})
    return rows[np.isfinite(rows["similarity"])]


def _scanned(queries: DataFrame, targets: DataFrame, k: int, skip_self: bool, digits: int) -> DataFrame:
    rows = queries.orderBy("q").collect()  # at most one block
    ids = np.array([r["q"] for r in rows], dtype="int64")
    vectors = np.array([r["v"] for r in rows], dtype="float64")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch) and len(ids):
                yield best_of(ids, vectors, batch["t"].to_numpy(), np.stack(batch["v"].to_numpy()), k, skip_self, digits)

    return targets.mapInPandas(run, FOUND)


def _blocked(queries: DataFrame, targets: DataFrame, k: int, skip_self: bool, digits: int, blocks: int, groups: int) -> DataFrame:
    """Every block of queries with every group of targets: both are copied to the cells of that grid."""
    number = lambda id_, n: F.pmod(F.xxhash64(id_), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.withColumn("b", number("q", blocks)).withColumn("g", every(groups))
    right = targets.withColumn("g", number("t", groups)).withColumn("b", every(blocks))

    def run(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        if not len(one) or not len(two):
            return pd.DataFrame({"q": [], "t": [], "similarity": []})
        ids, vectors = one["q"].to_numpy(), np.stack(one["v"].to_numpy())
        parts = []
        for low in range(0, len(two), 1024):
            part = two.iloc[low : low + 1024]
            parts.append(best_of(ids, vectors, part["t"].to_numpy(), np.stack(part["v"].to_numpy()), k, skip_self, digits))
        return pd.concat(parts).sort_values(["q", "similarity", "t"], ascending=[True, False, True]).groupby("q").head(k)

    return left.groupBy("b", "g").cogroup(right.groupBy("b", "g")).applyInPandas(run, FOUND)


def at_least(pairs: DataFrame, column: str, threshold: float) -> DataFrame:
    """Single-precision columns are compared in single precision: a double literal would shut out equals."""
    kind = dict(pairs.dtypes)[column]
    return pairs.where(F.col(column) >= F.lit(threshold).cast(kind))


def between_open(pairs: DataFrame, column: str, low: float, high: float) -> DataFrame:
    kind = dict(pairs.dtypes)[column]
    return pairs.where((F.col(column) > F.lit(low).cast(kind)) & (F.col(column) < F.lit(high).cast(kind)))


def best_matches(candidates: DataFrame, by: str, rank: str = "rank") -> DataFrame:
    """The candidate of lowest rank per ``by``."""
    rest = [c for c in candidates.columns if c != by]
    return candidates.groupBy(by).agg(F.min_by(F.struct(*rest), rank).alias("_b")).select(by, *[F.col("_b")[c].alias(c) for c in rest])
