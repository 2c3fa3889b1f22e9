"""Pairwise matches consolidated into groups (problem 2): alternating large-star and small-star rewrites.

Kiveris et al., "Connected components in MapReduce and beyond", 2014. Each rewrite is an aggregation (with
partial aggregation before its shuffle) and a join that splits hot nodes; lineage is cut by checkpoints in
reliable storage after every rewrite. No link, label or component reaches the driver, only a count and a
checksum of the edges. O(log^2 n) rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from granary.operators.skew import join_unique
from granary.session import cut, drop


def state_of(edges: DataFrame) -> Row:
    """Count and checksum: equal before and after a rewrite means that it changed nothing."""
    return edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")).first()


def star(edges: DataFrame, rows: int, large: bool) -> DataFrame:
    """One rewrite of the edges (a > b), without repeats, written out.

    Large: every neighbour above a node is tied to the smallest of the node and its neighbours. Small: every
    node and its smaller neighbours are tied to the smallest of them.
    """
    if large:
        near = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"), F.count("*").alias("rows")))
        tied = join_unique(near, least, ["a"], "rows", 2 * rows).where("b > a")
        rewritten = tied.select(F.col("b").alias("a"), F.col("least").alias("b")).where("a <> b")
    else:
        least = cut(edges.groupBy("a").agg(F.min("b").alias("least"), F.count("*").alias("rows")))
        tied = join_unique(edges, least, ["a"], "rows", rows).where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
        rewritten = tied.unionByName(least.select("a", F.col("least").alias("b")))
    written = cut(rewritten.distinct())
    drop(edges, least)
    return written


def components(pairs: DataFrame, one: str, other: str, most_rounds: int = 200) -> DataFrame:
    """id, group_id of every id that a pair ties to another; group_id is the smallest id of its component.

    Pairs with a null, pairs of an id with itself, mirrored and repeated pairs change nothing. No pair gives
    an empty result. Raises RuntimeError if ``most_rounds`` do not suffice (they are beyond any real size).
    """
    a, b = F.col(one).cast("long"), F.col(other).cast("long")
    edges = pairs.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where(a.isNotNull() & b.isNotNull() & (a != b)).distinct()
    edges = cut(edges)
    state = state_of(edges)
    for _ in range(most_rounds):
        before = state
        if not before["n"]:
            break
        edges = star(edges, before["n"], large=True)
        between = state_of(edges)
        edges = star(edges, between["n"], large=False)
        state = state_of(edges)
        if state == before == between:
            break
    else:
        raise RuntimeError("components: no fixed point reached")
    members = edges.select(F.col("a").alias("id"), F.col("b").alias("group_id"))
    return members.unionByName(members.select(F.col("group_id").alias("id"), "group_id").distinct())


def label_pairs(labels: DataFrame) -> DataFrame:
    """The pairs that a label of 4 or 5 ties."""
    return labels.where(F.col("likert_label").isin(4, 5)).select("recipe_id", "match_id")


def found_groups(labels: DataFrame) -> DataFrame:
    """The rows of p2_found: recipe_id, group_id."""
    return components(label_pairs(labels), "recipe_id", "match_id").select(F.col("id").alias("recipe_id"), "group_id")
