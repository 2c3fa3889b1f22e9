"""Clusters of an undirected graph: minimum labels with shortcuts, and their numbering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.operators.numbering import numbered
from granary.operators.skew import join_unique
from granary.session import cut, drop


def cluster_roots(edges: DataFrame, a: str, b: str, most_rounds: int = 100) -> DataFrame:
    """id, root of every id in an edge; root is the smallest id of its cluster.

    Each round every node takes the smallest label around it, then the label of that label, so chains shorten
    exponentially. Nulls and loops are left out. Only a change count reaches the driver. Links of a node that
    holds more than a thousandth of them are spread over several tasks.
    """
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    one = edges.where(x.isNotNull() & y.isNotNull() & (x != y)).select(x.alias("id"), y.alias("other"))
    links = cut(one.unionByName(one.select(F.col("other").alias("id"), F.col("id").alias("other"))).distinct())
    total = links.count()
    labels = cut(links.groupBy("id").agg(F.least(F.col("id"), F.min("other")).alias("root"), F.count("*").alias("rows")))
    for _ in range(most_rounds):
        near = join_unique(links, labels.select(F.col("id").alias("other"), F.col("root").alias("near"), "rows"), ["other"], "rows", total)
        around = near.groupBy("id").agg(F.min("near").alias("near"))
        lower = labels.join(around, "id").select("id", "rows", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        sizes = lower.groupBy("root").agg(F.count("*").alias("members"))
        jump = sizes.join(labels.select(F.col("id").alias("root"), F.col("root").alias("beyond")), "root")
        stepped = cut(join_unique(lower, jump, ["root"], "members", total).select("id", "rows", "old", F.least("root", "beyond").alias("root")))
        changed = stepped.where("root < old").limit(1).count()
        drop(labels)
        labels = stepped.select("id", "root", "rows")
        if not changed:
            drop(links)
            return labels.select("id", "root")
    raise RuntimeError("cluster_roots: no fixed point reached")


def clusters(edges: DataFrame, a: str, b: str) -> DataFrame:
    """cluster_id, recipe_id, cluster_size; clusters are numbered from 0 by their smallest member.

    Sizes are aggregated and joined back, numbering runs over the roots alone.
    """
    roots = cluster_roots(edges, a, b)
    sizes = numbered(roots.groupBy("root").agg(F.count("*").alias("cluster_size")), "cluster_id", "root")
    total = roots.count()
    members = join_unique(roots, sizes, ["root"], "cluster_size", total)
    return members.select("cluster_id", F.col("id").alias("recipe_id"), "cluster_size")
