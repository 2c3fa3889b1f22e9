"""Near-duplicate recipes: exact dedupe, set-similar pairs, clusters, survivors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions import similarity
from granary.operators.skew import fetched, join_unique, self_join
from granary.session import cut


def first_of_equal(df: DataFrame, columns: list[str], key: str) -> DataFrame:
    """Keys kept when rows equal in ``columns`` (nulls equal nulls) leave the smallest key only."""
    return df.groupBy(*columns).agg(F.min(key).alias(key)).select(key)


def set_classes(df: DataFrame, key: str, values: Column) -> DataFrame:
    """member, class: rows with the same set of values share a class, named by its smallest key."""
    sets = df.select(F.col(key).alias("member"), F.xxhash64(F.array_sort(F.array_distinct(values))).alias("h"), F.md5(F.array_join(F.array_sort(F.array_distinct(values)), "\u0001")).alias("d"))
    heads = cut(sets.groupBy("h", "d").agg(F.min("member").alias("class"), F.count("*").alias("rows")))
    return join_unique(sets, heads, ["h", "d"], "rows", df.count()).select("member", "class")


def similar_sets(df: DataFrame, key: str, values: Column, threshold: float) -> DataFrame:
    """a, b, jaccard of the pairs (a < b) of class representatives with a Jaccard similarity of at least
    ``threshold`` (above 0). Copies are classes of ``set_classes``, so no group of copies is paired out.

    Values are ordered by rarity; similar sets share one of their first |x| - ceil(t |x|) + 1 values, so the
    frequent ones are never joined on. Hashes of the values are joined, a pair is met at the first value that both share, hot values
    are split; the sets themselves are fetched for the pairs that are left and compared whole. Empty sets have no pair.
    """
    sets = df.select(F.col(key).alias("id"), F.array_sort(F.array_distinct(values)).alias("values")).where("size(values) > 0")
    sets = cut(sets.groupBy("values").agg(F.min("id").alias("id")))
    long = sets.select("id", F.size("values").alias("n"), F.explode("values").alias("value"))
    rarity = cut(long.groupBy("value").agg(F.count("*").alias("df")))
    ranked = join_unique(long, rarity, ["value"], "df", long.count())
    ordered = ranked.groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "value"))).alias("o"))  # one set's values
    ordered = ordered.select("id", "n", F.transform("o", lambda v: F.xxhash64(v["value"])).alias("hashes"))
    size = F.col("n") - F.ceil(F.col("n") * F.lit(threshold) - 1e-9) + 1
    heads = cut(ordered.select("id", "n", "hashes", F.posexplode(F.slice("hashes", F.lit(1), size.cast("int"))).alias("at", "value")))
    left, right, on = self_join(heads, ["value"])
    x, y = left.alias("x"), right.alias("y")
    need = F.ceil((F.col("x.n") + F.col("y.n")) * F.lit(threshold / (1 + threshold)) - 1e-9)
    fits = (F.col("x.n") >= F.col("y.n") * threshold) & (F.col("y.n") >= F.col("x.n") * threshold)
    ahead = F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at")) >= need
    before = lambda s: F.slice(f"{s}.hashes", F.lit(1), F.col(f"{s}.at"))
    met = x.join(y, [*[F.col(f"x.{c}") == F.col(f"y.{c}") for c in on], F.col("x.id") < F.col("y.id"), fits, ahead, ~F.arrays_overlap(before("x"), before("y"))])
    pairs = cut(met.where(F.size(F.array_intersect("x.hashes", "y.hashes")) >= need).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")))
    total = pairs.count()
    both = fetched(fetched(pairs, sets, "a", ["values"], total), sets, "b", ["values"], total)
    scored = both.select("a", "b", similarity.jaccard(F.col("values_a"), F.col("values_b")).alias("jaccard"))
    return scored.where(F.col("jaccard") >= threshold)


def unmirrored(pairs: DataFrame, a: str, b: str, score: str) -> DataFrame:
    """One row per unordered pair: smaller id first, the higher score."""
    return pairs.groupBy(F.least(a, b).alias(a), F.greatest(a, b).alias(b)).agg(F.max(score).alias(score))


def survivors(members: DataFrame, measures: DataFrame) -> DataFrame:
    """cluster_id, recipe_id of the record kept per cluster: most ingredients, longest directions, smallest id.
    ``measures``: recipe_id, ingredient_count, directions_length."""
    order = F.struct("ingredient_count", "directions_length", (-F.col("recipe_id")).alias("i"))
    return members.join(measures, "recipe_id").groupBy("cluster_id").agg(F.max_by("recipe_id", order).alias("recipe_id"))


def flagged(recipes: DataFrame, key: str, members: DataFrame, kept: DataFrame) -> DataFrame:
    """``recipes`` with hybrid_cluster_id, is_hybrid_duplicate_candidate, keep_hybrid_representative; rows in
    no cluster are kept."""
    marks = members.join(kept.select("recipe_id", F.lit(True).alias("_kept")), "recipe_id", "left").select(F.col("recipe_id").alias(key), "cluster_id", "_kept")
    rows = recipes.join(marks, key, "left")
    inside = F.col("cluster_id").isNotNull()
    return rows.select(
        *recipes.columns,
        F.col("cluster_id").alias("hybrid_cluster_id"),
        inside.alias("is_hybrid_duplicate_candidate"),
        (~inside | F.coalesce("_kept", F.lit(False))).alias("keep_hybrid_representative"),
    )


def size_histogram(members: DataFrame, most: int = 20) -> DataFrame:
    """cluster_size, n_members of the smallest sizes (member rows are counted, not clusters)."""
    return members.groupBy("cluster_size").agg(F.count("*").alias("n_members")).orderBy("cluster_size").limit(most)


def largest_cluster(members: DataFrame) -> DataFrame:
    """Members of the largest cluster; of equal ones the first."""
    top = members.select("cluster_id", "cluster_size").orderBy(F.desc("cluster_size"), "cluster_id").limit(1).select("cluster_id")
    return members.join(F.broadcast(top), "cluster_id", "left_semi")

