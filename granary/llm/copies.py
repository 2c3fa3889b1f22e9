"""Records that are the same but for formatting (problem 4): Merkle-style digests, then full comparison.

A record is a tree: title (leaf), ingredients (unordered node of leaves), directions (leaf). Leaves are
normalised and digested, the digests of an unordered node's children are sorted, and the digest of the
children is the node's. Records group by root digest; the texts themselves are compared afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.leaves import normal_record
from granary.operators.skew import join_unique
from granary.session import cut


def digest(text: Column) -> Column:
    return F.unhex(F.md5(text))


def node(children: Column, ordered: bool) -> Column:
    """Digest of a node from the digests of its children (repeats count)."""
    kept = children if ordered else F.array_sort(children)
    return digest(F.array_join(F.transform(kept, F.hex), "."))


def root(record: Column) -> Column:
    ingredients = node(F.transform(record["ingredients"], digest), ordered=False)
    return node(F.array(digest(record["title"]), ingredients, digest(record["directions"])), ordered=True)


def canonical(record: Column) -> Column:
    """The whole normalised record as one text, unordered parts sorted."""
    return F.concat_ws("\x1e", record["title"], F.array_join(F.array_sort(record["ingredients"]), "\x1f"), record["directions"])


def copies(recipes: DataFrame) -> DataFrame:
    """group_id, recipe_id of the records that have a copy; group_id is the smallest id of the set.

    Null fields count as empty. Rows with null id are left out. A set of any size is safe: rows of a hot
    digest are spread over many tasks, and no task gathers a set.
    """
    recipes = recipes.where(F.col("id").isNotNull()).select("id", "title", "ingredients", "directions")
    record = normal_record(F.col("title"), F.col("ingredients"), F.col("directions"))
    slim = cut(recipes.select("id", record.alias("r")).select("id", root(F.col("r")).alias("root")))
    total = slim.count()
    sets = cut(slim.groupBy("root").agg(F.min("id").alias("group_id"), F.count("*").alias("rows")).where("rows > 1"))
    members = cut(join_unique(slim, sets, ["root"], "rows", total).select("id", "root", "group_id"))

    # Only members are read and normalised again, for the comparison of the texts.
    texts = recipes.join(members.select("id", "root"), "id").select("id", "root", normal_record(F.col("title"), F.col("ingredients"), F.col("directions")).alias("r"))
    texts = texts.select("id", "root", canonical(F.col("r")).alias("text"))
    shapes = texts.groupBy("root", "text").agg(F.min("id").alias("least"), F.count("*").alias("rows"))
    clashes = cut(shapes.select("root", F.xxhash64("text").alias("shape"), "least", "rows").withColumn("shapes", F.count("*").over(_by_root())).where("shapes > 1"))
    sure = members
    if clashes.limit(1).count():  # different texts under one digest: told apart by the texts
        of_clash = clashes.select("root").distinct()
        sure = members.join(of_clash, "root", "left_anti")
        split = shapes.where("rows > 1").join(of_clash, "root", "left_semi").select("root", "text", F.col("least").alias("group_id"))
        sure = sure.unionByName(texts.join(of_clash, "root", "left_semi").join(split, ["root", "text"]).select("id", "root", "group_id"))
    return sure.select("group_id", F.col("id").alias("recipe_id"))


def _by_root():
    from pyspark.sql import Window

    return Window.partitionBy("root")  # of shapes, not of rows: one per set unless digests clash
