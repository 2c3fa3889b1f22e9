"""Near-duplicate recipes from end to end: candidates by the similarity of their texts, scores, validation, clusters.

The text of a record is embedded as its set of words with equal weights. All pairs above a cosine are found exactly,
without an index and without a limit on partners: two sets that are that similar differ in few words, so if the words are
dealt to a few parts by hash, at least two parts (or one, for long texts) are the same in both. Records are joined on such parts.
Copies form classes first, so no group of copies is paired out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions import similarity
from granary.functions.embedding import words
from granary.operators.graph import clusters
from granary.operators.skew import fetched, join_unique, self_join
from granary.session import cut

SEMANTIC, JACCARD, HYBRID = 0.95, 0.50, 0.75  # least scores of a validated pair
#: Up to so many differing words a signature is two parts, beyond it one.
TWO_PARTS = 12


def levels(largest: int, least: float) -> list[tuple[int, int]]:
    """(smallest size, most differing words) of each level: a set pairs only with sets of its own level and those beside it."""
    found, low = [], 1
    while low <= largest:
        high = math.floor(low / least**2 + 1e-9)
        found.append((low, math.floor(high * max(2 * (1 - least), 1 / least**2 - 1) + 1e-9)))
        low = high + 1
    return found


def signatures(sets: DataFrame, least: float) -> DataFrame:
    """id, n, level, own, parts, i, j, signature of sets given as id, words. A set stands at its own level and at the one below,
    where it meets smaller sets. Every signature holds the words of parts i and j (j is -1 for one part)."""
    sized = sets.select("id", F.size("words").alias("n"), F.transform("words", lambda w: F.xxhash64(w)).alias("w")).where("n > 0")
    found = levels(sized.agg(F.coalesce(F.max("n"), F.lit(1)).alias("n")).first()["n"], least)
    lows, differing = (F.array(*[F.lit(x[k]) for x in found]) for k in (0, 1))
    own = F.size(F.filter(lows, lambda low: low <= F.col("n")))
    at = sized.withColumn("top", own).withColumn("level", F.explode(F.filter(F.array(F.col("top"), F.col("top") - 1), lambda k: k > 0)))
    at = at.withColumn("d", F.element_at(differing, F.col("level"))).withColumn("two", F.col("d") <= TWO_PARTS)
    at = at.withColumn("k", F.col("d") + F.when(F.col("two"), 2).otherwise(1))
    part = lambda p: F.xxhash64(F.filter("w", lambda w: F.pmod(w, F.col("k")) == p))
    at = at.withColumn("parts", F.transform(F.sequence(F.lit(0), F.col("k") - 1), part))
    of = lambda i, j: F.struct(i.alias("i"), j.alias("j"), F.xxhash64(F.col("level"), i, j, F.get("parts", i), F.coalesce(F.get("parts", j), F.lit(0))).alias("signature"))
    pairs = F.flatten(F.transform(F.sequence(F.lit(0), F.col("k") - 2), lambda i: F.transform(F.sequence(i + 1, F.col("k") - 1), lambda j: of(i, j))))
    single = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda i: of(i, F.lit(-1)))
    at = at.withColumn("s", F.explode(F.when(F.col("two"), pairs).otherwise(single)))
    return at.select("id", "n", "level", (F.col("top") == F.col("level")).alias("own"), "d", "parts", "s.i", "s.j", "s.signature")


def candidate_pairs(sets: DataFrame, least: float = SEMANTIC) -> DataFrame:
    """a, b (a < b): a superset of the pairs of ``sets`` (unique id, words) whose cosine is at least ``least``, each once."""
    signed = cut(signatures(sets, least))
    left, right, on = self_join(signed, ["signature"])
    x, y = left.alias("x"), right.alias("y")
    same = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in [*on, "level", "i", "j"]]
    bound = F.least("x.n", "y.n") >= F.greatest("x.n", "y.n") * F.lit(least**2 - 1e-9)
    met = x.join(y, [*same, F.col("x.id") < F.col("y.id"), bound, F.col("x.own") | F.col("y.own")])
    equal = F.filter(F.transform(F.zip_with("x.parts", "y.parts", lambda p, q: p == q), lambda e, k: F.when(e, k)), lambda k: k.isNotNull())
    met = met.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.col("x.i"), F.col("x.j"), F.col("x.d"), F.size("x.parts").alias("k"), equal.alias("equal"))
    first = (F.get("equal", F.lit(0)) == F.col("i")) & ((F.col("j") < 0) | (F.get("equal", F.lit(1)) == F.col("j")))
    return met.where(first & (F.col("k") - F.size("equal") <= F.col("d"))).select("a", "b")


def cosine(a: Column, b: Column) -> Column:
    """Of two sets of words with equal weights; 0 if either is empty."""
    shared = F.size(F.array_intersect(a, b)) / F.sqrt(F.size(a).cast("double") * F.size(b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), shared).otherwise(F.lit(0.0))


def text_records(recipes: DataFrame, key: str, title_clean: Column, phrases: Column, measures: dict[str, Column]) -> DataFrame:
    """id, title, phrases (different ones in order), words, digest and ``measures`` of each record. Records of equal title and
    phrases have equal digests. Null titles and lists count as empty."""
    kept = F.array_sort(F.array_distinct(F.coalesce(phrases, F.array().cast("array<string>"))))
    text = F.struct(F.coalesce(title_clean, F.lit("")).alias("title"), kept.alias("phrases"))
    rows = recipes.select(F.col(key).alias("id"), F.explode(F.array(text)).alias("t"), *[c.alias(n) for n, c in measures.items()]).select("*", "t.*").drop("t")
    rows = rows.withColumn("words", words(F.concat_ws(" ", F.col("title"), F.col("phrases"))))
    return rows.withColumn("digest", F.md5(F.concat_ws("\u0001", F.size("phrases"), F.col("title"), F.array_join("phrases", "\u0002"))))


def classes(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One record per class of equal title and phrases (the smallest id), and member, class of all records."""
    heads = cut(records.groupBy("digest").agg(F.min("id").alias("id"), F.count("*").alias("rows"), *[F.first(c).alias(c) for c in ("title", "phrases", "words")]))
    members = join_unique(records.select(F.col("id").alias("member"), "digest"), heads.select("digest", F.col("id").alias("class"), "rows"), ["digest"], "rows", records.count())
    return heads.drop("digest"), members.select("member", "class")


def scored_pairs(heads: DataFrame, least: float = SEMANTIC, candidates: DataFrame | None = None) -> DataFrame:
    """recipe_id, match_id, semantic_score, ingredient_jaccard, title_similarity, hybrid_score of the pairs of class heads whose
    texts are at least ``least`` similar. ``candidates`` (a, b, semantic) of another search or embedder may be given instead."""
    pairs = cut(candidates if candidates is not None else candidate_pairs(heads, least))
    total = pairs.count()
    both = fetched(fetched(pairs, heads, "a", ["title", "phrases", "words"], total), heads, "b", ["title", "phrases", "words"], total)
    if candidates is None:
        both = both.withColumn("semantic", cosine(F.col("words_a"), F.col("words_b"))).where(F.col("semantic") >= F.lit(least - 1e-12))
    title = similarity.title_similarity(F.col("title_a"), F.col("title_b"))
    rows = both.select("a", "b", "semantic", similarity.jaccard(F.col("phrases_a"), F.col("phrases_b")).alias("jaccard"), title.alias("title"))
    score = similarity.hybrid_score(F.col("semantic"), F.col("jaccard"), F.col("title"))
    return rows.select(
        F.col("a").alias("recipe_id"), F.col("b").alias("match_id"), F.col("semantic").alias("semantic_score"), F.col("jaccard").alias("ingredient_jaccard"),
        F.col("title").alias("title_similarity"), score.alias("hybrid_score"),
    )


def validated(scored: DataFrame) -> DataFrame:
    return scored.where((F.col("semantic_score") >= SEMANTIC) & (F.col("ingredient_jaccard") >= JACCARD) & (F.col("hybrid_score") >= HYBRID - 1e-12))


def duplicate_clusters(records: DataFrame) -> DataFrame:
    """cluster_id, recipe_id, cluster_size over validated pairs and copies. A copy of a record with words and phrases scores at least
    0.85 with it, so it is linked to its class; records without any phrase are in no cluster."""
    heads, members = classes(records)
    pairs = validated(scored_pairs(heads)).select(F.col("recipe_id").alias("a"), F.col("match_id").alias("b"))
    told = heads.where("size(phrases) > 0 and size(words) > 0 and rows > 1").select(F.col("id").alias("class"), "rows")
    copies = join_unique(members.where("member <> class"), told, ["class"], "rows", records.count()).select(F.col("class").alias("a"), F.col("member").alias("b"))
    return clusters(pairs.unionByName(copies), "a", "b")
