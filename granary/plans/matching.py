"""Queries of vector search, matching, loading, lookups and the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import similarity
from granary.functions.embedding import DIMENSIONS, Embedder, hashed_letters
from granary.functions.text import simple_clean
from granary.operators import catalog, dedupe, knn, loading, profile
from granary.operators.numbering import numbered
from granary.plans.recipes import CLEANED, unique_phrases
from granary.session import cut, table

ACCEPT, LOW, HIGH, PAIRED = 0.35, 0.25, 0.35, 0.30


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))


def l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = similarity.l2_normalized(F.col("embedding"))
    return vectors(spark, sf_dir).select("vec_id", F.round(similarity.inner_product(v, v), 6).alias("norm"), F.round(v[0], 6).alias("first"))


def _search(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """The vectors whose id is divisible by 100 as queries, all vectors as targets."""
    rows = vectors(spark, sf_dir)
    return knn.nearest(rows.where("vec_id % 100 = 0"), rows, k, "vec_id", "vec_id", "embedding", "embedding", skip_self=True)


def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, 9).withColumn("similarity", F.round("similarity", 5))


def threshold_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.at_least(_search(spark, sf_dir, 9), "similarity", PAIRED).select("query_id", "match_id")


def unique_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = dedupe.unmirrored(_search(spark, sf_dir, 9), "query_id", "match_id", "similarity")
    return pairs.withColumn("similarity", F.round("similarity", 5))


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = vectors(spark, sf_dir).select(F.col("vec_id").alias("match_id"), F.col("label").alias("match_label"))
    return _search(spark, sf_dir, 5).join(labels, "match_id").select("query_id", "rank", "match_id", "match_label", F.col("similarity").cast("float").alias("similarity"))


def knn_match_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir).withColumn("similarity", F.round(F.col("similarity").cast("double"), 5))


def best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.best_matches(_candidates(spark, sf_dir), "query_id").select("query_id", "match_id", "match_label")


def accepted_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.at_least(knn.best_matches(_candidates(spark, sf_dir), "query_id"), "similarity", ACCEPT).select("query_id", "match_id")


def midrange_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.between_open(_candidates(spark, sf_dir), "similarity", LOW, HIGH).select("query_id", "rank", "match_id")


def topk_weakest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir).orderBy("similarity", "query_id", "match_id").limit(20).select("query_id", "match_id")


def topk_strongest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir).orderBy(F.desc("similarity"), "query_id", "match_id").limit(20).select("query_id", "match_id")


MATCHED = 0.72


def _phrase_foods(spark: SparkSession, sf_dir: str, embed: Embedder = hashed_letters) -> DataFrame:
    """The five nearest foods of the list of each different ingredient phrase: two tables, embedded alike."""
    phrases = numbered(unique_phrases(spark, sf_dir), "phrase_id", "phrase")
    foods = table(spark, sf_dir, "canonical_item").where("kind = 'food'").select("item_id", "name")
    asked = cut(phrases.select("phrase_id", "phrase", embed(F.col("phrase")).alias("v")))
    near = knn.nearest(asked, foods.select("item_id", embed(simple_clean(F.col("name"))).alias("v")), 5, "phrase_id", "item_id", "v", "v", digits=9)
    named = near.join(asked.select(F.col("phrase_id").alias("query_id"), "phrase"), "query_id").join(foods.select(F.col("item_id").cast("long").alias("match_id"), "name"), "match_id")
    return named.select("phrase", "rank", F.col("match_id").cast("int").alias("item_id"), "name", F.col("similarity").cast("float").alias("similarity"))


def phrase_foods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _phrase_foods(spark, sf_dir).withColumn("similarity", F.round(F.col("similarity").cast("double"), 5))


def phrase_best_food(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.best_matches(_phrase_foods(spark, sf_dir), "phrase").select("phrase", "item_id", "name")


def phrase_accepted_food(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.at_least(knn.best_matches(_phrase_foods(spark, sf_dir), "phrase"), "similarity", MATCHED).select("phrase", "item_id")


def describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.describe(table(spark, sf_dir, "lineitem"), "l_extendedprice").withColumn("value", F.round("value", 3))


def safe_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("density_g_per_ml")
    plain = F.when(text.rlike(r"^\d+(\.\d+)?$"), text)
    return table(spark, sf_dir, "food_density").select("id", plain.try_cast("double").alias("density"), F.when(F.col("biblio_id").rlike(r"^\d+$"), F.col("biblio_id")).try_cast("bigint").alias("biblio"))


def left_join_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return rows.join(part, rows["l_partkey"] == part["p_partkey"], "left").select("l_orderkey", "l_linenumber", "l_partkey", "p_name", "p_brand")


def star_join_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point lookup through a star: the report of one key, first 20 rows."""
    customer = table(spark, sf_dir, "customer").where("c_custkey = 7").select("c_custkey", "c_name")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    rows = customer.join(orders, customer["c_custkey"] == orders["o_custkey"]).join(lines, orders["o_orderkey"] == lines["l_orderkey"])
    return rows.select("c_custkey", "c_name", "o_orderkey", "l_linenumber", "l_quantity").orderBy("o_orderkey", "l_linenumber").limit(20)


CUT_DATE = "1995-01-01"


def _split_orders(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All orders as the batch, those before a date as what is already stored."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    return rows, rows.where(F.col("o_orderdate") < F.lit(CUT_DATE).cast("timestamp"))


def insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch, stored = _split_orders(spark, sf_dir)
    return loading.insert_or_ignore(batch.unionAll(batch), stored, ["o_orderkey"], ["o_orderdate", "o_totalprice"]).select("o_orderkey", "o_custkey", "o_totalprice")


def insert_ignore_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First row of each id of open_recipe; rows without an id share the empty one and only one stays."""
    rows = table(spark, sf_dir, "open_recipe").select("id", "url", "name")
    return loading.first_rows(rows, ["id"], ["url", "name"])


def resume_hwm(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch, _ = _split_orders(spark, sf_dir)
    stored = batch.where("o_totalprice < 5000")
    return loading.resume_rows(batch, stored, "o_orderkey").select("o_orderkey")


def pk_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "open_recipe")
    return loading.key_violations(rows, ["id"], ["id", "source", "name"])


def union_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("recipe_nlg", "open_recipe", "food_density", "orders")
    return loading.row_counts({n: table(spark, sf_dir, n) for n in names})


def infer_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.infer_joins(catalog.declared_columns(spark)).select("from_table", "from_column", "to_table", "to_column", "source")


def satellites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.satellites(catalog.infer_joins(catalog.declared_columns(spark)))


def fuzzy_best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best fuzzy match of each food name whose id is divisible by 100 among the canonical foods."""
    items = table(spark, sf_dir, "canonical_item").where("kind = 'food'").select("item_id", "name")
    names = table(spark, sf_dir, "food_density").where("id % 100 = 0 and food_name is not null").select("id", F.lower("food_name").alias("food_name"))
    block = F.array(*[F.struct(F.lit(r["item_id"]).alias("item_id"), F.lit(r["name"]).alias("name")) for r in items.orderBy("item_id").collect()])  # 214 rows, fixed
    scored = names.select("id", "food_name", F.explode(block).alias("i")).select("id", "food_name", "i.item_id", "i.name")
    scored = scored.withColumn("score", F.round(similarity.fuzzy_ratio(F.col("food_name"), F.col("name")), 4))
    return scored.groupBy("id", "food_name").agg(F.max_by(F.struct("item_id", "name", "score"), F.struct("score", (-F.col("item_id")).alias("i"))).alias("b")).select("id", "food_name", "b.item_id", "b.name", "b.score")


QUERIES = {
    f.__name__: f
    for f in (
        json_extract, l2_normalize, knn_topk, threshold_pairs, unique_pairs, knn_match_top5, best_match, accepted_matches, midrange_matches, topk_weakest, topk_strongest, phrase_foods, phrase_best_food, phrase_accepted_food, describe, safe_cast,
        left_join_lookup, star_join_lookup, insert_ignore, insert_ignore_recipes, resume_hwm, pk_violations, union_counts, infer_joins, satellites, fuzzy_best_match,
    )
}

SCORED = """scored AS (SELECT q.vec_id AS query_id, t.vec_id AS match_id, t.label AS match_label, list_inner_product(q.embedding::DOUBLE[], t.embedding::DOUBLE[]) AS s
  FROM embeddings q JOIN embeddings t ON q.vec_id <> t.vec_id WHERE q.vec_id % 100 = 0),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, match_id) AS rank FROM scored),
  cand AS (SELECT query_id, rank, match_id, match_label, s::FLOAT AS similarity FROM ranked WHERE rank <= 5)"""


def letters_sql(name: str, source: str, text: str) -> str:
    """``name``: the rows of ``source`` with their hashed letter triples as the vector v."""
    padded = f"(' ' || {text} || ' ')"
    places = f"list_transform(range(1, length({padded}) - 1), lambda i: ('0x' || substr(md5(substr({padded}, i, 3)), 1, 8))::BIGINT % {DIMENSIONS})"
    return f"""{name}_places AS MATERIALIZED (SELECT *, {places} AS places FROM {source}),
  {name} AS MATERIALIZED (SELECT *, list_transform(range(0, {DIMENSIONS}), lambda k: len(list_filter(places, lambda p: p = k))::DOUBLE) AS v FROM {name}_places)"""


PHRASE_FOODS = rf"""{CLEANED}, told AS (SELECT phrase FROM (SELECT DISTINCT unnest(c) AS phrase FROM cleaned) WHERE trim(phrase) <> ''), {letters_sql('phrases', 'told', 'phrase')},
  names AS (SELECT item_id, name, trim(regexp_replace(regexp_replace(lower(name), '[^a-z\s]', ' ', 'g'), '\s+', ' ', 'g')) AS n FROM canonical_item WHERE kind = 'food'), {letters_sql('foods', 'names', 'n')},
  paired AS (SELECT phrase, item_id, name, round(list_inner_product(p.v, f.v) / sqrt(list_inner_product(p.v, p.v) * list_inner_product(f.v, f.v)), 9) AS s FROM phrases p CROSS JOIN foods f),
  matched AS MATERIALIZED (SELECT phrase, item_id, name, s::FLOAT AS similarity, row_number() OVER (PARTITION BY phrase ORDER BY s DESC, item_id) AS rank FROM paired)"""
JOINS = [
    ("branded_food", "fdc_id", "food", "fdc_id"), ("fndds_ingredient_nutrient_value", "fdc_id", "food", "fdc_id"), ("food", "food_category_id", "food_category", "id"), ("food_component", "fdc_id", "food", "fdc_id"),
    ("food_nutrient", "fdc_id", "food", "fdc_id"), ("food_nutrient", "nutrient_id", "nutrient", "id"), ("food_portion", "fdc_id", "food", "fdc_id"), ("food_portion", "measure_unit_id", "measure_unit", "id"),
    ("foundation_food", "fdc_id", "food", "fdc_id"), ("input_food", "fdc_id", "food", "fdc_id"), ("input_food", "fdc_id_of_input_food", "food", "fdc_id"), ("lab_method_code", "lab_method_id", "lab_method", "id"),
    ("lab_method_nutrient", "lab_method_id", "lab_method", "id"), ("lab_method_nutrient", "nutrient_id", "nutrient", "id"), ("market_acquisition", "fdc_id", "food", "fdc_id"), ("microbe", "food_id", "food", "fdc_id"),
    ("retention_factor", "food_group_id", "food_category", "id"), ("sample_food", "fdc_id", "food", "fdc_id"), ("sr_legacy_food", "fdc_id", "food", "fdc_id"), ("sub_sample_food", "fdc_id", "food", "fdc_id"),
    ("sub_sample_food", "fdc_id_of_sample_food", "sample_food", "fdc_id"), ("sub_sample_result", "food_nutrient_id", "food_nutrient", "id"), ("sub_sample_result", "lab_method_id", "lab_method", "id"),
    ("survey_fndds_food", "fdc_id", "food", "fdc_id"), ("survey_fndds_food", "wweia_category_code", "wweia_food_category", "wweia_food_category"),
]

ORACLES = {
    "json_extract": "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    "l2_normalize": """SELECT vec_id, round(list_inner_product(u, u), 6) AS norm, round(u[1], 6) AS "first" FROM (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS u FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings))""",
    "knn_topk": f"WITH {SCORED} SELECT query_id, rank, match_id, round(s, 5) AS similarity FROM ranked WHERE rank <= 9",
    "threshold_pairs": f"WITH {SCORED} SELECT query_id, match_id FROM ranked WHERE rank <= 9 AND s >= 0.30::DOUBLE",
    "unique_pairs": f"WITH {SCORED} SELECT least(query_id, match_id) AS query_id, greatest(query_id, match_id) AS match_id, round(max(s), 5) AS similarity FROM ranked WHERE rank <= 9 GROUP BY 1, 2",
    "knn_match_top5": f"WITH {SCORED} SELECT query_id, rank, match_id, match_label, round(similarity::DOUBLE, 5) AS similarity FROM cand",
    "best_match": f"WITH {SCORED} SELECT query_id, match_id, match_label FROM cand WHERE rank = 1",
    "accepted_matches": f"WITH {SCORED} SELECT query_id, match_id FROM cand WHERE rank = 1 AND similarity >= 0.35::FLOAT",
    "midrange_matches": f"WITH {SCORED} SELECT query_id, rank, match_id FROM cand WHERE similarity > 0.25::FLOAT AND similarity < 0.35::FLOAT",
    "topk_weakest": f"WITH {SCORED} SELECT query_id, match_id FROM cand ORDER BY similarity, query_id, match_id LIMIT 20",
    "topk_strongest": f"WITH {SCORED} SELECT query_id, match_id FROM cand ORDER BY similarity DESC, query_id, match_id LIMIT 20",
    "phrase_foods": f"WITH {PHRASE_FOODS} SELECT phrase, rank, item_id, name, round(similarity::DOUBLE, 5) AS similarity FROM matched WHERE rank <= 5",
    "phrase_best_food": f"WITH {PHRASE_FOODS} SELECT phrase, item_id, name FROM matched WHERE rank = 1",
    "phrase_accepted_food": f"WITH {PHRASE_FOODS} SELECT phrase, item_id FROM matched WHERE rank = 1 AND similarity >= 0.72::FLOAT",
    "describe": """WITH s AS (SELECT count(l_extendedprice)::DOUBLE AS c, avg(l_extendedprice) AS m, stddev_samp(l_extendedprice) AS d, min(l_extendedprice) AS lo, quantile_cont(l_extendedprice, 0.25) AS q1,
  quantile_cont(l_extendedprice, 0.5) AS q2, quantile_cont(l_extendedprice, 0.75) AS q3, max(l_extendedprice) AS hi FROM lineitem)
  SELECT statistic, round(value, 3) AS value FROM (SELECT unnest(['count', 'mean', 'std', 'min', '25%', '50%', '75%', 'max']) AS statistic, unnest([c, m, d, lo, q1, q2, q3, hi]) AS value FROM s)""",
    "safe_cast": r"SELECT id, CASE WHEN regexp_matches(density_g_per_ml, '^\d+(\.\d+)?$') THEN TRY_CAST(density_g_per_ml AS DOUBLE) END AS density, CASE WHEN regexp_matches(biblio_id, '^\d+$') THEN TRY_CAST(biblio_id AS BIGINT) END AS biblio FROM food_density",
    "left_join_lookup": "SELECT l_orderkey, l_linenumber, l_partkey, p_name, p_brand FROM lineitem LEFT JOIN part ON l_partkey = p_partkey",
    "star_join_lookup": "SELECT c_custkey, c_name, o_orderkey, l_linenumber, l_quantity FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey WHERE c_custkey = 7 ORDER BY o_orderkey, l_linenumber LIMIT 20",
    "insert_ignore": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01'",
    "insert_ignore_recipes": "SELECT id, url, name FROM (SELECT id, url, name, row_number() OVER (PARTITION BY id ORDER BY url NULLS FIRST, name NULLS FIRST) AS n FROM open_recipe) WHERE n = 1",
    "resume_hwm": "SELECT o_orderkey FROM orders WHERE o_orderkey > (SELECT coalesce(max(o_orderkey), -1) FROM orders WHERE o_totalprice < 5000)",
    "pk_violations": """SELECT 'primary key' AS "check", 'id' AS "column", count(*) AS n FROM (SELECT id FROM open_recipe GROUP BY id HAVING count(*) > 1) HAVING count(*) > 0
  UNION ALL SELECT 'not null', c, n FROM (SELECT 'id' AS c, count(*) FILTER (id IS NULL) AS n FROM open_recipe UNION ALL SELECT 'source', count(*) FILTER (source IS NULL) FROM open_recipe
  UNION ALL SELECT 'name', count(*) FILTER (name IS NULL) FROM open_recipe) WHERE n > 0""",
    "union_counts": " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in ("recipe_nlg", "open_recipe", "food_density", "orders")),
    "infer_joins": "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', '{c}', '{d}', 'named_convention')" for a, b, c, d in JOINS) + ") AS j(from_table, from_column, to_table, to_column, source)",
    "satellites": "SELECT * FROM (VALUES " + ", ".join(f"('{t}')" for t in sorted({a for a, b, c, _ in JOINS if c == "food" and b in ("fdc_id", "food_id")})) + ") AS s(satellite)",
}
