"""Queries of the recipe pipeline: cleaning, deduplication, clusters, survivors, review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import similarity, text
from granary.functions.unpack import read_list
from granary.operators import dedupe, hybrid, profile, review
from granary.session import cut, spread, table

THRESHOLD = 0.5
SEED = 42


def recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "recipe_nlg")


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every recipe with the list of its ingredients, whatever their packing, and its cleaned form. No ingredients give an empty list."""
    rows = spread(recipes(spark, sf_dir)).withColumn("parsed", read_list(F.col("ingredients")))
    # The generator evaluates the cleaning once, however often the column is used.
    return rows.select("*", F.explode(F.array(text.clean_ingredients(F.col("parsed")))).alias("ingredients_clean"))


def dedupe_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.first_of_equal(recipes(spark, sf_dir), ["title", "ingredients", "directions"], "id")


def dedupe_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = recipes(spark, sf_dir)
    kept = dedupe.first_of_equal(rows, ["title", "ingredients", "directions"], "id")
    return rows.agg(F.count("*").alias("n_rows")).crossJoin(F.broadcast(kept.agg(F.count("*").alias("n_kept"))))  # one row by one row


def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = lambda c: text.normalize_text(F.col(c)).alias(f"{c}_clean")
    return recipes(spark, sf_dir).select("id", clean("title"), clean("directions"), clean("source"))


def simple_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "food_density").select("id", text.simple_clean(F.col("food_name")).alias("name_clean"))


def clean_ingredient(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = parsed(spark, sf_dir).select("id", F.posexplode("parsed").alias("pos", "value"))
    return values.select("id", F.col("pos").cast("long").alias("pos"), text.clean_ingredient(F.col("value")).alias("ingredient_clean"))


def clean_ingredient_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed(spark, sf_dir).select("id", F.array_join("ingredients_clean", "|").alias("ingredients_clean"), F.size("ingredients_clean").cast("long").alias("n"))


def semantic_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed(spark, sf_dir).select("id", text.semantic_text(text.normalize_text(F.col("title")), F.col("ingredients_clean")).alias("semantic_text"))


def parse_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed(spark, sf_dir).select("id", F.size("parsed").cast("long").alias("n"), F.array_join("parsed", "|").alias("joined"))


def json_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw text where it is JSON, ``[]`` for empty, and a mark for the rest (the strict scan raises on it)."""
    raw = F.col("ner")
    valid = F.when(F.coalesce(raw, F.lit("")) == "", F.lit("[]")).when(text.is_json(raw), raw)
    return recipes(spark, sf_dir).select("id", F.coalesce(valid, F.lit("invalid")).alias("ner"))


def _sets() -> Column:
    return F.col("ingredients_clean")


def jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs between classes of equal ingredient sets; set_classes has the members."""
    return dedupe.similar_sets(parsed(spark, sf_dir), "id", _sets(), THRESHOLD).withColumn("jaccard", F.round("jaccard", 6))


def set_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.set_classes(parsed(spark, sf_dir), "id", _sets()).select("member", "class")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every recipe, unpacked and cleaned once and stored: later stages read those rows."""
    measures = {"ingredient_count": F.size("ingredients_clean"), "directions_length": F.char_length(text.normalize_text(F.col("directions")))}
    return cut(hybrid.text_records(parsed(spark, sf_dir), "id", text.normalize_text(F.col("title")), F.col("ingredients_clean"), measures))


def hybrid_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all pairs of different recipes whose texts are at least 0.95 similar; recipe_classes has the copies."""
    scored = hybrid.scored_pairs(hybrid.classes(_records(spark, sf_dir))[0])
    return scored.select("recipe_id", "match_id", *[F.round(c, 9).alias(c) for c in ("semantic_score", "ingredient_jaccard", "title_similarity", "hybrid_score")])


def hybrid_validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hybrid.validated(hybrid.scored_pairs(hybrid.classes(_records(spark, sf_dir))[0])).select("recipe_id", "match_id")


def recipe_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hybrid.classes(_records(spark, sf_dir))[1].select("member", "class")


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hybrid.duplicate_clusters(_records(spark, sf_dir))


def cluster_size_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.size_histogram(clusters(spark, sf_dir))


def largest_cluster_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.largest_cluster(clusters(spark, sf_dir))


def _survivors(records: DataFrame, members: DataFrame) -> DataFrame:
    return dedupe.survivors(members, records.select(F.col("id").alias("recipe_id"), "ingredient_count", "directions_length"))


def survivor_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = _records(spark, sf_dir)
    return _survivors(records, hybrid.duplicate_clusters(records))


def survivor_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = _records(spark, sf_dir)
    members = cut(hybrid.duplicate_clusters(records))
    return dedupe.flagged(records.select("id"), "id", members, _survivors(records, members))


def trimmed_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivor_flags(spark, sf_dir).where("keep_hybrid_representative").select("id")


def unique_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    phrases = parsed(spark, sf_dir).select(F.explode("ingredients_clean").alias("phrase"))
    return phrases.where(F.col("phrase").isNotNull() & (F.trim("phrase") != "")).distinct()


def dropna_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["name", "ingredients", "source", "date_published", "date_modified"]
    return table(spark, sf_dir, "open_recipe").select("id", "url", *columns).na.drop("any", subset=columns).select("id", "url")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "duplicate_likert_labels")


def pair_hydrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = labels(spark, sf_dir).select("recipe_id", "match_id").where("recipe_id is not null and match_id is not null").distinct()
    return review.hydrated(pairs, recipes(spark, sf_dir), "id", ["title", "source"])


def hybrid_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = similarity.hybrid_score(F.col("semantic_score"), F.col("ingredient_jaccard"), F.col("title_similarity"))
    return labels(spark, sf_dir).select("recipe_id", "match_id", F.round(score, 9).alias("score"))


def validated_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labels(spark, sf_dir).where("semantic_score >= 0.92 and ingredient_jaccard >= 0.50 and hybrid_score >= 0.75")
    return rows.select("recipe_id", "match_id", "semantic_score", "ingredient_jaccard", "hybrid_score")


def mirror_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.unmirrored(labels(spark, sf_dir).where("recipe_id <> match_id"), "recipe_id", "match_id", "hybrid_score")


def unlabeled_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labels(spark, sf_dir)
    return review.unlabeled(rows.where("likert_label is null").select("recipe_id", "match_id").distinct(), rows.where("likert_label is not null"))


def append_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["recipe_id", "match_id", "likert_label", "notes"]
    log = labels(spark, sf_dir).where("likert_label is not null").select(*columns)
    return log.unionByName(review.record_label(unlabeled_queue(spark, sf_dir), 3, "unsure").select(*columns))


def title_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = pair_hydrate(spark, sf_dir).where("title_a is not null and title_b is not null")
    clean = lambda c: text.normalize_text(F.col(c))
    return pairs.select("recipe_id", "match_id", similarity.title_similarity(clean("title_a"), clean("title_b")).alias("title_similarity"))


def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.seeded_sample(labels(spark, sf_dir).select("recipe_id", "match_id").distinct(), ["recipe_id", "match_id"], 20, SEED)


def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.seeded_order(unlabeled_queue(spark, sf_dir), ["recipe_id", "match_id"], SEED).select("recipe_id", "match_id", "place")


QUERIES = {
    f.__name__: f
    for f in (
        dedupe_exact, dedupe_shape, normalize_text, simple_clean, hybrid_pairs, hybrid_validated, recipe_classes, clean_ingredient, clean_ingredient_list, semantic_text, parse_list, json_validate, jaccard_pairs, set_classes,
        clusters, cluster_size_hist, largest_cluster_members, survivor_top1, survivor_flags, trimmed_dataset, unique_phrases, dropna_any, pair_hydrate, hybrid_score, validated_pairs,
        mirror_removal, unlabeled_queue, append_label, title_similarity, seeded_sample, review_queue,
    )
}

UNITS_SQL = "|".join(sorted(text.UNITS, key=len, reverse=True))
BLANK_SQL = r"[\s\x0B\p{Z}\x{1C}-\x{1F}\x{85}]"


def cleaned_sql(value: str) -> str:
    """RE2 has no lookaround: the measure words go in two passes that keep the letters beside them."""
    steps = rf"lower(coalesce({value}, ''))"
    steps = rf"regexp_replace({steps}, '\([^)]*\)', ' ', 'g')"
    steps = rf"regexp_replace({steps}, '\d+\s*/\s*\d+|\d+\.\d+|\d+', ' ', 'g')"
    for _ in range(2):
        steps = rf"regexp_replace({steps}, '(^|[^\p{{L}}\p{{N}}_])({UNITS_SQL})($|[^\p{{L}}\p{{N}}_])', '\1 \3', 'g')"
    return rf"trim(regexp_replace(regexp_replace({steps}, '[^a-z\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def fields_sql(delimiters: str) -> str:
    """Fields of ``b`` between delimiters outside quotes, each with what delimits it."""
    return rf"""regexp_extract_all(b, '\s*"(?:[^"]|"")*"\s*(?:[{delimiters}]|$)|[^{delimiters}]*(?:[{delimiters}]|$)')"""


# Packed lists in SQL: plain JSON as it stands; JSON in a JSON text; list literals; else fields outside quotes, between the strong
# delimiters if there are any and else between commas, without bullets or running numbers that all of them carry.
BULLET_SQL, NUMBER_SQL = r"^\s*[-–—*•▪◦‣·]\s+", r"^\s*\(?(\d{1,3})(?:[.):]|\s-)\s+"
PARSED = rf"""texts AS (SELECT id, title, directions, ingredients, regexp_replace(ingredients, '^{BLANK_SQL}+|{BLANK_SQL}+$', '', 'g') AS t FROM recipe_nlg),
  opened AS (SELECT * EXCLUDE t, starts_with(ingredients, '["') AND json_valid(ingredients) AS plain, CASE WHEN starts_with(t, '"[') AND ends_with(t, ']"') AND json_valid(t) THEN json_extract_string(t, '$') ELSE t END AS b FROM texts),
  cut AS (SELECT *, coalesce(starts_with(b, '['), false) AS literal, CASE WHEN starts_with(b, '[') THEN regexp_extract_all(b, '''(?:[^''\\]|\\.)*''|"(?:[^"\\]|\\.)*"')
    WHEN regexp_matches(regexp_replace(b, '"(?:[^"]|"")*"', '', 'g'), '[\n\t;|·]') THEN list_transform({fields_sql(r'\n\t;|·')}, lambda v: regexp_replace(v, '[\n\t;|·]$', ''))
    ELSE list_transform({fields_sql(',')}, lambda v: regexp_replace(v, ',$', '')) END AS raw FROM opened),
  bare AS (SELECT *, list_filter(list_transform(raw, lambda v: CASE WHEN literal THEN regexp_replace(v[2:-2], '\\(.)', '\1', 'g') WHEN regexp_matches(v, '^\s*"(?:[^"]|"")*"\s*$') THEN replace(regexp_replace(v, '^\s+|\s+$', '', 'g')[2:-2], '""', '"') ELSE v END),
    lambda v: regexp_matches(v, '[^\s\p{{Z}}]')) AS f FROM cut),
  marked AS (SELECT *, len(f) > 0 AND NOT literal AND len(list_filter(f, lambda v: regexp_matches(v, '{BULLET_SQL}'))) = len(f) AS bullets,
    len(f) > 0 AND NOT literal AND list_transform(f, lambda v: regexp_extract(v, '{NUMBER_SQL}', 1)) = list_transform(range(1, len(f) + 1), lambda k: k::VARCHAR) AS numbers FROM bare),
  parsed AS MATERIALIZED (SELECT id, title, directions, CASE WHEN plain THEN from_json(ingredients, '["VARCHAR"]') ELSE list_filter(list_transform(coalesce(f, []), lambda v: trim(regexp_replace(CASE WHEN bullets THEN regexp_replace(v, '{BULLET_SQL}', '')
    WHEN numbers THEN regexp_replace(v, '{NUMBER_SQL}', '') ELSE v END, '{BLANK_SQL}+', ' ', 'g'))), lambda v: v <> '') END AS vs FROM marked)"""
CLEANED = f"{PARSED}, cleaned AS (SELECT id, title, directions, list_transform(vs, lambda v: {cleaned_sql('v')}) AS c FROM parsed)"
NORMAL = lambda c: rf"coalesce(regexp_replace(lower({c}), '^{BLANK_SQL}+|{BLANK_SQL}+$', '', 'g'), '')"
SETS = f"{CLEANED}, sets AS (SELECT min(id) AS id, s FROM (SELECT id, list_sort(list_distinct(c)) AS s FROM cleaned WHERE len(c) > 0) GROUP BY s)"
PAIRS = f"""{SETS}, pairs AS (SELECT a.id AS a, b.id AS b, len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))) AS j FROM sets a JOIN sets b ON a.id < b.id
  AND len(a.s) >= 0.5 * len(b.s) AND len(b.s) >= 0.5 * len(a.s) WHERE list_has_any(a.s, b.s))"""


def common_sql(a: str, b: str) -> str:
    """Length of the longest common subsequence: rows of the table folded one from the other."""
    cell = f"greatest(above[j[1] + 1], done[-1], above[j[1]] + (unicode({b}[j[1]]) = x[1])::BIGINT)"
    row = f"list_reduce(list_transform(range(1, length({b}) + 1), lambda k: [k]), lambda done, j: list_append(done, {cell}), [0::BIGINT])"
    return f"list_reduce(list_transform(range(1, length({a}) + 1), lambda k: [unicode({a}[k])::BIGINT]), lambda above, x: {row}, list_transform(range(0, length({b}) + 1), lambda k: 0::BIGINT))[-1]"


def titled_sql(source: str, columns: str) -> str:
    """``titled``: ``columns`` of ``source`` and title_similarity of its title_a and title_b (cleaned)."""
    return f"""word_sets AS (SELECT {columns}, list_distinct(regexp_extract_all(title_a, '[^{BLANK_SQL[1:]}+')) AS u, list_distinct(regexp_extract_all(title_b, '[^{BLANK_SQL[1:]}+')) AS v FROM {source}),
  word_parts AS (SELECT *, array_to_string(list_sort(list_intersect(u, v)), ' ') AS s, array_to_string(list_sort(list_filter(u, lambda w: NOT list_contains(v, w))), ' ') AS l, array_to_string(list_sort(list_filter(v, lambda w: NOT list_contains(u, w))), ' ') AS r FROM word_sets),
  word_texts AS (SELECT *, trim(s || ' ' || l) AS p, trim(s || ' ' || r) AS q FROM word_parts),
  titled AS (SELECT {columns}, CASE WHEN len(u) = 0 OR len(v) = 0 THEN 0.0::DOUBLE WHEN s <> '' AND (l = '' OR r = '') THEN 1.0::DOUBLE ELSE greatest(2 * {common_sql('p', 'q')} / (length(p) + length(q)),
    CASE WHEN s <> '' THEN 2 * length(s) / (length(s) + length(p)) END, CASE WHEN s <> '' THEN 2 * length(s) / (length(s) + length(q)) END) END AS title_similarity FROM word_texts)"""


WORDS_SQL = r"list_distinct(regexp_extract_all(t || ' ' || array_to_string(p, ' '), '[\p{L}\p{N}]+'))"
RECORDS = f"""{CLEANED}, records AS MATERIALIZED (SELECT id, t, p, {WORDS_SQL} AS w, n, d, min(id) OVER (PARTITION BY t, p) AS "class" FROM (SELECT id, {NORMAL('title')} AS t, list_sort(list_distinct(c)) AS p, len(c) AS n, length({NORMAL('directions')}) AS d FROM cleaned)),
  heads AS (SELECT * FROM records WHERE id = "class")"""
HYBRID = f"""{RECORDS}, long AS (SELECT id, unnest(w) AS v FROM heads), near AS MATERIALIZED (SELECT x.id AS a, y.id AS b, count(*) AS m FROM long x JOIN long y ON x.v = y.v AND x.id < y.id GROUP BY 1, 2),
  semantic AS (SELECT a, b, m / sqrt(len(x.w) * len(y.w)) AS cos, CASE WHEN len(x.p) = 0 OR len(y.p) = 0 THEN 0.0 ELSE len(list_intersect(x.p, y.p))::DOUBLE / len(list_distinct(list_concat(x.p, y.p))) END AS j, x.t AS title_a, y.t AS title_b
    FROM near JOIN heads x ON x.id = a JOIN heads y ON y.id = b WHERE m / sqrt(len(x.w) * len(y.w)) >= 0.95::DOUBLE - 1e-12::DOUBLE),
  {titled_sql('semantic', 'a, b, cos, j')}, hybrid AS (SELECT a, b, cos, j, title_similarity AS i, 0.50::DOUBLE * cos + 0.35::DOUBLE * j + 0.15::DOUBLE * title_similarity AS h FROM titled),
  valid AS MATERIALIZED (SELECT a, b FROM hybrid WHERE cos >= 0.95::DOUBLE - 1e-12::DOUBLE AND j >= 0.5::DOUBLE AND h >= 0.75::DOUBLE - 1e-12::DOUBLE)"""
CLUSTERS = f"""{HYBRID}, edges AS (SELECT a, b FROM valid UNION SELECT "class", id FROM records WHERE id <> "class" AND len(p) > 0 AND len(w) > 0),
  links AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
  reach(id, other) AS (SELECT a, a FROM links UNION SELECT r.id, l.b FROM reach r JOIN links l ON r.other = l.a),
  roots AS (SELECT id, min(other) AS root FROM reach GROUP BY id),
  clusters AS MATERIALIZED (SELECT dense_rank() OVER (ORDER BY root) - 1 AS cluster_id, id AS recipe_id, count(*) OVER (PARTITION BY root) AS cluster_size FROM roots)"""
SURVIVORS = f"""{CLUSTERS}, kept AS (SELECT cluster_id, recipe_id FROM (SELECT k.cluster_id, k.recipe_id, row_number() OVER (PARTITION BY k.cluster_id
  ORDER BY c.n DESC, c.d DESC, k.recipe_id) AS n FROM clusters k JOIN records c ON c.id = k.recipe_id) WHERE n = 1)"""
FLAGS = f"""{SURVIVORS}, flags AS (SELECT c.id, k.cluster_id AS hybrid_cluster_id, k.cluster_id IS NOT NULL AS is_hybrid_duplicate_candidate,
  k.cluster_id IS NULL OR s.recipe_id IS NOT NULL AS keep_hybrid_representative FROM cleaned c LEFT JOIN clusters k ON k.recipe_id = c.id LEFT JOIN kept s ON s.recipe_id = c.id)"""
QUEUE = "queue AS (SELECT DISTINCT recipe_id, match_id FROM duplicate_likert_labels l WHERE likert_label IS NULL AND NOT EXISTS (SELECT 1 FROM duplicate_likert_labels d WHERE d.likert_label IS NOT NULL AND d.recipe_id = l.recipe_id AND d.match_id = l.match_id))"

ORACLES = {
    "dedupe_exact": "SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY title, ingredients, directions ORDER BY id) AS n FROM recipe_nlg) WHERE n = 1",
    "dedupe_shape": "SELECT count(*) AS n_rows, count(*) FILTER (n = 1) AS n_kept FROM (SELECT row_number() OVER (PARTITION BY title, ingredients, directions ORDER BY id) AS n FROM recipe_nlg)",
    "normalize_text": f"SELECT id, {NORMAL('title')} AS title_clean, {NORMAL('directions')} AS directions_clean, {NORMAL('source')} AS source_clean FROM recipe_nlg",
    "simple_clean": r"SELECT id, trim(regexp_replace(regexp_replace(lower(coalesce(food_name, '')), '[^a-z\s]', ' ', 'g'), '\s+', ' ', 'g')) AS name_clean FROM food_density",
    "clean_ingredient": f"WITH {PARSED} SELECT id, pos, {cleaned_sql('v')} AS ingredient_clean FROM (SELECT id, unnest(vs) AS v, unnest(range(len(vs))) AS pos FROM parsed)",
    "clean_ingredient_list": f"WITH {CLEANED} SELECT id, array_to_string(c, '|') AS ingredients_clean, len(c) AS n FROM cleaned",
    "semantic_text": f"WITH {CLEANED} SELECT id, {NORMAL('title')} || ' | ' || array_to_string(list_sort(c), ' ') AS semantic_text FROM cleaned",
    "parse_list": f"WITH {PARSED} SELECT id, len(vs) AS n, array_to_string(vs, '|') AS joined FROM parsed",
    "json_validate": """SELECT id, CASE WHEN coalesce(ner, '') = '' THEN '[]' WHEN json_valid(ner) THEN ner ELSE 'invalid' END AS ner FROM recipe_nlg""",
    "jaccard_pairs": f"WITH {PAIRS} SELECT a, b, round(j, 6) AS jaccard FROM pairs WHERE j >= 0.5",
    "set_classes": f'WITH {CLEANED} SELECT id AS member, min(id) OVER (PARTITION BY list_sort(list_distinct(c))) AS "class" FROM cleaned',
    "hybrid_pairs": f"WITH {HYBRID} SELECT a AS recipe_id, b AS match_id, round(cos, 9) AS semantic_score, round(j, 9) AS ingredient_jaccard, round(i, 9) AS title_similarity, round(h, 9) AS hybrid_score FROM hybrid",
    "hybrid_validated": f"WITH {HYBRID} SELECT a AS recipe_id, b AS match_id FROM valid",
    "recipe_classes": f'WITH {RECORDS} SELECT id AS member, "class" FROM records',
    "title_similarity": f"""WITH pairs AS (SELECT p.recipe_id, p.match_id, {NORMAL('a.title')} AS title_a, {NORMAL('b.title')} AS title_b FROM (SELECT DISTINCT recipe_id, match_id FROM duplicate_likert_labels) p JOIN recipe_nlg a ON a.id = p.recipe_id
  JOIN recipe_nlg b ON b.id = p.match_id), {titled_sql('pairs', 'recipe_id, match_id')} SELECT * FROM titled""",
    "clusters": f"WITH RECURSIVE {CLUSTERS} SELECT * FROM clusters",
    "cluster_size_hist": f"WITH RECURSIVE {CLUSTERS} SELECT cluster_size, count(*) AS n_members FROM clusters GROUP BY 1 ORDER BY 1 LIMIT 20",
    "largest_cluster_members": f"WITH RECURSIVE {CLUSTERS} SELECT * FROM clusters WHERE cluster_id = (SELECT cluster_id FROM clusters ORDER BY cluster_size DESC, cluster_id LIMIT 1)",
    "survivor_top1": f"WITH RECURSIVE {SURVIVORS} SELECT * FROM kept",
    "survivor_flags": f"WITH RECURSIVE {FLAGS} SELECT * FROM flags",
    "trimmed_dataset": f"WITH RECURSIVE {FLAGS} SELECT id FROM flags WHERE keep_hybrid_representative",
    "unique_phrases": f"WITH {CLEANED} SELECT DISTINCT phrase FROM (SELECT unnest(c) AS phrase FROM cleaned) WHERE trim(phrase) <> ''",
    "dropna_any": "SELECT id, url FROM open_recipe WHERE name IS NOT NULL AND ingredients IS NOT NULL AND source IS NOT NULL AND date_published IS NOT NULL AND date_modified IS NOT NULL",
    "pair_hydrate": """SELECT p.recipe_id, p.match_id, a.title AS title_a, a.source AS source_a, b.title AS title_b, b.source AS source_b
  FROM (SELECT DISTINCT recipe_id, match_id FROM duplicate_likert_labels WHERE recipe_id IS NOT NULL AND match_id IS NOT NULL) p LEFT JOIN recipe_nlg a ON a.id = p.recipe_id LEFT JOIN recipe_nlg b ON b.id = p.match_id""",
    "hybrid_score": "SELECT recipe_id, match_id, round(0.50::DOUBLE * semantic_score + 0.35::DOUBLE * ingredient_jaccard + 0.15::DOUBLE * title_similarity, 9) AS score FROM duplicate_likert_labels",
    "validated_pairs": "SELECT recipe_id, match_id, semantic_score, ingredient_jaccard, hybrid_score FROM duplicate_likert_labels WHERE semantic_score >= 0.92 AND ingredient_jaccard >= 0.50 AND hybrid_score >= 0.75",
    "mirror_removal": "SELECT least(recipe_id, match_id) AS recipe_id, greatest(recipe_id, match_id) AS match_id, max(hybrid_score) AS hybrid_score FROM duplicate_likert_labels WHERE recipe_id <> match_id GROUP BY 1, 2",
    "unlabeled_queue": f"WITH {QUEUE} SELECT * FROM queue",
    "seeded_sample": "SELECT recipe_id, match_id FROM (SELECT DISTINCT recipe_id, match_id FROM duplicate_likert_labels) ORDER BY md5('42|' || coalesce(recipe_id::VARCHAR, 'null') || '|' || coalesce(match_id::VARCHAR, 'null')), recipe_id, match_id LIMIT 20",
    "review_queue": f"WITH {QUEUE} SELECT recipe_id, match_id, md5('42|' || coalesce(recipe_id::VARCHAR, 'null') || '|' || coalesce(match_id::VARCHAR, 'null')) AS place FROM queue",
    "append_label": f"WITH {QUEUE} SELECT recipe_id, match_id, likert_label, notes FROM duplicate_likert_labels WHERE likert_label IS NOT NULL UNION ALL SELECT recipe_id, match_id, 3, 'unsure' FROM queue",
}
