import json
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from granary.functions import embedding, density_rows, similarity, text
from granary.operators import catalog, dedupe, graph, knn, loading, profile, review
from granary.sources import connection, scans, sinks
from granary.sources.schemas import TABLES, table_of
from granary.streaming.ingest import load_new_files
from tests.conftest import ROOT, rows


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expression(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    "raw,clean",
    [
        ("1 c. firmly packed brown sugar", "firmly packed brown sugar"), ("1/2 tsp. vanilla", "vanilla"), ("2 (16 oz.) pkg. frozen corn", "frozen corn"), ("8oz can corn", "corn"),
        ("½cup sugar", "cup sugar"), ("2 cups", ""), ("1.5 kg potatoes", "potatoes"), ("bite size shredded rice biscuits", "bite size shredded rice biscuits"), ("3 1/2 c. bite size", "bite size"),
        ("vitamin C", "vitamin"), ("crème fraîche", "cr me fra che"), (None, ""),
    ],
)
def test_clean_ingredient(spark, raw, clean):
    assert one(spark, raw, text.clean_ingredient) == clean


def test_normalize_text(spark):
    assert one(spark, " \u00a0\x1cAb  C\t\n", text.normalize_text) == "ab  c"
    assert one(spark, None, text.normalize_text) == ""


ROWS = [
    (["Cocoa powder", "0.53", "BR"], ("Cocoa powder", "0.53", "", "BR", "")),
    (["Water", "1.0", "1.0", "3", "x"], ("Water", "1.0", "1.0", "3", "x")),
    (["Flour, wheat", "0.48-0.56", "7"], ("Flour, wheat", "0.48-0.56", "7", "", "")),
    (["Honey", "1.42", "BR", "1.41"], ("Honey", "1.42", "1.41", "BR", "")),
    (["Oil", "0.92", "0.91", "BR", "0.90"], ("Oil", "0.92", "0.90", "BR", "")),
    (["Dough", "raw", "0.6", "ASI", "junk"], ("Dough raw", "0.6", "", "ASI", "")),
    (["1.2", "x"], None),
    (["Foo", "bar"], None),
    ([], None),
]


@pytest.mark.parametrize("cells,parsed", ROWS)
def test_density_rows(spark, cells, parsed):
    assert density_rows.parse_data_row(cells) == parsed
    found = one(spark, cells, density_rows.parsed_row, "array<string>")
    assert (tuple(found) if found else None) == parsed


def test_density_tables(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF")
    tables = [[[["Food name", "d"], [None], ["x"], ["Milk products"], ["Whey\npowder", None, "0.5", "7", "x"]]], [[["other"]]]]
    got = scans.read_density_pdf(spark, str(tmp_path), lambda content: tables)
    assert rows(got.drop("file")) == [(0, 0, 4, "Milk products", "Whey powder", "0.5", "7", "", True)]


def test_similarities():
    for a, b, s in [("banana bread", "best banana bread", 1.0), ("", "", 0.0), ("apple pie", "apple tart", 0.714286), ("chicken soup", "beef stew", 0.285714), ("no bake cookies", "no-bake cookies", 0.8)]:
        assert similarity.token_set(a, b) == similarity.token_set(b, a) == pytest.approx(s, abs=1e-6)
    assert similarity.token_set(None, "a") == 0.0
    assert similarity.weighted("abc", "abc") == 1.0 and similarity.weighted("", "abc") == 0.0


@pytest.mark.parametrize("a,b,s", [(["salt", "sugar"], ["salt", "flour"], 1 / 3), (["salt", "salt"], ["salt"], 1.0), ([], ["salt"], 0.0), (["", "salt"], ["", "flour"], 1 / 3), (None, ["a"], 0.0)])
def test_jaccard(spark, a, b, s):
    df = spark.createDataFrame([(a, b)], "a array<string>, b array<string>")
    assert df.select(similarity.jaccard(F.col("a"), F.col("b"))).first()[0] == pytest.approx(s)


def test_vectors(spark):
    assert one(spark, [3.0, 4.0], similarity.l2_normalized, "array<float>") == pytest.approx([0.6, 0.8])
    assert one(spark, [0.0, 0.0], similarity.l2_normalized, "array<float>") == [0.0, 0.0]
    v = one(spark, "a b b", lambda c: embedding.hashed_letters(c, 8))
    assert sum(x * x for x in v) == pytest.approx(1.0)


def test_clusters_and_survivors(spark):
    edges = spark.createDataFrame([(1, 2), (2, 5), (4, 6), (6, 4), (3, 3), (None, 1)], "a long, b long")
    members = graph.clusters(edges, "a", "b")
    assert rows(members) == [(0, 1, 3), (0, 2, 3), (0, 5, 3), (1, 4, 2), (1, 6, 2)]
    measures = spark.createDataFrame([(1, 5, 10), (2, 6, 8), (5, 6, 9), (4, 3, 3), (6, 3, 3)], "recipe_id long, ingredient_count int, directions_length int")
    kept = dedupe.survivors(members, measures)
    assert rows(kept) == [(0, 5), (1, 4)]
    flags = dedupe.flagged(spark.range(7).withColumnRenamed("id", "r"), "r", members, kept)
    assert [r[0] for r in rows(flags.where("keep_hybrid_representative"))] == [0, 3, 4, 5]
    assert rows(dedupe.largest_cluster(members), "recipe_id") == [(1,), (2,), (5,)]
    assert graph.clusters(edges.limit(0), "a", "b").count() == 0


def test_long_chain(spark):
    chain = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert rows(graph.cluster_roots(chain, "a", "b")) == sorted([(k, 0) for k in range(61)], key=repr)


def test_numbered(spark):
    from granary.operators.numbering import numbered

    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("x"))
    assert [(r["x"], r["n"]) for r in sorted(numbered(df, "n", "x").collect())] == [(k, k) for k in range(1000)]
    assert numbered(df.limit(0), "n", "x").count() == 0


def test_hot_node(spark, monkeypatch):
    from granary.operators import skew

    monkeypatch.setattr(skew, "LEAST", 5)
    hub = spark.range(1, 200).select(F.lit(500).alias("a"), F.col("id").alias("b"))
    assert rows(graph.cluster_roots(hub, "a", "b").select("root").distinct()) == [(1,)]
    copies = spark.createDataFrame([(k, ["a", "b"]) for k in range(50)] + [(99, None)], "id long, v array<string>")
    assert dedupe.set_classes(copies.where("id < 50"), "id", F.col("v")).where("class = 0").count() == 50


def test_similar_sets_is_exact(spark):
    import random

    random.seed(4)
    data = [(k, random.choices("abcdefghij", k=random.randint(0, 6))) for k in range(80)] + [(90, None)]
    df = spark.createDataFrame(data, "id long, v array<string>")
    heads = {}
    for k, v in data:
        if v:
            heads.setdefault(frozenset(v), k)
    brute = sorted((a, b) for x, a in heads.items() for y, b in heads.items() if a < b and len(x & y) / len(x | y) >= 0.5)
    assert sorted((r["a"], r["b"]) for r in dedupe.similar_sets(df, "id", F.col("v"), 0.5).collect()) == brute


def test_knn_is_exact(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(60, 8)).round(3)
    df = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(vectors)] + [(99, None)], "id long, v array<double>")
    for parts in (1, 7):
        got = knn.nearest(df.where("id < 10"), df.repartition(parts), 3, "id", "id", "v", "v", skip_self=True)
        for q in range(10):
            s = vectors @ vectors[q]
            want = sorted((k for k in range(60) if k != q), key=lambda k: (-s[k], k))[:3]
            assert [r["match_id"] for r in sorted(got.where(F.col("query_id") == q).collect(), key=lambda r: r["rank"])] == want
    assert knn.nearest(df.limit(0), df, 3, "id", "id", "v", "v").count() == 0
    whole = rows(knn.nearest(df, df, 3, "id", "id", "v", "v", skip_self=True, digits=9).withColumn("similarity", F.round("similarity", 6)))
    assert rows(knn.nearest(df, df, 3, "id", "id", "v", "v", skip_self=True, block=7, group=11, digits=9).withColumn("similarity", F.round("similarity", 6))) == whole


def test_single_precision_threshold(spark):
    df = spark.createDataFrame([(0.95,), (0.6,)], "s float")
    assert knn.at_least(df, "s", 0.95).count() == 1
    assert knn.between_open(df, "s", 0.6, 0.8).count() == 0


def test_csv(spark, tmp_path):
    (tmp_path / "c.csv").write_text('id,name,note\n1,"",x\n2,,"a ""q"", line\nbreak"\n')
    from granary.sources.schemas import Table
    from pyspark.sql import types as T

    t = Table("t", T.StructType([T.StructField("id", T.IntegerType()), T.StructField("name", T.StringType()), T.StructField("note", T.StringType())]), ("id",), ("id",))
    assert rows(scans.read_csv(spark, str(tmp_path), t)) == [(1, "", "x"), (2, None, 'a "q", line\nbreak')]
    (tmp_path / "c.csv").write_text("id,name,note\nx,y,z\n")
    with pytest.raises(Exception):
        scans.read_csv(spark, str(tmp_path), t).collect()
    (tmp_path / "c.csv").write_text("id,name,note\n1,NA,None\nq, nan ,v\n")
    assert rows(scans.read_csv_lenient(spark, str(tmp_path), t.schema)) == [(1, None, None), (None, None, "v")]


def test_json_lines(spark, tmp_path):
    lines = [{"_id": {"$oid": "a1"}, "name": "n", "cookTime": "PT1H", "ts": {"$date": 5}}, {"_id": "plain"}, {"_id": 7}, {"name": "x", "ts": "soon"}]
    (tmp_path / "r.json").write_text("\n\n".join(json.dumps(x) for x in lines))
    got = scans.read_open_recipes(spark, str(tmp_path))
    assert rows(got, "id", "cook_time", "ts_millis") == sorted([("a1", "PT1H", 5), ("plain", None, None), ("7", None, None), ("", None, None)], key=repr)


def test_strict_fields(spark):
    assert one(spark, "", scans.checked_json) == one(spark, None, scans.checked_json) == "[]"
    assert one(spark, '["a"]', scans.checked_json) == '["a"]'
    with pytest.raises(Exception):
        one(spark, "[1", scans.checked_json)
    assert one(spark, "['a', 'b']", scans.listed_strictly) == ["a", "b"]
    with pytest.raises(Exception):
        one(spark, "nope", scans.listed_strictly)


def test_loading(spark, tmp_path):
    batch = spark.createDataFrame([(k, f"v{k}", k) for k in range(8)] + [(7, "again", 9)], "id long, v string, at int")
    stored = batch.where("id in (0, 1, 5)")
    assert rows(loading.resume_rows(batch.where("at < 9"), stored, "id"), "id") == [(6,), (7,)]
    assert loading.resume_rows(batch, stored.limit(0), "id").count() == 9
    assert rows(loading.insert_or_ignore(batch, stored, ["id"], ["at"]), "id", "v")[-1] == (7, "v7")
    path = str(tmp_path / "t")
    assert sinks.append_new(batch, path, ["id"], ["at"]) == 9  # submitted
    assert sinks.append_new(batch, path, ["id"], ["at"]) == 9
    assert spark.read.parquet(path).count() == 8
    assert sinks.append_resumed(batch.withColumn("id", F.col("id") + 4), path, "id") == 5
    assert rows(loading.key_violations(batch, ["id"], ["id", "v"])) == [("primary key", "id", 1)]
    assert rows(loading.row_counts({"a": batch, "b": batch.limit(0)})) == [("a", 9), ("b", 0)]


def test_streaming_load(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    batch = spark.createDataFrame([(k, k) for k in range(5)], "id long, at int")
    for _ in range(2):
        batch.write.mode("append").parquet(source)
        load_new_files(spark, source, batch.schema, target, str(tmp_path / "cp"), ["id"], ["at"], 1).awaitTermination()
    assert rows(spark.read.parquet(target), "id") == [(k,) for k in range(5)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, v string")
    sinks.overwrite(df, str(tmp_path / "p"))
    assert rows(spark.read.parquet(str(tmp_path / "p"))) == rows(df)
    sinks.recreate(spark, "conversions")
    t = table_of("food_density")
    rows_in = spark.createDataFrame([(1, None, "Honey", "1.42", None, None, False)], t.schema)
    sinks.save_table(rows_in, t, buckets=2)
    assert spark.table("conversions.food_density").count() == 1
    assert "food_density" in {r["table"] for r in catalog.catalog_columns(spark, "conversions").collect()}
    sinks.recreate(spark, "conversions")
    assert not spark.catalog.listTables("conversions")


def test_labels(spark, tmp_path):
    path = str(tmp_path / "labels")
    assert scans.read_labels(spark, path).count() == 0
    pairs = spark.createDataFrame([(1, 2, 0.9, 0.5, 0.5, 0.7), (3, 4, 0.9, 0.5, 0.5, 0.7), (None, 4, 0.9, 0.5, 0.5, 0.7)], "recipe_id long, match_id long, semantic_score double, ingredient_jaccard double, title_similarity double, hybrid_score double")
    sinks.append_label(review.record_label(pairs.where("recipe_id = 1"), 4, "ok"), path)
    log = scans.read_labels(spark, path)
    assert rows(log, "recipe_id", "likert_label", "notes") == [(1, 4, "ok")]
    assert rows(review.unlabeled(pairs, log), "recipe_id", "match_id") == [(3, 4), (None, 4)]
    with pytest.raises(ValueError):
        review.record_label(pairs, 6, None)


def test_catalog(spark):
    columns = catalog.declared_columns(spark)
    joins = catalog.infer_joins(columns)
    assert joins.count() == 25 and catalog.satellites(joins).count() == 13
    content = catalog.payload(columns, joins)
    assert content["primary_keys"]["lab_method_code"] == ["lab_method_id", "code"]
    assert "food_portion.fdc_id -> food.fdc_id" in catalog.report(content)
    declared = spark.createDataFrame([("food_portion", "fdc_id")], "from_table string, from_column string")
    assert catalog.infer_joins(columns, declared).count() == 24
    own = spark.createDataFrame([("a", 1, "b_c_id"), ("bc", 1, "id"), ("bc", 2, "a_id")], "table string, position int, column string").withColumns({"type": F.lit("int"), "nullable": F.lit(True), "in_key": F.lit(False), "key_size": F.lit(0)})
    assert rows(catalog.infer_joins(own), "from_table", "to_table", "to_column", "source") == [("a", "bc", "id", "suffix_id_heuristic")]
    assert len(TABLES) == 28


def test_information_schema(spark):
    frame = lambda names, *data: spark.createDataFrame(data, ", ".join(f"{n} string" for n in names.split()))
    tables = frame("table_schema table_name table_type", ("s", "a", "BASE TABLE"), ("s", "b", "BASE TABLE"), ("s", "v", "VIEW"), ("x", "a", "BASE TABLE"))
    columns = frame("table_schema table_name column_name ordinal_position data_type is_nullable", ("s", "a", "id", "1", "bigint", "NO"), ("s", "b", "k", "1", "int", "NO"), ("s", "b", "a_id", "2", "bigint", "YES"), ("s", "v", "id", "1", "int", "YES"), ("x", "a", "id", "1", "int", "YES"))
    constraints = frame("table_schema table_name constraint_name constraint_type", ("s", "a", "a_pk", "PRIMARY KEY"), ("s", "b", "b_pk", "PRIMARY KEY"), ("s", "b", "b_fk", "FOREIGN KEY"), ("x", "a", "a_pk", "PRIMARY KEY"))
    usage = frame("table_schema constraint_name column_name ordinal_position", ("s", "a_pk", "id", "1"), ("s", "b_pk", "k", "1"), ("s", "b_pk", "a_id", "2"), ("s", "b_fk", "a_id", "1"), ("x", "a_pk", "id", "1"))
    targets = frame("table_schema constraint_name table_name column_name", ("s", "b_fk", "a", "id"), ("x", "b_fk", "a", "zz"))
    told = catalog.described_columns(tables, columns, constraints, usage, "s")
    assert rows(told, "table", "column", "nullable", "in_key", "key_size") == [("a", "id", False, True, 1), ("b", "a_id", True, True, 2), ("b", "k", False, True, 2)]
    foreign = catalog.foreign_keys(constraints, usage, targets, "s")
    assert rows(foreign) == [("b", "a_id", "a", "id", "b_fk")]
    content = catalog.payload(told, catalog.infer_joins(told, foreign), "s", foreign)
    assert content["foreign_keys"][0]["source"] == "foreign_key" and content["inferred_joins"] == [] and "b.a_id -> a.id" in catalog.report(content)


def test_connection(tmp_path):
    (tmp_path / "env").write_text("# no\nPG_POOL_USER = me\nPG_PASSWORD=a b@/\n\nPG_POOL_HOST=h\nPG_POOL_HOST=second\nbroken\n")
    env = connection.with_file({"PG_POOL_USER": "you"}, tmp_path / "env")
    assert connection.url(env) == "postgresql://you:a+b%40%2F@h:5432/postgres?sslmode=require"
    assert connection.jdbc_options({**env, "PG_PSQL_USE_TRANSACTION_POOLER_PORT": "1"})["url"] == "jdbc:postgresql://h:6543/postgres?sslmode=require"
    with pytest.raises(KeyError, match="PG_PASSWORD"):
        connection.url(connection.with_file({"PG_POOL_USER": "you", "PG_POOL_HOST": "h"}, tmp_path / "none"))


def test_keys_are_enforced(spark, tmp_path):
    path = str(tmp_path / "t")
    good = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    assert rows(sinks.overwrite_checked(good, path, ["id"], ["v"])) == [(1, "a"), (2, "b")]
    for bad, told in (([(3, "a"), (3, "b")], "primary key"), ([(3, None)], "not null"), ([(None, "a")], "not null")):
        df = spark.createDataFrame(bad, "id long, v string")
        with pytest.raises(ValueError, match=told):
            sinks.overwrite_checked(df, path, ["id"], ["v"])
        with pytest.raises(ValueError, match=told):
            sinks.append_checked(df, path, ["id"], ["v"])
    with pytest.raises(ValueError, match="already"):
        sinks.append_checked(good, path, ["id"], ["v"])
    sinks.append_checked(spark.createDataFrame([(7, "c")], "id long, v string"), path, ["id"], ["v"])
    assert rows(spark.read.parquet(path)) == [(1, "a"), (2, "b"), (7, "c")]


def test_embedders(spark):
    df = spark.createDataFrame([(1, "brown sugar"), (2, "sugar brown"), (3, ""), (4, None)], "id int, t string")
    got = {r["id"]: r["v"] for r in df.select("id", embedding.hashed_letters(F.col("t")).alias("v")).collect()}
    assert all(len(v) == embedding.DIMENSIONS for v in got.values()) and sum(a * b for a, b in zip(got[1], got[2])) > 0.5
    assert got[3] == got[4] and sum(got[3]) == 0
    model = embedding.batch_model(lambda: lambda texts: [[len(t), t.count("s") * 1.0] for t in texts], batch_size=2)
    vectors = {r["id"]: r["v"] for r in df.select("id", model(F.col("t")).alias("v")).collect()}
    assert vectors[1] == pytest.approx([11 / 122**0.5, 1 / 122**0.5]) and vectors[4] == [0.0, 0.0]


def test_common_against_table():
    import random

    random.seed(2)
    for _ in range(200):
        a, b = ("".join(random.choices("abc", k=random.randint(0, 12))) for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            corner = 0
            for j, y in enumerate(b, 1):
                corner, row[j] = row[j], corner + 1 if x == y else max(row[j], row[j - 1])
        assert similarity.common(a, b) == row[-1]


def test_profile(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,), (None,)], "x double")
    got = dict(rows(profile.describe(df, "x")))
    assert (got["count"], got["25%"], got["50%"], got["75%"]) == (4.0, 1.75, 2.5, 4.75)
    assert dict(rows(profile.describe(df.limit(0), "x")))["count"] == 0.0
    import statistics

    many = [float(k % 7 if k % 3 else 3) for k in range(2000)]
    got = dict(rows(profile.describe(spark.createDataFrame([(x,) for x in many], "x double"), "x")))
    assert [got[q] for q in ("25%", "50%", "75%")] == statistics.quantiles(many, n=4, method="inclusive")
    keys = spark.range(100)
    a = profile.seeded_sample(keys, ["id"], 10, 42).collect()
    assert a == profile.seeded_sample(keys.repartition(9), ["id"], 10, 42).collect() and len(a) == 10


def test_entry_without_llm():
    code = "import sys; sys.modules['granary.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'p3_found' in q and 'p1_found' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, env=os.environ)


def test_command_line(spark, tmp_path, capsys):
    from granary import cli

    cli.main(["infer", "--out", str(tmp_path / "s.json")])
    assert len(json.loads((tmp_path / "s.json").read_text())["inferred_joins"]) == 25
    (tmp_path / "o.json").write_text('{"_id": {"$oid": "a"}, "name": "n"}\n{"_id": "a"}\n')
    (tmp_path / "n.csv").write_text('i,title,ingredients,directions,link,source,NER\n0,T,"[""a""]","[""b""]",l,s,\n')
    for _ in range(2):
        cli.main(["recipes", "--open", str(tmp_path / "o.json"), "--nlg", str(tmp_path / "n.csv"), "--target", str(tmp_path / "t")])
    assert spark.read.parquet(str(tmp_path / "t/open_recipe")).count() == 1
    assert rows(spark.read.parquet(str(tmp_path / "t/recipe_nlg")), "id", "ner") == [(0, "[]")]
    (tmp_path / "d.csv").write_text('g,n,d,s,b,u\nMilk,Whey,0.5,,7,true\n')
    from granary.sources.schemas import DATABASES

    os.mkdir(tmp_path / "usda")
    for name in DATABASES["usda"]:
        (tmp_path / f"usda/{name}.csv").write_text(",".join(table_of(name).schema.names) + "\n" + ("1,Dairy\n" if name == "measure_unit" else ""))
    cli.main(["usda", "--folder", str(tmp_path / "usda"), "--target", str(tmp_path / "u")])
    assert "measure_unit: 1" in capsys.readouterr().out
    cli.main(["density", "--csv", str(tmp_path / "d.csv"), "--target", str(tmp_path / "t")])
    assert rows(spark.read.parquet(str(tmp_path / "t/food_density")), "food_name", "updated_version_2") == [("Whey", True)]
