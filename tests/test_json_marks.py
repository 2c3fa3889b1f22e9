"""json_validate: any JSON is valid, whatever it begins with."""

from granary.plans import recipes

VALID = ["[]", '["a", "b"]', '"[\\"lard\\"]"', '{"a": 1}', " [1, 2]", "null", "3"]
INVALID = ["['a']", '["a"', "salt; oil", "[a]"]


def test_json_validate(spark, tmp_path):
    df = spark.createDataFrame(list(enumerate([*VALID, *INVALID, "", None])), "id long, ner string")
    df.write.parquet(str(tmp_path / "recipe_nlg.parquet"))
    found = {r["id"]: r["ner"] for r in recipes.json_validate(spark, str(tmp_path)).collect()}
    assert found == dict(enumerate([*VALID, *["invalid"] * len(INVALID), "[]", "[]"]))
