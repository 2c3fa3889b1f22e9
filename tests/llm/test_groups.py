import random

import pytest
from pyspark.sql import functions as F

from granary.llm import components, copies, leaves, survivors
from granary.operators import skew
from tests.conftest import rows


def union_find(pairs):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


LABEL = "recipe_id long, match_id long, likert_label int, rows int, a string"


def label_rows(pairs):
    return [(a, b, label, 1, "x") for a, b, label in pairs]


def test_components_against_union_find(spark):
    random.seed(7)
    pairs = [(random.randrange(120), random.randrange(120), random.choice([4, 5])) for _ in range(90)]
    pairs += [(k, k + 1, 4) for k in range(1000, 1040)] + [(5000, 5000 + k, 5) for k in range(1, 60)]  # a chain and a hub
    noise = [(1, 1, 5), (None, 3, 5), (3, None, 4), (700, 701, 3), (700, 702, None), (2, 1, 6)]
    df = spark.createDataFrame(label_rows(pairs + pairs[:20] + [(b, a, s) for a, b, s in pairs[:20]] + noise), LABEL)
    want = union_find([(a, b) for a, b, _ in pairs if a != b])
    assert dict(rows(components.found_groups(df))) == want


def test_contradicting_rows_still_tie(spark):
    df = spark.createDataFrame(label_rows([(1, 2, 5), (2, 1, 1), (9, 8, 1)]), LABEL)
    assert rows(components.found_groups(df)) == [(1, 1), (2, 1)]


def test_no_pairs(spark):
    empty = spark.createDataFrame([], LABEL)
    assert components.found_groups(empty).count() == 0


def test_hot_keys_are_split(spark, monkeypatch):
    monkeypatch.setattr(skew, "LEAST", 5)
    left = spark.createDataFrame([(1 if k % 2 else k, k) for k in range(200)] + [(None, 1)], "k long, x long")
    right = left.groupBy("k").agg(F.count("*").alias("rows"), F.min("x").alias("least"))
    got = skew.join_unique(left, right, ["k"], "rows", 201)
    assert got.count() == 200 and rows(got.where("k = 1").select("least").distinct()) == [(1,)]


@pytest.mark.parametrize(
    "a,b,same",
    [
        ("1 Cup  All-Purpose Flour, sifted", "1 cup all purpose flour sifted!", True),
        ("1/2 c salt", "12 c salt", False),
        ("1.5 c salt", "15 c salt", False),
        ("2-3 c", "23 c", False),
        ("225 - 275 g", "225275 g", False),
        ("crème", "crème", True),
        ("creme", "crème", False),
        ("baker's", "baker’s", True),
        ("1 2", "12", False),
        (" 1\tcan", "1 can", True),
    ],
)
def test_normal_form(a, b, same):
    assert (leaves.normal(a) == leaves.normal(b)) == same


RECIPE = "id long, title string, ingredients string, directions string, source string, root string, rows long"


def recipe(spark, *data):
    return spark.createDataFrame([(*d, "x", 1) for d in data], RECIPE)


def test_copies(spark):
    df = recipe(
        spark,
        (1, "Soup", '["1 c a", "2 b"]', '["Mix it.", "Serve, hot."]', None),
        (7, "SOUP!", "2 B; 1 c  a", '["Mix it. serve hot"]', None),
        (3, "Soup", '["1 c a", "2 b", "2 b"]', '["Mix it.", "Serve, hot."]', None),  # one entry said twice
        (4, "Soup", '["1 c a", "2 b", "..."]', "['mix it', 'serve hot']", None),  # a wordless entry
        (5, None, None, None, None),
        (6, "", "[]", '[" "]', None),
        (8, "Soup", '["1 c a"]', None, None),
    )
    assert rows(copies.copies(df)) == [(1, 1), (1, 4), (1, 7), (5, 5), (5, 6)]
    assert copies.copies(df.limit(0)).count() == 0


def test_clashing_digests_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(copies, "root", lambda record: F.unhex(F.lit("00")))
    df = recipe(spark, (1, "a", "", "", None), (2, "A", "", "", None), (3, "b", "", "", None), (4, "c", "", "", None), (9, "C", "", "", None))
    assert rows(copies.copies(df)) == [(1, 1), (1, 2), (4, 4), (4, 9)]


REGISTRY = "source string, trust int, time_zone string, date_order string"


def test_survivors(spark):
    df = recipe(
        spark,
        (1, "t", '["a", "A!", "n/a", ""]', '["x"]', "nobody"),
        (2, "t", '["a", "b"]', '["x", "y", "see link"]', " S.one "),
        (3, "t", "a; b; b", '["x", "z"]', "s.two"),
        (4, "t", None, None, None),
        (5, "t", "a", "", None),
        (8, "t", "a", "", "s.one"),
    )
    groups = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (77, 1), (4, 4), (5, 4), (8, 8), (99, 8)], "recipe_id long, group_id long")
    registry = spark.createDataFrame([("s.one", 2, "UTC", "DMY"), ("s.two", 1, "UTC", "DMY")], REGISTRY)
    assert rows(survivors.found_survivors(df, groups, registry)) == [(1, 2, 2, 3), (4, 5, 4, -1)]
    assert survivors.found_survivors(df.limit(0), groups, registry).count() == 0
    votes = rows(survivors.voted_survivors(df, groups, registry))
    assert [v[0] for v in votes] == [1, 4]
    assert votes[0][1] == 2  # two records say a and b
    assert [v[3] for v in votes] == [3, None]  # the most trusted source; no record of the other group has one
    spoken = recipe(spark, (1, "t", "a", "x", "S.three"), (2, "t", "a", "x", " s.THREE "), (3, "t", "a", "x", "s.two"), (4, "t", "a", "x", " "))
    five = spark.createDataFrame([("s.two", 3, "UTC", "DMY"), ("s.three", 4, "UTC", "DMY")], REGISTRY)
    once = spark.createDataFrame([(k, 1) for k in (1, 2, 3, 4)], "recipe_id long, group_id long")
    assert rows(survivors.voted_survivors(spoken, once, five)) == [(1, 1, 1, 1)]  # two of trust 4 outvote one of trust 3


def test_elect_sums_votes_and_breaks_ties(spark):
    data = [(1, "f", 10, "x", 1.0), (1, "f", 11, "y", 0.6), (1, "f", 12, "y", 0.6), (1, "g", 10, None, 1.0), (2, "f", 21, "a", 1.0), (2, "f", 20, "b", 1.0)]
    long = spark.createDataFrame(data, "group long, field string, record long, value string, vote double")
    assert rows(survivors.elect(long, ["f", "g"])) == [(1, 11, None), (2, 20, None)]
