import json
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from granary.functions.unpack import unpack
from granary.operators.unpacking import explode_values, found_values
from tests.conftest import rows

CASES = [
    (None, []),
    ("", []),
    (" \u00a0\n", []),
    ("[]", []),
    ('["a", " b  c ", ""]', ["a", "b c"]),
    ('"[\\"a\\", \\"b, c\\"]"', ["a", "b, c"]),
    ("['1 c', \"baker's shelf\", 'it\\'s']", ["1 c", "baker's shelf", "it's"]),
    ("['cut off", ["cut off"]),
    ("a, b ,, c", ["a", "b", "c"]),
    ('1 c,"b, chopped",d', ["1 c", "b, chopped", "d"]),
    ('"b; x";c', ["b; x", "c"]),
    ('"say ""hi"", now",b', ['say "hi", now', "b"]),
    ('"never closed, b', ["never closed, b"]),
    ("1 c a, chopped; 2 b | 3 d\n4 e", ["1 c a, chopped", "2 b", "3 d", "4 e"]),
    ("a, x\\nb", ["a, x", "b"]),
    ("<ul><li>a, x</li><li>b &amp; c</li></ul>", ["a, x", "b & c"]),
    ("a<br/>b<BR />\nc", ["a", "b", "c"]),
    ("- a\n- b", ["a", "b"]),
    ("1. a\n2. b, c\n3. d", ["a", "b, c", "d"]),
    ("(1) 15 ml x\n(2) y", ["15 ml x", "y"]),
    ("2. a\n2. b", ["2. a", "2. b"]),
    ("1/2 cup a; 1 b", ["1/2 cup a", "1 b"]),
    ("a\\, b, c", ["a, b", "c"]),
]


@pytest.mark.parametrize("text,values", CASES)
def test_forms(text, values):
    assert unpack(text) == values


def test_slashes():
    assert unpack("a / b//all-purpose flour", slashes=True) == ["a", "b", "all-purpose flour"]
    assert unpack("soda,, n/a", slashes=True) == ["soda", "n/a"]
    assert unpack("1/2 c a") == ["1/2 c a"]


@given(st.lists(st.text(alphabet="ab ,;|\"'\\[]é½/", min_size=1, max_size=8), max_size=6))
def test_json_round_trip(values):
    kept = [" ".join(v.split()) for v in values if v.strip()]
    assert unpack(json.dumps(values)) == kept
    assert unpack(json.dumps(json.dumps(values))) == kept


@given(st.lists(st.text(alphabet="abc ,é½", min_size=1, max_size=8).filter(str.strip), min_size=2, max_size=6))
def test_quoted_round_trip(values):
    packed = ",".join('"' + v + '"' for v in values)
    assert unpack(packed) == [" ".join(v.split()) for v in values]


def test_long_text_is_linear():
    words = [f"w{random.random()}" for _ in range(50_000)]
    assert unpack(";".join(words)) == words


def test_explode(spark):
    df = spark.createDataFrame([(1, "a;b", "x"), (2, None, None), (3, '["c"]', "y"), (4, "", "z")], "id long, packed string, pos string")
    assert rows(explode_values(df, {"id": df["id"]}, "packed")) == [(1, 1, "a"), (1, 2, "b"), (3, 1, "c")]
    assert rows(explode_values(df, {"id": df["id"]}, "packed", plain_json=False)) == [(1, 1, "a"), (1, 2, "b")]


def test_found_values(spark):
    nlg = spark.createDataFrame([(1, "a;b", "x/y", 7), (2, '["p"]', None, 7)], "id long, ingredients string, ner string, value int")
    opened = spark.createDataFrame([("k", "c, d", "t"), ("k", "c, d", "t"), ("", "e, f", "t"), (None, "g, h", "t")], "id string, ingredients string, pos string")
    assert rows(found_values(nlg, opened)) == [
        ("open_recipe.ingredients", "k", 1, "c"), ("open_recipe.ingredients", "k", 2, "d"), ("recipe_nlg.ingredients", "1", 1, "a"),
        ("recipe_nlg.ingredients", "1", 2, "b"), ("recipe_nlg.ner", "1", 1, "x"), ("recipe_nlg.ner", "1", 2, "y"),
    ]
    assert found_values(nlg.limit(0), opened.limit(0)).count() == 0


@pytest.mark.parametrize("text,values", [("1 cup nuts (walnuts, pecans), 2 eggs", ["1 cup nuts (walnuts, pecans)", "2 eggs"]), ("a (b, c", ["a (b", "c"]), ("x (y [z; w], v); q, r", ["x (y [z; w], v)", "q, r"]), ("a), b (c", ["a)", "b (c"]), ('a (b, "c, d)", e', ["a (b", "c, d)", "e"])])
def test_brackets(text, values):
    assert unpack(text) == values
