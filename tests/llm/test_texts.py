import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from granary.llm import bpe, canonical, leaks, sentences
from tests.conftest import rows

TEXTS = [
    None, "", "   ", "\n\n", "Hello world, it's 25°C!", "<|endoftext|> x", "เติมน้ำ", "吃了吗？", "a" * 3000, "  two  spaces nbsp　wide  ", "\U0001f60b\U0001f468‍\U0001f469",
    "can't WON'T they'll I'd", "x1y2 3.14 1,000", "\u0000\x1f﻿", "दाल और", "|a||b|! !x", '"quoted" [list] {brace} \\n',
]


@pytest.mark.skipif(not os.path.exists(bpe.TOKENIZER), reason="no vocabulary files here")
def test_bpe_against_library_and_round_trip(spark):
    import tiktoken

    ranks = bpe.read_ranks()
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    random.seed(3)
    noise = ["".join(chr(random.choice([32, 97, 101, 233, 0x3042, 0x1F600, 10, 39])) for _ in range(60)) for _ in range(20)]
    texts = TEXTS + noise
    df = spark.createDataFrame([(k, t, "x", [1]) for k, t in enumerate(texts)], "doc_id long, text string, word string, ids array<int>")
    for hot in (0, 1000):
        got = bpe.encode(df.select("doc_id", "text"), "text", ranks, hot=hot)
        found = {r["doc_id"]: list(r["ids"]) for r in got.collect()}
        assert found == {k: library.encode_ordinary(t or "") for k, t in enumerate(texts)}
    back = bpe.found_ids(df).select("doc_id", bpe.decoded(F.col("ids"), ranks).alias("t"))
    assert {r["doc_id"]: r["t"] for r in back.collect()} == {k: t or "" for k, t in enumerate(texts)}
    assert bpe.found_ids(df.limit(0)).count() == 0


ITEM_WORDS = [f"word{k}" for k in range(40)]


def doc(words):
    return " ".join(words)


def test_leaks(spark):
    random.seed(5)
    filler = [f"fill{k}" for k in range(300)]
    item = ITEM_WORDS
    changed = item[5:30].copy()
    changed[7], changed[20] = "other", "another"
    broken = item[0:24].copy()
    for k in (2, 6, 10, 14, 18, 22):
        broken[k] = f"no{k}"
    dropped = item[10:22] + item[23:35]
    docs = {
        1: doc(filler[:50] + item + filler[50:]),
        2: doc(filler[:9] + changed + filler[60:]),
        3: doc(filler + item[3:21]),  # 18 words
        4: doc(broken),
        5: doc(dropped).upper().replace(" ", ",\n"),
        6: doc(item[20:] + filler[:30] + item[:19]),
        7: None,
        8: "",
        9: doc(item[:20]) + "’s " + doc(filler * 40),
        10: doc(sorted(item, reverse=True)),
    }
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in docs.items()], "doc_id long, text string, term string, item_id int")
    items = spark.createDataFrame([(501, "s", doc(item)), (502, "s", "too short an item"), (503, "s", None)], "item_id int, suite string, text string")
    assert rows(leaks.found_leaks(df, items)) == [(1, 501), (2, 501), (5, 501), (6, 501), (9, 501)]
    assert leaks.found_leaks(df.limit(0), items).count() == 0
    assert leaks.found_leaks(df, items.limit(0)).count() == 0


def test_index_against_brute_force(spark):
    random.seed(11)
    words = [f"w{k}" for k in range(30)]
    items = {k: random.choices(words, k=45) for k in range(6)}
    docs = {}
    for k in range(60):
        source = items[k % 6]
        start = random.randrange(20)
        piece = source[start : start + random.randint(12, 25)]
        for _ in range(random.randint(0, 3)):
            piece[random.randrange(len(piece))] = "zzz"
        docs[k] = random.choices(words, k=30) + piece + random.choices(words, k=30)
    brute = sorted((d, i) for d, text in docs.items() for i, item in items.items() if leaks.passage(item, text))
    df = spark.createDataFrame([(k, doc(v)) for k, v in docs.items()], "doc_id long, text string")
    it = spark.createDataFrame([(k, doc(v)) for k, v in items.items()], "item_id int, text string")
    assert sorted((r[0], r[1]) for r in leaks.found_leaks(df, it).collect()) == brute


SENTENCES = [
    "Dr. Noxley uses approx. 59 g of orange, i.e. two spoons.|It works.",
    "Use only 2 tbsp.|It was salty.",
    "Use only 2 tbsp.|pH below 4.6 is safe.|Ask Dr.Noxley.",
    "Mix 1.5 c. flour with 0.25 tsp. salt.|Done!",
    'She said, "Stop! It burns." and left.',
    'She said, "Stop! It burns."|He left.',
    '"Is it done?" asked Fennimark.|Yes.',
    "Wait... is that kale?|Really?!|Keep on.",
    "Great texture...|It held.",
    "Add it (drain first!) and stir.|Fine.",
    "J. K. Corvane weighed it at 5 p.m. on Friday.|The U.S. label lists 3 mg. of sodium.",
    "See kettleandoak.example/charts.html for more.|pH below 4.6 is safe.",
    "We left it once.|My neighbour came.",
    "Fig. 48 shows it at 72.5 °C.|Keep the lid on.",
    "Man nehme z. B. 76 g Mehl, d. h. wenig.|Am 3. Mai kochte Dr. Voss die Suppe.",
    "„Ist das gar?“, fragte sie.|Nr. 4 war gut.",
    "« C'est prêt ? » demanda-t-elle.|M. Oswerth ajoute env. 1,5 l d'eau.",
    "El Sr. Tisloe añade aprox. 12 g.|¿Está listo?|¡No tape la olla!",
    "「もう少し。」と言いました。|塩を入れる！",
    "她说：“再等。”然后关了火。|味道特别……|好吃吗？",
    "डॉ. Voss ने कहा।|ठीक है?",
    "ใส่เกลือ |เติมน้ำ1.9ถ้วย",
    "قالت: «انتظر.» ثم مشت.|هل نضج؟",
]


@pytest.mark.parametrize("marked", SENTENCES)
def test_boundaries(marked):
    parts = [p.strip() for p in marked.split("|")]
    text = " ".join(parts)
    assert [text[a:b] for a, b in sentences.sentences(text)] == parts


def test_lines_and_lists():
    text = "Quick Soup\n\nIngredients\n\n- 1 Tbsp. Butter\n- 150g. of macaroni\n\nSteps:\n\n1. Mix. Then wait\ntwo hours.\n2. Serve.\n\nThe end was near\nthe road. Am\n3. Mai kam er.once.My cat"
    got = [text[a:b] for a, b in sentences.sentences(text)]
    assert got == ["Quick Soup", "Ingredients", "- 1 Tbsp. Butter", "- 150g. of macaroni", "Steps:", "1. Mix.", "Then wait\ntwo hours.", "2. Serve.", "The end was near\nthe road.", "Am\n3. Mai kam er.once.", "My cat"]


def test_nothing_is_lost():
    random.seed(2)
    for _ in range(300):
        text = "".join(random.choice("ab A.!?\"'()“”「」\n -1。") for _ in range(60))
        last = 0
        for a, b in sentences.sentences(text):
            assert last <= a < b and not text[last:a].strip() and not text[a].isspace() and not text[b - 1].isspace()
            last = b
        assert not text[last:].strip()


def test_sentence_rows(spark):
    df = spark.createDataFrame([(1, "A. b", "note"), (2, None, "note"), (3, " \n", "guide"), (4, "One. Two.", "scrape"), (5, "\U0001f60b Yes. No.", None)], "doc_id long, text string, kind string")
    assert rows(sentences.found_sentences(df)) == [(1, 0, 4), (5, 0, 6), (5, 7, 10)]
    assert sentences.found_sentences(df.limit(0)).count() == 0


ITEMS = [
    (1, "food", "granulated sugar", ["white sugar", "caster sugar"]), (2, "food", "lemon", []), (3, "food", "lemon juice", None), (4, "food", "ham", []), (5, "food", "radish", []),
    (6, "food", "crème fraîche", []), (7, "food", "chopped parsley", []), (8, "food", "cod fillet", []), (9, "category", "Legumes and Pulses", []), (10, "food", "all-purpose flour", []), (11, "food", "ground beef", []),
    (12, "category", "Sea Fish", []), (13, "category", "Dried Pasta", []), (14, "category", "Table Sauces", []),
]
# Additions that the corpus teaches: none of them stands in the code.
LEADING, TRAILING = ["goldcrest", "organic", "cold", "finely chopped", "out of this world"], ["to taste", "see note", "kept dry", "raw"]
CORPUS = [f"{a} {i[2]}" for i in ITEMS if i[1] == "food" for a in LEADING] + [f"{i[2]}, {a}" for i in ITEMS if i[1] == "food" for a in TRAILING] + ["white sgr", "caster sgr"]
VALUES = {
    "sugar, granulated": 1, "granulatedsugar": 1, "organic granulatd sgr": 1, "Caster Sugar (divided)": 1, "lemons": 2, "cold LEMON to taste": 2, "lemon-juice": 3, "juice lemon": 3, "hma": 4, "horseradish": 0,
    "creme fraiche": 6, "finely chopped chopped parsley": 7, "cod fillets": 8, "flour, alll-purpose": 10, "groud beef": 11, "to taste": 0, "n/a": 0, "velmberry jam": 0, "???": 0, "lemon juice - see note !": 3,
    "Goldcrest ham kept dry": 4, "goldcerst out of this world hma": 4, "goldcrest": 0, "goldcrest velmberry jam": 0, "cold organic radish, raw, kept dry": 5, "unheard ham": 0,
}


def frames(spark, values):
    packed = [json.dumps([v, v]) for v in values]
    recipes = spark.createDataFrame([(k, t, "x") for k, t in enumerate(packed)] + [(900, None, None), (901, "", None), (902, "[]", None)] + [(2000 + k, json.dumps([v]), "x") for k, v in enumerate(CORPUS)], "id long, ner string, value string")
    density = spark.createDataFrame([(5, "Lemon, raw"), (6, None), (7, " ")], "id long, food_name string")
    told = [f"Grp 4: {i[2]}" for i in ITEMS if i[1] == "category"] + [f"{i[2]} etc." for i in ITEMS if i[1] == "category"]
    category = spark.createDataFrame([(1, "0100", "Grp 4: Pulses & Legumes etc."), (2, "0200", "Lottery"), (3, "", None)] + [(100 + k, "", t) for k, t in enumerate(told)], "id int, code string, description string")
    return recipes, density, category, spark.createDataFrame(ITEMS, "item_id int, kind string, name string, aliases array<string>")


def test_canonical(spark):
    got = canonical.found_items(*frames(spark, list(VALUES)))
    found = {(r["field"], r["record_id"]): r["item_id"] for r in got.collect()}
    assert [(v, found[("recipe_nlg.ner", k)]) for k, v in enumerate(VALUES)] == list(VALUES.items())
    assert {k: v for k, v in found.items() if k[0] != "recipe_nlg.ner" and k[1] < 100} == {("food_density.food_name", 5): 2, ("food_category.description", 1): 9, ("food_category.description", 2): 0}
    assert sorted(v for k, v in found.items() if k[0] == "food_category.description" and k[1] >= 100) == [9, 9, 12, 12, 13, 13, 14, 14]
    assert got.count() == len(VALUES) + 3 + len(CORPUS) + 8


def test_learned_rules(spark):
    values = spark.createDataFrame([("food", v.lower(), 1) for v in CORPUS + ["lemon jam", "ham jam"]], "kind string, value string, rows long")
    rules = canonical.learned_rules(values, canonical.canonical_names(frames(spark, [])[3]))
    assert (sorted(rules["food"].leading.phrases), sorted(rules["food"].trailing.phrases), rules["food"].words) == (sorted(LEADING), sorted(TRAILING), {"sgr": "sugar"})
    assert "goldcerst" in rules["food"].leading and "goldxxst" not in rules["food"].leading
    assert canonical.learned_rules(values.limit(0), canonical.canonical_names(frames(spark, [])[3]))["food"].words == {}


def test_canonical_empty(spark):
    assert canonical.found_items(*[f.limit(0) for f in frames(spark, ["x"])]).count() == 0
    assert rows(canonical.found_items(*frames(spark, ["lemon"])[:3], frames(spark, ["x"])[3].limit(0)).select("item_id").distinct()) == [(0,)]


def test_prefix_filter_is_exact(spark):
    random.seed(9)
    letters = "abcdefg"
    names = [(k, "".join(random.choices(letters, k=random.randint(3, 9)))) for k in range(40)]
    keys = ["".join(random.choices(letters, k=random.randint(3, 9))) for _ in range(150)] + [names[3][1]]
    schema = "kind string, item_id int, name string, tokens array<string>"
    right = spark.createDataFrame([("food", k, n, canonical.tokens(n)) for k, n in names], schema)
    left = spark.createDataFrame([("food", k, canonical.tokens(k)) for k in sorted(set(keys))], "kind string, key string, tokens array<string>")
    want = {}
    for key in set(keys):
        x = set(canonical.tokens(key))
        scored = [(len(x & set(canonical.tokens(n))) / len(x | set(canonical.tokens(n))), -plain_distance(key, n), -k, n) for k, n in names]
        passed = [p for p in scored if p[0] >= canonical.THRESHOLD and canonical.slip(key, p[3])]
        if passed:
            want[key] = -max(passed)[2]
    assert {r["key"]: r["item_id"] for r in canonical.best_names(left, right).collect()} == want


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        corner, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            corner, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, corner + (x != y))
    return row[-1]


@pytest.mark.parametrize("unit", ["(a ", "„a b. ", "a.B", "12. ", '"a. ', "A. B. ", "“a. "])
def test_boundaries_take_linear_time(unit):
    def seconds(n):
        text = (unit * (n // len(unit) + 1))[:n]
        began = time.perf_counter()
        sentences.sentences(text)
        return time.perf_counter() - began

    assert seconds(1 << 18) < 3 * seconds(1 << 17) + 0.5
    assert seconds(1 << 20) < 10
