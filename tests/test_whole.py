"""Recipes of every packing stay in: the queries on the recipe table, against brute force."""

import json
import math
import random
import re

from granary.functions import similarity
from granary.operators import hybrid, skew
from granary.plans import recipes
from tests.conftest import rows

MIXED = [
    (1, "A", '["1 c. sugar", "", "2 eggs"]', "mix"),
    (2, "B", "['1 c. sugar', '2 eggs']", "mix well"),
    (3, "C", '"[\\"salt\\", \\"2 eggs\\", \\"sugar\\"]"', "mix"),
    (4, "D", "flour; water", "bake"),
    (5, "E", "- flour\n- water", "bake it"),
    (6, "F", "[]", "nothing"),
    (7, "G", None, "nothing"),
    (8, "H", '["rice"]', None),
    (9, "I", '["sugar", ', "broken"),
]
CLEAN = {1: ["sugar", "", "eggs"], 2: ["sugar", "eggs"], 3: ["salt", "eggs", "sugar"], 4: ["flour", "water"], 5: ["flour", "water"], 6: [], 7: [], 8: ["rice"], 9: ["sugar"]}


def folder(spark, tmp_path, extra=()):
    df = spark.createDataFrame([(*r, None) for r in [*MIXED, *extra]], "id long, title string, ingredients string, directions string, ner string")
    df.write.parquet(str(tmp_path / "recipe_nlg.parquet"))
    return str(tmp_path)


def test_every_packing_is_read(spark, tmp_path):
    at = folder(spark, tmp_path)
    assert {r["id"]: (r["ingredients_clean"], r["n"]) for r in recipes.clean_ingredient_list(spark, at).collect()} == {k: ("|".join(v), len(v)) for k, v in CLEAN.items()}
    assert {r["id"]: r["joined"] for r in recipes.parse_list(spark, at).collect()}[1] == "1 c. sugar||2 eggs"
    assert {r["phrase"] for r in recipes.unique_phrases(spark, at).collect()} == {p for v in CLEAN.values() for p in v if p}
    assert {r["id"] for r in recipes.semantic_text(spark, at).collect()} == set(CLEAN)


def similarity_of(a, b):
    """Scores of two (title, phrases) by the definition: cosine of word sets, Jaccard of phrases, words of the titles."""
    bags = [set(re.findall(r"[^\W_]+", " ".join([t, *p]))) for t, p in (a, b)]
    cosine = len(bags[0] & bags[1]) / math.sqrt(len(bags[0]) * len(bags[1])) if all(bags) else 0.0
    one, two = set(a[1]), set(b[1])
    jaccard = len(one & two) / len(one | two) if one and two else 0.0
    return cosine, jaccard, 0.5 * cosine + 0.35 * jaccard + 0.15 * similarity.token_set(a[0], b[0])


def test_every_recipe_is_flagged(spark, tmp_path):
    random.seed(4)
    foods = ["salt", "brown sugar", "rice", "egg", "whole milk", "butter", "flour", "water", "oat", "thyme", "olive oil", "onion"]
    extra = []
    for k in range(20, 60):
        picked = random.sample(foods, random.randint(1, 12)) if k % 2 else [f for f in foods if random.random() > 0.1]
        picked += [f"spice{random.randint(1, 3)}"] * (k % 3 == 0)
        extra.append((k, random.choice(["Rice Soup", "Rice Soup No. 2", ""]), json.dumps([f"{k} cups {f}" for f in picked]), "mix " * (k % 5)))
    at = folder(spark, tmp_path, extra)
    clean = CLEAN | {k: [p.split("cups ")[1] if "spice" not in p else "spice" for p in json.loads(t)] for k, _, t, _ in extra}
    told = {r[0]: (r[1].lower(), clean[r[0]]) for r in [*MIXED, *extra]}
    root = {k: k for k in told}
    for _ in told:
        for a in told:
            for b in told:
                scores = similarity_of(told[a], told[b])
                if scores[0] >= 0.95 - 1e-12 and scores[1] >= 0.5 and scores[2] >= 0.75 - 1e-12:
                    root[a] = root[b] = min(root[a], root[b])
    groups = {r: [k for k in told if root[k] == r] for r in root.values()}
    assert sum(len(g) > 1 for g in groups.values()) > 1
    length = {r[0]: len((r[3] or "").strip()) for r in [*MIXED, *extra]}
    kept = sorted(max(g, key=lambda k: (len(clean[k]), length[k], -k)) for g in groups.values())
    flags = recipes.survivor_flags(spark, at)
    assert sorted(r["id"] for r in flags.collect()) == sorted(told)
    assert sorted(r["id"] for r in flags.collect() if r["is_hybrid_duplicate_candidate"]) == sorted(k for g in groups.values() if len(g) > 1 for k in g)
    assert sorted(r["id"] for r in recipes.trimmed_dataset(spark, at).collect()) == kept
    sets = {k: set(v) for k, v in clean.items()}
    assert sorted(tuple(r) for r in recipes.set_classes(spark, at).collect()) == sorted((k, min(j for j in clean if sets[j] == sets[k])) for k in clean)


def pairs_of(sets, least):
    cosine = lambda a, b: len(a & b) / math.sqrt(len(a) * len(b))
    return {(a, b) for a, x in sets.items() for b, y in sets.items() if a < b and x and y and cosine(x, y) >= least - 1e-12}


def test_signatures_lose_no_pair(spark):
    random.seed(8)
    words = [f"w{k}" for k in range(400)]
    sets = {0: set()}
    for k in range(1, 90):
        base = sets[random.randrange(k)] if random.random() < 0.7 else set()
        base = base or set(random.sample(words, random.choice([1, 3, 9, 10, 19, 21, 40, 150, 200])))
        sets[k] = set(w for w in base if random.random() > 0.03) | set(random.sample(words, random.randint(0, 2)))
    df = spark.createDataFrame([(k, sorted(v)) for k, v in sets.items()], "id long, words array<string>")
    for least in (0.95, 0.8):
        found = {(r["a"], r["b"]) for r in hybrid.candidate_pairs(df, least).collect()}
        assert pairs_of(sets, least) <= found
        assert hybrid.candidate_pairs(df, least).count() == len(found)
    assert hybrid.candidate_pairs(df.limit(0)).count() == 0


def test_hot_signature_is_split(spark, monkeypatch):
    monkeypatch.setattr(skew, "MEETING", 3)
    sets = {k: {f"w{j}" for j in range(30)} | {f"own{k}"} for k in range(12)}
    df = spark.createDataFrame([(k, sorted(v)) for k, v in sets.items()], "id long, words array<string>")
    assert {tuple(r) for r in hybrid.candidate_pairs(df).collect()} >= pairs_of(sets, 0.95)
