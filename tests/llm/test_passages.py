"""Passages beside a longer stretch that is edited too much."""

import random

import pytest

from granary.llm import leaks
from tests.conftest import rows

ITEM = [f"word{k}" for k in range(76)]


def edited(first, last, at):
    return [f"new{k}" if k in at else ITEM[k] for k in range(first, last)]


HEAVY = edited(0, 36, range(5, 36, 6)) + [f"other{k}" for k in range(20)]
TEXTS = {
    1: HEAVY + edited(56, 76, (60, 70)),
    2: edited(0, 48, range(3, 48, 6)) + [f"other{k}" for k in range(8)] + edited(56, 76, ()),
    3: HEAVY + edited(56, 76, (60, 65, 70)),  # 3 in 20 words
    4: HEAVY,
}


@pytest.mark.parametrize("doc,found", [(1, True), (2, True), (3, False), (4, False)])
def test_passage_behind_heavier_edits(doc, found):
    assert leaks.passage(ITEM, TEXTS[doc]) == found


def test_found_behind_heavier_edits(spark):
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in TEXTS.items()], "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(ITEM))], "item_id int, text string")
    assert rows(leaks.found_leaks(docs, items)) == [(1, 7), (2, 7)]


def least_edits(item, text, least=20):
    """From every pair of equal words, the least edits of every stretch that starts there."""
    for a, b in ((a, b) for a, x in enumerate(item) for b, y in enumerate(text) if x == y):
        edits = list(range(len(text) - b))
        for i in range(a + 1, len(item)):
            before, edits = edits, [edits[0] + 1]
            for j in range(1, len(before)):
                same = item[i] == text[b + j]
                if same and i - a + 1 >= least and 10 * before[j - 1] <= i - a + 1 + 5:
                    return True
                edits.append(min(before[j - 1] + (not same), before[j] + 1, edits[j - 1] + 1))
    return False


def test_passage_against_all_alignments():
    random.seed(11)
    seen = set()
    for _ in range(60):
        item = [random.randint(0, random.choice([3, 60])) for _ in range(random.randint(20, 32))]
        text = [w if random.random() > 0.12 else random.randint(90, 99) for w in item if random.random() > 0.03]
        seen.add(found := leaks.passage(item, text))
        assert found == least_edits(item, text)
    assert seen == {True, False}


CLUSTERED = ITEM[:20] + ["x1", "x2", "x3", "x4"] + ITEM[24:39]


@pytest.mark.parametrize("text", [ITEM[:15] + ["x1", "x2", "x3", "x4"] + ITEM[19:35], CLUSTERED, ITEM[:15] + ITEM[19:35], ITEM[:10] + ["y1", "y2"] + ITEM[10:30]])
def test_clustered_edits_are_found(spark, text):
    docs = spark.createDataFrame([(1, " ".join(["before"] * 30 + text + ["behind"] * 30))], "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(ITEM))], "item_id int, text string")
    assert least_edits(ITEM, text) and rows(leaks.found_leaks(docs, items)) == [(1, 7)]


def pairs_kept(length, edits, kind):
    """Most intact pairs of any window of a passage whose item words ``edits`` are changed, or are followed by added words."""
    broken = {k for e in edits for k in ((e - 1, e) if kind == "changed" else (e,))}
    return max(sum(k not in broken for k in range(w, w + leaks.WINDOW - 1)) for w in range(length - leaks.WINDOW + 1))


def test_support_holds_for_any_edits():
    random.seed(6)
    for _ in range(20_000):
        length = random.randint(20, 95)
        most = (length + 5) // 10
        centre = random.randrange(1, length - 1)
        spread = random.choice([4, 8, 20, 95])
        near = [k for k in range(1, length - 1) if abs(k - centre) <= spread]
        edits = random.sample(near, min(most, len(near)))
        assert pairs_kept(length, edits, random.choice(["changed", "added"])) >= leaks.SUPPORT


def test_long_passages_against_brute_force(spark):
    random.seed(21)
    vocabulary = [f"w{k}" for k in range(60)]
    items = {k: random.choices(vocabulary, k=random.randint(30, 93)) for k in range(8)}
    docs = {}
    for k in range(80):
        text = random.choices(vocabulary, k=20)
        for _ in range(random.randint(1, 2)):
            source = items[random.randrange(8)]
            start = random.randrange(len(source) - 20)
            piece = source[start : start + random.randint(18, 93)]
            at = random.randrange(len(piece))
            for _ in range(random.randint(0, len(piece) // 9 + 1)):
                spot = min(len(piece) - 1, max(0, at + random.randint(-5, 5))) if k % 2 else random.randrange(len(piece))
                piece[spot : spot + 1] = random.choice([[], ["zz"], [piece[spot], "zz"]])
            text += piece + random.choices(vocabulary, k=random.randint(0, 20))
        docs[k] = text
    brute = sorted((d, i) for d, text in docs.items() for i, item in items.items() if leaks.passage(item, text))
    df = spark.createDataFrame([(k, " ".join(v)) for k, v in docs.items()], "doc_id long, text string")
    it = spark.createDataFrame([(k, " ".join(v)) for k, v in items.items()], "item_id int, text string")
    assert 20 < len(brute) < 640
    assert sorted((r[0], r[1]) for r in leaks.found_leaks(df, it).collect()) == brute


def test_segments_keep_documents_whole(spark, monkeypatch):
    monkeypatch.setattr(leaks, "SEGMENT", 50)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 40)
    df = spark.createDataFrame([(k, " ".join(ITEM[k % 7 : 40])) for k in range(30)] + [(99, " ".join(ITEM * 40))], "doc_id long, text string").coalesce(1)
    pairs = leaks.pair_places(spark.createDataFrame([(1, " ".join(ITEM))], "item_id long, text string"), "item_id").select("term")
    found = [set(r["docs"]) for r in leaks.index_of(df, pairs).collect()]
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(found) > 3 and sum(map(len, found)) == len(set().union(*found)) == 31
