"""Free-entered values mapped to a canonical list (problem 1): a prefix-filter set-similarity join.

Values and names are cleaned to a key (case, accents, plurals, remarks in brackets). What else is added to a name, and which words
are cut short, is learned from the corpus itself: additions are phrases that stand beside many different names, short forms
fill the gaps of names. Keys are cut to a set of tokens: numbered letters and pairs of letters within words, so that word order,
joined words and slips of the keyboard change few of them. Tokens are ordered by rarity over the list; a pair that reaches the
Jaccard threshold must share a token among its first |x| - ceil(t |x|) + 1, so only those are joined, under
length and positional filters. Jaccard is then verified exactly on the whole sets, an edit-distance check on the keys
decides between a slip and another food, and the best name that passes is kept.

The list (a few hundred names) is broadcast behind a count. Distinct keys are joined once, whatever the
number of rows; results go back to the rows by a join that splits hot values.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.unpack import WHITESPACE_RUN, listed
from granary.llm.bpe import looked_up, slotted
from granary.operators.skew import join_unique
from granary.session import broadcast_checked, cut

THRESHOLD = 0.4

#: An addition stands beside at least this share of the list's items (and three of them), and makes up at least this share of all
#: that stands beside items, so that there are at most 1,000 of a kind and side.
BESIDE, SHARE = 0.03, 0.001
#: A short form is seen in two different names, or so many times in one.
SEEN = 3
JOINERS = frozenset(("and", "n", "&"))
WORD = re.compile(r"[^\W_]+(?:['’][a-z]+)?")


def singular(word: str) -> str:
    if word == "leaves":
        return "leaf"
    if len(word) > 4 and word.endswith("ies"):
        return word[:-3] + "y"
    if len(word) > 4 and word.endswith(("oes", "ses", "xes", "zes", "ches", "shes")):
        return word[:-2]
    return word[:-1] if len(word) > 3 and word.endswith("s") and not word.endswith(("ss", "us")) else word


def distance(a: str, b: str) -> int:
    """Edits with swaps of neighbours (optimal string alignment)."""
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                row[j] = min(row[j], before[j - 2] + 1)
        before = last
    return row[-1]


def shortened(text: str) -> set[str]:
    """The text without one of its characters, and itself: two texts one edit apart share one of these."""
    return {text, *(text[:k] + text[k + 1 :] for k in range(len(text)))}


class Phrases:
    """A set of phrases that also holds what is one edit away from a phrase of over 4 letters."""

    def __init__(self, phrases: list[str]) -> None:
        self.phrases = frozenset(phrases)
        self.sizes = sorted({len(p.split()) for p in phrases}, reverse=True)  # in words, the longest first
        self.near: dict[str, list[str]] = {}
        for phrase in phrases:
            for short in shortened(phrase) if len(phrase) > 4 else ():
                self.near.setdefault(short, []).append(phrase)

    def __contains__(self, text: str) -> bool:
        if text in self.phrases:
            return True
        return any(distance(text, phrase) == 1 for phrase in {p for short in shortened(text) for p in self.near.get(short, ())})


@dataclass(frozen=True)
class Rules:
    """What the corpus taught about a kind: additions before and behind a name, and the words that short forms stand for."""

    leading: Phrases
    trailing: Phrases
    words: dict[str, str]

    def singles(self) -> tuple[list[str], list[str]]:
        return tuple(sorted(p for p in side.phrases if " " not in p) for side in (self.leading, self.trailing))


NONE = Rules(Phrases([]), Phrases([]), {})


def plain(text: str) -> str:
    text = unicodedata.normalize("NFD", text.lower())
    return text if text.isascii() else "".join(c for c in text if not unicodedata.combining(c))


def value_words(value: str) -> list[str]:
    """Words in lower case without accents and without remarks in brackets; none for ``n/a``."""
    words = WORD.findall(re.sub(r"\([^()]*\)", " ", plain(value)))
    return [] if words == ["n", "a"] else words


def key(value: str, rules: Rules = NONE) -> str:
    """Cleaned words of a value or a name; empty if nothing but additions is left."""
    words = value_words(value)
    changed = True
    while changed:
        changed = False
        for size in rules.trailing.sizes:
            if len(words) >= size and " ".join(words[-size:]) in rules.trailing:
                words, changed = words[:-size], True
        for size in rules.leading.sizes:
            if len(words) > size and " ".join(words[:size]) in rules.leading:
                words, changed = words[size:], True
    words = [rules.words.get(w, w) for w in words]
    return " ".join(singular(w) for w in words if not (w in JOINERS or (2 < len(w) < 5 and distance(w, "and") == 1)))


def beside(value: str, names: set[str], longest: int) -> Iterator[tuple[str, str, str]]:
    """(side, phrase, name) of what stands before and behind the longest name, of at most ``longest`` words, that a value holds
    in exact spelling."""
    words = value_words(value)
    keyed = [singular(w) for w in words]
    for size in range(min(len(words), longest), 0, -1):
        for first in range(len(words) - size + 1):
            name = " ".join(w for w in keyed[first : first + size] if w not in JOINERS)
            if name in names:
                for side, phrase in (("leading", words[:first]), ("trailing", words[first + size :])):
                    if phrase:
                        yield side, " ".join(phrase), name
                return


def stands_for(short: str, word: str) -> bool:
    """Whether ``short`` may be short for ``word``: it lacks at least two letters, begins alike and keeps the order; its last
    letter may be another."""
    if len(short) < 2 or len(short) > len(word) - 2 or short[0] != word[0]:
        return False
    letters = iter(word)
    return all(c in letters for c in short[:-1])


def shortenings(cleaned: str, gaps: dict[str, list[tuple[str, str]]], known: set[str]) -> Iterator[tuple[str, str, str]]:
    """(short, word, name) of each name that a key is but for one word that may be short for the name's. ``gaps``: names with one
    word left out, as (word, name)."""
    words = cleaned.split()
    for k, short in enumerate(words):
        if short not in known:
            for word, name in gaps.get(" ".join([*words[:k], "*", *words[k + 1 :]]), ()):
                if stands_for(short, word):
                    yield short, word, name


def tokens(cleaned: str) -> list[str]:
    """Numbered letters and pairs of neighbours within words."""
    counts: dict[str, int] = {}
    found = []
    for word in cleaned.split():
        for char in word:
            counts[char] = counts.get(char, 0) + 1
            found.append(f"{char}{counts[char]}")
        for pair in zip(word, word[1:]):
            pair = "".join(pair)
            counts[pair] = counts.get(pair, 0) + 1
            found.append(f"{pair}{counts[pair]}")
    return found


def cleaned(column: str, rules: dict[str, Rules]) -> Column:
    """``struct<key, tokens>`` of a value of the kind in the column ``kind``."""

    @F.pandas_udf("struct<key:string,tokens:array<string>>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for kinds, values in batches:
            keys = [key(v, rules.get(k, NONE)) for k, v in zip(kinds, values, strict=True)]
            yield pd.DataFrame({"key": keys, "tokens": [tokens(k) for k in keys]})

    return run("kind", column)


def told(df: DataFrame, column: str, of: Callable[[str, str], Iterator[tuple[str, str, str]]]) -> DataFrame:
    """kind, rows, a, b, c of the triples that ``of`` (kind, text) yields for each row."""

    @F.pandas_udf("array<struct<a:string,b:string,c:string>>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for kinds, texts in batches:
            yield pd.Series([list(of(k, t)) for k, t in zip(kinds, texts, strict=True)], dtype=object)

    return df.select("kind", "rows", F.explode(run("kind", column)).alias("x")).select("kind", "rows", "x.*")


def learned_rules(values: DataFrame, names: DataFrame) -> dict[str, Rules]:
    """Additions and short forms of each kind, from all distinct values (kind, value, rows) and the list (kind, name).

    An addition is a phrase that stands beside many different names: the names that a phrase stands beside are counted in one
    aggregation. A short form fills the gap of a name of several words in more than one way that a slip would explain.
    Both lists are bounded by their definition; the names are a fixed list, so they are collected.
    """
    listed_names: dict[str, set[str]] = {}
    for r in names.select("kind", "name").distinct().collect():
        listed_names.setdefault(r["kind"], set()).add(r["name"])
    longest = max((len(n.split()) + 1 for some in listed_names.values() for n in some), default=0)  # a joiner may come on top
    found = told(values, "value", lambda kind, value: beside(value, listed_names.get(kind, set()), longest))
    counted = cut(found.groupBy("kind", "a", "b").agg(F.count_distinct("c").alias("names"), F.sum("rows").alias("rows")))
    totals = counted.groupBy("kind", "a").agg(F.sum("rows").alias("total"))
    least = F.greatest(F.lit(3), F.ceil(F.lit(BESIDE) * F.create_map(*[F.lit(x) for k, n in listed_names.items() for x in (k, len(n))])[F.col("kind")])) if listed_names else F.lit(3)
    kept = counted.join(totals, ["kind", "a"]).where((F.col("names") >= least) & (F.col("rows") >= F.col("total") * SHARE))
    sides: dict[tuple[str, str], list[str]] = {}
    for r in kept.select("kind", "a", "b").orderBy("kind", "a", "b").collect():
        sides.setdefault((r["kind"], r["a"]), []).append(r["b"])
    rules = {kind: Rules(Phrases(sides.get((kind, "leading"), [])), Phrases(sides.get((kind, "trailing"), [])), {}) for kind in listed_names}

    gaps: dict[str, dict[str, list[tuple[str, str]]]] = {}
    known: dict[str, set[str]] = {}
    for kind, some in listed_names.items():
        for name in some:
            words = name.split()
            known.setdefault(kind, set()).update(words)
            for k, word in enumerate(words) if len(words) > 1 else ():
                gaps.setdefault(kind, {}).setdefault(" ".join([*words[:k], "*", *words[k + 1 :]]), []).append((word, name))
    keys = values.select("kind", "rows", cleaned("value", rules).alias("k")).groupBy("kind", "k.key").agg(F.sum("rows").alias("rows"))
    forms = told(keys, "key", lambda kind, text: shortenings(text, gaps.get(kind, {}), known.get(kind, set())))
    forms = forms.groupBy("kind", "a", "b").agg(F.count_distinct("c").alias("names"), F.sum("rows").alias("rows")).where((F.col("names") > 1) | (F.col("rows") >= SEEN))
    best = forms.groupBy("kind", "a").agg(F.max_by("b", F.struct("names", "rows", "b")).alias("b"))
    words_of: dict[str, dict[str, str]] = {}
    for r in best.collect():  # subsequences of the list's words
        words_of.setdefault(r["kind"], {})[r["a"]] = r["b"]
    return {kind: Rules(r.leading, r.trailing, words_of.get(kind, {})) for kind, r in rules.items()}


def slip(value: str, name: str, singles: tuple[list[str], list[str]] = ((), ())) -> bool:
    """Whether ``value`` is ``name`` but for slips: words in any rotation, joined or not, a slip in an addition of one word."""
    words, target = value.split(), name.replace(" ", "")
    readings = [words]
    if len(words) > 1 and any(distance(words[0], a) == 1 for a in singles[0]):
        readings.append(words[1:])
    if len(words) > 1 and any(distance(words[-1], a) == 1 for a in singles[1]):
        readings.append(words[:-1])
    goals = {target, "".join(sorted(name.split()))}
    allowed = 1 if len(target) <= 4 else 2
    if len(target) > 8:  # a third slip in a long name, if most of it is there
        one, two = set(tokens(value)), set(tokens(name))
        allowed += len(one & two) >= 0.5 * len(one | two)
    for reading in readings:
        turns = {"".join(reading[k:] + reading[:k]) for k in range(len(reading))} | {"".join(sorted(reading))}
        if any(abs(len(t) - len(g)) <= allowed and distance(t, g) <= allowed for t in turns for g in goals):
            return True
    return False


def slips(kind: Column, value: Column, name: Column, rules: dict[str, Rules]) -> Column:
    singles = {k: r.singles() for k, r in rules.items()}

    @F.pandas_udf("boolean")
    def run(kinds: pd.Series, values: pd.Series, names: pd.Series) -> pd.Series:
        return pd.Series([slip(v, n, singles.get(k, ((), ()))) for k, v, n in zip(kinds, values, names, strict=True)], dtype=bool)

    return run(kind, value, name)


def prefix(size: Column, threshold: float) -> Column:
    return size - F.ceil(size * F.lit(threshold) - 1e-9) + 1


def best_names(keys: DataFrame, names: DataFrame, threshold: float = THRESHOLD, rules: dict[str, Rules] | None = None) -> DataFrame:
    """kind, key, item_id of the keys for which a name is found. ``keys``: kind, key, tokens (distinct);
    ``names``: kind, item_id, name (cleaned), tokens. A key that is a name stands for it; of the names that a key is a slip of, the
    most similar is kept. Ties go to the name nearer in letters, then to the smaller id."""
    rarity = names.select(F.explode("tokens").alias("t")).groupBy("t").count().orderBy("count", "t").collect()  # of the fixed list
    ranks = slotted({r["t"]: k for k, r in enumerate(rarity)}, "int")
    # Tokens that no name holds come first: they are the rarest and join nothing.
    order = lambda c: F.array_sort(F.transform(c, lambda t: F.coalesce(looked_up(ranks, t), F.lit(-1))))
    sized = lambda df: df.withColumn("size", F.size("tokens")).where("size > 0").withColumn("ordered", order(F.col("tokens")))
    heads = lambda df: df.select("*", F.posexplode(F.slice("ordered", F.lit(1), prefix(F.col("size"), threshold).cast("int"))).alias("at", "token"))
    same = names.groupBy("kind", F.col("name").alias("key")).agg(F.min("item_id").alias("item_id"))
    exact = keys.where("size(tokens) > 0").join(broadcast_checked(same), ["kind", "key"])
    keys = keys.join(broadcast_checked(same), ["kind", "key"], "left_anti")
    left = heads(sized(keys)).where("token >= 0").select("kind", "key", "token", "at", "size", "ordered")
    right = heads(sized(names)).select("kind", "token", "item_id", "name", F.col("at").alias("at2"), F.col("size").alias("size2"), F.col("ordered").alias("ordered2"))
    need = F.ceil((F.col("size") + F.col("size2")) * F.lit(threshold / (1 + threshold)) - 1e-9)
    long_enough = (F.col("size2") >= F.col("size") * threshold) & (F.col("size") >= F.col("size2") * threshold)
    ahead = F.least(F.col("size") - F.col("at"), F.col("size2") - F.col("at2")) >= need
    hits = left.join(broadcast_checked(right), ["kind", "token"]).where(long_enough & ahead)
    # A pair may meet in several tokens: it is verified at the first one that both heads share.
    shared = F.array_intersect("ordered", "ordered2")
    first = F.element_at(F.filter(shared, lambda t: t >= 0), 1) == F.col("token")
    overlap = F.size(F.filter(shared, lambda t: t >= 0))
    scored = hits.where(first).withColumn("overlap", overlap).where(F.col("overlap") >= need)
    scored = scored.withColumn("jaccard", F.col("overlap") / (F.col("size") + F.col("size2") - F.col("overlap")))
    # Every name above the threshold is checked, so that a nearer one that is no slip hides none that is.
    passed = scored.where(slips(F.col("kind"), F.col("key"), F.col("name"), rules or {}))
    order = F.struct("jaccard", (-F.levenshtein("key", "name")).alias("d"), (-F.col("item_id")).alias("i"))
    best = passed.groupBy("kind", "key").agg(F.max_by("item_id", order).alias("item_id"))
    return best.unionByName(exact.select("kind", "key", "item_id"))


def canonical_names(items: DataFrame) -> DataFrame:
    """kind, item_id, name, tokens of every name and alias."""
    every = F.array_union(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))
    long = items.select("kind", "item_id", F.explode(every).alias("n")).where("n is not null").select("kind", "item_id", cleaned("n", {}).alias("c"))
    return long.select("kind", F.col("item_id").cast("int").alias("item_id"), F.col("c.key").alias("name"), "c.tokens").where("name <> ''")


def found_items(recipes: DataFrame, density: DataFrame, categories: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of p1_found: field, record_id, item_id; item_id 0 once if a value stands for no item.

    Null and blank values are none; a record whose values all are gives no row. Repeated values and repeated
    rows count once. A value with nothing but additions (``to taste``) stands for no item.
    """
    ner = recipes.where("ner is not null").select(F.lit("recipe_nlg.ner").alias("field"), F.lit("food").alias("kind"), F.col("id").cast("long").alias("record_id"), F.explode(listed(F.col("ner"), slashes=True)).alias("value"))
    food = density.select(F.lit("food_density.food_name").alias("field"), F.lit("food").alias("kind"), F.col("id").cast("long").alias("record_id"), F.col("food_name").alias("value"))
    category = categories.select(F.lit("food_category.description").alias("field"), F.lit("category").alias("kind"), F.col("id").cast("long").alias("record_id"), F.col("description").alias("value"))
    values = ner.unionByName(food).unionByName(category)
    values = values.withColumn("value", F.trim(F.regexp_replace(F.lower("value"), WHITESPACE_RUN, " "))).where("value <> ''")
    values = cut(values)
    counted = cut(values.groupBy("kind", "value").agg(F.count("*").alias("rows")))
    names = cut(canonical_names(items))
    rules = learned_rules(counted, names)
    distinct = cut(counted.select("kind", "value", "rows", cleaned("value", rules).alias("c")).select("kind", "value", "rows", "c.key", "c.tokens"))
    keys = distinct.groupBy("kind", "key").agg(F.first("tokens").alias("tokens"))
    best = cut(best_names(keys, names, rules=rules))
    mapped = cut(distinct.select("kind", "value", "rows", "key").join(best, ["kind", "key"], "left").select("kind", "value", "rows", F.coalesce("item_id", F.lit(0)).alias("item_id")))
    found = join_unique(values, mapped, ["kind", "value"], "rows", values.count())
    return found.select("field", "record_id", "item_id").distinct()
