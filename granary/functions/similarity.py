"""Similarities of sets, texts and vectors."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all different elements; 0 if either list is empty or null."""
    value = F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), value).otherwise(F.lit(0.0))


def inner_product(u: Column, v: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(u, v, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value evaluated once: Spark would evaluate it anew at every place, in lambdas at every element."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def l2_normalized(v: Column) -> Column:
    """A vector of length 1; a zero vector stays as it is."""
    scaled = lambda w, norm: F.transform(w, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(x.cast("double")))
    return let(v, lambda w: let(F.sqrt(inner_product(w, w)), lambda norm: scaled(w, norm)))


def hybrid_score(semantic: Column, ingredients: Column, title: Column) -> Column:
    return F.lit(0.50) * semantic + F.lit(0.35) * ingredients + F.lit(0.15) * title


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence: a row of the table is the bits of one integer."""
    places: dict[str, int] = {}
    for k, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << k
    every = (1 << len(a)) - 1
    row = every
    for y in b:
        met = row & places.get(y, 0)
        row = ((row + met) | (row - met)) & every
    return len(a) - row.bit_count()


def indel(a: str, b: str) -> float:
    """Share of two texts that no insertion or deletion touches; 1 for two empty ones."""
    return 2 * common(a, b) / (len(a) + len(b)) if a or b else 1.0


def token_set(a: str | None, b: str | None) -> float:
    """Similarity of the sets of words: 0 if either is empty, 1 if one holds the other."""
    one, two = set((a or "").split()), set((b or "").split())
    if not one or not two:
        return 0.0
    both, left, right = (" ".join(sorted(s)) for s in (one & two, one - two, two - one))
    if both and (not left or not right):
        return 1.0
    first, second = f"{both} {left}".strip(), f"{both} {right}".strip()
    scores = [indel(first, second)]
    if both:
        scores += [2 * len(both) / (len(both) + len(s)) for s in (first, second)]
    return max(scores)


def token_sort(a: str, b: str) -> float:
    return indel(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def partial(a: str, b: str) -> float:
    """Best similarity of the shorter text to a stretch of the longer one."""
    short, long = sorted((a, b), key=len)
    if not short:
        return 1.0 if not long else 0.0
    stretches = {long[max(0, k) : k + len(short)] for k in range(1 - len(short), len(long))}
    return max(indel(short, s) for s in stretches)


def weighted(a: str | None, b: str | None) -> float:
    """Best of plain, word and partial similarities, the latter two weighed down as the lengths differ."""
    a, b = a or "", b or ""
    if not a or not b:
        return 0.0
    ratio = max(len(a), len(b)) / min(len(a), len(b))
    if ratio < 1.5:
        return max(indel(a, b), 0.95 * max(token_sort(a, b), token_set(a, b)))
    weight = 0.9 if ratio <= 8 else 0.6
    one, two = set(a.split()), set(b.split())
    words = 1.0 if one & two else partial(" ".join(sorted(one)), " ".join(sorted(two)))
    sort = partial(" ".join(sorted(a.split())), " ".join(sorted(b.split())))
    return max(indel(a, b), weight * partial(a, b), 0.95 * weight * max(sort, words))


def title_similarity(a: Column, b: Column) -> Column:
    """``token_set`` of two columns, in Arrow batches: for candidate pairs, after all filters."""

    @F.pandas_udf("double")
    def run(one: pd.Series, two: pd.Series) -> pd.Series:
        return pd.Series([token_set(x, y) for x, y in zip(one, two, strict=True)], dtype="float64")

    return run(a, b)


def fuzzy_ratio(a: Column, b: Column) -> Column:
    """``weighted`` of two columns, from 0 to 100."""

    @F.pandas_udf("double")
    def run(one: pd.Series, two: pd.Series) -> pd.Series:
        return pd.Series([100 * weighted(x, y) for x, y in zip(one, two, strict=True)], dtype="float64")

    return run(a, b)
