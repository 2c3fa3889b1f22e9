"""Evaluation passages inside training texts (problem 9): a distributed positional inverted index.

1. The index: its terms are pairs of neighbouring words, its postings document and place. It is stored in segments of whole
   documents; a segment is one row that holds the sorted terms and the list of each. Nothing is shuffled, and the list of a term
   that is in every text is spread over all segments. The index holds the terms that the test side asks for.
2. Each item is searched in each segment. A passage that counts keeps at least SUPPORT pairs of some WINDOW words of the item, so the
   SUPPORT - 1 longest lists alone prove nothing: the documents come from the rarest lists, and the long lists are only looked up for
   those. Places are adjusted by the offset in the item; SUPPORT pairs of a window must agree on it, give or take the words that
   edits add or drop. That gives proximity matches: document, item, offset and range in the text.
3. The texts of the documents found are aligned with the item exactly, word by word, over all alignments.

Everything of the test side (300 items) is collected: it is fixed and small.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.session import cut, spread

LEAST = 20  # words of a passage
TOLERANCE = 0.1  # changed, dropped or added words per word of the passage, rounded to the nearest
#: A passage has a window of WINDOW words in which edits destroy at most 6 of the 19 pairs: of the windows that
#: part it, one holds at most 3 edits, or 4 that lie within 5 words.
WINDOW, SUPPORT = 20, 13
DRIFT = 6  # words by which the offset may wander within a window, and more
SEGMENT = 100_000  # postings of a segment, whole documents
#: Most matches that are broadcast to the second scan of the texts; beyond it both are shuffled.
FEW = 200_000
SEGMENT_ROW = "terms array<long>, starts array<int>, docs array<long>, places array<int>"
LATIN = "".join(chr(c) for c in range(0xC0, 0x180) if len(unicodedata.normalize("NFD", chr(c))) > 1)
PLAIN = "".join(unicodedata.normalize("NFD", c)[0] for c in LATIN)


def unaccented(text: Column) -> Column:
    return F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), LATIN, PLAIN), r"\p{M}", "")


def folded_words(text: Column) -> Column:
    """Words in lower case without accents: runs of letters and digits. Null gives an empty array."""
    return F.regexp_extract_all(F.lower(unaccented(text)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def item_words(items: DataFrame) -> dict[int, list[str]]:
    """Words of each item. The test set is fixed: it is collected."""
    rows = items.where("text is not null").select("item_id", folded_words(F.col("text")).alias("w")).orderBy("item_id").collect()
    return {r["item_id"]: list(r["w"]) for r in rows}


def pair_places(texts: DataFrame, key: str) -> DataFrame:
    """key, place, term of every two neighbouring words of ``texts`` (key, text); the term is the hash of both."""
    plain = F.lower(unaccented(F.col("text")))
    # One generator per step, so that no step is evaluated twice.
    rows = texts.select(key, F.explode(F.array(F.split(F.trim(F.regexp_replace(plain, r"[^\p{L}\p{N}]+", " ")), " "))).alias("w")).where("size(w) > 1")
    pairs = F.arrays_zip(F.slice("w", F.lit(1), F.size("w") - 1).alias("a"), F.slice("w", F.lit(2), F.size("w") - 1).alias("b"))
    return rows.select(key, F.posexplode(pairs).alias("place", "p")).select(key, "place", F.xxhash64("p.a", "p.b").alias("term"))


def index_of(documents: DataFrame, terms: DataFrame) -> DataFrame:
    """The stored segments of the index over ``terms`` (one column, bounded by the test side, so it is broadcast): ``terms`` in order,
    ``starts`` of their lists (one more than terms), ``docs`` and ``places`` of all lists. No document is in two segments."""
    places = pair_places(documents.select("doc_id", "text").where("text is not null"), "doc_id").join(F.broadcast(terms), "term")

    def segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: list[pd.DataFrame] = []
        size = 0
        for batch in batches:
            if not len(batch):
                continue
            if size >= SEGMENT:
                # Rows of one document follow each other: cut where the next one begins.
                ids = batch["doc_id"].to_numpy()
                same = int(np.argmax(ids != waiting[-1]["doc_id"].iloc[-1])) if (ids != waiting[-1]["doc_id"].iloc[-1]).any() else len(ids)
                waiting.append(batch.iloc[:same])
                if same == len(ids):
                    continue
                yield segment(pd.concat(waiting))
                waiting, size, batch = [], 0, batch.iloc[same:]
            waiting.append(batch)
            size += len(batch)
        if waiting:
            yield segment(pd.concat(waiting))

    return cut(places.select("doc_id", "term", "place").mapInPandas(segments, SEGMENT_ROW))


def segment(postings: pd.DataFrame) -> pd.DataFrame:
    """One row of the index."""
    term = postings["term"].to_numpy()
    order = np.argsort(term, kind="stable")
    terms, starts = np.unique(term[order], return_index=True)
    lists = [terms, np.append(starts, len(term)).astype(np.int32), postings["doc_id"].to_numpy()[order], postings["place"].to_numpy()[order].astype(np.int32)]
    return pd.DataFrame({"terms": [lists[0]], "starts": [lists[1]], "docs": [lists[2]], "places": [lists[3]]})


def near_matches(terms: np.ndarray, starts: np.ndarray, docs: np.ndarray, places: np.ndarray, items: dict[int, np.ndarray]) -> list[tuple[int, int, int, int, int]]:
    """(doc_id, item_id, offset, low, high) of every proximity match in a segment: the most frequent offset of the item in the text,
    and the lowest and highest. ``items``: the terms of each item in order."""
    names, number = np.unique(docs, return_inverse=True)
    found = []
    for item_id, wanted in items.items():
        at = np.searchsorted(terms, wanted)
        known = (at < len(terms)) & (terms[np.minimum(at, len(terms) - 1)] == wanted)
        spots, at = np.flatnonzero(known), at[known]
        if len(spots) < SUPPORT:
            continue
        sizes = starts[at + 1] - starts[at]
        rarest = np.argsort(sizes, kind="stable")
        take = lambda some: np.concatenate([np.arange(starts[k], starts[k + 1]) for k in at[some]])  # noqa: E731, B023
        leading, common = rarest[: len(rarest) - SUPPORT + 1], rarest[len(rarest) - SUPPORT + 1 :]
        hits, spot = take(leading), np.repeat(spots[leading], sizes[leading])
        led = np.zeros(len(names), dtype=bool)
        led[number[hits]] = True
        more = take(common)
        kept = led[number[more]]
        hits, spot = np.concatenate((hits, more[kept])), np.concatenate((spot, np.repeat(spots[common], sizes[common])[kept]))
        enough = np.bincount(number[hits], minlength=len(names)) >= SUPPORT
        kept = enough[number[hits]]
        hits, spot = hits[kept], spot[kept]
        if not len(hits):
            continue
        doc, offset = number[hits], places[hits].astype(np.int64) - spot
        # Bands of 2 DRIFT offsets that overlap by half; a pair of an item counts once in a band.
        band = np.concatenate((offset // DRIFT, offset // DRIFT - 1))
        doc, spot, offset = np.tile(doc, 2), np.tile(spot, 2), np.tile(offset, 2)
        order = np.lexsort((spot, band, doc))
        doc, spot, offset, band = doc[order], spot[order], offset[order], band[order]
        fresh = np.append(True, (doc[1:] != doc[:-1]) | (band[1:] != band[:-1]) | (spot[1:] != spot[:-1]))
        doc1, band1, spot1 = doc[fresh], band[fresh], spot[fresh]
        span = SUPPORT - 1
        if len(doc1) <= span:
            continue
        close = (doc1[span:] == doc1[:-span]) & (band1[span:] == band1[:-span]) & (spot1[span:] - spot1[:-span] < WINDOW - 1)
        for d, b in {(int(d), int(b)) for d, b in zip(doc1[:-span][close], band1[:-span][close])}:
            low, high = np.searchsorted(doc, (d, d + 1))
            mine = offset[low:high][band[low:high] == b]
            found.append((int(names[d]), item_id, Counter(mine.tolist()).most_common(1)[0][0], int(mine.min()), int(mine.max())))
    return found


def proximity_matches(index: DataFrame, items: dict[int, np.ndarray]) -> DataFrame:
    """doc_id, item_id, offset, low, high over all segments; a document may match an item in several places."""

    @F.pandas_udf("array<struct<doc_id:long,item_id:int,offset:int,low:int,high:int>>")
    def search(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for columns in batches:
            yield pd.Series([near_matches(*row, items) for row in zip(*columns, strict=True)], dtype=object)

    return index.select(F.explode(search("terms", "starts", "docs", "places")).alias("m")).select("m.*")


def passage(item: list, text: list, least: int = LEAST, tolerance: float = TOLERANCE) -> bool:
    """Whether ``text`` holds a passage of ``item`` (words): a stretch of at least ``least`` words of the item that
    begins and ends with equal words, with at most ``tolerance`` edits per word, rounded to the nearest.

    Exact over all alignments: ``best[k][j]`` is the most that the tolerated edits can exceed those made, over all
    stretches of k words (``least`` stands for all longer ones too) that end before word i of the item and j of the text.
    """
    n, m = len(item), len(text)
    places: dict = {}
    for j, word in enumerate(text, 1):
        places.setdefault(word, []).append(j)
    columns = np.arange(m + 1)
    best = np.full((least + 1, m + 1), -np.inf)
    for word in item:
        longer = np.full((least + 1, m + 1), -np.inf)
        longer[1:] = best[:-1]
        np.maximum(longer[least], best[least], out=longer[least])
        longer += tolerance
        row = longer - 1  # the item's word dropped, or changed
        np.maximum(row[:, 1:], longer[:, :-1] - 1, out=row[:, 1:])
        if word in places:
            at = np.array(places[word])
            row[:, at] = np.maximum(row[:, at], longer[:, at - 1])
            row[1, at] = np.maximum(row[1, at], tolerance)  # a stretch begins
            if (longer[least, at - 1] > -0.5 - 1e-9).any():
                return True
        best = np.maximum.accumulate(row + columns, axis=1) - columns  # words added
    return False


def straight(item: list[str], text: list[str], shift: int, least: int = LEAST, tolerance: float = TOLERANCE) -> bool:
    """Whether ``text`` holds a passage without dropped or added words, where item word k stands at ``shift + k``."""
    first, last = max(0, -shift), min(len(item), len(text) - shift)
    if last - first < least:
        return False
    equal = np.fromiter((item[k] == text[shift + k] for k in range(first, last)), dtype=bool, count=last - first)
    at = np.flatnonzero(equal)
    # Among equal words, edits between two are their distance less their rank: over all beginnings and ends at once.
    length = at[None, :] - at[:, None] + 1
    edits = length - (np.arange(len(at))[None, :] - np.arange(len(at))[:, None] + 1)
    return bool(((length >= least) & (edits <= length * tolerance + 0.5 + 1e-9)).any())


def leaks_in(words: list[str], matches: dict[int, list[tuple[int, int, int]]], items: dict[int, list[str]]) -> list[int]:
    """ids of the items that a document leaks, given its proximity matches (offset, low, high) by item.

    A passage reaches as far as its item does, and its edits may shift it. Ranges that overlap are aligned together.
    """
    found = []
    for item_id, spots in sorted(matches.items()):
        item = items[item_id]
        if any(straight(item, words, offset) for offset in {offset for offset, _, _ in spots}):
            found.append(item_id)
            continue
        slack = math.floor(len(item) * TOLERANCE + 0.5) + 1
        ranges: list[list[int]] = []
        for low, high in sorted((low - slack, high + len(item) + slack) for _, low, high in spots):
            if ranges and low <= ranges[-1][1]:
                ranges[-1][1] = max(ranges[-1][1], high)
            else:
                ranges.append([low, high])
        if any(passage(item, words[max(0, low) : high]) for low, high in ranges):
            found.append(item_id)
    return found


def found_leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of p9_found: doc_id, item_id.

    Null, empty and short texts leak nothing, nor do items of under 20 words. Repeated texts each count, an item once per document.
    Texts of any length are indexed whole; there is no limit on matches. Extra columns are left out at the scan.
    """
    documents = documents.select("doc_id", "text").where("text is not null")
    texts = {k: w for k, w in item_words(items).items() if len(w) >= LEAST}
    rows = pair_places(items.select("item_id", "text").where("text is not null"), "item_id").orderBy("item_id", "place").collect()  # of the fixed test set
    terms: dict[int, list[int]] = {k: [] for k in texts}
    for r in rows:
        if r["item_id"] in terms:
            terms[r["item_id"]].append(r["term"])
    asked = documents.sparkSession.createDataFrame([(t,) for t in sorted({t for some in terms.values() for t in some})], "term long")
    index = index_of(spread(documents), asked)
    matches = proximity_matches(index, {k: np.array(t, dtype=np.int64) for k, t in terms.items()})
    # Matches of one document: bounded by its own length and the test side.
    grouped = cut(matches.groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "offset", "low", "high")).alias("m")))
    few = grouped.limit(FEW + 1).count() <= FEW
    both = documents.join(F.broadcast(grouped) if few else grouped, "doc_id")

    @F.pandas_udf("array<int>")
    def verify(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for words, met in batches:
            leaks = []
            for w, m in zip(words, met, strict=True):
                by_item: dict[int, list[tuple[int, int, int]]] = {}
                for one in m:
                    by_item.setdefault(one["item_id"], []).append((one["offset"], one["low"], one["high"]))
                leaks.append(leaks_in(list(w), by_item, texts))
            yield pd.Series(leaks, dtype=object)

    found = both.select("doc_id", F.explode(verify(folded_words(F.col("text")), F.col("m"))).alias("item_id"))
    return found.select("doc_id", F.col("item_id").cast("int").alias("item_id"))
