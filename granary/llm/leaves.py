"""The normal form of recipe texts, in which records that differ in formatting only are equal.

Case, whitespace, punctuation and the composition of letters are dropped; punctuation between digits
(``1/2``, ``1.5``, ``2-3``) is content and stays, and digits that whitespace parts stay apart.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from granary.functions.unpack import unpack

BETWEEN_DIGITS = re.compile(r"(?<=\d)([^\w\s])(?=\d)")
APART = re.compile(r"(?<=\d)[^\w\ue000-\uf8ff\x1f]+(?=\d)")
#: Private characters that stand for kept punctuation and for a gap between digits.
KEEP, GAP = 0xE000, "\uf8ff"


class Dropped(dict):
    """Translation table, filled as characters are met: letters, marks, numbers and private ones stay."""

    def __missing__(self, code: int) -> int | None:
        kept = unicodedata.category(chr(code))[0] in "LMN" or 0xE000 <= code < 0xF900 or code == 0x1F
        self[code] = code if kept else None
        return self[code]


DROPPED = Dropped()
PLACEHOLDERS = frozenset(("na", "seewebsite", "seelink", "tba"))


def normal(text: str) -> str:
    """Normal form of a text; \\x1f in it is kept as a border between values."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
    text = text.lower()
    text = BETWEEN_DIGITS.sub(lambda m: chr(KEEP + ord(m[1]) % 0x800), text)
    text = APART.sub(GAP, text)
    return text.translate(DROPPED)


def normal_values(packed: str | None) -> list[str]:
    """Normal forms of a field's values; values without words become empty and are left out."""
    values = unpack(packed)
    return [v for v in normal("\x1f".join(values)).split("\x1f") if v] if values else []


def different(values: list[str]) -> int:
    """How many different values count: none that is a placeholder."""
    return len({v for v in values if v not in PLACEHOLDERS})


RECORD = "struct<title:string,ingredients:array<string>,directions:string>"


def normal_record(title: Column, ingredients: Column, directions: Column) -> Column:
    """title, ingredients (in order, repeats kept) and directions (one run of words) in normal form."""

    @F.pandas_udf(RECORD)
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for titles, lists, steps in batches:
            yield pd.DataFrame(
                {
                    "title": [normal(t or "") for t in titles],
                    "ingredients": [normal_values(v) for v in lists],
                    "directions": [normal(" ".join(unpack(v))) for v in steps],
                }
            )

    return run(title, ingredients, directions)


def different_values(packed: Column) -> Column:
    """Number of different values of a packed field, without blanks, wordless values and placeholders."""

    @F.pandas_udf("int")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([different(normal_values(v)) for v in batch], dtype="int32")

    return run(packed)
