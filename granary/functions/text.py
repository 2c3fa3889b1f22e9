"""Cleaning of titles, directions and ingredient phrases, all in Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The measure words that a cleaned ingredient loses.
UNITS = "c cup cups tbsp tablespoon tablespoons tsp teaspoon teaspoons oz ounce ounces lb lbs pound pounds g gram grams kg ml l pkg package packages can cans jar jars".split()
#: White space as Python's strip() sees it.
BLANK = r"[\s\p{Z}\x{1C}-\x{1F}\x{85}]"
#: Borders of a word as Python sees them: Java's \b takes no account of letters beyond ASCII.
NOT_AFTER, NOT_BEFORE = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"


def replaced(text: Column, *steps: tuple[str, str]) -> Column:
    for pattern, by in steps:
        text = F.regexp_replace(text, pattern, by)
    return text


def lowered(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def normalize_text(text: Column) -> Column:
    """Lower case without outer white space; null becomes empty."""
    return replaced(lowered(text), (f"^{BLANK}+|{BLANK}+$", ""))


def simple_clean(text: Column) -> Column:
    """Letters a-z in single-spaced words; everything else parts words. Null becomes empty."""
    return F.trim(replaced(lowered(text), (r"[^a-z\s]", " "), (r"\s+", " ")))


def clean_ingredient(text: Column) -> Column:
    """An ingredient without remarks in brackets, numbers and measure words; null becomes empty."""
    units = f"{NOT_AFTER}(?:{'|'.join(UNITS)}){NOT_BEFORE}"
    plain = replaced(lowered(text), (r"\([^)]*\)", " "), (r"\d+\s*/\s*\d+|\d+\.\d+|\d+", " "), (units, " "))
    return F.trim(replaced(plain, (r"[^a-z\s]", " "), (r"\s+", " ")))


def clean_ingredients(values: Column) -> Column:
    """Each value of a list cleaned, in order; empty results stay in the list."""
    return F.transform(values, clean_ingredient)


def semantic_text(title_clean: Column, ingredients_clean: Column) -> Column:
    """Title and sorted ingredients in one text; repeats and empty phrases stay."""
    return F.concat(title_clean, F.lit(" | "), F.array_join(F.array_sort(ingredients_clean), " "))


def is_json(text: Column) -> Column:
    """Whether a text is one JSON value and nothing else; null is not. Spark's own parser stops behind the first value, so the text
    is parsed as the first of two entries of a list, which must then hold two."""
    both = F.try_parse_json(F.concat(F.lit("["), text, F.lit(", 0]")))
    return F.coalesce(F.size(F.try_variant_get(both, "$", "array<variant>")) == 2, F.lit(False))
