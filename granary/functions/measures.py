"""Quantities in many units and spellings, as exact amounts in the common unit of their dimension.

The reading is pure: ``amount`` takes a text and gives (dimension, low, high) in thousandths of a ml, g or
g/ml. Sums use fractions, so no rounding happens before the last step (nearest, halves up). Texts that state
no measure (null, blank, counts, packages without size, pinches) give None.
"""

from __future__ import annotations

import re
from fractions import Fraction
from functools import lru_cache

# Units in ml and g with the spellings read (lower case, without final dot).
VOLUMES = {
    "4.92892159375": "tsp tsps teaspoon teaspoons",
    "14.78676478125": "tbsp tbsps tbs tablespoon tablespoons",
    "29.5735295625": "fl.oz floz fl-oz fluidounce fluidounces",
    "236.5882365": "c cup cups",
    "473.176473": "pt pts pint pints",
    "946.352946": "qt qts quart quarts",
    "3785.411784": "gal gals gallon gallons",
    "1": "ml mls milliliter milliliters millilitre millilitres cc",
    "10": "cl centiliter centiliters centilitre centilitres",
    "100": "dl deciliter deciliters decilitre decilitres",
    "1000": "l liter liters litre litres",
}
MASSES = {
    "28.349523125": "oz ozs ounce ounces",
    "453.59237": "lb lbs pound pounds",
    "0.001": "mg mgs milligram milligrams milligramme milligrammes",
    "1": "g gs gm gms gr gram grams gramme grammes",
    "1000": "kg kgs kilo kilos kilogram kilograms kilogramme kilogrammes",
}
POUND_PER_CUBIC_FOOT = Fraction("16.01846337396014") / 1000
CHARACTER_FRACTIONS = {"½": "1/2", "⅓": "1/3", "⅔": "2/3", "¼": "1/4", "¾": "3/4", "⅕": "1/5", "⅖": "2/5", "⅗": "3/5", "⅘": "4/5", "⅙": "1/6", "⅚": "5/6", "⅛": "1/8", "⅜": "3/8", "⅝": "5/8", "⅞": "7/8"}
NUMBER_WORDS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12, "dozen": 12}
CONTAINERS = "can tin jar bottle box bag pkg package packet pack carton container tub tube pouch sachet envelope block stick bar brick loaf scoop ladle ramekin glass tray piece slice"

FACTORS = {name: (dim, Fraction(size)) for dim, table in (("volume", VOLUMES), ("mass", MASSES)) for size, names in table.items() for name in names.split()}
FLUID = r"(?:fl|fluid)\b\.?[\s-]*(?:oz|ounces?)\b"
UNIT = rf"(?:{FLUID}|tea[\s-]spoons?\b|table[\s-]spoons?\b|(?:{'|'.join(sorted(map(re.escape, FACTORS), key=len, reverse=True))})(?![^\W_]))\.?"
WORD = "(?:" + "|".join(NUMBER_WORDS) + r")\b"
CHARS = "".join(CHARACTER_FRACTIONS)
PLAIN = rf"(?:\d+(?:\s+|-)\d+/\d+|\d+/\d+|\d+\s*[{CHARS}]|[{CHARS}]|\d+(?:[.,]\d+)?|[.,]\d+)"
NUMBER = rf"(?:{PLAIN}|half\s+an?\b|half\b|quarter\s+(?:of\s+)?an?\b|{WORD}(?:\s+and\s+(?:a|one)\s+(?:half|quarter)\b)?|an?\b)"
RANGE = rf"(?:between\s+{NUMBER}\s+and\s+{NUMBER}|{NUMBER}(?:\s*[-–—]\s*{NUMBER}|\s+(?:to|or)\s+{NUMBER})?)"
ONE = rf"{RANGE}[\s-]*(?:heaped|heaping|level|scant|generous|us)?\s*{UNIT}"
JOINED = rf"{ONE}(?:\s*(?:\+|plus|and|&|,)?\s*{ONE})*"
HEDGE = r"(?:(?:about|approx\.?|approximately|around|ca\.?|circa|roughly|scant|[~≈])\s*)?"
SIZES = "small|medium|large|big|heaped"
CONTAINER = rf"(?:{'|'.join(CONTAINERS.split())})(?:s|es)?\b\.?"
PACKS = rf"{RANGE}\s*(?:(?:x|×)\s*{ONE}|(?:(?:{SIZES})\s+)?\(\s*{HEDGE}{ONE}(?:\s+each)?\s*\)\s*{CONTAINER}|{CONTAINER}\s*\(\s*{HEDGE}{ONE}(?:\s+each)?\s*\)|{CONTAINER}\s+of\s+{ONE})"
LEADING = re.compile(rf"\s*{HEDGE}({PACKS}|{JOINED})", re.I)
ONES = re.compile(rf"({RANGE})[\s-]*(?:heaped|heaping|level|scant|generous|us)?\s*({UNIT})")
RANGE_ALONE = re.compile(rf"\s*({RANGE})")
HALVES = re.compile(rf"between\s+({NUMBER})\s+and\s+({NUMBER})|({NUMBER})(?:(?:\s*[-–—]\s*|\s+(?:to|or)\s+)({NUMBER}))?$")
PACKED = re.compile(rf"{PACKS}$")
ANYWHERE = re.compile(rf"(?<![\w.,/])({ONE})", re.I)
UNIT_ALONE = re.compile(rf"(?:level|measuring|us|metric|heaped)?\s*({UNIT})\s*(?:\(us\)|us)?$")


def number(text: str) -> Fraction:
    """One number: decimal point or comma, fraction, mixed number, number word."""
    text = text.strip()
    for char, plain in CHARACTER_FRACTIONS.items():
        text = text.replace(char, f" {plain}")
    if text.startswith("half"):
        return Fraction(1, 2)
    if text.startswith("quarter"):
        return Fraction(1, 4)
    if text[:1].isalpha():
        words = text.split()
        base = Fraction(NUMBER_WORDS.get(words[0], 1))
        return base + (Fraction(1, 2) if words[-1] == "half" else Fraction(1, 4) if words[-1] == "quarter" else 0)
    total = Fraction(0)
    for part in re.split(r"\s+|-", text):
        if part:
            total += Fraction(*map(int, part.split("/"))) if "/" in part else Fraction(part.replace(",", "."))
    return total


def span(text: str) -> tuple[Fraction, Fraction]:
    """Both ends of a range, equal for one number. ``2-1/2`` is a mixed number, ``1/4-1/2`` a range."""
    if re.fullmatch(PLAIN, text.strip()):
        low = high = number(text)
    else:
        m = HALVES.match(text.strip())
        low = number(m[1] or m[3])
        high = number(m[2] or m[4]) if m[2] or m[4] else low
    return min(low, high), max(low, high)


def unit(text: str) -> tuple[str, Fraction]:
    name = re.sub(r"[\s.-]+", "", text)
    if name.startswith(("fl", "fluid")):
        return "volume", Fraction("29.5735295625")
    return FACTORS[name]


def nearest(value: Fraction) -> int:
    return int((value * 1000 * 2 + 1) // 2)


def fold(text: str) -> str:
    return text.lower().replace("⁄", "/").replace("\xa0", " ").replace("’", "'")


@lru_cache(maxsize=1 << 17)
def phrase(text: str) -> tuple[str, int, int] | None:
    """The amount of a phrase that consists of nothing else (what LEADING cut out)."""
    low, high, dim = Fraction(0), Fraction(0), ""
    parts = ONES.findall(text)
    if not parts:
        return None
    times = (Fraction(1), Fraction(1))
    if PACKED.match(text):
        times = span(RANGE_ALONE.match(text)[1])
        parts = ONES.findall(text, RANGE_ALONE.match(text).end())[:1]
    for count, name in parts:
        kind, size = unit(name)
        if dim and kind != dim:
            break
        a, b = span(count)
        dim, low, high = kind, low + a * size, high + b * size
    return dim, nearest(low * times[0]), nearest(high * times[1])


#: Every word that an amount may consist of; the first other word ends it.
AMOUNT_WORDS = (
    {*FACTORS, *NUMBER_WORDS, *SIZES.split("|"), *(c + end for c in CONTAINERS.split() for end in ("", "s", "es"))}
    | set("fl fluid oz tea table spoon spoons half quarter a an and plus or to between of x × us each + & about approx approximately around ca circa roughly".split())
    | set("scant generous heaping level - – — ~ ≈".split())
)


def amount(text: str | None) -> tuple[str, int, int] | None:
    """What a phrase such as an ingredient line states at its start."""
    if text is None:
        return None
    words = fold(text).split()
    for k, word in enumerate(words):
        first = word.strip(".,;:()[]").split("-", 1)[0]
        if first.isalpha() and first not in AMOUNT_WORDS:
            return leading(" ".join(words[:k])) if k else None
    return leading(" ".join(words))


@lru_cache(maxsize=1 << 17)
def leading(text: str) -> tuple[str, int, int] | None:
    m = LEADING.match(text)
    return phrase(m[1]) if m and not zero_divided(m[1]) else None


def zero_divided(text: str) -> bool:
    return bool(re.search(r"/0+(?!\d)", text))


def unit_name(text: str | None) -> tuple[str, int, int] | None:
    """What the name of a measure means: the size it states, or one of the unit."""
    if text is None or zero_divided(text):
        return None
    folded = fold(text).strip()
    if m := ANYWHERE.search(folded):
        return phrase(m[1])
    if m := UNIT_ALONE.fullmatch(folded):
        kind, size = unit(m[1])
        return kind, nearest(size), nearest(size)
    return None


# Densities: mass unit over volume unit, in g/ml.
DENSE = r"\d+(?:[.,]\d+)?(?:e[+-]?\d+)?"
DENSITY = re.compile(rf"(?:(?:about|approx\.?|approximately|around|ca\.?|circa|[~≈])\s*)?({DENSE})(?:\s*(?:-|–|—|to)\s*({DENSE}))?\s*(.*)")
CUBES = {"m3": Fraction(10**6), "ft3": None, "cuft": None, "cm3": Fraction(1), "ccm": Fraction(1), "dm3": Fraction(1000)}


def density_unit(text: str) -> str:
    """The name of a density's unit as it is looked up; empty for a bare number."""
    return fold(text).strip().rstrip(".").replace("³", "3").replace("^", "")


def density_factor(text: str) -> Fraction | None:
    """What one of the unit is in g/ml; a bare number is g/ml."""
    name = density_unit(text)
    if not name:
        return Fraction(1)
    halves = re.split(r"\s*/\s*|\s+per\s+", name)
    if len(halves) != 2:
        return None
    top, bottom = (re.sub(r"[\s.]+", "", h).replace("cubicfoot", "ft3").replace("cubicfeet", "ft3").replace("cubicmeter", "m3").replace("cubicmetre", "m3") for h in halves)
    mass = FACTORS.get(top)
    if not mass or mass[0] != "mass":
        return None
    if bottom in ("ft3", "cuft"):
        return POUND_PER_CUBIC_FOOT * mass[1] / Fraction("453.59237")
    if bottom in CUBES:
        return mass[1] / CUBES[bottom]
    volume = (("volume", Fraction("29.5735295625")) if bottom in ("floz", "fluidounce") else FACTORS.get(bottom))
    return mass[1] / volume[1] if volume and volume[0] == "volume" else None


def stated_density(text: str | None) -> tuple[str, str | None, str] | None:
    """(low, high, unit) as said, of a text that is a density or a bare number."""
    m = DENSITY.fullmatch(fold(text).strip()) if text else None
    return (m[1], m[2], m[3]) if m else None


def density(text: str | None) -> tuple[str, int, int] | None:
    said = stated_density(text)
    factor = density_factor(said[2]) if said else None
    if factor is None:
        return None
    low, high = (Fraction(x.replace(",", ".")) * factor for x in (said[0], said[1] or said[0]))
    return "density", nearest(min(low, high)), nearest(max(low, high))


def bare_density(text: str | None) -> float | None:
    """The number of a density that is stated without any unit; the middle of a range."""
    said = stated_density(text)
    if said is None or density_unit(said[2]):
        return None
    return sum(float(x.replace(",", ".")) for x in (said[0], said[1] or said[0])) / 2
