"""Several values packed in one text: a quote-aware finite-state tokenizer.

``unpack`` is the pure function, ``unpacked`` the column. The automaton tracks whether it is inside a
quoted value, whether the next character is escaped, and the depth of brackets. Which
characters delimit is read off the text itself: the strongest delimiter that occurs outside quotes and brackets.

Defined cases: null, empty and blank texts and ``[]`` hold no value; blank values are dropped and do
not count as a position; a quote that is never closed runs to the end of the text; a malformed list
literal is read by the automaton as far as it goes; texts of any length take linear time.
"""

from __future__ import annotations

import html
import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TAG = re.compile(r"</?\s*(?:br|li|ul|ol|p|div)\b[^<>]*>", re.I)
LITERAL_BREAK = re.compile(r"(?:\\r)?\\n")
STRONG = "\n\t;|·"
NOT_AVAILABLE = re.compile(r"(?<![^\W_])n/a(?![^\W_])", re.I)
BULLET = re.compile(r"\s*[-–—*•▪◦‣·]\s+")
NUMBER = re.compile(r"\s*\(?(\d{1,3})(?:[.):]|\s-)\s+")
SPECIAL = re.compile("[\"\\\\\n\t;|·,/]")
BRACKET = re.compile("[()\\[\\]{}\"\n]")
CLOSING = {"(": ")", "[": "]", "{": "}"}
IN_LIST = re.compile(r"[\"'\\\[\],]")
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}


def squeeze(value: str) -> str:
    """Outer whitespace trimmed, inner runs made one space."""
    return " ".join(value.split())


def list_literal(text: str) -> list[str]:
    """Values of a ``[...]`` literal with single or double quotes; nested lists are flattened."""
    values: list[str] = []
    buffer: list[str] = []
    quote, depth, at, n = "", 0, 0, len(text)
    while at < n:
        found = IN_LIST.search(text, at)
        if not found:
            buffer.append(text[at:])
            break
        where, char = found.start(), found.group()
        buffer.append(text[at:where])
        at = where + 1
        if char == "\\" and at < n:
            code = text[at]
            if code == "u" and re.fullmatch("[0-9a-fA-F]{4}", text[at + 1 : at + 5]):
                buffer.append(chr(int(text[at + 1 : at + 5], 16)))
                at += 5
            else:
                buffer.append(ESCAPES.get(code, code))
                at += 1
        elif quote:
            if char == quote:
                quote = ""
            else:
                buffer.append(char)
        elif char in "\"'" and not "".join(buffer).strip():
            quote, buffer = char, []
        elif char == "[":
            depth += 1
        elif char in ",]":
            depth -= char == "]"
            values.append("".join(buffer))
            buffer = []
            if depth <= 0 and char == "]":
                break
        else:
            buffer.append(char)
    values.append("".join(buffer))
    return values


def closes(text: str, at: int, delimiters: str) -> bool:
    """Whether a quote just before ``at`` ends its value: only blanks up to a delimiter or the end."""
    n = len(text)
    while at < n and text[at] in " \r\xa0":
        at += 1
    return at >= n or text[at] in delimiters


def nested(text: str) -> list[tuple[int, int]]:
    """Spans inside brackets (outermost ones) that close on their line and hold no quote."""
    spans: list[tuple[int, int]] = []
    stack: list[tuple[str, int]] = []
    for m in BRACKET.finditer(text):
        char = m.group()
        if char in CLOSING:
            stack.append((CLOSING[char], m.start()))
        elif char in '"\n':
            stack = []
        elif stack and stack[-1][0] == char:
            begin = stack.pop()[1]
            while spans and spans[-1][0] > begin:
                spans.pop()
            spans.append((begin, m.end()))
    return spans


def fields(text: str, delimiters: str) -> tuple[list[str], set[str]]:
    """Split outside quotes and brackets; also the special characters that were met there."""
    values: list[str] = []
    buffer: list[str] = []
    met: set[str] = set()
    quoted, fresh, at, n = False, True, 0, len(text)
    spans = nested(text) if "(" in text or "[" in text or "{" in text else []
    deep = 0
    while at < n:
        found = SPECIAL.search(text, at)
        where = found.start() if found else n
        piece = text[at:where]
        if piece:
            buffer.append(piece)
            fresh = fresh and not piece.strip()
        if not found:
            break
        char, at = found.group(), where + 1
        if quoted:
            if char == "\\" and at < n and text[at] in '"\\':
                buffer.append(text[at])
                at += 1
            elif char == '"' and text[at : at + 1] == '"' and not closes(text, at, delimiters):
                buffer.append('"')
                at += 1
            elif char == '"' and closes(text, at, STRONG + ",/"):
                quoted = False
            else:
                buffer.append(char)
        elif char == '"' and fresh:
            quoted, fresh, buffer = True, False, []
        elif char == "\\" and at < n and text[at] in STRONG + ',/"\\':
            buffer.append(text[at])
            at, fresh = at + 1, False
        else:
            while deep < len(spans) and spans[deep][1] <= where:
                deep += 1
            if deep < len(spans) and spans[deep][0] < where:
                buffer.append(char)
                continue
            met.add(char)
            if char in delimiters:
                values.append("".join(buffer))
                buffer, fresh = [], True
            else:
                buffer.append(char)
                fresh = fresh and char in "\n\t"
    values.append("".join(buffer))
    return values, met


def unmarked(values: list[str]) -> list[str]:
    """Bullets and running numbers removed, where every value carries one."""
    if values and all(BULLET.match(v) for v in values):
        return [v[BULLET.match(v).end() :] for v in values]
    numbers = [NUMBER.match(v) for v in values]
    if values and all(numbers) and [int(m.group(1)) for m in numbers] == list(range(1, len(values) + 1)):
        return [v[m.end() :] for v, m in zip(values, numbers, strict=True)]
    return values


def unpack(text: str | None, slashes: bool = False) -> list[str]:
    """Non-blank values in order. slashes: whether ``/`` may delimit (not where fractions occur)."""
    if text is None or not (body := text.strip()) or body == "[]":
        return []
    if body[0] == '"' and body[1:2] == "[" and body[-2:] == ']"':
        try:
            body = json.loads(body)
        except ValueError:
            body = body[1:-1].replace('\\"', '"')
    if body[0] == "[" and body[1:].lstrip()[:1] in ('"', "'", "]"):
        try:
            values = json.loads(body)
            if not isinstance(values, list) or not all(isinstance(v, str) for v in values):
                raise ValueError
        except ValueError:
            values = list_literal(body)
        return [v for v in map(squeeze, values) if v]
    if "<" in body and TAG.search(body):
        body = html.unescape(TAG.sub("\n", body))
    if "\\n" in body:
        body = LITERAL_BREAK.sub("\n", body)
    whole = slashes and "/" in body
    if whole:
        body = NOT_AVAILABLE.sub(lambda m: m.group().replace("/", "\0"), body)
    values, met = fields(body, STRONG)
    if not met & set(STRONG):
        if slashes and "/" in met:
            values, met = fields(body, "/")
        elif "," in met:
            values, met = fields(body, ",")
    if whole:
        values = [v.replace("\0", "/") for v in values]
    return [v for v in map(squeeze, unmarked([v for v in values if v.strip()])) if v]


def unpacked(column: Column, slashes: bool = False) -> Column:
    """``array<string>`` of the values. Null gives an empty array."""
    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([unpack(t, slashes) for t in texts], dtype=object)

    return run(column)


def is_json_list(column: Column) -> Column:
    """Plain JSON lists, as TESTDATA.md draws the line: the text begins with ``["``."""
    return F.coalesce(column.startswith('["'), F.lit(False))


def listed(column: Column, slashes: bool = False) -> Column:
    """Values of any packing: plain JSON is read by Spark itself, only the rest by the automaton."""
    plain = F.from_json(column, "array<string>")
    clean = F.transform(plain, lambda v: F.trim(F.regexp_replace(F.coalesce(v, F.lit("")), WHITESPACE_RUN, " ")))
    read = is_json_list(column) & plain.isNotNull()
    return F.when(read, F.filter(clean, lambda v: v != "")).otherwise(unpacked(F.when(~F.coalesce(read, F.lit(False)), column), slashes))


def read_list(column: Column) -> Column:
    """The entries of plain JSON as they stand, blank ones too; of any other packing the values of ``unpack``."""
    plain = F.when(is_json_list(column), F.from_json(column, "array<string>"))
    return F.coalesce(plain, unpacked(F.when(plain.isNull(), column)))


#: The characters Python's str.split() takes for whitespace, as a Java pattern.
WHITESPACE_RUN = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
