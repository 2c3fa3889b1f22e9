"""Byte-level BPE of the whole corpus in Spark expressions (problem 8).

Ranked merges are folded over the bytes of a word by higher-order functions. Bytes are written as hex pairs
and pieces stand between bars (``|61||6262|``), so a merge of all occurrences of a pair is one text
replacement. The rank map is a literal: an array of small maps, addressed by the CRC of the piece, because a
lookup in a Spark map reads it from the start.

Each of the HOT most frequent words of the corpus is folded once; their ids form a second literal. Texts are
then encoded row by row, without a shuffle; rarer words are folded where they stand. Both literals have a
fixed size (the vocabulary, and HOT words of at most LONGEST bytes), and the result is exact whatever HOT is.

Defined cases: null and empty texts give an empty list; special tokens in a text are ordinary text; blank
texts and texts of any length are encoded whole; every text decodes to itself.
"""

from __future__ import annotations

import base64
import json
import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SLOTS = 4096
HOT, LONGEST = 1 << 15, 64
# Fixed value: the published splitting pattern, with Unicode white space spelled out for Java.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{IsWhite_Space}\p{L}\p{N}]+"
    r"|\p{IsWhite_Space}+(?![^\p{IsWhite_Space}])|\p{IsWhite_Space}+"
)


def read_ranks(path: str = TOKENIZER) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}


def slotted(entries: dict[str, object], kind: str) -> Column:
    """A map as a literal array of SLOTS maps, folded to a constant when the plan is optimised."""
    slots: list[dict[str, object]] = [{} for _ in range(SLOTS)]
    for key, value in entries.items():
        slots[zlib.crc32(key.encode()) % SLOTS][key] = value
    return F.from_json(F.lit(json.dumps(slots, ensure_ascii=False)), f"array<map<string,{kind}>>")


def looked_up(slots: Column, key: Column) -> Column:
    return F.try_element_at(slots[F.pmod(F.crc32(key), F.lit(SLOTS)).cast("int")], key)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def pieces_of(state: Column) -> Column:
    return F.split(F.substring(state, F.lit(2), F.length(state) - 2), r"\|\|")


def merge_once(state: Column, ranks: Column) -> Column:
    """Merge every occurrence of the adjacent pair with the lowest rank; a leading ``!`` says there is none."""

    def over(pieces: Column) -> Column:
        pair = lambda i: F.struct(looked_up(ranks, F.concat(pieces[i], pieces[i + 1])).alias("rank"), i.alias("at"))
        ranked = F.filter(F.transform(F.sequence(F.lit(0), F.size(pieces) - 2), pair), lambda p: p["rank"].isNotNull())

        def apply(best: Column) -> Column:
            one, two = pieces[best["at"]], pieces[best["at"] + 1]
            merged = F.replace(state, F.concat(F.lit("|"), one, F.lit("||"), two, F.lit("|")), F.concat(F.lit("|"), one, two, F.lit("|")))
            return F.when(best.isNull(), F.concat(F.lit("!"), state)).otherwise(merged)

        return F.when(F.size(pieces) < 2, F.concat(F.lit("!"), state)).otherwise(let(F.array_min(ranked), apply))

    return F.when(state.startswith("!"), state).otherwise(let(pieces_of(state), over))


def word_ids(word: Column, ranks: Column) -> Column:
    """ids of a non-empty word: the whole word's rank if it has one, else the fold of ranked merges."""

    def encode(hexed: Column) -> Column:
        start = F.regexp_replace(hexed, "(..)", "|$1|")
        rounds = F.sequence(F.lit(1), F.greatest(F.length(hexed) / 2, F.lit(1)).cast("int"))
        folded = F.aggregate(rounds, start, lambda s, _: merge_once(s, ranks))
        parts = F.transform(pieces_of(F.ltrim(folded, F.lit("!"))), lambda p: looked_up(ranks, p))
        return let(looked_up(ranks, hexed), lambda whole: F.when(whole.isNotNull(), F.array(whole)).otherwise(parts))

    return let(F.hex(F.encode(word, "UTF-8")), encode)


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PATTERN), F.lit(0))


def encode(documents: DataFrame, text: str, ranks: dict[bytes, int], out: str = "ids", hot: int = HOT) -> DataFrame:
    """``documents`` with a column ``out``: the ids of ``text``. Other columns pass through."""
    table = slotted({piece.hex().upper(): rank for piece, rank in ranks.items()}, "int")
    counts = documents.select(F.explode(words_of(F.col(text))).alias("word")).groupBy("word").count()
    frequent = counts.where((F.octet_length("word") <= LONGEST) & (F.octet_length("word") > 0)).orderBy(F.desc("count"), "word").limit(hot)
    known = {r["word"]: r["ids"] for r in frequent.repartition(16).select("word", word_ids(F.col("word"), table).alias("ids")).collect()}
    memory = slotted(known, "array<int>")
    ids = F.flatten(F.transform(words_of(F.col(text)), lambda w: F.coalesce(looked_up(memory, w), word_ids(w, table))))
    return documents.withColumn(out, ids)


def decoded(ids: Column, ranks: dict[bytes, int]) -> Column:
    """The text of ``ids``: their binary pieces concatenated. Unknown ids give null."""
    pieces = [""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece.hex()
    table = F.from_json(F.lit(json.dumps(pieces)), "array<string>")
    hexed = F.transform(ids, lambda i: F.try_element_at(table, i + 1))
    return F.when(~F.exists(hexed, lambda h: h.isNull()), F.decode(F.unhex(F.array_join(hexed, "")), "UTF-8"))


def found_ids(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """The rows of p8_ids."""
    return encode(documents.select("doc_id", "text"), "text", read_ranks(path)).select("doc_id", "ids")
