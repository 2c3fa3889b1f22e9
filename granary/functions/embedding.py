"""Embedders: from a text column to vectors of length 1.

An embedder is any function from a text column to an ``array`` column. ``hashed_letters`` needs no model and runs in Spark
expressions; ``batch_model`` wraps a model that is loaded once per Python worker and called with batches.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.functions.similarity import l2_normalized, let

Embedder = Callable[[Column], Column]

DIMENSIONS = 128


def words(text: Column) -> Column:
    """Different words in alphabetical order: runs of letters and digits. Null gives an empty array."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))))


def triples(text: Column) -> Column:
    """Runs of three characters of the text between two blanks; null and empty texts have none."""
    padded = F.concat(F.lit(" "), F.coalesce(text, F.lit("")), F.lit(" "))
    ends = F.sequence(F.lit(1), F.greatest(F.char_length(padded) - 2, F.lit(1)))
    return F.when(F.char_length(padded) > 2, F.transform(ends, lambda k: F.substring(padded, k, F.lit(3)))).otherwise(F.array().cast("array<string>"))


def hashed_letters(text: Column, dimensions: int = DIMENSIONS) -> Column:
    """Counts of letter triples, each at the place its digest names, scaled to length 1. Empty texts give zeros."""
    places = F.transform(triples(text), lambda t: F.pmod(F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long"), F.lit(dimensions)).cast("int"))
    counts = lambda found: F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda k: F.size(F.filter(found, lambda p: p == k)).cast("double"))
    return l2_normalized(let(places, counts))


def batch_model(load: Callable[[], Callable[[list[str]], np.ndarray]], batch_size: int = 256) -> Embedder:
    """``load`` returns an encoder from texts to a matrix; its rows are scaled to length 1. Null texts count as empty."""

    def make() -> Callable[[np.ndarray], np.ndarray]:
        encode = load()

        def predict(texts: np.ndarray) -> np.ndarray:
            found = np.asarray(encode([str(t) for t in texts.ravel()]), dtype="float32")
            lengths = np.linalg.norm(found, axis=1, keepdims=True)
            return found / np.where(lengths > 0, lengths, 1)

        return predict

    run = predict_batch_udf(make, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size)
    return lambda text: run(F.coalesce(text, F.lit("")))
