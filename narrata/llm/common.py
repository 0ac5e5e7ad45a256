"""Helpers that the training-data operators share: words, shingles, lineage cuts and size-checked broadcasts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from narrata.operators.lineage import settle, shared_folder  # noqa: F401

#: A word for the counting contracts: anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: A word after lower-casing: digits, small letters and all that is not ASCII.
PLAIN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A table of at most this many narrow rows may be broadcast; its rows are counted first.
BROADCAST_ROWS = 200_000
#: Words in a shingle and least similarity of near duplicates.
SHINGLE, NEAR = 5, 0.8
#: Columns of the documents table, which pipeline stages hand on.
DOCUMENT = ["doc_id", "text", "lang", "source", "n_chars"]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind an array or struct expression once inside a larger expression, so that lambdas do not repeat it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """White-space words of a text; a null text has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def plain_words(text: Column) -> Column:
    """Lower-cased words of letters, digits and non-ASCII characters; a null text has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(PLAIN), F.lit(0))


def shingles(found: Column, n: int = SHINGLE) -> Column:
    """64-bit hashes of the n-word shingles of an array of words, in text order; empty if there are fewer words."""
    grams = lambda w: F.when(
        F.size(w) >= n,
        F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.xxhash64(*[F.element_at(w, i + k) for k in range(n)])),
    ).otherwise(F.array().cast("array<bigint>"))
    return let(found, grams)


def small(frame: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """The settled frame, marked for broadcast only if it has at most `limit` rows; else Spark joins it by shuffle."""
    held = settle(frame)
    return F.broadcast(held) if held.count() <= limit else held


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder, local or on any store that Spark reads."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
