"""Helpers that several corpus operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.session import shared_path

#: White space between words: blank and the controls 9 to 13.
SPACE = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written as Parquet below the shared folder and read again: lineage ends here."""
    path = shared_path(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def space_words(text: Column) -> Column:
    """The words of a text between white space; none for a null text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def rolling_hashes(words: Column, k: int) -> Column:
    """A 64-bit hash of every window of ``k`` words, in order.

    Windows are put together from windows of half the size, so the work per
    word is about ``2 log2 k`` hashes and not ``k``.
    """
    def step(hashes: Column, by: int) -> Column:
        return let(hashes, lambda h: F.zip_with(
            h, F.slice(h, F.lit(by + 1), F.size(h)), lambda a, b: F.xxhash64(a, b)))

    first = F.transform(words, lambda w: F.xxhash64(w))
    if k == 1:
        return first
    size, hashes = 1, first
    while size < k:
        by = min(size, k - size)
        hashes, size = step(hashes, by), size + by
    return F.slice(hashes, F.lit(1), F.greatest(F.size(words) - F.lit(k - 1), F.lit(0)))
