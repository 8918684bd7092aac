"""Serving tables laid out for their reads: bucketed, sorted, with Bloom filters.

Predictions and newest scores are bucketed by the same slot, a symbol and one
of ``parts`` parts, so that they join where they lie and a point read opens
the buckets of its symbol alone. The parts spread a symbol with very many rows.
Bucketing, pruning and filters are Spark's and Parquet's own.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.operators import serving

SLOT = "serving_slot"
#: Rows that a bucket is to have, and the share of them that a part of a symbol may have.
ROWS_PER_BUCKET = 1_000_000
_PART_SHARE = 0.25


def _slot(symbol: str, part: Column) -> Column:
    return F.concat(F.col(symbol), F.lit("#"), part.cast("string"))


def sizes(
    predictions: DataFrame, buckets: int = 1, parts: int = 1, rows_per_bucket: int = ROWS_PER_BUCKET,
) -> tuple[int, int]:
    """Buckets for the rows and parts for the largest symbol, no fewer than those given; one count per symbol."""
    counts = predictions.groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"))
    # rows without a symbol have one slot that no part spreads, as they are never read by it
    total, largest = counts.agg(F.sum("rows"), F.max(F.when(F.col("symbol").isNotNull(), F.col("rows")))).first()
    return (max(buckets, math.ceil((total or 0) / rows_per_bucket)),
            max(parts, math.ceil((largest or 0) / (rows_per_bucket * _PART_SHARE))))


def store_bucketed(
    df: DataFrame, name: str, path: str, key: str, buckets: int, sort_by: Sequence[str] = (),
    bloom: dict[str, int] | None = None,
) -> None:
    """Write a table of one sorted file per bucket; ``bloom`` are columns with a filter, and the values one file may have of them."""
    writer = df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key, *sort_by).option("path", path)
    for column, values in (bloom or {}).items():
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true").option(
            f"parquet.bloom.filter.expected.ndv#{column}", str(values))
    writer.mode("overwrite").format("parquet").saveAsTable(name)


@dataclass(frozen=True)
class ServingLayout:
    """The two tables below ``path``, in the session's catalog under names that begin with ``name``.

    ``buckets`` is to grow with the data (some hundred MB a bucket), ``parts``
    with the rows of the largest symbol: it is cut into so many (:func:`sizes`).
    """

    spark: SparkSession
    path: str
    name: str
    buckets: int
    parts: int = 1

    def write_predictions(
        self, predictions: DataFrame, ts: str = "timestamp", ties: Sequence[str] = (), bloom: dict[str, int] | None = None,
    ) -> None:
        """Rows without a symbol have no slot and stay."""
        part = F.pmod(F.xxhash64(ts, *ties), F.lit(self.parts))
        slotted = predictions.withColumn(SLOT, _slot("symbol", part))
        store_bucketed(slotted, f"{self.name}_predictions", f"{self.path}/predictions", SLOT, self.buckets, [ts, *ties], bloom)

    def write_sentiment(
        self, news: DataFrame, ts: str = "timestamp", ties: Sequence[str] = (), score: str = "overall_sentiment",
    ) -> None:
        """The newest score of every company, once for each part."""
        parts = F.explode(F.sequence(F.lit(0), F.lit(self.parts - 1)))
        newest = serving.latest_sentiment(news.filter(F.col("company").isNotNull()), ts, ties, score)
        slotted = newest.select("company", "sentiment", parts.alias("part")).select(
            _slot("company", F.col("part")).alias(SLOT), "sentiment")
        store_bucketed(slotted, f"{self.name}_sentiment", f"{self.path}/sentiment", SLOT, self.buckets)

    def predictions(self) -> DataFrame:
        return self.spark.table(f"{self.name}_predictions").drop(SLOT)

    def predictions_of(self, symbol: str) -> DataFrame:
        """A symbol's predictions, from the buckets of its parts."""
        return self._of(symbol).drop(SLOT)

    def _of(self, symbol: str) -> DataFrame:
        slots = [f"{symbol}#{part}" for part in range(self.parts)]
        return self.spark.table(f"{self.name}_predictions").filter(F.col(SLOT).isin(slots) & (F.col("symbol") == symbol))

    def _joined(self, predictions: DataFrame) -> DataFrame:
        scores = self.spark.table(f"{self.name}_sentiment").hint("merge")
        return serving.or_zero(predictions.join(scores, SLOT, "left"), predictions)

    def joined(self) -> DataFrame:
        """Predictions with the newest score, 0 for a company without news; no rows are exchanged."""
        return self._joined(self.spark.table(f"{self.name}_predictions")).drop(SLOT)

    def joined_of(self, symbol: str) -> DataFrame:
        return self._joined(self._of(symbol)).drop(SLOT)

    def drop(self) -> None:
        """Take the tables out of the catalog; the files stay."""
        for table in ("predictions", "sentiment"):
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{table}")
