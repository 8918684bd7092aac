"""Time windows and de-duplication; the same functions serve batch and stream."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens.operators.upsert import VersionedLog

_STATE_SLOTS = 3


def _place(ts: str, ties: Sequence[str]) -> Column:
    return F.struct(ts, *ties) if ties else F.col(ts)


def ohlc_bars(
    bars: DataFrame, width: str = "1 hour", ts: str = "timestamp", ties: Sequence[str] = (),
    slide: str | None = None,
) -> DataFrame:
    """Open, high, low, close and volume per symbol and window.

    On a stream, set a watermark on ``ts`` first; bars behind it are left out,
    :func:`ohlc_parts` takes them in. Map tasks combine their rows per window,
    so a busy symbol adds little to the shuffle.
    """
    at = _place(ts, ties)
    span = F.window(ts, width, slide) if slide else F.window(ts, width)
    rolled = bars.groupBy(span.alias("w"), "symbol").agg(
        F.min_by("price", at).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", at).alias("close"),
        F.sum("volume").alias("volume"),
        F.count(F.lit(1)).alias("ticks"),
    )
    return _flat(rolled, ["symbol"], ["open", "high", "low", "close", "volume", "ticks"])


#: Windows of one batch: opening and closing prices with their places, which merge with those of other batches.
PARTS = T.StructType(
    [
        T.StructField("window_start", T.TimestampType()),
        T.StructField("window_end", T.TimestampType()),
        T.StructField("symbol", T.StringType()),
        *[T.StructField(n, T.TimestampType()) for n in ("open_at", "close_at")],
        *[T.StructField(n, T.DoubleType()) for n in ("open", "high", "low", "close", "volume")],
        T.StructField("ticks", T.LongType()),
    ]
)


def ohlc_parts(bars: DataFrame, width: str = "1 hour", ts: str = "timestamp") -> DataFrame:
    """What a batch of bars adds to the windows, in the shape of :data:`PARTS`.

    Batches are put together by :func:`merged_ohlc`, so a bar counts however
    late it comes. Bars without a time are in no window, here as in
    :func:`ohlc_bars`. Of bars at one time, the lower price opens and the
    higher one closes.
    """
    at = F.struct(ts, "price")
    rolled = bars.groupBy(F.window(ts, width).alias("w"), "symbol").agg(
        F.min(at).alias("__open"), F.max(at).alias("__close"),
        F.max("price").alias("high"), F.min("price").alias("low"), F.sum("volume").alias("volume"),
        F.count(F.lit(1)).alias("ticks"),
    )
    return rolled.select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "symbol",
        F.col(f"__open.{ts}").alias("open_at"), F.col(f"__close.{ts}").alias("close_at"),
        F.col("__open.price").alias("open"), "high", "low", F.col("__close.price").alias("close"), "volume", "ticks",
    )


def merged_ohlc(log: VersionedLog, spark: SparkSession) -> DataFrame:
    """The windows over all batches of a log of :func:`ohlc_parts`."""
    opened, closed = F.struct("open_at", "open"), F.struct("close_at", "close")
    return log.versions(spark).groupBy("window_start", "window_end", "symbol").agg(
        F.min(opened)["open"].alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max(closed)["close"].alias("close"), F.sum("volume").alias("volume"), F.sum("ticks").alias("ticks"),
    )


@dataclass
class RepeatFilter:
    """Batch handler that writes the first copy of each key to ``output`` and sets late rows aside in ``late``.

    Keys are remembered for ``delay`` behind the latest time of earlier
    batches. A row behind that, of which nobody can say whether it is a copy,
    goes to ``late`` as it is, and so does a row without a time; none is lost.
    Copies within a batch are reduced in the map tasks, to the least row by the
    other columns. Null key values are equal. The remembered keys of a batch
    are written beside those of the batch before, so a batch that is run again
    finds what it started from.
    """

    spark: SparkSession
    state_path: str
    output: VersionedLog
    late: VersionedLog
    keys: Sequence[str] = ("symbol", "timestamp")
    ts: str = "timestamp"
    delay: str = "1 hour"

    def _seen(self, rows: DataFrame, batch_id: int) -> DataFrame:
        known = T.StructType([rows.schema[c] for c in dict.fromkeys([*self.keys, self.ts])])
        if batch_id == 0:
            return self.spark.createDataFrame([], known)
        path = f"{self.state_path}/slot={(batch_id - 1) % _STATE_SLOTS}"
        try:
            return self.spark.read.schema(known).parquet(path)
        except AnalysisException as error:
            raise RuntimeError(f"no keys of batch {batch_id - 1} below {self.state_path}") from error

    def _border(self, seen: DataFrame) -> Column:
        """The latest time less the delay, as a scalar; null where nothing was seen."""
        return seen.agg((F.max(self.ts) - F.expr(f"INTERVAL {self.delay}")).alias("t")).scalar()

    def __call__(self, rows: DataFrame, batch_id: int) -> None:
        seen = self._seen(rows, batch_id)
        usable = F.coalesce(F.col(self.ts) >= F.coalesce(self._border(seen), F.col(self.ts)), F.lit(False))
        rest = [c for c in rows.columns if c not in self.keys]
        in_time = rows.filter(usable)
        least = F.min(F.struct(*rest)).alias("__row") if rest else None
        first = in_time.groupBy(*self.keys).agg(least).select(*self.keys, "__row.*") if rest else in_time.distinct()
        before = seen.select(*[F.col(k).alias(f"__seen{i}") for i, k in enumerate(self.keys)])
        same = [F.col(k).eqNullSafe(F.col(f"__seen{i}")) for i, k in enumerate(self.keys)]
        fresh = first.join(before, same, "left_anti").select(*rows.columns).persist()
        try:
            self.output.append(fresh, batch_id)
            self.late.append(rows.filter(~usable), batch_id)
            known = seen.unionByName(fresh.select(*seen.columns))
            kept = known.filter(F.col(self.ts) >= self._border(known))
            kept.write.mode("overwrite").parquet(f"{self.state_path}/slot={batch_id % _STATE_SLOTS}")
        finally:
            fresh.unpersist()


def sentiment_windows(
    scored: DataFrame, width: str = "1 hour", ts: str = "published_at", slide: str | None = None
) -> DataFrame:
    """Mean score and article count per company and window."""
    span = F.window(ts, width, slide) if slide else F.window(ts, width)
    rolled = scored.groupBy(span.alias("w"), "company").agg(
        F.avg("overall_sentiment").alias("avg_sentiment"), F.count(F.lit(1)).alias("article_count")
    )
    return _flat(rolled, ["company"], ["avg_sentiment", "article_count"])


def _flat(rolled: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    return rolled.select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, *values
    )


def drop_repeats(
    stream: DataFrame, keys: Sequence[str] = ("symbol", "timestamp"), ts: str = "timestamp",
    delay: str = "1 hour", spread: Column | None = None,
) -> DataFrame:
    """First copy of each key within the watermark delay.

    Rows behind the watermark are left out; :class:`RepeatFilter` sets them aside.

    ``spread`` names something that differs between copies, such as the offset
    of a message. Copies are then first reduced per (key, spread), so that a
    key with very many copies is not the work of one task.
    """
    marked = stream.withWatermark(ts, delay)
    if spread is None:
        return marked.dropDuplicatesWithinWatermark(list(keys))
    thinned = marked.withColumn("__spread", spread).dropDuplicatesWithinWatermark([*keys, "__spread"])
    return thinned.drop("__spread").dropDuplicatesWithinWatermark(list(keys))
