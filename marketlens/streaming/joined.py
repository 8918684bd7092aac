"""A serving table that two streams write: predictions with the sentiment of the time before them.

:class:`LateSplit` stages a stream: rows behind its watermark go to a log, the
others to files that a second query reads. :func:`serve` joins two staged
streams; the same function over tables gives the batch result.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens.operators.upsert import VersionedLog

_SLOTS = 3
#: Time slots that an interval of :func:`serve` has; each takes the newest article of those before it.
_STEPS = 24
_DAY = 86_400_000_000


@dataclass
class LateSplit:
    """Batch handler that stages rows in time below ``path`` and sets rows behind the watermark aside in ``late``.

    A row is late if its time lies more than ``delay`` before the latest time
    of earlier batches, or is null; rows of one batch are never late to each
    other. A batch is written to a hidden folder and renamed once it is whole,
    so a reader of :meth:`staged` never sees a part of one; a batch that runs
    again has the same rows, and its folder stays as it is. The latest time per
    batch is kept in a few slots, so a batch that runs again finds what it
    started from.
    """

    spark: SparkSession
    path: str
    late: VersionedLog
    ts: str = "timestamp"
    delay: str = "1 day"

    def __call__(self, rows: DataFrame, batch_id: int) -> None:
        seen = self._latest(batch_id - 1)
        border = seen.agg((F.max("latest") - F.expr(f"INTERVAL {self.delay}")).alias("t")).scalar()
        in_time = F.coalesce(F.col(self.ts) >= F.coalesce(border, F.col(self.ts)), F.lit(False))
        self.late.append(rows.filter(~in_time), batch_id)
        self._stage(rows.filter(in_time), batch_id)
        newest = rows.agg(F.max(self.ts).cast("timestamp").alias("latest")).unionByName(seen).agg(F.max("latest").alias("latest"))
        newest.coalesce(1).write.mode("overwrite").parquet(self._slot(batch_id))

    def _slot(self, batch_id: int) -> str:
        return f"{self.path}/state/slot={batch_id % _SLOTS}"

    def _latest(self, batch_id: int) -> DataFrame:
        if batch_id < 0:
            return self.spark.createDataFrame([], "latest timestamp")
        try:
            return self.spark.read.schema("latest timestamp").parquet(self._slot(batch_id))
        except AnalysisException as error:
            raise RuntimeError(f"no time of batch {batch_id} below {self.path}") from error

    def _stage(self, rows: DataFrame, batch_id: int) -> None:
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        done, hidden = place(f"{self.path}/rows/batch={batch_id}"), place(f"{self.path}/rows/_batch={batch_id}")
        fs = done.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if fs.exists(done):
            return
        rows.write.mode("overwrite").parquet(hidden.toString())
        if not fs.rename(hidden, done):
            raise RuntimeError(f"batch {batch_id} could not be put in place below {self.path}")

    def staged(self, schema: T.StructType) -> DataFrame:
        """The staged rows as a stream, in the order of their batches."""
        return self.spark.readStream.schema(schema).parquet(f"{self.path}/rows/batch=*")


def _micros(spark: SparkSession, interval: str) -> int:
    """The most microseconds that an interval can have; a day more allows for clock changes and leap years."""
    start = "TIMESTAMP '1970-07-01 00:00:00'"
    whole = spark.sql(f"SELECT unix_micros({start} + INTERVAL {interval}) - unix_micros({start}) AS n").first().n
    return whole + max(min(whole, _DAY), 0)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _at_or_before(moments: pd.Series, times: pd.Series) -> pd.Series:
    """For each moment, how many of the ascending times are not after it."""
    return pd.Series([np.searchsorted(t, m, side="right").astype("int32") for m, t in zip(moments, times)])


def serve(
    predictions: DataFrame, articles: DataFrame, interval: str, delay: str | None = None, ts: str = "timestamp",
    news_ts: str = "published_at", news_ties: Sequence[str] = (), score: str = "overall_sentiment", spread: int = 1,
) -> DataFrame:
    """Predictions with ``sentiment``, the newest score of their company in the ``interval`` up to their time, else null.

    Over streams, ``delay`` is the watermark of both. A prediction is emitted
    once, when no article can come any more that belongs before it, and state
    older than the interval is dropped; what is still open stays in the state.
    Over tables there is no delay and every prediction is in the result.

    Time is cut into slots, of which the interval has ``_STEPS``. A slot's
    articles meet the predictions of the slot alone, and only its newest one
    goes on to the slots that the interval reaches, so the work grows with the
    rows, not with the pairs of a prediction and the articles before it.

    An article counts for the bars of its own time. Predictions without a
    symbol or company take null; over streams, rows without a time belong in a
    log (:class:`LateSplit`). Predictions that agree in all columns are one
    row. ``spread`` deals the predictions of a symbol and slot to so many
    parts, each with a copy of the articles, for symbols that are too much for
    one task.
    """
    names, spark = predictions.columns, predictions.sparkSession
    width = max(-(-_micros(spark, interval) // (1000 * _STEPS)), 1) * 1000
    wide, steps = F.lit(width).cast("long"), F.sequence(F.lit(0), F.lit(_STEPS))

    def slot(at: str) -> Column:  # its end; the watermark is of slots, so it lies one more behind
        moment = F.unix_micros(F.col(at).cast("timestamp"))
        return F.timestamp_micros(moment - F.pmod(moment, wide) + wide)

    def slotted(rows: DataFrame, at: str) -> DataFrame:
        rows = rows.withColumn("__slot", slot(at))
        if delay is None:
            return rows
        late = spark.sql(f"SELECT unix_micros(TIMESTAMP '1970-07-01' + INTERVAL {delay}) - unix_micros(TIMESTAMP '1970-07-01') AS n").first().n
        return rows.withWatermark("__slot", f"{late + width} microseconds")

    # what meets no article is not brought together
    alone = F.xxhash64(*names)
    part = F.when(F.col("symbol").isNull() | F.col(ts).isNull(), alone).otherwise(F.pmod(alone, F.lit(spread)))
    # as grouping does, one zero for both
    shown = [(F.col(f.name) + F.lit(0).cast(f.dataType)).alias(f.name) if isinstance(f.dataType, T.FractionalType) else F.col(f.name)
             for f in predictions.schema]
    left = slotted(predictions, ts).select(F.col("symbol").alias("__symbol"), part.alias("__part"), "__slot", F.struct(*shown).alias("__bar"))

    ties = [F.col(t).alias(f"tie{i}") for i, t in enumerate(news_ties)]
    told = F.struct(F.unix_micros(F.col(news_ts).cast("timestamp")).alias("us"), F.col(news_ts).alias("at"), *ties, F.col(score).cast("double").alias("score"))
    known = slotted(articles.filter(F.col("company").isNotNull() & F.col(news_ts).isNotNull()), news_ts)
    known = known.groupBy("company", "__slot").agg(F.array_sort(F.collect_list(told)).alias("__own"))
    right = known.withColumn("__step", F.explode(steps)).select(
        F.col("company").alias("__symbol"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(spread - 1).cast("long"))).alias("__part"),
        F.timestamp_micros(F.unix_micros("__slot") + F.col("__step") * wide).alias("__slot"),
        F.when(F.col("__step") == 0, F.col("__own")).alias("__own"), F.when(F.col("__step") > 0, F.element_at("__own", -1)).alias("__before"))

    met = left.unionByName(right, allowMissingColumns=True).groupBy("__symbol", "__part", "__slot").agg(
        F.collect_set("__bar").alias("__bars"), F.first("__own", ignorenulls=True).alias("__own"), F.max("__before").alias("__before"))
    moments = F.transform("__bars", lambda b: F.unix_micros(b[ts].cast("timestamp")))
    times = F.coalesce(F.col("__own")["us"], F.array().cast("array<bigint>"))
    found = met.filter(F.size("__bars") > 0).withColumn("__upto", _at_or_before(moments, times))
    newest = lambda n: F.when(n > 0, F.get("__own", n - 1)).otherwise(F.col("__before"))
    paired = F.transform(F.arrays_zip(F.col("__bars").alias("bar"), F.col("__upto").alias("upto")),
                         lambda x: F.struct(x["bar"].alias("bar"), newest(x["upto"]).alias("newest")))
    each = found.select(F.explode(paired).alias("__met"))
    at, bar_at = F.col("__met.newest.at"), F.col(f"__met.bar.{ts}")
    near = (at <= bar_at) & (at > bar_at - F.expr(f"INTERVAL {interval}"))
    return each.select("__met.bar.*", F.when(near, F.col("__met.newest.score")).alias("sentiment"))
