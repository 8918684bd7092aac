"""Bar features across micro-batch borders.

A window sees one micro-batch only, so each symbol would lose its first rows
in every batch. Between batches we keep the bars that later ones may look back
to. With a lateness allowance we also keep the bars that a late one would
change; their features are emitted again, and the log's later version wins.
A row whose features are no longer complete, since a bar was corrected to one
without a price, is emitted as deleted.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens.operators.features import FEATURE_NAMES, ROWS_BACK, _over_segments
from marketlens.operators.segments import ROWS_PER_SEGMENT, split_large_keys
from marketlens.operators.upsert import DELETED, VersionedLog, latest_per_key

_FRESH = "__fresh"
_STATE_SLOTS = 3


def _with_horizon(bars: DataFrame, seen: DataFrame, ts: str, lateness: str) -> DataFrame:
    """Add the time from which bars of the symbol may still arrive; null for a new symbol."""
    newest = seen.groupBy("symbol").agg(F.max(ts).alias("__newest"))
    horizon = newest.select("symbol", (F.col("__newest") - F.expr(f"INTERVAL {lateness}")).alias("__horizon"))
    # one short row per symbol: adaptive execution broadcasts it by its measured size
    return bars.join(horizon, "symbol", "left")


def split_late(context: DataFrame, batch: DataFrame, ts: str, lateness: str) -> tuple[DataFrame, DataFrame]:
    """The batch's bars that can be used, and the others: too late, or without symbol or time."""
    columns = batch.columns
    dated = _with_horizon(batch, context, ts, lateness)
    usable = F.col("symbol").isNotNull() & F.col(ts).isNotNull() & (F.col(ts) >= F.coalesce("__horizon", F.col(ts)))
    usable = F.coalesce(usable, F.lit(False))
    return dated.filter(usable).select(*columns), dated.filter(~usable).select(*columns)


def merge_batch(context: DataFrame, batch: DataFrame, ts: str = "timestamp", ties: Sequence[str] = ()) -> DataFrame:
    """Context and batch, its bars marked; a bar that comes again replaces the earlier copy."""
    columns = batch.columns
    both = context.select(*columns, F.lit(False).alias(_FRESH)).unionByName(
        batch.select(*columns, F.lit(True).alias(_FRESH))
    )
    return latest_per_key(both, ["symbol", ts, *ties], [_FRESH])


def changed_features(
    merged: DataFrame, ts: str = "timestamp", ties: Sequence[str] = (), rows_per_segment: int = ROWS_PER_SEGMENT,
) -> DataFrame:
    """Features of a merged batch that it adds or changes, marked as deleted where they are incomplete."""
    columns = [c for c in merged.columns if c != _FRESH]
    seg = split_large_keys(merged, ["symbol"], [ts, *ties], rows_per_segment)
    # a bar changes its own features and those of the bars whose frame holds it
    touched = F.max(_FRESH).over(seg.window().rowsBetween(-ROWS_BACK, Window.currentRow))
    wide = _over_segments(seg, FEATURE_NAMES, ts, columns, {"__touched": touched})
    changed = wide.filter("__touched").drop("__touched")
    missing = [F.col(f.name).isNull() for f in changed.schema.fields]
    missing += [F.isnan(f.name) for f in changed.schema.fields if f.dataType.typeName() in ("double", "float")]
    # for a null, isnan is false
    return changed.withColumn(DELETED, reduce(Column.__or__, missing))


def next_context(
    merged: DataFrame, ts: str = "timestamp", ties: Sequence[str] = (), lateness: str = "0 seconds"
) -> DataFrame:
    """The bars a later batch can need: those it may precede, and ``ROWS_BACK`` before them."""
    dated = _with_horizon(merged, merged, ts, lateness)
    open_rows = dated.filter(F.col(ts) >= F.col("__horizon")).select(*merged.columns)
    newest = Window.partitionBy("symbol").orderBy(*[F.desc(c) for c in (ts, *ties)])
    before = (
        dated.filter(F.col(ts) < F.col("__horizon"))
        .withColumn("__rank", F.row_number().over(newest))
        .filter(F.col("__rank") <= ROWS_BACK)
        .select(*merged.columns)
    )
    return open_rows.unionByName(before)


@dataclass
class FeatureStream:
    """Batch handler that appends features to a log and keeps its context in files.

    ``output`` is a log that takes deletions. Bars beyond the allowance and
    bars without symbol or time go to ``late``, so none is lost. The context of a batch is written next to that of the batch before, so a
    batch that is run again finds what it started from.
    """

    spark: SparkSession
    state_path: str
    output: VersionedLog
    late: VersionedLog
    bars: T.StructType
    ts: str = "timestamp"
    ties: Sequence[str] = field(default_factory=tuple)
    lateness: str = "0 seconds"

    def _slot(self, batch_id: int) -> str:
        return f"{self.state_path}/slot={batch_id % _STATE_SLOTS}"

    def context(self, batch_id: int) -> DataFrame:
        if batch_id == 0:
            return self.spark.createDataFrame([], self.bars)
        try:
            return self.spark.read.schema(self.bars).parquet(self._slot(batch_id - 1))
        except AnalysisException as error:
            raise RuntimeError(f"no context of batch {batch_id - 1} below {self.state_path}") from error

    def __call__(self, rows: DataFrame, batch_id: int) -> None:
        context = self.context(batch_id)
        usable, aside = split_late(context, rows, self.ts, self.lateness)
        merged = merge_batch(context, usable, self.ts, self.ties).persist()
        try:
            self.output.append(changed_features(merged, self.ts, self.ties), batch_id)
            self.late.append(aside, batch_id)
            kept = next_context(merged.drop(_FRESH), self.ts, self.ties, self.lateness)
            kept.write.mode("overwrite").parquet(self._slot(batch_id))
        finally:
            merged.unpersist()
