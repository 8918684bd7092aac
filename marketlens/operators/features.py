"""Time-series features of bars: lags, differences, calendar parts, rolling means."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from marketlens.operators.segments import (
    COPIES,
    OWN,
    ROWS_PER_SEGMENT,
    SEGMENT,
    Segmented,
    collapse_copies,
    copy_order,
    expand_copies,
    split_large_keys,
    with_preceding_rows,
)

# The rolling frame is the row and the five before it, partial
# at the start; the names are the model's input columns.
ROWS_BACK = 5
MIN_TRAINING_ROWS = 10
FEATURE_NAMES = (
    "price_lag1",
    "price_lag2",
    "price_lag3",
    "volume_lag1",
    "price_change",
    "volume_change",
    "hour",
    "day",
    "day_of_week",
    "rolling_mean_price",
    "rolling_mean_volume",
)


def _feature(name: str, ts: str, w: WindowSpec) -> Column:
    recent = w.rowsBetween(-ROWS_BACK, Window.currentRow)
    build: dict[str, Callable[[], Column]] = {
        "price_lag1": lambda: F.lag("price", 1).over(w),
        "price_lag2": lambda: F.lag("price", 2).over(w),
        "price_lag3": lambda: F.lag("price", 3).over(w),
        "volume_lag1": lambda: F.lag("volume", 1).over(w),
        "price_change": lambda: F.col("price") - F.lag("price", 1).over(w),
        "volume_change": lambda: F.col("volume") - F.lag("volume", 1).over(w),
        "hour": lambda: F.hour(ts),
        "day": lambda: F.dayofmonth(ts),
        "day_of_week": lambda: F.dayofweek(ts),
        "rolling_mean_price": lambda: F.avg("price").over(recent),
        "rolling_mean_volume": lambda: F.avg("volume").over(recent),
    }
    return build[name]().alias(name)


def add_features(
    bars: DataFrame,
    names: Sequence[str] = FEATURE_NAMES,
    ts: str = "timestamp",
    ties: Sequence[str] = (),
    rows_per_segment: int = ROWS_PER_SEGMENT,
) -> DataFrame:
    """Add the named features, computed per symbol in time order.

    ``ties`` are further order columns for bars of one symbol at one time.
    All features share one window, so one exchange and one sort.
    """
    seg = split_large_keys(bars, ["symbol"], [ts, *ties], rows_per_segment)
    if not seg.crowded:
        return _over_segments(seg, names, ts, bars.columns)
    # copies after the sixth see only copies, so they have the sixth one's features
    few = collapse_copies(bars, kept=ROWS_BACK + 1)
    seg = split_large_keys(few, ["symbol"], copy_order(bars, [ts, *ties]), rows_per_segment)
    return expand_copies(_over_segments(seg, names, ts, few.columns))


def _over_segments(
    seg: Segmented, names: Sequence[str], ts: str, keep: Sequence[str], extra: dict[str, Column] | None = None
) -> DataFrame:
    """Features, and ``extra`` columns over the same frame, of the rows of each segment."""
    extended = with_preceding_rows(seg, ROWS_BACK)
    w = seg.window()
    further = [c.alias(n) for n, c in (extra or {}).items()]
    wide = extended.select(*keep, SEGMENT, OWN, *[_feature(n, ts, w) for n in names], *further)
    return wide.filter(OWN).drop(SEGMENT, OWN)


def drop_incomplete(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with a null or NaN in any column."""
    return df.na.drop("any", subset=list(subset) if subset else None)


def feature_table(
    bars: DataFrame,
    ts: str = "timestamp",
    ties: Sequence[str] = (),
    rows_per_segment: int = ROWS_PER_SEGMENT,
) -> DataFrame:
    """The model's input: all features, rows with any missing value dropped.

    Rows are dropped after all features are known, so a symbol loses its first
    three rows, and a bar with a missing price costs the bars that look back
    to it as well.
    """
    named = bars.filter(F.col("symbol").isNotNull())  # would be dropped at the end in any case
    return drop_incomplete(add_features(named, FEATURE_NAMES, ts, ties, rows_per_segment))


def next_price_label(
    bars: DataFrame, ts: str = "timestamp", ties: Sequence[str] = (), name: str = "next_price",
    rows_per_segment: int = ROWS_PER_SEGMENT,
) -> DataFrame:
    """Add the following price of the symbol, null on its last bar.

    The features contain the price itself (``price_lag1 + price_change``), so
    a model of ``price`` only repeats its input. This label is for forecasts.
    """
    columns = bars.columns
    seg = split_large_keys(bars, ["symbol"], [ts, *ties], rows_per_segment)
    if seg.crowded:
        # all copies but the last are followed by a copy
        bars = collapse_copies(bars, kept=2, rest_on_first=True)
        order = copy_order(bars.select(*columns), [ts, *ties])
        seg = split_large_keys(bars, ["symbol"], order, rows_per_segment)
    labelled = _with_next_price(seg, bars.columns, name)
    return expand_copies(labelled) if COPIES in bars.columns else labelled


def _with_next_price(seg: Segmented, keep: Sequence[str], name: str) -> DataFrame:
    within = F.lead("price", 1).over(seg.window())
    if not seg.split:
        return seg.frame.withColumn(name, within).drop(SEGMENT)
    # the last row of a segment looks at the first price of the next one
    starts = (
        seg.frame.filter(F.col(SEGMENT) > 0)
        .groupBy("symbol", SEGMENT)
        .agg(
            F.min(F.struct(*seg.order)).alias("__start"),
            F.min_by(F.struct("price"), F.struct(*seg.order)).alias("__first"),
        )
    )
    after = Window.partitionBy("symbol").orderBy("__start")
    nexts = starts.select(
        F.col(SEGMENT).alias("__of"), F.lead("__first", 1).over(after)["price"].alias("__next")
    )
    last = F.lead(F.lit(1), 1).over(seg.window()).isNull()
    # one row per segment of a split key, bounded by the number of segments
    return (
        seg.frame.withColumn("__within", within)
        .withColumn("__is_last", last)
        .join(F.broadcast(nexts), F.col(SEGMENT) == F.col("__of"), "left")
        .select(*keep, F.when(F.col("__is_last"), F.col("__next")).otherwise(F.col("__within")).alias(name))
    )


def symbols_with_enough_rows(df: DataFrame, more_than: int = MIN_TRAINING_ROWS) -> DataFrame:
    """Keys of the symbols with more than ``more_than`` rows."""
    return df.groupBy("symbol").agg(F.count(F.lit(1)).alias("symbol_rows")).filter(
        F.col("symbol_rows") > more_than
    )


def has_enough_rows(df: DataFrame, more_than: int = MIN_TRAINING_ROWS) -> bool:
    """Whether the frame as a whole passes the training gate; reads no more rows than needed."""
    return df.limit(more_than + 1).count() > more_than
