"""Rolling-origin evaluation: folds cut by time, trained on what was known at their origin.

An example pairs the features of a bar with the price so many bars later. A
fold has an origin; it trains on the examples whose target lies before it and
is tested on those whose features begin at it or after, up to the next origin.
Examples that reach across an origin belong to neither side of that fold.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.functions import columns as C
from marketlens.operators import forecast
from marketlens.operators.features import FEATURE_NAMES, MIN_TRAINING_ROWS
from marketlens.operators.lookup import hold
from marketlens.operators.segments import (
    COPIES,
    OWN,
    ROWS_PER_SEGMENT,
    collapse_copies,
    copy_order,
    expand_copies,
    split_large_keys,
    with_preceding_rows,
)


def horizon_examples(
    table: DataFrame, horizons: Sequence[int], ts: str = "timestamp", ties: Sequence[str] = (),
    rows_per_segment: int = ROWS_PER_SEGMENT,
) -> DataFrame:
    """Each row once per horizon that its symbol's later rows reach, with ``horizon``, ``target`` and ``target_time``.

    ``target`` is the price so many rows later, which may be null. The row that
    has the price looks back to the row it belongs to, so all horizons share
    one window, and large symbols are cut like those of the features. Copies
    beyond the longest horizon see only copies.
    """
    if not horizons or min(horizons) < 1:
        raise ValueError("horizons count rows from 1")
    names, deepest = table.columns, max(horizons)
    seg, copies = split_large_keys(table, ["symbol"], [ts, *ties], rows_per_segment), []
    if seg.crowded:
        copies = [COPIES]
        few = collapse_copies(table, kept=deepest + 1)
        seg = split_large_keys(few, ["symbol"], copy_order(table, [ts, *ties]), rows_per_segment)
    w = seg.window()
    row = F.struct(*names)
    pairs = F.array(*[F.struct(F.lit(h).alias("horizon"), F.lag(row, h).over(w).alias("row")) for h in horizons])
    wide = with_preceding_rows(seg, deepest).select(
        F.col(ts).alias("target_time"), F.col("price").alias("target"), *copies, OWN, pairs.alias("__pairs"))
    found = wide.filter(OWN).select("*", F.explode("__pairs").alias("__pair")).filter(F.col("__pair.row").isNotNull())
    shown = found.select("__pair.row.*", "__pair.horizon", "target", "target_time", *copies)
    return expand_copies(shown) if copies else shown


def _micros(name: str) -> Column:
    return F.unix_micros(F.col(name).cast("timestamp"))


def fold_origins(examples: DataFrame, folds: int, ts: str = "timestamp") -> list[int]:
    """Origins in microseconds: the time from the first to the last row cut into ``folds + 1`` equal parts.

    The first part is only trained on. Empty without rows that have a time.
    """
    lo, hi = examples.agg(F.min(_micros(ts)), F.max(_micros(ts))).first()
    return [] if lo is None else [lo + (hi - lo) * k // (folds + 1) for k in range(1, folds + 1)]


def in_training(origin: int) -> Column:
    return _micros("target_time") < origin


def in_test(origins: Sequence[int], fold: int, ts: str = "timestamp") -> Column:
    """Rows from the fold's origin up to the next one; the last fold goes to the end."""
    begun = _micros(ts) >= origins[fold]
    return begun & (_micros(ts) < origins[fold + 1]) if fold + 1 < len(origins) else begun


def fold_rows(examples: DataFrame, origins: Sequence[int], ts: str = "timestamp") -> DataFrame:
    """The examples of each ``fold`` (from 0), with ``is_train``; those across the origin are left out."""
    sides = [
        F.when(in_training(o), F.struct(F.lit(k).alias("fold"), F.lit(True).alias("is_train"))).when(
            in_test(origins, k, ts), F.struct(F.lit(k).alias("fold"), F.lit(False).alias("is_train")))
        for k, o in enumerate(origins)
    ]
    if not sides:
        return examples.limit(0).select("*", F.lit(0).alias("fold"), F.lit(True).alias("is_train"))
    side = F.explode(F.array_compact(F.array(*sides))).alias("__side")
    return examples.select("*", side).select(*examples.columns, "__side.fold", "__side.is_train")


def _trained(rows: DataFrame, features: Sequence[str], trees: int, depth: int, seed: int) -> PipelineModel | None:
    usable = rows.na.drop("any", subset=["target", *features])
    if usable.limit(MIN_TRAINING_ROWS + 1).count() <= MIN_TRAINING_ROWS:
        return None
    return forecast.train_forest(usable, "target", features, trees=trees, depth=depth, seed=seed)


def rolling_forecasts(
    table: DataFrame, horizons: Sequence[int] = (1,), folds: int = 3, ts: str = "timestamp",
    ties: Sequence[str] = (), features: Sequence[str] = FEATURE_NAMES, trees: int = forecast.TREES,
    depth: int = forecast.DEPTH, seed: int = 17, at_once: int = 4,
) -> DataFrame:
    """The test examples of every fold and horizon with the ``prediction`` of the model trained before their origin.

    One model per fold and horizon, ``at_once`` of them trained side by side on
    one persisted table (until ``release_measured``). Without more than ten
    usable training examples a fold's predictions are null; a table without
    rows gives none.
    """
    examples = hold(forecast.spread_evenly(horizon_examples(table, horizons, ts, ties), ["symbol", ts, *ties]))
    origins = fold_origins(examples, folds, ts)
    cells = [(k, h) for k in range(len(origins)) for h in horizons]

    def fold(cell: tuple[int, int]) -> DataFrame:
        k, h = cell
        of_horizon = examples.filter(F.col("horizon") == h)
        model = _trained(of_horizon.filter(in_training(origins[k])), features, trees, depth, seed)
        test = of_horizon.filter(in_test(origins, k, ts)).withColumn("fold", F.lit(k))
        return forecast.score(model, test) if model else test.withColumn("prediction", F.lit(None).cast("double"))

    if not cells:
        return examples.limit(0).withColumns({"fold": F.lit(0), "prediction": F.lit(None).cast("double")})
    with ThreadPoolExecutor(at_once) as pool:
        # a target of its own for each fold, made in this thread, whose properties it takes along
        runs = [pool.submit(inheritable_thread_target(table.sparkSession)(fold), cell) for cell in cells]
        return reduce(DataFrame.unionByName, [run.result() for run in runs])


def forecast_errors(forecasts: DataFrame) -> DataFrame:
    """Per fold and horizon, the errors of the model beside those of a forecast that repeats the price known.

    Only rows with a prediction and a target count, but ``examples`` are all.
    Errors are null where no row counts.
    """
    known = F.col("prediction").isNotNull() & F.col("target").isNotNull()

    def of(guess: str) -> tuple[Column, Column]:
        off = F.when(known, F.col(guess) - F.col("target"))
        return F.avg(F.when(known, C.percent_error(guess, "target"))), F.sqrt(F.avg(off * off))

    (percent, rmse), (naive_percent, naive_rmse) = of("prediction"), of("price")
    return forecasts.groupBy("fold", "horizon").agg(
        F.count(F.lit(1)).alias("examples"), F.count_if(known).alias("scored"),
        percent.alias("error_percentage"), rmse.alias("rmse"),
        naive_percent.alias("naive_error_percentage"), naive_rmse.alias("naive_rmse"),
    )
