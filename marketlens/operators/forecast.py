"""Random-forest price model: split, train, score, error statistics."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.functions import columns as C
from marketlens.operators.features import FEATURE_NAMES, has_enough_rows
from marketlens.operators.lookup import hold
from marketlens.operators.segments import ROWS_PER_SEGMENT, number_rows

# Model size and share of training rows.
TREES, DEPTH = 50, 10
TRAIN_SHARE = 0.8
_HASH_PARTS = 1000
#: Rows of a partition that a training reads.
ROWS_PER_PART = 500_000


def split_by_time(
    df: DataFrame, ts: str = "timestamp", ties: Sequence[str] = (), share: float = TRAIN_SHARE,
    rows_per_segment: int = ROWS_PER_SEGMENT,
) -> DataFrame:
    """Mark the first ``share`` of each symbol's rows as ``is_train``."""
    numbered = number_rows(df, ["symbol"], [ts, *ties], "__rank", "__size", rows_per_segment)
    return numbered.withColumn("is_train", F.col("__rank") <= F.col("__size") * share).drop(
        "__rank", "__size"
    )


def split_by_hash(df: DataFrame, key: Sequence[str], share: float = TRAIN_SHARE) -> DataFrame:
    """Mark about ``share`` of the rows as ``is_train``; a key always falls on the same side."""
    part = F.pmod(F.xxhash64(*key), F.lit(_HASH_PARTS))
    return df.withColumn("is_train", part < int(share * _HASH_PARTS))


def spread_evenly(df: DataFrame, key: Sequence[str], rows: int | None = None) -> DataFrame:
    """The rows over all cores, by hash of the key; ``rows`` is their number, if it is known.

    A feature table comes out of a shuffle by symbol, which leaves few
    partitions; each of the many passes of a training would run on these. On
    more than the rows need, each partition would send statistics of all nodes.
    """
    rows = df.count() if rows is None else rows
    parts = max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(rows / ROWS_PER_PART))
    return df.repartition(parts, *key)


def train_forest(
    train: DataFrame, label: str = "price", features: Sequence[str] = FEATURE_NAMES,
    trees: int = TREES, depth: int = DEPTH, seed: int = 17,
) -> PipelineModel:
    assemble = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip")
    # the node of a row in each tree is kept from level to level, else every level walks all trees from their roots
    forest = RandomForestRegressor(
        featuresCol="features", labelCol=label, numTrees=trees, maxDepth=depth, seed=seed, cacheNodeIds=True,
        checkpointInterval=-1,
    )
    # the last bar of a symbol has no next price
    return Pipeline(stages=[assemble, forest]).fit(train.filter(F.col(label).isNotNull()))


def score(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """The rows with ``prediction``; null, and no row left out, where a feature is null or NaN."""
    assemble, *rest = model.stages
    names = assemble.getInputCols()
    scored = assemble.copy().setHandleInvalid("keep").transform(rows)
    for stage in rest:
        scored = stage.transform(scored)
    complete = reduce(Column.__and__, [F.col(n).isNotNull() & ~F.isnan(F.col(n).cast("double")) for n in names])
    return scored.withColumn("prediction", F.when(complete, F.col("prediction"))).drop("features")


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def with_percent_error(scored: DataFrame) -> DataFrame:
    return scored.withColumn("prediction_error", C.percent_error("prediction", "price"))


def error_statistics(scored: DataFrame, per_symbol: bool = False) -> DataFrame:
    """Mean, largest and smallest percent error.

    ``per_symbol`` adds a row per symbol to the row over all (null symbol),
    from the same pass.
    """
    known = with_percent_error(scored)
    groups = known.rollup("symbol") if per_symbol else known.groupBy()
    return groups.agg(
        F.avg("prediction_error").alias("mean_error_percentage"),
        F.max("prediction_error").alias("max_error_percentage"),
        F.min("prediction_error").alias("min_error_percentage"),
    )


def rmse(scored: DataFrame) -> DataFrame:
    """Root mean squared error, null without rows."""
    return scored.agg(F.sqrt(F.avg(F.pow(F.col("prediction") - F.col("price"), F.lit(2)))).alias("rmse"))


def latest_predictions(
    scored: DataFrame, count: int = 5, ts: str = "timestamp", ties: Sequence[str] = ("symbol",)
) -> DataFrame:
    """The ``count`` newest predictions."""
    return (
        scored.orderBy(F.desc(ts), *ties)
        .select(ts, "symbol", "price", "prediction", *[t for t in ties if t != "symbol"])
        .limit(count)
    )


def train_on_early(
    features: DataFrame, ts: str = "timestamp", ties: Sequence[str] = (), label: str = "price",
    trees: int = TREES, depth: int = DEPTH, seed: int = 17,
) -> tuple[PipelineModel, DataFrame] | None:
    """A model of the early rows of a feature table, and all its rows with ``is_train``.

    None when the table does not pass the training gate. The training reads
    its rows several times and others are read later, so they stay persisted
    until ``release_measured``.
    """
    if not has_enough_rows(features):
        return None
    marked = hold(spread_evenly(split_by_time(features, ts, ties), ["symbol", ts, *ties], features.count()))
    return train_forest(marked.filter("is_train"), label, trees=trees, depth=depth, seed=seed), marked


def train_and_score(
    features: DataFrame, ts: str = "timestamp", ties: Sequence[str] = (), label: str = "price",
    trees: int = TREES, depth: int = DEPTH, seed: int = 17,
) -> DataFrame | None:
    """Train on the early rows of a feature table and score the rest.

    As :func:`train_on_early`; only the held-out rows come back.
    """
    trained = train_on_early(features, ts, ties, label, trees, depth, seed)
    if trained is None:
        return None
    model, marked = trained
    return score(model, marked.filter("NOT is_train")).drop("is_train")
