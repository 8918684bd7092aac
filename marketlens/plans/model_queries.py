"""Random forest over the whole feature table.

SQL cannot predict, but it knows which rows are held out, and what holds for a
mean of training prices: it lies between the least and the greatest of them.
The predictions themselves are in ``forest_predictions``, which has no twin.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlens.operators import evaluate, features, forecast, upsert
from marketlens.operators.lookup import hold
from marketlens.plans.catalog import query
from marketlens.plans.tick_queries import COMPLETE, FEATURES_SQL, TIES, rounded
from marketlens.plans.views import TICKS, ticks
from marketlens.session import shared_path
from marketlens.streaming import jobs


_SPLIT_SQL = f"""WITH {TICKS}, {FEATURES_SQL}, complete AS (SELECT * FROM features WHERE {COMPLETE}),
r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY "timestamp", event_id) AS rn,
             count(*) OVER (PARTITION BY symbol) AS n FROM complete),
held AS (SELECT * FROM r WHERE rn > n * 0.8::DOUBLE AND (SELECT count(*) FROM complete) > 10)"""
_SLACK = 1e-9


def held_out(spark, sf_dir):
    return _scored_with_range(spark, sf_dir)[0]


def _scored_with_range(spark, sf_dir):
    """The scored held-out rows, and the least and greatest price of the training rows as one struct."""
    table = hold(features.feature_table(ticks(spark, sf_dir), ties=TIES))
    model, marked = forecast.train_on_early(table, ties=TIES)
    scored = forecast.score(model, marked.filter("NOT is_train")).drop("is_train")
    return scored, marked.filter("is_train").agg(F.struct(F.min("price").alias("lo"), F.max("price").alias("hi"))).scalar()


def _shown(scored, bounds, slack, *names):
    p = F.col("prediction")
    return scored.select(
        *names,
        p.isNotNull().alias("predicted"),
        p.between(bounds["lo"] - slack, bounds["hi"] + slack).alias("in_range"),
    )


@query(
    "train_forest",
    f"SELECT CAST(i AS INTEGER) AS tree, true AS odd, true AS depth_kept, true AS grown FROM range({forecast.TREES}) AS t(i)",
)
def train_forest(spark, sf_dir):
    """The trained model's trees: a binary tree has an odd number of nodes, and is no deeper than asked for."""
    table = hold(features.feature_table(ticks(spark, sf_dir), ties=TIES))
    marked = forecast.split_by_time(table, ties=TIES)
    train = hold(forecast.spread_evenly(marked.filter("is_train"), ["symbol", "timestamp", *TIES], table.count()))
    model = forecast.train_forest(train)
    path = shared_path(spark, "model")
    forecast.save_model(model, path)
    forest = forecast.load_model(path).stages[-1]
    trees = [
        (i, tree.numNodes % 2 == 1, tree.depth <= forecast.DEPTH, tree.depth > 0) for i, tree in enumerate(forest.trees)
    ]
    return spark.createDataFrame(trees, "tree int, odd boolean, depth_kept boolean, grown boolean")


@query(
    "score_forest",
    f"""{_SPLIT_SQL} SELECT event_id, symbol, "timestamp", price, true AS predicted, true AS in_range FROM held""",
)
def score_forest(spark, sf_dir):
    """Every held-out row has a prediction within the range of the training prices."""
    scored, bounds = _scored_with_range(spark, sf_dir)
    return _shown(scored, bounds, _SLACK, "event_id", "symbol", "timestamp", "price")


@query("forest_predictions")
def forest_predictions(spark, sf_dir):
    scored = held_out(spark, sf_dir)
    return scored.select("event_id", "symbol", "timestamp", "price", F.round("prediction", 6).alias("prediction"))


@query(
    "stock_job",
    f"""{_SPLIT_SQL} SELECT symbol, "timestamp", CAST(CAST(price AS FLOAT) AS DOUBLE) AS price,
    CAST(trunc(volume) AS INTEGER) AS volume, true AS predicted, true AS in_range FROM held""",
)
def stock_job(spark, sf_dir):
    """Rows the stock job stores for one batch, of single precision."""
    scored, bounds = _scored_with_range(spark, sf_dir)
    stored = upsert.prediction_rows(jobs.stock_result(scored).scored)
    as_double = stored.withColumn("price", F.col("price").cast("double"))
    return _shown(as_double, bounds, 1e-3, "symbol", "timestamp", "price", "volume")


@query(
    "forest_errors",
    f"{_SPLIT_SQL} SELECT symbol, count(*) AS held_rows, true AS ordered, true AS positive FROM held GROUP BY ROLLUP (symbol)",
)
def forest_errors(spark, sf_dir):
    """Error statistics of the held-out rows, over all and per symbol: groups, their sizes, and the order of the figures."""
    scored = hold(held_out(spark, sf_dir))
    stats = forecast.error_statistics(scored, per_symbol=True)
    sizes = scored.rollup("symbol").agg(F.count(F.lit(1)).alias("held_rows"))
    low, mean, high = (f"{n}_error_percentage" for n in ("min", "mean", "max"))
    same = stats["symbol"].eqNullSafe(sizes["symbol"])
    return stats.join(sizes, same).select(
        sizes["symbol"], "held_rows",
        ((F.col(low) <= F.col(mean) + _SLACK) & (F.col(mean) <= F.col(high) + _SLACK)).alias("ordered"),
        (F.col(low) >= 0).alias("positive"),
    )


_HORIZONS, _FOLDS = (1, 5), 3
_FOLDS_SQL = f"""WITH {TICKS}, {FEATURES_SQL}, complete AS (SELECT * FROM features WHERE {COMPLETE}),
examples AS (
  SELECT event_id, symbol, "timestamp", price, horizon, lead(price, horizon) OVER later AS target,
         lead("timestamp", horizon) OVER later AS target_time
  FROM complete, (VALUES {", ".join(f"({h})" for h in _HORIZONS)}) AS hs(horizon)
  WINDOW later AS (PARTITION BY symbol, horizon ORDER BY "timestamp", event_id)),
reached AS (SELECT * FROM examples WHERE target_time IS NOT NULL),
ends AS (SELECT min(epoch_us("timestamp")) AS lo, max(epoch_us("timestamp")) AS hi FROM reached),
origins AS (
  SELECT CAST(k - 1 AS INTEGER) AS fold, lo + (hi - lo) * k // {_FOLDS + 1} AS origin,
         CASE WHEN k < {_FOLDS} THEN lo + (hi - lo) * (k + 1) // {_FOLDS + 1} END AS until
  FROM ends, range(1, {_FOLDS + 1}) AS ks(k)),
sides AS (
  SELECT *, epoch_us(target_time) < origin AS is_train,
         epoch_us("timestamp") >= origin AND (until IS NULL OR epoch_us("timestamp") < until) AS is_test
  FROM reached, origins)"""


@query(
    "rolling_folds",
    f"""{_FOLDS_SQL} SELECT event_id, symbol, "timestamp", horizon, target, target_time, fold, is_train
    FROM sides WHERE is_train OR is_test""",
)
def rolling_folds(spark, sf_dir):
    """The training and test rows of every fold and horizon; rows that reach across an origin are in neither."""
    complete = features.feature_table(ticks(spark, sf_dir), ties=TIES)
    examples = hold(evaluate.horizon_examples(complete, _HORIZONS, ties=TIES))
    folds = evaluate.fold_rows(examples, evaluate.fold_origins(examples, _FOLDS))
    return folds.select("event_id", "symbol", "timestamp", "horizon", "target", "target_time", "fold", "is_train")


@query(
    "rolling_errors",
    f"""{_FOLDS_SQL} SELECT fold, horizon, count(*) AS examples, count(*) AS scored,
      round(avg(CASE WHEN target <> 0 THEN abs(price - target) / target * 100 END) + 1e-10, 6) AS naive_error_percentage,
      round(sqrt(avg((price - target) * (price - target))) + 1e-10, 6) AS naive_rmse
    FROM sides WHERE is_test GROUP BY fold, horizon""",
)
def rolling_errors(spark, sf_dir):
    """Every test row is scored; the errors of the forecast that repeats the known price, which SQL can tell."""
    complete = features.feature_table(ticks(spark, sf_dir), ties=TIES)
    forecasts = evaluate.rolling_forecasts(complete, _HORIZONS, _FOLDS, ties=TIES, trees=10, depth=5)
    naive = ("naive_error_percentage", "naive_rmse")
    return rounded(evaluate.forecast_errors(forecasts).select("fold", "horizon", "examples", "scored", *naive), naive)
