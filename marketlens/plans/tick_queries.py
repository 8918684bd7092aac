"""Queries over ticks and bars: features, gates, upserts, windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlens.functions import columns as C
from marketlens.operators import features, forecast, upsert
from marketlens.operators.lookup import lookup_join
from marketlens.plans.catalog import query
from marketlens.plans.views import BARS, TICKS, VERSION, VERSION_DESC, bars, table, ticks
from marketlens.session import shared_path
from marketlens.sources import landed
from marketlens.streaming import windows

TIES = ("event_id",)
BAR_TIES = ("l_orderkey", "l_linenumber", "l_partkey", "price")
_W = 'WINDOW w AS (PARTITION BY symbol ORDER BY "timestamp", event_id)'
_RECENT = '(PARTITION BY symbol ORDER BY "timestamp", event_id ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)'

FEATURES_SQL = f"""features AS (
  SELECT event_id, symbol, "timestamp", price, volume,
         lag(price, 1) OVER w AS price_lag1, lag(price, 2) OVER w AS price_lag2,
         lag(price, 3) OVER w AS price_lag3, lag(volume, 1) OVER w AS volume_lag1,
         price - lag(price, 1) OVER w AS price_change, volume - lag(volume, 1) OVER w AS volume_change,
         CAST(hour("timestamp") AS INTEGER) AS "hour", CAST(day("timestamp") AS INTEGER) AS "day",
         CAST(dayofweek("timestamp") + 1 AS INTEGER) AS day_of_week,
         avg(price) OVER {_RECENT} AS rolling_mean_price, avg(volume) OVER {_RECENT} AS rolling_mean_volume
  FROM ticks WHERE symbol IS NOT NULL {_W})"""

COMPLETE = " AND ".join(
    [f"{c} IS NOT NULL AND NOT isnan({c})" for c in (
        "price", "volume", "price_lag1", "price_lag2", "price_lag3", "volume_lag1", "price_change",
        "volume_change", "rolling_mean_price", "rolling_mean_volume")]
    + ['event_id IS NOT NULL AND "timestamp" IS NOT NULL']
)
_ROUNDED = ("price_change", "volume_change", "rolling_mean_price", "rolling_mean_volume")

FEATURE_TABLE_SQL = f"""WITH {TICKS}, {FEATURES_SQL}
SELECT event_id, symbol, "timestamp", price, volume, price_lag1, price_lag2, price_lag3, volume_lag1,
       round(price_change + 1e-10, 6) AS price_change, round(volume_change + 1e-10, 6) AS volume_change,
       "hour", "day", day_of_week, round(rolling_mean_price + 1e-10, 6) AS rolling_mean_price,
       round(rolling_mean_volume + 1e-10, 6) AS rolling_mean_volume
FROM features WHERE {COMPLETE}"""


def settled(column, digits=6):
    """Rounded for the comparison with SQL.

    Sums of doubles differ in their last bits with the order of rows. A value
    that sits on a rounding border up to those bits is moved off it, on both
    sides of the comparison.
    """
    return F.round(F.col(column) + 10.0 ** -(digits + 4), digits)


def rounded(df, names=_ROUNDED, digits=6):
    return df.select(*[settled(c, digits).alias(c) if c in names else c for c in df.columns])


def _feature_sql(*names: str) -> str:
    shown = ", ".join(f'round("{n}" + 1e-10, 6) AS "{n}"' if n in _ROUNDED else f'"{n}"' for n in names)
    return f"WITH {TICKS}, {FEATURES_SQL} SELECT event_id, symbol, {shown} FROM features"


def _feature_query(name: str, *names: str) -> None:
    @query(name, _feature_sql(*names))
    def run(spark, sf_dir):
        wide = features.add_features(ticks(spark, sf_dir), names, ties=TIES)
        return rounded(wide.select("event_id", "symbol", *names))


_feature_query("feat_price_lags", "price_lag1", "price_lag2", "price_lag3")
_feature_query("feat_volume_lag", "volume_lag1")
_feature_query("feat_rolling_price", "rolling_mean_price")
_feature_query("feat_rolling_volume", "rolling_mean_volume")
_feature_query("feat_changes", "price_change", "volume_change")


@query("feat_calendar", _feature_sql("hour", "day", "day_of_week"))
def feat_calendar(spark, sf_dir):
    # no window among these, so no exchange
    t = F.col("timestamp")
    return ticks(spark, sf_dir).select(
        "event_id", "symbol", F.hour(t).alias("hour"), F.dayofmonth(t).alias("day"),
        F.dayofweek(t).alias("day_of_week"),
    )


@query("feature_table", FEATURE_TABLE_SQL)
def feature_table(spark, sf_dir):
    return rounded(features.feature_table(ticks(spark, sf_dir), ties=TIES))


@query("feature_table_bucketed", FEATURE_TABLE_SQL)
def feature_table_bucketed(spark, sf_dir):
    """As feature_table with a row limit that every symbol exceeds, so all are cut."""
    return rounded(features.feature_table(ticks(spark, sf_dir), ties=TIES, rows_per_segment=500))


@query(
    "feature_next_price",
    f"""WITH {TICKS} SELECT event_id, symbol, price,
    lead(price, 1) OVER (PARTITION BY symbol ORDER BY "timestamp", event_id) AS next_price FROM ticks""",
)
def feature_next_price(spark, sf_dir):
    labelled = features.next_price_label(ticks(spark, sf_dir), ties=TIES)
    return labelled.select("event_id", "symbol", "price", "next_price")


@query(
    "drop_incomplete",
    f"""WITH {TICKS}, holes AS (SELECT event_id, symbol, CASE WHEN volume < 10 THEN NULL ELSE price END AS price,
      CASE WHEN price < 5 THEN 'NaN'::DOUBLE ELSE volume END AS volume FROM ticks)
    SELECT event_id, symbol, price, volume FROM holes
    WHERE price IS NOT NULL AND volume IS NOT NULL AND NOT isnan(price) AND NOT isnan(volume)
      AND event_id IS NOT NULL AND symbol IS NOT NULL""",
)
def drop_incomplete(spark, sf_dir):
    holes = ticks(spark, sf_dir).select(
        "event_id",
        "symbol",
        F.when(F.col("volume") < 10, None).otherwise(F.col("price")).alias("price"),
        F.when(F.col("price") < 5, float("nan")).otherwise(F.col("volume")).alias("volume"),
    )
    return features.drop_incomplete(holes)


@query(
    "gate_min_rows",
    f"""WITH {BARS}, n AS (SELECT symbol, "timestamp", price, count(*) OVER (PARTITION BY symbol) AS symbol_rows FROM bars)
    SELECT symbol, "timestamp", price, symbol_rows FROM n WHERE symbol_rows > 600""",
)
def gate_min_rows(spark, sf_dir):
    rows = bars(spark, sf_dir).select("symbol", "timestamp", "price")
    passing = features.symbols_with_enough_rows(rows, 600)
    return lookup_join(rows, passing, ["symbol"], "inner")


@query(
    "dedup_last_write",
    f"""WITH {BARS}, r AS (SELECT *, row_number() OVER (PARTITION BY symbol, "timestamp" ORDER BY {VERSION_DESC}) AS rn
      FROM bars)
    SELECT symbol, "timestamp", price, volume, l_orderkey, l_linenumber, l_partkey
    FROM r WHERE rn = 1""",
)
def dedup_last_write(spark, sf_dir):
    rows = bars(spark, sf_dir).drop("prediction")
    return upsert.latest_per_key(rows, ["symbol", "timestamp"], VERSION)


def _narrow(column: str, kind: str) -> str:
    return f"CAST(CAST({column} AS {kind}) AS DOUBLE)"


@query(
    "upsert_predictions",
    f"""WITH {BARS}, r AS (SELECT *, row_number() OVER (PARTITION BY symbol, "timestamp" ORDER BY {VERSION_DESC}) AS rn
      FROM bars)
    SELECT symbol, "timestamp", {_narrow('prediction', 'FLOAT')} AS prediction, {_narrow('price', 'FLOAT')} AS price,
           CAST(trunc(volume) AS INTEGER) AS volume FROM r WHERE rn = 1""",
)
def upsert_predictions(spark, sf_dir):
    newest = upsert.latest_per_key(bars(spark, sf_dir), ["symbol", "timestamp"], VERSION)
    return _widened(upsert.prediction_rows(newest), "prediction", "price")


@query(
    "upsert_retried_compacted",
    f"""WITH {TICKS} SELECT event_id, symbol, "timestamp",
      CASE WHEN event_id % 7 = 3 THEN 3.0::DOUBLE WHEN event_id % 5 = 2 THEN 2.0::DOUBLE
           WHEN event_id % 3 = 1 THEN 1.0::DOUBLE ELSE price END AS price, volume FROM ticks""",
)
def upsert_retried_compacted(spark, sf_dir):
    """Ticks and three batches of corrections: one is run again with fewer rows, two are put together in between."""
    rows = ticks(spark, sf_dir).persist()
    log = upsert.VersionedLog(shared_path(spark, "retried"), rows.schema, ["symbol", "timestamp", "event_id"])
    log.append(rows, 0)
    log.append(rows.withColumn("price", F.lit(-1.0)), 1)  # a try with too much
    for i, divisor in enumerate((3, 5, 7), 1):
        log.append(rows.filter(F.col("event_id") % divisor == i).withColumn("price", F.lit(float(i))), i)
        if i == 2:
            log.compact(spark, 1)
            log.remove_compacted(spark)
    rows.unpersist()
    return log.current(spark)


def _widened(df, *names):
    return df.select(*[F.col(c).cast("double").alias(c) if c in names else c for c in df.columns])


@query(
    "upsert_partial_columns",
    f"""WITH {BARS}, writes AS (SELECT symbol, "timestamp", CAST(price AS FLOAT) AS price,
        CAST(prediction AS FLOAT) AS prediction,
        CASE WHEN l_linenumber % 2 = 0 THEN NULL ELSE CAST(trunc(volume) AS INTEGER) END AS volume,
        row_number() OVER (PARTITION BY symbol, "timestamp" ORDER BY {VERSION_DESC}) AS age FROM bars)
    SELECT symbol, "timestamp", CAST(arg_min(price, age) AS DOUBLE) AS price,
           CAST(arg_min(prediction, age) AS DOUBLE) AS prediction,
           CAST(arg_min(volume, age) FILTER (WHERE volume IS NOT NULL) AS DOUBLE) AS volume
    FROM writes GROUP BY symbol, "timestamp" """,
)
def upsert_partial_columns(spark, sf_dir):
    """Writers of even lines leave the volume out."""
    rows = bars(spark, sf_dir)
    volume = F.when(F.col("l_linenumber") % 2 != 0, F.col("volume").try_cast("int"))
    writes = rows.select(
        "symbol", "timestamp", F.col("price").cast("float").alias("price"),
        F.col("prediction").cast("float").alias("prediction"), volume.alias("volume"),
        F.struct(*VERSION).alias("version"),
    )
    merged = upsert.merge_partial_rows(writes, ["symbol", "timestamp"], ["version"])
    return _widened(merged, "price", "prediction", "volume")


@query(
    "snapshot_map",
    f"""WITH {BARS}, r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY "timestamp" DESC, {VERSION_DESC}) AS rn
      FROM bars)
    SELECT symbol, strftime("timestamp", '%Y-%m-%d %H:%M:%S') AS "timestamp",
           {_narrow('price', 'FLOAT')} AS price, {_narrow('volume', 'FLOAT')} AS volume FROM r WHERE rn = 1""",
)
def snapshot_map(spark, sf_dir):
    latest = upsert.snapshot(bars(spark, sf_dir), ties=VERSION)
    entries = [F.col("data")[name].cast("double").alias(name) for name in ("price", "volume")]
    return latest.select("symbol", "timestamp", *entries)


@query(
    "latest_predictions",
    f"""WITH {BARS} SELECT "timestamp", symbol, price, prediction, l_orderkey, l_linenumber, l_partkey FROM bars
    ORDER BY "timestamp" DESC, symbol, l_orderkey, l_linenumber, l_partkey LIMIT 5""",
)
def latest_predictions(spark, sf_dir):
    ties = ("symbol", "l_orderkey", "l_linenumber", "l_partkey")
    return forecast.latest_predictions(bars(spark, sf_dir), ties=ties)


@query(
    "score_pct_error",
    f"""WITH {BARS} SELECT symbol, "timestamp", l_orderkey, l_linenumber, l_partkey,
      abs(prediction - price) / nullif(price, 0) * 100 AS prediction_error FROM bars""",
)
def score_pct_error(spark, sf_dir):
    return bars(spark, sf_dir).select(
        "symbol", "timestamp", "l_orderkey", "l_linenumber", "l_partkey",
        C.percent_error("prediction", "price").alias("prediction_error"),
    )


_ERROR_SQL = """round(avg(e) + 1e-10, 6) AS mean_error_percentage, round(max(e) + 1e-10, 6) AS max_error_percentage,
      round(min(e) + 1e-10, 6) AS min_error_percentage"""
_ERRORS = f"{BARS}, errors AS (SELECT symbol, abs(prediction - price) / nullif(price, 0) * 100 AS e FROM bars)"
_ERROR_NAMES = ("mean_error_percentage", "max_error_percentage", "min_error_percentage")


@query("agg_error_stats", f"WITH {_ERRORS} SELECT symbol, {_ERROR_SQL} FROM errors GROUP BY ROLLUP (symbol)")
def agg_error_stats(spark, sf_dir):
    return rounded(forecast.error_statistics(bars(spark, sf_dir), per_symbol=True), _ERROR_NAMES)


@query("agg_rmse", f"WITH {BARS} SELECT round(sqrt(avg((prediction - price) ** 2)) + 1e-10, 6) AS rmse FROM bars")
def agg_rmse(spark, sf_dir):
    return rounded(forecast.rmse(bars(spark, sf_dir)), ("rmse",))


@query(
    "split_train_test",
    f"""WITH {BARS}, r AS (SELECT *, row_number() OVER (PARTITION BY symbol
        ORDER BY "timestamp", l_orderkey, l_linenumber, l_partkey, price) AS rn,
        count(*) OVER (PARTITION BY symbol) AS n FROM bars)
    SELECT symbol, "timestamp", l_orderkey, l_linenumber, l_partkey, rn <= n * 0.8::DOUBLE AS is_train FROM r""",
)
def split_train_test(spark, sf_dir):
    marked = forecast.split_by_time(bars(spark, sf_dir), ties=BAR_TIES)
    return marked.select("symbol", "timestamp", "l_orderkey", "l_linenumber", "l_partkey", "is_train")


@query(
    "window_ohlc",
    f"""WITH {TICKS} SELECT time_bucket(INTERVAL '1 hour', "timestamp") AS window_start,
      time_bucket(INTERVAL '1 hour', "timestamp") + INTERVAL '1 hour' AS window_end, symbol,
      arg_min(price, "timestamp") AS "open", max(price) AS high, min(price) AS low,
      arg_max(price, "timestamp") AS "close", round(sum(volume) + 1e-10, 6) AS volume, count(*) AS ticks
    FROM ticks GROUP BY ALL""",
)
def window_ohlc(spark, sf_dir):
    return rounded(windows.ohlc_bars(ticks(spark, sf_dir), ties=TIES), ("volume",))


@query(
    "normalise_ohlcv",
    """SELECT l_orderkey, l_linenumber, l_partkey, strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS "timestamp",
      concat('S', CAST(l_suppkey AS VARCHAR)) AS symbol, l_extendedprice AS price, l_quantity AS volume FROM lineitem""",
)
def normalise_ohlcv(spark, sf_dir):
    downloads = table(spark, sf_dir, "lineitem").withColumnsRenamed(
        {"l_shipdate": "Datetime", "l_extendedprice": "Close", "l_quantity": "Volume"}
    )
    symbol = F.concat(F.lit("S"), F.col("l_suppkey").cast("string"))
    return landed.normalise_ohlcv(downloads, symbol, keep=("l_orderkey", "l_linenumber", "l_partkey"))
