"""Queries of the serving side: keyed scans, sentiment joins, blend, chart series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.functions import columns as C
from marketlens.operators.lookup import lookup_join
from marketlens.operators.segments import ROWS_PER_SEGMENT, carry_forward, number_rows
from marketlens.operators.upsert import latest_value


def by_symbol(df: DataFrame, symbol: str, column: str = "symbol") -> DataFrame:
    """Rows of the symbol, given in any case; stored symbols are upper case."""
    return df.filter(F.col(column) == F.upper(F.lit(symbol)))


def symbol_series(predictions: DataFrame, symbol: str, ts: str = "timestamp", ties: Sequence[str] = ()) -> DataFrame:
    """A symbol's predictions in time order."""
    columns = [ts, "price", "symbol", "volume", "prediction"]
    return predictions.filter(F.col("symbol") == symbol).select(*columns, *ties).orderBy(ts, *ties)


def company_series(news: DataFrame, company: str, ts: str = "timestamp", ties: Sequence[str] = ()) -> DataFrame:
    """A company's articles in time order."""
    return news.filter(F.col("company") == company).orderBy(ts, *ties)


def latest_sentiment(
    news: DataFrame, ts: str = "timestamp", ties: Sequence[str] = (), score: str = "overall_sentiment"
) -> DataFrame:
    """The newest article's score per company, 0 when that score is null or NaN."""
    newest = latest_value(news, "company", score, [ts, *ties], "__score")
    return newest.select("company", C.number_or_zero("__score").alias("sentiment"))


def join_latest_sentiment(
    predictions: DataFrame, news: DataFrame, ts: str = "timestamp", ties: Sequence[str] = (),
    score: str = "overall_sentiment",
) -> DataFrame:
    """Predictions with their company's newest score, 0 for a company without news."""
    newest = latest_sentiment(news, ts, ties, score).withColumnRenamed("company", "symbol")
    return or_zero(lookup_join(predictions, newest, ["symbol"]), predictions)


def join_daily_sentiment(
    predictions: DataFrame, news: DataFrame, ts: str = "timestamp", news_ts: str = "timestamp",
    score: str = "overall_sentiment",
) -> DataFrame:
    """Predictions with the mean score of their company on their day, 0 without one."""
    daily = news.groupBy(F.col("company").alias("symbol"), C.utc_day(news_ts).alias("date")).agg(
        F.avg(score).alias("sentiment")
    )
    dated = predictions.withColumn("date", C.utc_day(ts))
    return or_zero(lookup_join(dated, daily, ["symbol", "date"]), dated)


def join_sentiment_asof(
    predictions: DataFrame, news: DataFrame, ts: str = "timestamp", news_ts: str = "timestamp",
    ties: Sequence[str] = (), news_ties: Sequence[str] = (), score: str = "overall_sentiment",
    rows_per_segment: int = ROWS_PER_SEGMENT,
) -> DataFrame:
    """Predictions with the newest score of their company up to their time, else null.

    Both sides form one ordered sequence per company; an article precedes the
    bars of its own timestamp. Long sequences are cut, see ``segments``.
    """
    bars = predictions.select(
        F.struct(*predictions.columns).alias("__bar"),
        F.col("symbol").alias("__company"),
        F.col(ts).alias("__ts"),
        F.lit(1).alias("__side"),
        *[F.col(t).alias(f"__tie{i}") for i, t in enumerate(ties)],
        *[F.lit(None).alias(f"__news_tie{i}") for i in range(len(news_ties))],
        F.lit(None).cast("double").alias("__score"),
    )
    # an article without a company belongs to no bar, also to none without a symbol
    articles = news.filter(F.col("company").isNotNull()).select(
        F.col("company").alias("__company"),
        F.col(news_ts).alias("__ts"),
        F.lit(0).alias("__side"),
        *[F.lit(None).alias(f"__tie{i}") for i in range(len(ties))],
        *[F.col(t).alias(f"__news_tie{i}") for i, t in enumerate(news_ties)],
        F.col(score).cast("double").alias("__score"),
    )
    order = ["__ts", "__side", *[f"__tie{i}" for i in range(len(ties))]]
    order += [f"__news_tie{i}" for i in range(len(news_ties))]
    both = bars.unionByName(articles, allowMissingColumns=True)
    carried = carry_forward(
        both, ["__company"], order, F.col("__score"), F.col("__side") == 0, "__latest", rows_per_segment
    )
    return carried.filter(F.col("__side") == 1).select("__bar.*", F.col("__latest").alias("sentiment"))


def or_zero(joined: DataFrame, left: DataFrame) -> DataFrame:
    """The columns of ``left`` and the sentiment, 0 where there is none."""
    return joined.select(*left.columns, C.number_or_zero("sentiment").alias("sentiment"))


def join_company_name(df: DataFrame, companies: DataFrame) -> DataFrame:
    """Add the company's name, null for an unlisted symbol."""
    return lookup_join(df, companies.select("symbol", "name"), ["symbol"])


def serving_records(
    joined: DataFrame, ts: str = "timestamp", raw_weight: float | Column = 1.0,
    sentiment_weight: float | Column = 0.0, keep: Sequence[str] = (),
) -> DataFrame:
    """Joined predictions as serving records with the blended prediction."""
    raw = F.col("prediction").cast("double")
    return joined.select(
        C.utc_day(ts).alias("date"),
        F.col("price").cast("double").alias("price"),
        "symbol",
        F.col("volume").try_cast("int").alias("volume"),
        raw.alias("rawPrediction"),
        F.col("sentiment").cast("double").alias("sentiment"),
        C.blend_linear(raw, F.col("sentiment"), raw_weight, sentiment_weight).alias("finalPrediction"),
        *keep,
    )


def market_data(
    predictions: DataFrame, news: DataFrame, ts: str = "timestamp", news_ts: str = "timestamp",
    news_ties: Sequence[str] = (), raw_weight: float | Column = 1.0, sentiment_weight: float | Column = 0.0,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Serving records of all symbols; filter on ``symbol`` for one."""
    joined = join_latest_sentiment(predictions, news, news_ts, news_ties)
    return serving_records(joined, ts, raw_weight, sentiment_weight, keep)


def market_data_for(
    symbol: str, predictions: DataFrame, news: DataFrame, ts: str = "timestamp", news_ts: str = "timestamp",
    news_ties: Sequence[str] = (), ties: Sequence[str] = (), **weights,
) -> DataFrame:
    """Serving records of one symbol in time order; no rows for an unknown symbol."""
    own_news = by_symbol(news, symbol, "company")
    joined = join_latest_sentiment(by_symbol(predictions, symbol), own_news, news_ts, news_ties)
    return serving_records(joined.orderBy(ts, *ties), ts, **weights)


def blend_fitted(records: DataFrame, fit: DataFrame, name: str = "finalPrediction") -> DataFrame:
    """Blend by a one-row fit: its weights and intercept, the sentiment scaled by the bounds it was fitted with."""
    weights = fit.select(F.struct("alpha", "beta", "intercept", "lo", "hi")).scalar()
    lo, hi, s = weights["lo"], weights["hi"], F.col("sentiment")
    scaled = F.when(hi > lo, (s - lo) / (hi - lo)).otherwise(s)
    blended = C.blend_linear("rawPrediction", scaled, weights["alpha"], weights["beta"])
    return records.withColumn(name, blended + weights["intercept"])


def blend_with_coefficients(records: DataFrame, coefficients: DataFrame, name: str = "finalPrediction") -> DataFrame:
    """Replace the blended prediction by the one with an interaction term."""
    stored = coefficients.select(F.struct("x", "y", "z")).scalar()
    x, y, z = (stored[c] for c in ("x", "y", "z"))
    return records.withColumn(name, C.blend_product("rawPrediction", "sentiment", x, y, z))


def chart_pages(
    records: DataFrame, ts: str = "timestamp", ties: Sequence[str] = (), points: int = 1000,
    rows_per_segment: int = ROWS_PER_SEGMENT,
) -> DataFrame:
    """Aligned arrays for charts, as pages of up to ``points`` points in time order.

    Pages keep an array bounded however long a symbol's series is; the pages of
    a symbol in order are its whole series.
    """
    fields = ["date", "price", "volume", "finalPrediction"]
    ranked = number_rows(records, ["symbol"], [ts, *ties], "__rank", "__size", rows_per_segment)
    page = F.floor((F.col("__rank") - 1) / points).cast("long")
    grouped = ranked.groupBy("symbol", page.alias("page")).agg(
        F.array_sort(F.collect_list(F.struct("__rank", *fields))).alias("__points")
    )
    names = {"date": "labels", "price": "prices", "volume": "volumes", "finalPrediction": "predictions"}
    # a field of an array of structs is the array of that field
    return grouped.select("symbol", "page", *[F.col("__points")[f].alias(n) for f, n in names.items()])


def sentiment_gauges(records: DataFrame, ts: str = "timestamp", ties: Sequence[str] = ()) -> DataFrame:
    """Newest sentiment of each symbol with its dashboard label and gauge position."""
    newest = latest_value(records, "symbol", "sentiment", [ts, *ties], "score")
    return newest.select(
        "symbol", "score", C.gauge_label("score").alias("label"), C.gauge_position("score").alias("gauge")
    )
