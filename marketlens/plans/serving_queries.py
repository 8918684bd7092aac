"""Queries of the serving side over bars, predictions and scored articles."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlens.functions import columns as C
from marketlens.operators import calibrate, serving
from marketlens.operators.lookup import hold, lookup_join
from marketlens.plans.catalog import query
from marketlens.plans.news_queries import scored_articles
from marketlens.plans.tick_queries import BAR_TIES, TIES, rounded, settled
from marketlens.plans.views import (
    BARS,
    NEWS,
    SCORED,
    TICK_COMPANIES_SQL,
    TICKS,
    bars,
    company_symbol,
    news,
    table,
    tick_companies,
    ticks,
)
from marketlens.session import shared_path
from marketlens.sources import landed, layout

KEY = ("doc_id",)
_ROW = "l_orderkey, l_linenumber, l_partkey"


def company_scores(spark, sf_dir):
    """Scores without texts, with companies named as the bars name them."""
    scored = scored_articles(spark, sf_dir, ("company", "published_at"))
    return scored.select(
        "doc_id", company_symbol(F.col("company")).alias("company"), "published_at",
        settled("overall_sentiment", 9).alias("overall_sentiment"),
    )


_COMPANY_SCORES = f"""{SCORED}, company_scores AS (
  SELECT doc_id, concat('S', substr(company, 4)) AS company, published_at,
         round(overall_sentiment + 1e-13, 9) AS overall_sentiment FROM scored)"""
_LATEST = f"""{_COMPANY_SCORES}, latest AS (
  SELECT company, coalesce(arg_max(overall_sentiment, (published_at, doc_id)), 0) AS sentiment
  FROM company_scores GROUP BY company)"""


@query(
    "serve_scan_symbol",
    f"""WITH {TICKS} SELECT "timestamp", price, symbol, volume, price * 0.99::DOUBLE AS prediction, event_id FROM ticks
    WHERE symbol = 'click' ORDER BY "timestamp", event_id""",
)
def serve_scan_symbol(spark, sf_dir):
    predictions = ticks(spark, sf_dir).withColumn("prediction", F.col("price") * 0.99)
    return serving.symbol_series(predictions, "click", ties=TIES)


@query(
    "serve_scan_news",
    f"""WITH {NEWS} SELECT doc_id, company, title, published_at FROM news WHERE company = 'src3'
    ORDER BY published_at, doc_id""",
)
def serve_scan_news(spark, sf_dir):
    articles = news(spark, sf_dir).select("doc_id", "company", "title", "published_at")
    return serving.company_series(articles, "src3", "published_at", KEY)


@query(
    "filter_symbol_ci",
    f"""WITH {BARS} SELECT symbol, "timestamp", price, {_ROW} FROM bars WHERE symbol = upper('s7')""",
)
def filter_symbol_ci(spark, sf_dir):
    return serving.by_symbol(bars(spark, sf_dir), "s7").select(
        "symbol", "timestamp", "price", "l_orderkey", "l_linenumber", "l_partkey"
    )


@query("agg_latest_sentiment", f"WITH {_LATEST} SELECT company, round(sentiment + 1e-10, 6) AS sentiment FROM latest")
def agg_latest_sentiment(spark, sf_dir):
    return rounded(serving.latest_sentiment(company_scores(spark, sf_dir), "published_at", KEY), ("sentiment",))


@query(
    "serve_join_latest_sentiment",
    f"""WITH {BARS}, {_LATEST} SELECT symbol, "timestamp", price, prediction, {_ROW},
    round(coalesce(sentiment, 0) + 1e-10, 6) AS sentiment FROM bars LEFT JOIN latest ON company = symbol""",
)
def serve_join_latest_sentiment(spark, sf_dir):
    rows = bars(spark, sf_dir).drop("volume")
    joined = serving.join_latest_sentiment(rows, company_scores(spark, sf_dir), "published_at", KEY)
    return rounded(joined, ("sentiment",))


def mapped_ticks(spark, sf_dir):
    """Ticks under their company's name; a symbol without a company keeps its own."""
    return lookup_join(ticks(spark, sf_dir), tick_companies(spark), ["symbol"]).select(
        "event_id", F.coalesce("company", "symbol").alias("symbol"), "timestamp", "price", "volume",
        (F.col("price") * 0.99).alias("prediction"),
    )


_MAPPED = f"""{TICKS}, {TICK_COMPANIES_SQL}, mapped AS (
  SELECT event_id, coalesce(company, symbol) AS symbol, "timestamp", price, volume,
         price * 0.99::DOUBLE AS prediction
  FROM ticks LEFT JOIN tick_companies USING (symbol))"""


@query(
    "join_sentiment_by_day",
    f"""WITH {_MAPPED}, {SCORED}, daily AS (
      SELECT company, strftime(published_at, '%Y-%m-%d') AS "date", avg(overall_sentiment) AS sentiment
      FROM scored GROUP BY ALL)
    SELECT event_id, m.symbol, strftime(m."timestamp", '%Y-%m-%d') AS "date", price,
           round(coalesce(sentiment, 0) + 1e-10, 6) AS sentiment
    FROM mapped m LEFT JOIN daily d ON d.company = m.symbol AND d."date" = strftime(m."timestamp", '%Y-%m-%d')""",
)
def join_sentiment_by_day(spark, sf_dir):
    scored = scored_articles(spark, sf_dir, ("company", "published_at"))
    joined = serving.join_daily_sentiment(mapped_ticks(spark, sf_dir), scored, news_ts="published_at")
    return rounded(joined.select("event_id", "symbol", "date", "price", "sentiment"), ("sentiment",))


_ASOF_SQL = f"""WITH {_MAPPED}, {SCORED} SELECT event_id, m.symbol, m."timestamp", price,
    round(s.overall_sentiment + 1e-10, 6) AS sentiment
    FROM mapped m ASOF LEFT JOIN scored s ON s.company = m.symbol AND m."timestamp" >= s.published_at"""


def _asof(spark, sf_dir, **options):
    # read twice, for the sizes of the sequences and for the join
    scored = hold(scored_articles(spark, sf_dir, ("company", "published_at")))
    joined = serving.join_sentiment_asof(
        mapped_ticks(spark, sf_dir).select("event_id", "symbol", "timestamp", "price"), scored,
        news_ts="published_at", ties=TIES, news_ties=KEY, **options,
    )
    return rounded(joined, ("sentiment",))


@query("join_sentiment_asof", _ASOF_SQL)
def join_sentiment_asof(spark, sf_dir):
    return _asof(spark, sf_dir)


@query("join_sentiment_asof_bucketed", _ASOF_SQL)
def join_sentiment_asof_bucketed(spark, sf_dir):
    """As join_sentiment_asof with a row limit that every company exceeds."""
    return _asof(spark, sf_dir, rows_per_segment=400)


def supplier_dimension(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("symbol"), F.col("s_name").alias("name")
    )


@query(
    "join_company_name",
    f"""WITH {BARS} SELECT symbol, s_name AS name, "timestamp", {_ROW} FROM bars
    LEFT JOIN supplier ON concat('S', CAST(s_suppkey AS VARCHAR)) = symbol""",
)
def join_company_name(spark, sf_dir):
    rows = bars(spark, sf_dir).select("symbol", "timestamp", "l_orderkey", "l_linenumber", "l_partkey")
    return serving.join_company_name(rows, supplier_dimension(spark, sf_dir))


_COMPANY_VALUES = ", ".join(f"('{s}', '{n}')" for s, n in landed.COMPANIES)


@query(
    "dim_company",
    f"""WITH {NEWS}, companies(symbol, name) AS (VALUES {_COMPANY_VALUES}),
    numbered AS (SELECT symbol, name, row_number() OVER (ORDER BY symbol) - 1 AS n FROM companies)
    SELECT symbol, name, count(doc_id) AS articles FROM numbered
    LEFT JOIN news ON CAST(substr(company, 4) AS INTEGER) % 8 = n GROUP BY ALL""",
)
def dim_company(spark, sf_dir):
    """The company list with the number of articles that the test sources map to each."""
    listed = sorted(s for s, _ in landed.COMPANIES)
    number = F.substr("company", F.lit(4)).try_cast("int") % len(listed)
    articles = news(spark, sf_dir).select(
        F.element_at(F.array(*map(F.lit, listed)), number + 1).alias("company")
    )
    companies = landed.company_dimension(spark).withColumnRenamed("symbol", "company")
    return landed.articles_by_company(companies, articles).withColumnRenamed("company", "symbol")


@query(
    "parse_numbers",
    """SELECT doc_id, coalesce(TRY_CAST(piece AS DOUBLE), 0) AS as_double,
      coalesce(CAST(trunc(TRY_CAST(piece AS DOUBLE)) AS INTEGER), 0) AS as_int, CAST(n_chars AS INTEGER) AS leading
    FROM (SELECT doc_id, n_chars, CASE WHEN lang = 'fr' THEN source
      ELSE concat('-', CAST(n_chars AS VARCHAR), '.75') END AS piece FROM documents)""",
)
def parse_numbers(spark, sf_dir):
    """Numbers as text, with words among them, and numbers with a unit behind."""
    number = F.concat(F.lit("-"), F.col("n_chars").cast("string"), F.lit(".75"))
    piece = F.when(F.col("lang") == "fr", F.col("source")).otherwise(number)
    with_unit = F.concat(F.col("n_chars").cast("string"), F.lit(" chars"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", C.parse_double(piece).alias("as_double"), C.parse_int(piece).alias("as_int"),
        C.parse_int(with_unit, prefix=True).alias("leading"),
    )


_GAUGE = """CASE WHEN {0} > 0.2 THEN 'Positive' WHEN {0} < -0.2 THEN 'Negative' ELSE 'Neutral' END AS label,
    round(coalesce(({0} + 1) / 2, 0.5) + 1e-10, 6) AS gauge"""


@query(
    "sentiment_gauge",
    f"""WITH {_COMPANY_SCORES}, newest AS (
      SELECT company AS symbol, arg_max(overall_sentiment, (published_at, doc_id)) AS score
      FROM company_scores GROUP BY company)
    SELECT symbol, round(score + 1e-10, 6) AS score, {_GAUGE.format('score')} FROM newest""",
)
def sentiment_gauge(spark, sf_dir):
    records = company_scores(spark, sf_dir).withColumnsRenamed(
        {"company": "symbol", "overall_sentiment": "sentiment"}
    )
    return rounded(serving.sentiment_gauges(records, "published_at", KEY), ("score", "gauge"))


_SERVED_SQL = f"""{BARS}, {_LATEST}, served AS (
  SELECT strftime("timestamp", '%Y-%m-%d') AS "date", price, symbol, CAST(trunc(volume) AS INTEGER) AS volume,
         prediction AS "rawPrediction", coalesce(sentiment, 0) AS sentiment, "timestamp", {_ROW}
  FROM bars LEFT JOIN latest ON company = symbol)"""
_SERVED_COLUMNS = f""""date", price, symbol, volume,  "rawPrediction",
    round(sentiment + 1e-10, 6) AS sentiment, {_ROW}"""


def served(spark, sf_dir, raw_weight=1.0, sentiment_weight=0.0):
    return serving.market_data(
        bars(spark, sf_dir), company_scores(spark, sf_dir), news_ts="published_at", news_ties=KEY,
        raw_weight=raw_weight, sentiment_weight=sentiment_weight,
        keep=("timestamp", "l_orderkey", "l_linenumber", "l_partkey"),
    )


_SERVED_ROUNDED = ("sentiment",)


@query(
    "serve_market_data",
    f"""WITH {_SERVED_SQL} SELECT {_SERVED_COLUMNS},
    "rawPrediction" * 1 + sentiment * 0.0 AS "finalPrediction" FROM served""",
)
def serve_market_data(spark, sf_dir):
    return rounded(served(spark, sf_dir), _SERVED_ROUNDED).drop("timestamp")


def _layout(spark, sf_dir):
    """Bars and newest scores in the serving layout, at least eight buckets and two parts a symbol."""
    path, rows = shared_path(spark, "layout"), bars(spark, sf_dir)
    buckets, parts = layout.sizes(rows, buckets=8, parts=2)
    tables = layout.ServingLayout(spark, path, path.rsplit("/", 1)[1].replace("-", "_"), buckets, parts)
    tables.write_predictions(rows, ties=BAR_TIES)
    tables.write_sentiment(company_scores(spark, sf_dir), "published_at", KEY)
    return tables


@query(
    "serve_market_data_bucketed",
    f"""WITH {_SERVED_SQL} SELECT {_SERVED_COLUMNS},
    "rawPrediction" * 1 + sentiment * 0.0 AS "finalPrediction" FROM served""",
)
def serve_market_data_bucketed(spark, sf_dir):
    """As serve_market_data, from tables that join without an exchange."""
    keep = ("l_orderkey", "l_linenumber", "l_partkey")
    return rounded(serving.serving_records(_layout(spark, sf_dir).joined(), keep=keep), _SERVED_ROUNDED)


@query(
    "serve_symbol_bucketed",
    f"""WITH {_SERVED_SQL} SELECT {_SERVED_COLUMNS},
    "rawPrediction" * 1 + sentiment * 0.0 AS "finalPrediction" FROM served WHERE symbol = 'S7'""",
)
def serve_symbol_bucketed(spark, sf_dir):
    """The serving records of one symbol, from the buckets of its parts."""
    keep = ("l_orderkey", "l_linenumber", "l_partkey")
    return rounded(serving.serving_records(_layout(spark, sf_dir).joined_of("S7"), keep=keep), _SERVED_ROUNDED)


@query(
    "blend_linear",
    f"""WITH {_SERVED_SQL} SELECT {_SERVED_COLUMNS},
    "rawPrediction" * 0.9::DOUBLE + sentiment * 25::DOUBLE AS "finalPrediction" FROM served""",
)
def blend_linear(spark, sf_dir):
    return rounded(served(spark, sf_dir, 0.9, 25.0), _SERVED_ROUNDED).drop("timestamp")


@query(
    "blend_nonlinear",
    f"""WITH {_SERVED_SQL} SELECT {_SERVED_COLUMNS},
    0.5::DOUBLE * "rawPrediction" + 0.3::DOUBLE * sentiment + 0.2::DOUBLE * ("rawPrediction" * sentiment)
      AS "finalPrediction" FROM served""",
)
def blend_nonlinear(spark, sf_dir):
    records = serving.blend_with_coefficients(served(spark, sf_dir), landed.read_coefficients(spark))
    return rounded(records, _SERVED_ROUNDED).drop("timestamp")


@query(
    "blend_stored_coefficients",
    f"""WITH {_SERVED_SQL}, stored AS (SELECT round(avg(l_discount) + 1e-10, 6) AS x, round(avg(l_tax) + 1e-10, 6) AS y FROM lineitem)
    SELECT {_SERVED_COLUMNS}, round(x * "rawPrediction" + y * sentiment + 0.2::DOUBLE * ("rawPrediction" * sentiment) + 1e-10, 6)
      AS "finalPrediction" FROM served, stored""",
)
def blend_stored_coefficients(spark, sf_dir):
    """Coefficients from a JSON file that lacks the third, for which the default stands in."""
    path = shared_path(spark, "coefficients")
    shares = table(spark, sf_dir, "lineitem").agg(F.avg("l_discount").alias("x"), F.avg("l_tax").alias("y"))
    rounded(shares, ("x", "y")).coalesce(1).write.json(path)
    records = serving.blend_with_coefficients(served(spark, sf_dir), landed.read_coefficients(spark, path))
    return rounded(records, (*_SERVED_ROUNDED, "finalPrediction")).drop("timestamp")


@query(
    "minmax_sentiment",
    f"""WITH {_COMPANY_SCORES} SELECT doc_id, company,
    round((overall_sentiment - (SELECT min(overall_sentiment) FROM company_scores))
      / (SELECT max(overall_sentiment) - min(overall_sentiment) FROM company_scores) + 1e-10, 6) AS normalized_sentiment
    FROM company_scores""",
)
def minmax_sentiment(spark, sf_dir):
    # read twice, for the bounds and for the rows
    scored = hold(company_scores(spark, sf_dir))
    scaled = calibrate.minmax_scaled(scored, "overall_sentiment", "normalized_sentiment")
    return rounded(scaled.select("doc_id", "company", "normalized_sentiment"), ("normalized_sentiment",))


_FIT_PARTS = """m AS (
  SELECT avg(y) AS my, avg(a) AS ma, avg(b) AS mb, var_pop(a) AS vaa, var_pop(b) AS vbb, covar_pop(a, b) AS vab,
         covar_pop(a, y) AS vay, covar_pop(b, y) AS vby, count(*) AS n FROM points),
w AS (SELECT *, (vay * vbb - vby * vab) / (vaa * vbb - vab * vab) AS alpha,
             (vby * vaa - vay * vab) / (vaa * vbb - vab * vab) AS beta FROM m)"""
_FIT_SQL = f"""{_FIT_PARTS}
SELECT round(alpha, 5) AS alpha, round(beta, 5) AS beta, round(my - alpha * ma - beta * mb, 4) AS intercept,
       n AS "rows" FROM w"""


def _rounded_fit(fit):
    return fit.select(
        F.round("alpha", 5).alias("alpha"), F.round("beta", 5).alias("beta"),
        F.round("intercept", 4).alias("intercept"), "rows",
    )


@query(
    "calibrate_blend",
    f"""WITH {_SERVED_SQL}, points AS (SELECT price AS y, "rawPrediction" AS a,
      (sentiment - (SELECT min(sentiment) FROM served)) / (SELECT max(sentiment) - min(sentiment) FROM served) AS b
      FROM served), {_FIT_SQL}""",
)
def calibrate_blend(spark, sf_dir):
    """Weights over all symbols' serving records."""
    return _rounded_fit(calibrate.fit_blend(served(spark, sf_dir)))


@query(
    "calibrate_events",
    f"""WITH points AS (SELECT value AS y, user_id AS a,
      (hour(ts) - (SELECT min(hour(ts)) FROM events)) / (SELECT max(hour(ts)) - min(hour(ts)) FROM events)::DOUBLE AS b
      FROM events), {_FIT_SQL}""",
)
def calibrate_events(spark, sf_dir):
    points = table(spark, sf_dir, "events").select("value", "user_id", F.hour("ts").alias("hour"))
    return _rounded_fit(calibrate.fit_blend(points, "value", "user_id", "hour"))


# the fit without its rounding, and three digits of the blend: its sums run over all rows
_BLENDED_SQL = f"""WITH {_SERVED_SQL}, points AS (SELECT price AS y, "rawPrediction" AS a,
      (sentiment - (SELECT min(sentiment) FROM served)) / (SELECT max(sentiment) - min(sentiment) FROM served) AS b,
      {_SERVED_COLUMNS} FROM served), {_FIT_PARTS}
    SELECT {_SERVED_COLUMNS.replace('round(sentiment + 1e-10, 6) AS ', '')},
      round(alpha * a + beta * b + my - alpha * ma - beta * mb + 1e-7, 3) AS "finalPrediction" FROM points, w"""


def _blended(records, fit):
    blended = rounded(serving.blend_fitted(records, fit), ("sentiment",))
    return rounded(blended, ("finalPrediction",), 3).drop("timestamp")


@query("blend_calibrated", _BLENDED_SQL)
def blend_calibrated(spark, sf_dir):
    """Serving records blended by the least-squares fit over them."""
    records = served(spark, sf_dir)
    return _blended(records, calibrate.fit_blend(records))


@query("blend_stored_fit", _BLENDED_SQL)
def blend_stored_fit(spark, sf_dir):
    """As blend_calibrated, with the fit written as a table and read back."""
    records, path = served(spark, sf_dir), shared_path(spark, "fit")
    calibrate.write_fit(calibrate.fit_blend(records), path)
    return _blended(records, calibrate.read_fit(spark, path))


@query(
    "read_market_json",
    f"""WITH {_SERVED_SQL} SELECT "date", price, symbol, volume, "rawPrediction",
    round(sentiment + 1e-10, 6) AS sentiment, "rawPrediction" * 1 + sentiment * 0.0 AS "finalPrediction" FROM served""",
)
def read_market_json(spark, sf_dir):
    """Serving records written as paged JSON documents and read back."""
    path = shared_path(spark, "market-json")
    landed.export_market_json(served(spark, sf_dir), path, order="timestamp", ties=BAR_TIES)
    return rounded(landed.read_market_json(spark, path), ("sentiment",))


@query(
    "series_arrays",
    f"""WITH {_SERVED_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY symbol
        ORDER BY "timestamp", l_orderkey, l_linenumber, l_partkey, price) - 1 AS k FROM served)
    SELECT symbol, CAST(floor(k / 500) AS BIGINT) AS page, count(*) AS points, string_agg("date", ',' ORDER BY k) AS labels,
      string_agg(CAST(CAST(price AS DECIMAL(18, 8)) AS VARCHAR), ',' ORDER BY k) AS prices,
      string_agg(CAST(volume AS VARCHAR), ',' ORDER BY k) AS volumes FROM r GROUP BY ALL""",
)
def series_arrays(spark, sf_dir):
    """Chart pages, arrays shown as text so that both engines print them alike."""
    pages = serving.chart_pages(served(spark, sf_dir), ties=BAR_TIES, points=500)

    def text(column, kind):
        return F.array_join(F.transform(column, lambda v: v.cast(kind).cast("string")), ",").alias(column)

    return pages.select(
        "symbol", "page", F.size("labels").cast("long").alias("points"), text("labels", "string"),
        text("prices", "decimal(18,8)"), text("volumes", "int"),
    )
