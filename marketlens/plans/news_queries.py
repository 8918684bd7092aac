"""Queries over articles: cleaning, scoring, statistics, ranking, filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlens.functions import columns as C
from marketlens.operators import sentiment, upsert
from marketlens.operators.lookup import lookup_join
from marketlens.operators.segments import number_rows
from marketlens.plans.catalog import query
from marketlens.plans.tick_queries import rounded, settled
from marketlens.plans.views import NEWS, NEWS_START, SCORED, lexicon, news
from marketlens.streaming import jobs, windows

KEY = ("doc_id",)
_SCORES = ("title_sentiment", "description_sentiment", "overall_sentiment")
# articles of the fixture name invented words, so frequent ones stand in
TERMS = ("the", "with", "from")
_FORTNIGHT = 14 * 24 * 60
PHRASES = ("and", "for", "that", "are", "this")


def scored_articles(spark, sf_dir, carry=("company",)):
    """Scores without the texts: one short row per article."""
    return sentiment.with_overall(sentiment.score_articles(news(spark, sf_dir), lexicon(spark), KEY, carry=carry))


@query(
    "clean_text",
    f"WITH {NEWS} SELECT doc_id, lower(trim(regexp_replace(text, '[ \\t\\n\\f\\r\\x0b]+', ' ', 'g'))) AS cleaned FROM news",
)
def clean_text(spark, sf_dir):
    return news(spark, sf_dir).select("doc_id", C.clean_text("text").alias("cleaned"))


@query(
    "sentiment_score",
    f"WITH {SCORED} SELECT doc_id, round(description_sentiment + 1e-10, 6) AS sentiment FROM scored",
)
def sentiment_score(spark, sf_dir):
    scores = sentiment.score_articles(news(spark, sf_dir), lexicon(spark), KEY, ["description"])
    return scores.select("doc_id", settled("description_sentiment").alias("sentiment"))


@query(
    "sentiment_two_fields",
    f"""WITH {SCORED} SELECT doc_id, round(title_sentiment + 1e-10, 6) AS title_sentiment,
    round(description_sentiment + 1e-10, 6) AS description_sentiment FROM scored""",
)
def sentiment_two_fields(spark, sf_dir):
    return rounded(sentiment.score_articles(news(spark, sf_dir), lexicon(spark), KEY), _SCORES)


@query(
    "sentiment_overall",
    f"WITH {SCORED} SELECT doc_id, company, round(overall_sentiment + 1e-10, 6) AS overall_sentiment FROM scored",
)
def sentiment_overall(spark, sf_dir):
    return rounded(scored_articles(spark, sf_dir).select("doc_id", "company", "overall_sentiment"), _SCORES)


@query("sentiment_label", f"WITH {SCORED} SELECT doc_id, company, sentiment_label FROM scored")
def sentiment_label(spark, sf_dir):
    return scored_articles(spark, sf_dir).select("doc_id", "company", "sentiment_label")


_STATS_SQL = """round(avg(overall_sentiment) + 1e-10, 6) AS avg_sentiment, count(*) AS article_count,
    round(avg(CASE WHEN sentiment_label = 'positive' THEN 1.0 ELSE 0.0 END) + 1e-10, 6) AS positive_ratio,
    round(avg(CASE WHEN sentiment_label = 'negative' THEN 1.0 ELSE 0.0 END) + 1e-10, 6) AS negative_ratio"""
_STATS = ("avg_sentiment", "positive_ratio", "negative_ratio")


@query("agg_company_sentiment", f"WITH {SCORED} SELECT company, {_STATS_SQL} FROM scored GROUP BY company")
def agg_company_sentiment(spark, sf_dir):
    return rounded(sentiment.company_statistics(scored_articles(spark, sf_dir)), _STATS)


def _ranked_titles(spark, sf_dir, ranked):
    """Titles of the few ranked articles; the rank itself ran on scores alone."""
    titles = news(spark, sf_dir).select("doc_id", "title")
    # bounded: `ranked` has a fixed number of rows
    return rounded(titles.join(F.broadcast(ranked.drop("title")), "doc_id"), ("overall_sentiment",))


@query(
    "top_positive",
    f"""WITH {SCORED} SELECT doc_id, company, title, round(overall_sentiment + 1e-10, 6) AS overall_sentiment FROM scored
    ORDER BY round(scored.overall_sentiment + 1e-13, 9) DESC NULLS LAST, doc_id LIMIT 3""",
)
def top_positive(spark, sf_dir):
    return _ranked_titles(spark, sf_dir, sentiment.most_positive(_for_rank(spark, sf_dir), ties=KEY))


@query(
    "top_negative",
    f"""WITH {SCORED} SELECT doc_id, company, title, round(overall_sentiment + 1e-10, 6) AS overall_sentiment FROM scored
    ORDER BY round(scored.overall_sentiment + 1e-13, 9) ASC NULLS LAST, doc_id LIMIT 3""",
)
def top_negative(spark, sf_dir):
    return _ranked_titles(spark, sf_dir, sentiment.most_negative(_for_rank(spark, sf_dir), ties=KEY))


def _for_rank(spark, sf_dir):
    # sums of doubles depend on their order in the last digits; rounding keeps ties ties
    return scored_articles(spark, sf_dir).select(
        "doc_id", "company", settled("overall_sentiment", 9).alias("overall_sentiment"), F.lit("").alias("title")
    )


@query(
    "topn_articles_per_company",
    f"""WITH {NEWS}, r AS (SELECT *, row_number() OVER (PARTITION BY company ORDER BY published_at DESC, doc_id) AS rn
      FROM news) SELECT doc_id, company, title, published_at FROM r WHERE rn <= 5""",
)
def topn_articles_per_company(spark, sf_dir):
    articles = news(spark, sf_dir).select("doc_id", "company", "title", "published_at")
    return sentiment.newest_per_company(articles, 5, ties=KEY)


@query(
    "filter_relevant_articles",
    f"""WITH {NEWS}, phrased AS (SELECT *, list_extract({list(PHRASES)!r},
        CAST(substr(company, 4) AS INTEGER) % {len(PHRASES)} + 1) AS phrase
      FROM (SELECT * REPLACE (TIMESTAMP '2024-01-01 00:00:00' + to_minutes((doc_id * 37) % {_FORTNIGHT}) AS published_at)
            FROM news))
    SELECT doc_id, company, published_at FROM phrased
    WHERE published_at >= DATE '2024-01-10' - 7 AND published_at < DATE '2024-01-10' + 1 AND lang = 'en'
      AND contains(lower(text), lower(phrase))
      AND regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{N}}_])({"|".join(TERMS)})([^\\p{{L}}\\p{{N}}_]|$)')""",
)
def filter_relevant_articles(spark, sf_dir):
    number = F.substr("company", F.lit(4)).try_cast("int")
    phrase = F.element_at(F.array(*map(F.lit, PHRASES)), number % len(PHRASES) + 1)
    # over two weeks at any scale, so that both ends of the window cut
    minutes = F.pmod(F.col("doc_id") * 37, F.lit(_FORTNIGHT)).cast("int")
    at = F.lit(NEWS_START).cast("timestamp_ntz") + F.make_dt_interval(mins=minutes)
    articles = news(spark, sf_dir).withColumns({"phrase": phrase, "published_at": at})
    kept = sentiment.relevant_articles(articles, "2024-01-10", phrase="phrase", terms=TERMS)
    return kept.select("doc_id", "company", "published_at")


_SENTIMENT_COLUMNS = """company, published_at AS "timestamp", description,
    round(CAST(round(description_sentiment + 1e-13, 9)::FLOAT AS DOUBLE) + 1e-10, 6) AS description_sentiment,
    round(CAST(round(overall_sentiment + 1e-13, 9)::FLOAT AS DOUBLE) + 1e-10, 6) AS overall_sentiment, sentiment_label, title,
    round(CAST(round(title_sentiment + 1e-13, 9)::FLOAT AS DOUBLE) + 1e-10, 6) AS title_sentiment"""


def _as_doubles(df):
    return rounded(df.select(*[F.col(c).cast("double").alias(c) if c in _SCORES else c for c in df.columns]), _SCORES)


@query(
    "upsert_sentiment",
    f"""WITH {SCORED}, r AS (SELECT *, date_trunc('hour', published_at) AS fetched,
        row_number() OVER (PARTITION BY company, date_trunc('hour', published_at) ORDER BY doc_id DESC) AS rn FROM scored)
    SELECT {_SENTIMENT_COLUMNS.replace('published_at AS', 'fetched AS')} FROM r WHERE rn = 1""",
)
def upsert_sentiment(spark, sf_dir):
    """One fetch per hour, so articles of a company and hour overwrite each other."""
    fetched = news(spark, sf_dir).withColumn(
        "fetch_timestamp", F.date_trunc("hour", "published_at").cast("timestamp_ntz")
    )
    # the surviving version is known before scoring, so only its text is scored
    newest = upsert.latest_per_key(
        fetched.select("company", "fetch_timestamp", "doc_id"), ["company", "fetch_timestamp"], ["doc_id"]
    )
    surviving = lookup_join(fetched.drop("text"), newest.select("doc_id"), ["doc_id"], "left_semi")
    scored = sentiment.score_news(surviving, lexicon(spark))
    return _as_doubles(upsert.sentiment_rows(_nine_digits(scored)))


def _nine_digits(scored):
    return rounded(scored, _SCORES, 9)


@query("news_job", f"WITH {SCORED} SELECT doc_id, {_SENTIMENT_COLUMNS} FROM scored")
def news_job(spark, sf_dir):
    """Rows the news job stores for one batch."""
    result = jobs.news_result(news(spark, sf_dir).drop("text"), lexicon(spark), KEY)
    return _as_doubles(upsert.sentiment_rows(_nine_digits(result.scored), "published_at", extra=KEY))


@query(
    "window_sentiment",
    f"""WITH {SCORED} SELECT time_bucket(INTERVAL '1 hour', published_at) AS window_start,
    time_bucket(INTERVAL '1 hour', published_at) + INTERVAL '1 hour' AS window_end, company,
    round(avg(overall_sentiment) + 1e-10, 6) AS avg_sentiment, count(*) AS article_count FROM scored GROUP BY ALL""",
)
def window_sentiment(spark, sf_dir):
    scored = scored_articles(spark, sf_dir, ("company", "published_at"))
    return rounded(windows.sentiment_windows(scored), ("avg_sentiment",))


@query(
    "rank_articles_by_text",
    f"""WITH {NEWS} SELECT company, doc_id,
      row_number() OVER (PARTITION BY company ORDER BY description NULLS FIRST, doc_id NULLS FIRST) AS "rank",
      count(*) OVER (PARTITION BY company) AS articles
    FROM news""",
)
def rank_articles_by_text(spark, sf_dir):
    """Articles of a company in the order of their texts; companies with many are cut along the texts."""
    texts = news(spark, sf_dir).select("company", "doc_id", "description")
    return number_rows(
        texts, ["company"], ["description", "doc_id"], size="articles", rows_per_segment=10, without=["description"])
