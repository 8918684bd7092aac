"""Queries that send the given tables through encoders, decoders and page flattening."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlens import schemas
from marketlens.plans.catalog import query
from marketlens.plans.views import NEWS, TICKS, news, table, ticks
from marketlens.sources import landed, topics

FETCHED = "2024-02-01 00:00:00"
PAGE_ROWS = 200
FAILED = ("src3", "src11")


@query(
    "encode_bars",
    f"""WITH {TICKS} SELECT event_id, strftime("timestamp", '%Y-%m-%d %H:%M:%S') AS "timestamp", symbol, price, volume
    FROM ticks""",
)
def encode_bars(spark, sf_dir):
    messages = topics.encode_bars(ticks(spark, sf_dir), keep=("event_id",))
    field = lambda name: F.get_json_object("value", f"$.{name}")
    return messages.select(
        "event_id", field("timestamp").alias("timestamp"), field("symbol").alias("symbol"),
        field("price").cast("double").alias("price"), field("volume").cast("double").alias("volume"),
    )


def news_messages(spark, sf_dir):
    full = news(spark, sf_dir).select(
        "doc_id", "title", "description", F.col("company").alias("source"),
        F.concat(F.lit("http://news.example/"), F.col("doc_id").cast("string")).alias("url"),
        "published_at", F.lit(FETCHED).cast("timestamp_ntz").alias("fetch_timestamp"), "company",
    )
    return topics.encode_news(full, F.lit(FETCHED).cast("timestamp_ntz"), keep=("doc_id",))


@query(
    "encode_news_keyed",
    f"""WITH {NEWS} SELECT doc_id, company AS "key", title, company, company AS company_symbol,
      '2024-02-01T00:00:00.000000' AS kafka_timestamp,
      strftime(published_at, '%Y-%m-%dT%H:%M:%S.%f') AS published_at FROM news""",
)
def encode_news_keyed(spark, sf_dir):
    text = F.decode("value", "UTF-8")
    names = ("title", "company", "company_symbol", "kafka_timestamp", "published_at")
    return news_messages(spark, sf_dir).select(
        "doc_id", F.decode("key", "UTF-8").alias("key"), *[F.get_json_object(text, f"$.{n}").alias(n) for n in names]
    )


@query(
    "decode_bars",
    f"""WITH {TICKS} SELECT event_id, date_trunc('second', "timestamp") AS "timestamp", symbol, price, volume FROM ticks""",
)
def decode_bars(spark, sf_dir):
    messages = topics.encode_bars(ticks(spark, sf_dir), keep=("event_id",))
    decoded = topics.decode_bars(messages, keep=("event_id",))
    return decoded.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


@query(
    "decode_news",
    f"""WITH {NEWS} SELECT doc_id, title, description, company AS source,
      concat('http://news.example/', CAST(doc_id AS VARCHAR)) AS url, published_at,
      TIMESTAMP '2024-02-01 00:00:00' AS fetch_timestamp, company FROM news""",
)
def decode_news(spark, sf_dir):
    decoded = topics.decode_news(news_messages(spark, sf_dir), keep=("doc_id",))
    return decoded.withColumns(
        {c: F.col(c).cast("timestamp_ntz") for c in ("published_at", "fetch_timestamp")}
    )


@query(
    "quarantine_bad_rows",
    f"""WITH {TICKS} SELECT event_id, symbol IN ('error', 'view') AS is_bad,
      CASE WHEN symbol IN ('error', 'view') THEN NULL ELSE price END AS price FROM ticks""",
)
def quarantine_bad_rows(spark, sf_dir):
    """Messages of one symbol are cut short, those of another carry a text as price."""
    messages = topics.encode_bars(ticks(spark, sf_dir), keep=("event_id", "symbol"))
    value = F.col("value")
    spoilt = (
        F.when(F.col("symbol") == "error", F.substr(value, F.lit(1), F.length(value) - 1))
        .when(F.col("symbol") == "view", F.regexp_replace(value, r'"price":[^,]*', '"price":"much"'))
        .otherwise(value)
    )
    checked = topics.decode_checked(
        messages.select("event_id", spoilt.alias("value")), schemas.BAR, ("timestamp", "symbol"), keep=("event_id",)
    )
    return checked.select("event_id", "is_bad", F.when(~F.col("is_bad"), F.col("price")).alias("price"))


def article_pages(spark, sf_dir):
    """Documents as raw article pages of up to PAGE_ROWS articles of one company.

    The requests for some companies failed, one of them without a message.
    """
    article = F.struct(
        "title",
        "description",
        F.struct(F.col("company").alias("name")).alias("source"),
        F.concat(F.lit("http://news.example/"), F.col("doc_id").cast("string")).alias("url"),
        F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("publishedAt"),
    )
    page = F.floor(F.col("doc_id") / PAGE_ROWS)
    # ids are unique, so a page holds at most PAGE_ROWS articles
    pages = news(spark, sf_dir).groupBy("company", page.alias("page")).agg(F.collect_list(article).alias("articles"))
    failed = F.col("company").isin(*FAILED)
    return pages.select(
        "company", "page", F.when(failed, "error").otherwise("ok").alias("status"),
        F.when(F.col("company") == FAILED[0], "limit reached").alias("message"), "articles",
    )


_PAGE = f"CAST(floor(doc_id / {PAGE_ROWS}) AS BIGINT)"


@query(
    "flatten_articles",
    f"""WITH {NEWS} SELECT title, description, company AS source,
      concat('http://news.example/', CAST(doc_id AS VARCHAR)) AS url, published_at,
      TIMESTAMP '2024-02-01 00:00:00' AS fetch_timestamp, company FROM news WHERE company NOT IN {FAILED}""",
)
def flatten_articles(spark, sf_dir):
    flat = landed.flatten_articles(
        article_pages(spark, sf_dir), fetched_at=F.lit(FETCHED).cast("timestamp_ntz")
    )
    return flat.withColumn("published_at", F.col("published_at").cast("timestamp_ntz"))


@query(
    "reject_bad_pages",
    f"""WITH {NEWS} SELECT company, {_PAGE} AS page, 'error' AS status,
      CASE WHEN company = '{FAILED[0]}' THEN 'limit reached' ELSE 'Unknown error' END AS reason, count(*) AS articles
    FROM news WHERE company IN {FAILED} GROUP BY ALL""",
)
def reject_bad_pages(spark, sf_dir):
    rejected = landed.rejected_pages(article_pages(spark, sf_dir))
    return rejected.select("company", "page", "status", "reason", F.size("articles").cast("long").alias("articles"))


@query(
    "articles_per_company",
    f"""WITH {NEWS} SELECT listed AS company,
      count(doc_id) FILTER (WHERE company NOT IN {FAILED}) AS articles
    FROM (SELECT DISTINCT source AS listed FROM documents WHERE source IS NOT NULL) LEFT JOIN news ON company = listed
    GROUP BY ALL""",
)
def articles_per_company(spark, sf_dir):
    """Every company of the documents with its count, those of failed pages with none included."""
    listed = table(spark, sf_dir, "documents").select(F.col("source").alias("company"))
    companies = listed.filter(F.col("company").isNotNull()).distinct()
    flat = landed.flatten_articles(article_pages(spark, sf_dir))
    return landed.articles_by_company(companies, flat)
