"""The given tables in the shapes of bars, news and predictions, with SQL twins.

Timestamps stay without a zone here, as they are stored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens import schemas

# Test lexicon (word, polarity, subjectivity), start of the news
# clock, and the tick symbols' companies; one symbol stays without a company.
LEXICON = (
    ("the", 0.1, 0.2),
    ("and", -0.3, 0.5),
    ("worthless", -0.8, 0.9),
    ("is", 0.4, 0.6),
    ("des", -0.2, 0.4),
    ("best", 1.0, 0.3),
    ("stupid", -0.8, 1.0),
    ("idiot", -0.8, 0.8),
)
NEWS_START = "2024-01-01 00:00:00"
TICK_COMPANIES = (("click", "src0"), ("error", "src1"), ("purchase", "src2"), ("signup", "src3"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("event_type").alias("symbol"),
        F.col("ts").alias("timestamp"),
        F.col("value").alias("price"),
        F.get_json_object("props", "$.k").try_cast("double").alias("volume"),
    )


TICKS = """ticks AS (
  SELECT event_id, event_type AS symbol, ts AS "timestamp", value AS price,
         TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS volume
  FROM events)"""


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with real key collisions; ``VERSION`` orders the copies of a key."""
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("symbol"),
        F.col("l_shipdate").alias("timestamp"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("volume"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount")) / F.col("l_quantity")).alias("prediction"),
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
    )


VERSION = ("l_orderkey", "l_linenumber", "l_partkey", "price")
BARS = """bars AS (
  SELECT concat('S', CAST(l_suppkey AS VARCHAR)) AS symbol, l_shipdate AS "timestamp",
         l_extendedprice / l_quantity AS price, l_quantity AS volume,
         l_extendedprice * (1 - l_discount) / l_quantity AS prediction,
         l_orderkey, l_linenumber, l_partkey
  FROM lineitem)"""
VERSION_DESC = "l_orderkey DESC, l_linenumber DESC, l_partkey DESC, price DESC"


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    title = F.split_part(text, F.lit("\n"), F.lit(1))
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.col("source").alias("company"),
        "lang",
        "text",
        title.alias("title"),
        F.substr(text, F.length(title) + 2).alias("description"),
        (
            F.lit(NEWS_START).cast("timestamp_ntz")
            + F.make_dt_interval(mins=F.col("doc_id").cast("int"))
        ).alias("published_at"),
    )


NEWS = """news AS (
  SELECT doc_id, source AS company, lang, text,
         split_part(text, chr(10), 1) AS title,
         substr(text, length(split_part(text, chr(10), 1)) + 2) AS description,
         TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) AS published_at
  FROM documents)"""


def lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LEXICON), schemas.LEXICON)


LEXICON_SQL = (
    "lexicon(word, polarity, subjectivity) AS (VALUES "
    + ", ".join(f"('{w}', {p}::DOUBLE, {s}::DOUBLE)" for w, p, s in LEXICON)
    + ")"
)

_PART_SCORE = """SELECT n.doc_id,
       CASE WHEN any_value(n.{part}) IS NULL THEN NULL
            ELSE coalesce(avg(l.polarity) * (0.5 + 0.5 * avg(l.subjectivity)), 0.0) END AS score
  FROM (SELECT doc_id, {part}, unnest(list_append(regexp_extract_all(lower({part}), '\\p{{L}}+'), '')) AS word
        FROM news) n
  LEFT JOIN lexicon l ON l.word = n.word
  GROUP BY n.doc_id"""

# news with both scores, the overall score and the label
SCORED = (
    f"{NEWS},\n{LEXICON_SQL},\n"
    f"title_scores AS ({_PART_SCORE.format(part='title')}),\n"
    f"description_scores AS ({_PART_SCORE.format(part='description')}),\n"
    """both_scores AS (
  SELECT n.*, t.score AS title_sentiment, d.score AS description_sentiment,
         (t.score + d.score) / 2 AS overall_sentiment
  FROM news n JOIN title_scores t USING (doc_id) JOIN description_scores d USING (doc_id)),
scored AS (
  SELECT *, CASE WHEN overall_sentiment >= 0.1 THEN 'positive'
                 WHEN overall_sentiment <= -0.1 THEN 'negative' ELSE 'neutral' END AS sentiment_label
  FROM both_scores)"""
)


def company_symbol(company: Column) -> Column:
    """Bar symbol of a news company: ``src7`` is ``S7``."""
    return F.concat(F.lit("S"), F.substr(company, F.lit(4)))


def tick_companies(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TICK_COMPANIES), "symbol string, company string")


TICK_COMPANIES_SQL = (
    "tick_companies(symbol, company) AS (VALUES " + ", ".join(f"('{s}', '{c}')" for s, c in TICK_COMPANIES) + ")"
)
