"""Files that feed the engine: article pages, price downloads, JSON documents, scored parquet."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens import schemas
from marketlens.functions import columns as C
from marketlens.operators.segments import ROWS_PER_SEGMENT, number_rows

# Defaults of the blend coefficients and the company list.
DEFAULT_COEFFICIENTS = {"x": 0.5, "y": 0.3, "z": 0.2}
COMPANIES = (
    ("AAPL", "Apple Inc."),
    ("MSFT", "Microsoft Corporation"),
    ("GOOGL", "Alphabet Inc."),
    ("AMZN", "Amazon.com Inc."),
    ("META", "Meta Platforms Inc."),
    ("NVDA", "NVIDIA Corporation"),
    ("TSLA", "Tesla Inc."),
    ("JPM", "JPMorgan Chase & Co."),
)
DASHBOARD_COMPANIES = COMPANIES[:4]


def _read_or_empty(reader, path: str, schema: T.StructType, spark: SparkSession) -> DataFrame:
    try:
        return reader.json(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def good_pages(pages: DataFrame) -> DataFrame:
    return pages.filter(F.col("status") == "ok")


def rejected_pages(pages: DataFrame) -> DataFrame:
    """Pages with any status but ``ok``, a missing one included, with a reason."""
    return pages.filter(~F.col("status").eqNullSafe("ok")).withColumn(
        "reason", F.coalesce("message", F.lit("Unknown error"))
    )


def flatten_articles(pages: DataFrame, company: str = "company", fetched_at: Column | None = None) -> DataFrame:
    """One row per article of the good pages; absent fields are null."""
    fetched = F.current_timestamp() if fetched_at is None else fetched_at
    one = good_pages(pages).select(company, F.explode("articles").alias("a"))
    return one.select(
        F.col("a.title").alias("title"),
        F.col("a.description").alias("description"),
        F.col("a.source.name").alias("source"),
        F.col("a.url").alias("url"),
        F.col("a.publishedAt").try_cast("timestamp").alias("published_at"),
        fetched.alias("fetch_timestamp"),
        F.col(company).alias("company"),
    )


def articles_by_company(companies: DataFrame, articles: DataFrame) -> DataFrame:
    """Article count of every listed company, 0 where none arrived."""
    counts = articles.groupBy("company").agg(F.count(F.lit(1)).alias("n"))
    return companies.join(counts, "company", "left").select(
        *companies.columns, F.coalesce("n", F.lit(0)).alias("articles")
    )


def normalise_ohlcv(
    downloads: DataFrame, symbol: Column, ts: str = "Datetime", source_zone: str | None = None,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Price downloads as bars: close becomes price, the time becomes text.

    The downloads carry wall-clock times; ``source_zone`` turns them into UTC.
    """
    at = F.col(ts) if source_zone is None else C.zone_to_utc(ts, source_zone)
    return downloads.select(
        *keep,
        C.wire_time(at).alias("timestamp"),
        symbol.alias("symbol"),
        F.col("Close").cast("double").alias("price"),
        F.col("Volume").cast("double").alias("volume"),
    )


def stream_scored_files(spark: SparkSession, path: str, **options) -> DataFrame:
    """Unbounded frame of the prediction files in a folder."""
    return spark.readStream.schema(schemas.PREDICTION_FILE).options(**options).parquet(path)


def read_market_json(
    spark: SparkSession, path: str, record: T.StructType = schemas.SERVING_RECORD, one_document: bool = False
) -> DataFrame:
    """Records below ``data`` of JSON documents; empty when the path does not exist.

    By default each line is a document, which splits over tasks.
    ``one_document`` reads a single pretty-printed file.
    """
    envelope = T.StructType([T.StructField("data", T.ArrayType(record))])
    reader = spark.read.schema(envelope).option("multiLine", one_document)
    documents = _read_or_empty(reader, path, envelope, spark)
    return documents.select(F.explode("data").alias("d")).select("d.*")


def market_documents(
    served: DataFrame, order: str = "date", ties: tuple[str, ...] = (), records: int = 1000,
    rows_per_segment: int = ROWS_PER_SEGMENT,
) -> DataFrame:
    """Serving records as JSON documents of up to ``records`` records of one symbol."""
    fields = schemas.SERVING_RECORD.fieldNames()
    ranked = number_rows(served, ["symbol"], [order, *ties], "__rank", "__size", rows_per_segment)
    page = F.floor((F.col("__rank") - 1) / records)
    grouped = ranked.groupBy("symbol", page.alias("page")).agg(
        F.array_sort(F.collect_list(F.struct("__rank", *fields))).alias("__rows")
    )
    data = F.transform("__rows", lambda r: F.struct(*[r[f].alias(f) for f in fields]))
    return grouped.select("symbol", "page", F.struct(F.lit("success").alias("status"), data.alias("data")).alias("d"))


def export_market_json(served: DataFrame, path: str, **paging) -> None:
    """Write serving records as one JSON document per line."""
    market_documents(served, **paging).select("d.*").write.mode("overwrite").json(path)


def read_coefficients(spark: SparkSession, path: str | None = None) -> DataFrame:
    """One row of blend coefficients; defaults stand in for a missing file or field."""
    stored = (
        spark.createDataFrame([], schemas.COEFFICIENTS)
        if path is None
        else _read_or_empty(
            spark.read.schema(schemas.COEFFICIENTS).option("multiLine", True), path, schemas.COEFFICIENTS, spark
        )
    )
    # a global aggregate has one row even over no input
    return stored.agg(
        *[F.coalesce(F.first(c, ignorenulls=True), F.lit(d)).alias(c) for c, d in DEFAULT_COEFFICIENTS.items()]
    )


def company_dimension(spark: SparkSession, rows=COMPANIES) -> DataFrame:
    return spark.createDataFrame(list(rows), schemas.COMPANY)
