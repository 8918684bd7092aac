"""Message topics: reading, decoding, encoding, writing.

Decoders and encoders work on any frame with a ``value`` column, batch or
streaming; only the two ends need the Kafka connector on the class path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens import schemas
from marketlens.functions import columns as C

# Topic names.
BAR_TOPIC = "stock_data"
NEWS_TOPIC = "stock_news"

CORRUPT = "_corrupt"


def read_topic(
    spark: SparkSession, servers: str, topic: str, starting_offsets: str = "latest", **options
) -> DataFrame:
    """Unbounded frame of a topic's messages."""
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", starting_offsets)
    )
    return reader.options(**options).load()


def write_topic(messages: DataFrame, servers: str, topic: str) -> None:
    """Send ``value`` (and ``key``) of a batch frame, in parallel from the executors."""
    (
        messages.write.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("topic", topic)
        .save()
    )


def decode(messages: DataFrame, schema: T.StructType, keep: tuple[str, ...] = ()) -> DataFrame:
    """JSON in ``value`` as columns of ``schema``.

    Fields outside the schema are ignored; a message that is no JSON object
    gives a row of nulls.
    """
    record = F.from_json(F.col("value").cast("string"), schema).alias("record")
    return messages.select(*keep, record).select(*keep, "record.*")


def decode_bars(messages: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    return decode(messages, schemas.BAR, keep)


def decode_news(messages: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    return decode(messages, schemas.NEWS, keep)


def decode_checked(
    messages: DataFrame, schema: T.StructType, required: tuple[str, ...], keep: tuple[str, ...] = ()
) -> DataFrame:
    """As :func:`decode`, plus ``is_bad`` and the message text of bad rows.

    Bad rows are those that do not parse under the schema, and those without a
    required field.
    """
    checked = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    raw = F.col("value").cast("string")
    record = F.from_json(raw, checked, {"columnNameOfCorruptRecord": CORRUPT})
    absent = F.lit(False)
    for name in required:
        absent = absent | F.col(f"record.{name}").isNull()
    bad = F.col("record").isNull() | F.col(f"record.{CORRUPT}").isNotNull() | absent
    return (
        messages.select(*keep, raw.alias("raw"), record.alias("record"))
        .withColumn("is_bad", bad)
        .select(
            *keep,
            *[F.col(f"record.{f}").alias(f) for f in schema.fieldNames()],
            "is_bad",
            F.when(F.col("is_bad"), F.col("raw")).alias("rejected"),
        )
    )


def quarantine(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows and rejected messages of :func:`decode_checked`."""
    good = checked.filter(~F.col("is_bad")).drop("is_bad", "rejected")
    return good, checked.filter("is_bad").drop("is_bad")


def encode_bars(bars: DataFrame, ts: str = "timestamp", keep: tuple[str, ...] = ()) -> DataFrame:
    """Bars as JSON messages without a key; the time is text to the second."""
    body = F.struct(
        C.wire_time(ts).alias("timestamp"),
        F.col("symbol"),
        F.col("price").cast("double").alias("price"),
        F.col("volume").cast("double").alias("volume"),
    )
    return bars.select(*keep, F.to_json(body).alias("value"))


def encode_news(news: DataFrame, sent_at: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Articles as UTF-8 JSON messages keyed by company.

    Messages of one company go to one topic partition and keep their order.
    ``sent_at`` defaults to the current time and is a parameter for tests.
    """
    sent = F.current_timestamp() if sent_at is None else sent_at
    body = F.struct(
        "title",
        "description",
        "source",
        "url",
        F.date_format("published_at", C.ISO_TIME_FORMAT).alias("published_at"),
        F.date_format("fetch_timestamp", C.ISO_TIME_FORMAT).alias("fetch_timestamp"),
        "company",
        F.date_format(sent, C.ISO_TIME_FORMAT).alias("kafka_timestamp"),
        F.col("company").alias("company_symbol"),
    )
    return news.select(
        *keep,
        F.encode("company", "UTF-8").alias("key"),
        F.encode(F.to_json(body), "UTF-8").alias("value"),
    )
