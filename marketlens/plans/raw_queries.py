"""The raw layer over the events: messages that gained fields, lost one, or broke off."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens import schemas
from marketlens.plans.catalog import query
from marketlens.plans.views import table
from marketlens.session import shared_path
from marketlens.sources import raw

# Every 13th message breaks off, every 17th is a list; every 7th has a field that the schema lacks, every 5th has its
# price as text, and every 9th has no volume.
_GOOD = "event_id % 13 <> 4 AND event_id % 17 <> 6"


def messages(spark, sf_dir):
    """Bars on the wire, each with the event's properties as an object, and their faults."""
    n = F.col("event_id")
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", "ts", "value", "props")
    parts = [
        F.concat(F.lit('"timestamp":"'), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit('"')),
        F.concat(F.lit('"symbol":"'), "event_type", F.lit('"')),
        F.concat(F.lit('"price":'), F.when(n % 5 == 2, F.concat(F.lit('"'), F.col("value").cast("string"), F.lit('"'))).otherwise(
            F.col("value").cast("string"))),
        F.when(n % 9 != 1, F.concat(F.lit('"volume":'), F.get_json_object("props", "$.k"))),
        F.when(n % 7 == 3, F.concat(F.lit('"venue":"v'), (n % 4).cast("string"), F.lit('"'))),
        F.concat(F.lit('"props":'), "props"),
    ]
    whole = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    value = F.when(n % 13 == 4, F.substr(whole, F.lit(1), F.length(whole) - 1)).when(
        n % 17 == 6, F.concat(F.lit("["), whole, F.lit("]"))).otherwise(whole)
    return rows.select("event_id", value.alias("value"))


def stored_raw(spark, sf_dir):
    """The good messages, written as variants and read back."""
    good, _ = raw.read_raw(messages(spark, sf_dir), ("event_id",))
    path = shared_path(spark, "raw")
    good.write.parquet(path)
    return spark.read.schema(T.StructType([good.schema["event_id"], good.schema[raw.BODY]])).parquet(path)


@query(
    "raw_extraction",
    f"""SELECT event_id, event_type AS symbol, CASE WHEN event_id % 7 = 3 THEN concat('v', event_id % 4) END AS venue,
    CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, value AS price FROM events WHERE {_GOOD}""",
)
def raw_extraction(spark, sf_dir):
    """Fields that the schema of bars does not name, taken from the stored messages."""
    found = raw.extract(stored_raw(spark, sf_dir), {
        "symbol": ("$.symbol", "string"), "venue": ("$.venue", "string"), "k": ("$.props.k", "long"), "price": ("$.price", "double")})
    return found.drop(raw.BODY)


@query(
    "raw_quarantine",
    """SELECT event_id, CASE WHEN event_id % 13 = 4 THEN 'malformed' ELSE 'no object' END AS reason FROM events
    WHERE event_id % 13 = 4 OR event_id % 17 = 6""",
)
def raw_quarantine(spark, sf_dir):
    _, bad = raw.read_raw(messages(spark, sf_dir), ("event_id",))
    return bad.select("event_id", "reason")


@query(
    "schema_drift",
    f"""WITH good AS (SELECT * FROM events WHERE {_GOOD}),
    told AS (
      SELECT 'timestamp' AS field, 'string' AS kind, 'string' AS declared_kind, NULL AS drift FROM good
      UNION ALL SELECT 'symbol', 'string', 'string', NULL FROM good
      UNION ALL SELECT 'price', CASE WHEN event_id % 5 = 2 THEN 'string' ELSE 'number' END, 'number',
        CASE WHEN event_id % 5 = 2 THEN 'other kind' END FROM good
      UNION ALL SELECT 'volume', CASE WHEN event_id % 9 <> 1 THEN 'number' END, 'number',
        CASE WHEN event_id % 9 = 1 THEN 'missing' END FROM good
      UNION ALL SELECT 'venue', 'string', NULL, 'new' FROM good WHERE event_id % 7 = 3
      UNION ALL SELECT 'props', 'object', NULL, 'new' FROM good)
    SELECT field, kind, declared_kind, drift, count(*) AS messages FROM told GROUP BY ALL""",
)
def schema_drift(spark, sf_dir):
    """What the messages have that the schema of bars lacks, and the other way round."""
    return raw.schema_drift(stored_raw(spark, sf_dir), schemas.BAR)
