"""A raw layer that keeps every field: messages as variants, late extraction, and a report of schema drift.

Decoders with a fixed schema lose what it does not name. Here a message is
parsed once, stored whole, and a field can be taken out when someone asks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BODY, REASON, REJECTED = "body", "reason", "rejected"
_OBJECT = r"^OBJECT\b"


def json_kind(value: Column) -> Column:
    """What JSON calls a variant: object, array, string, number, boolean or null; a null column has none."""
    shape = F.schema_of_variant(value)
    return (
        F.when(shape.rlike(_OBJECT), "object").when(shape.startswith("ARRAY"), "array")
        .when(shape == "STRING", "string").when(shape == "BOOLEAN", "boolean").when(shape == "VOID", "null")
        .when(value.isNotNull(), "number")
    )


def _declared_kind(kind: T.DataType) -> str:
    if isinstance(kind, T.NumericType):
        return "number"
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, T.ArrayType):
        return "array"
    return "object" if isinstance(kind, (T.StructType, T.MapType)) else "string"  # times and dates travel as texts


def _whole(text: Column) -> Column:
    """The text as a variant, null unless it is one JSON value from end to end.

    The parser stops behind the first value and takes no notice of the rest.
    Within a list, a rest has to begin with a comma, which gives a second
    element, or a bracket; within an object the latter is an error.
    """
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    named = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    alone = named.isNotNull() & F.variant_get(listed, "$[1]", "variant").isNull()
    return F.when(alone, F.variant_get(listed, "$[0]", "variant"))


def read_raw(messages: DataFrame, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """The messages in ``value`` as variants in ``body``, and those that are none with ``rejected`` and a ``reason``.

    Reasons are ``empty`` (null or blank), ``malformed`` (no JSON, more behind
    it, or a name that stands twice in an object) and ``no object``. ``keep`` are columns of
    the messages that both frames have.
    """
    text = F.col("value").cast("string")
    parsed = messages.select(*keep, text.alias(REJECTED), _whole(text).alias(BODY))
    reason = (
        F.when(F.coalesce(F.trim(REJECTED), F.lit("")) == "", "empty")
        .when(F.col(BODY).isNull(), "malformed")
        .when(~F.schema_of_variant(BODY).rlike(_OBJECT), "no object")
    )
    judged = parsed.withColumn(REASON, reason)
    good = judged.filter(F.col(REASON).isNull()).select(*keep, BODY)
    return good, judged.filter(F.col(REASON).isNotNull()).select(*keep, REJECTED, REASON)


def extract(raw: DataFrame, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """``raw`` with further columns: name to path (``$.a.b[0]``) and type; null where a value is absent or does not fit."""
    return raw.withColumns({n: F.try_variant_get(BODY, path, kind) for n, (path, kind) in fields.items()})


def fields_of(raw: DataFrame, *by: str) -> DataFrame:
    """Messages per top-level ``field`` and JSON ``kind`` (and per ``by``): ``messages``.

    Counted within the map tasks first; what is shuffled is as short as there
    are fields. Names are told apart by case.
    """
    spark = raw.sparkSession
    each = raw.lateralJoin(spark.tvf.variant_explode(F.col(BODY).outer()))
    return each.groupBy(*by, F.col("key").alias("field"), json_kind(F.col("value")).alias("kind")).agg(
        F.count(F.lit(1)).alias("messages"))


def schema_drift(raw: DataFrame, declared: T.StructType) -> DataFrame:
    """How the messages depart from a schema: ``field``, ``kind``, ``messages``, ``declared_kind``, ``drift``.

    ``drift`` is ``new`` for a field that the schema lacks, ``other kind`` for
    a value that is neither null nor of the declared kind, ``missing`` for a
    declared field that messages lack (kind null), and null for what is as
    declared. Fields that occur nowhere are missing in all messages; without
    messages the report is empty.
    """
    spark: SparkSession = raw.sparkSession
    shape = spark.createDataFrame([(f.name, _declared_kind(f.dataType)) for f in declared], "field string, declared_kind string")
    seen = fields_of(raw)
    # the schema is as short as it was written down
    told = seen.join(F.broadcast(shape), "field", "left").withColumn(
        "drift",
        F.when(F.col("declared_kind").isNull(), "new").when(~F.col("kind").isin("null") & (F.col("kind") != F.col("declared_kind")), "other kind"))
    total = raw.agg(F.count(F.lit(1)).alias("n")).scalar()
    having = seen.groupBy("field").agg(F.sum("messages").alias("__had"))
    lacking = (
        shape.join(having, "field", "left").withColumn("messages", total - F.coalesce("__had", F.lit(0)))
        .filter("messages > 0").withColumns({"kind": F.lit(None).cast("string"), "drift": F.lit("missing")})
    )
    shown = ("field", "kind", "messages", "declared_kind", "drift")
    return told.select(*shown).unionByName(lacking.select(*shown))
