"""Declared record shapes. Field names and types are fixed by the wire formats."""

from __future__ import annotations

from pyspark.sql import types as T

BAR = T.StructType(
    [
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("symbol", T.StringType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("volume", T.DoubleType()),
    ]
)

NEWS = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("published_at", T.TimestampType()),
        T.StructField("fetch_timestamp", T.TimestampType()),
        T.StructField("company", T.StringType()),
    ]
)

ARTICLE = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("source", T.StructType([T.StructField("name", T.StringType())])),
        T.StructField("url", T.StringType()),
        T.StructField("publishedAt", T.StringType()),
    ]
)

ARTICLE_PAGE = T.StructType(
    [
        T.StructField("status", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("articles", T.ArrayType(ARTICLE)),
    ]
)

# the file variant of a prediction carries no volume
PREDICTION_FILE = T.StructType(
    [
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("symbol", T.StringType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("prediction", T.DoubleType()),
    ]
)

# fixed shapes of the two result tables
PREDICTION = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("prediction", T.FloatType()),
        T.StructField("price", T.FloatType()),
        T.StructField("volume", T.IntegerType()),
    ]
)

STORED_NEWS = T.StructType(
    [
        T.StructField("company", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("description", T.StringType()),
        T.StructField("description_sentiment", T.FloatType()),
        T.StructField("overall_sentiment", T.FloatType()),
        T.StructField("sentiment_label", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("title_sentiment", T.FloatType()),
        T.StructField("url", T.StringType()),
    ]
)

SERVING_RECORD = T.StructType(
    [
        T.StructField("date", T.StringType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("symbol", T.StringType()),
        T.StructField("volume", T.IntegerType()),
        T.StructField("rawPrediction", T.DoubleType()),
        T.StructField("sentiment", T.DoubleType()),
        T.StructField("finalPrediction", T.DoubleType()),
    ]
)

COEFFICIENTS = T.StructType(
    [
        T.StructField("x", T.DoubleType()),
        T.StructField("y", T.DoubleType()),
        T.StructField("z", T.DoubleType()),
    ]
)

COMPANY = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("name", T.StringType()),
    ]
)

LEXICON = T.StructType(
    [
        T.StructField("word", T.StringType()),
        T.StructField("polarity", T.DoubleType()),
        T.StructField("subjectivity", T.DoubleType()),
    ]
)

BLEND_FIT = T.StructType(
    [
        *[T.StructField(n, T.DoubleType()) for n in ("alpha", "beta", "intercept")],
        T.StructField("rows", T.LongType()),
        *[T.StructField(n, T.DoubleType()) for n in ("lo", "hi")],
    ]
)

CONTEXT_LEXICON = "phrase string, role string, polarity double, subjectivity double, factor double, reach int"
VALENCE_LEXICON = "word string, role string, valence double"
MOMENTS = ("rows long, weight double, my double, ma double, ms double, caa double, css double, cas double, cay double, "
           "csy double, lo double, hi double")
