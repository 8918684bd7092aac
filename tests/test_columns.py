import datetime as dt

from pyspark.sql import functions as F

from marketlens.functions import columns as C
from tests.conftest import rows


def one(spark, values, kind, build):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in rows(df.select("i", build("v")), "i")]


def test_labels(spark):
    scores = [0.1, -0.1, 0.0999, -0.0999, 0.0, None]
    assert one(spark, scores, "double", C.sentiment_label) == [
        "positive", "negative", "neutral", "neutral", "neutral", "neutral"
    ]
    assert one(spark, [0.2, -0.2, 0.21, -0.21, None], "double", C.gauge_label) == [
        "Neutral", "Neutral", "Positive", "Negative", "Neutral"
    ]


def test_gauge(spark):
    assert one(spark, [-1.0, 0.0, 1.0, None, float("nan")], "double", C.gauge_position) == [0.0, 0.5, 1.0, 0.5, 0.5]


def test_numbers(spark):
    texts = ["12", "12.7", "abc", "", None, "-2.9", "12abc", "NaN", " 7"]
    assert one(spark, texts, "string", C.parse_double) == [12.0, 12.7, 0.0, 0.0, 0.0, -2.9, 0.0, 0.0, 7.0]
    assert one(spark, texts, "string", C.parse_int) == [12, 12, 0, 0, 0, -2, 0, 0, 7]
    assert one(spark, ["12abc", "-.5x", "x1", "1e3z"], "string", lambda c: C.parse_double(c, prefix=True)) == [
        12.0, -0.5, 0.0, 1000.0
    ]


def test_clean_text(spark):
    assert one(spark, ["  A \n\t b  ", "", None, "\u00a0a\u2003\u00a0b\u0085"], "string", C.clean_text) == ["a b", "", None, "a b"]


def test_percent_error(spark):
    df = spark.createDataFrame(
        [(1, 11.0, 10.0), (2, 5.0, 0.0), (3, None, 1.0), (4, 1.0, None), (5, -5.0, -10.0)],
        "i int, prediction double, price double",
    )
    got = [r[1] for r in rows(df.select("i", C.percent_error("prediction", "price")), "i")]
    assert got[0] == 10.0 and got[1:4] == [None, None, None] and got[4] == -50.0


def test_zone_and_wire_time(spark):
    at = dt.datetime(2024, 7, 1, 9, 30, 5)
    df = spark.createDataFrame([(at,)], "t timestamp")
    row = df.select(C.wire_time(C.zone_to_utc("t", "America/New_York")), C.utc_day("t")).first()
    assert tuple(row) == ("2024-07-01 13:30:05", "2024-07-01")


def test_blends(spark):
    df = spark.createDataFrame([(10.0, 0.5)], "rawPrediction double, sentiment double")
    linear = df.select(C.blend_linear("rawPrediction", "sentiment")).first()[0]
    product = df.select(
        C.blend_product("rawPrediction", "sentiment", F.lit(0.5), F.lit(0.3), F.lit(0.2))
    ).first()[0]
    assert linear == 10.0 and abs(product - (5 + 0.15 + 1.0)) < 1e-12
