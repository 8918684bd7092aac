"""The serving layout: joins without exchange, point reads, Bloom filters."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from marketlens.operators import serving
from marketlens.sources import layout
from tests.conftest import rows

T0 = dt.datetime(2024, 1, 1)
BARS = "n long, symbol string, timestamp timestamp, price double, volume double, prediction double"
NEWS = "company string, timestamp timestamp, overall_sentiment double"


@pytest.fixture(params=[1, 3])
def tables(spark, tmp_path, request):
    """Two thirds of the rows are of one symbol; some have none."""
    bars = [(i, None if i % 50 == 7 else "HOT" if i % 3 else f"S{i % 9}", T0 + dt.timedelta(minutes=i), float(i), 1.0, i + 0.5)
            for i in range(600)]
    bars += bars[:20]
    news = [("HOT", T0, 0.1), ("HOT", T0 + dt.timedelta(1), 0.7), ("S3", T0, None), ("S6", T0, -0.2), (None, T0, 0.9)]
    made = layout.ServingLayout(spark, f"{tmp_path}/t", f"layout_test_{request.param}", buckets=4, parts=request.param)
    predictions, articles = spark.createDataFrame(bars, BARS), spark.createDataFrame(news, NEWS)
    made.write_predictions(predictions, ties=["n"])
    made.write_sentiment(articles)
    yield made, predictions, articles
    made.drop()


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_the_join_exchanges_nothing(tables):
    made, predictions, articles = tables
    joined = made.joined()
    assert rows(joined) == rows(serving.join_latest_sentiment(predictions, articles))
    plan = final_plan(joined)
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_a_symbol_is_read_from_its_buckets(tables):
    made, predictions, articles = tables
    for symbol in ("HOT", "S3", "none", "it's#0"):
        own = predictions.filter(F.col("symbol") == symbol)
        assert rows(made.predictions_of(symbol)) == rows(own)
        assert rows(made.joined_of(symbol)) == rows(serving.join_latest_sentiment(own, articles))
    plan = final_plan(made.joined_of("S3"))  # says what it reads of a bucketed scan, which a join makes it
    assert "Exchange" not in plan
    if made.parts == 1:
        assert plan.count("SelectedBucketsCount: 1 out of 4") >= 1


def test_parts_spread_a_symbol(tables, spark):
    made, predictions, _ = tables
    files = spark.read.parquet(f"{made.path}/predictions").filter("symbol = 'HOT'").groupBy(F.input_file_name()).count()
    assert files.count() == made.parts or made.parts > 1 < files.count()
    assert rows(made.predictions()) == rows(predictions)


def test_buckets_and_parts_grow_with_the_rows(spark, tmp_path):
    """Four times the rows are four times the buckets, so no bucket has more; a large symbol gets more parts."""
    most = []
    for n in (2_000, 8_000):
        frame = spark.range(n).select(
            F.col("id").alias("n"), F.when(F.col("id") % 4 > 0, F.concat(F.lit("S"), F.col("id") % 97)).otherwise("HOT").alias("symbol"),
            F.timestamp_seconds("id").alias("timestamp"), *[F.lit(1.0).alias(c) for c in ("price", "volume", "prediction")])
        buckets, parts = layout.sizes(frame, 2, 3, rows_per_bucket=200)
        assert (buckets, parts) == (n // 200, n // 200)
        made = layout.ServingLayout(spark, f"{tmp_path}/{n}", f"layout_sized_{n}", buckets, parts)
        made.write_predictions(frame, ties=["n"])
        made.write_sentiment(spark.createDataFrame([("HOT", T0, 0.1)], NEWS))
        files = spark.read.parquet(f"{made.path}/predictions").groupBy(F.input_file_name()).count()
        most.append(files.agg(F.max("count")).first()[0])
        assert rows(made.joined_of("HOT").select("n")) == rows(frame.filter("symbol = 'HOT'").select("n"))
        made.drop()
    assert most[1] < 2 * most[0]
    assert layout.sizes(frame.limit(0), 8, 2) == (8, 2) == layout.sizes(frame, 8, 2)


def test_written_again_and_empty(spark, tmp_path):
    made = layout.ServingLayout(spark, f"{tmp_path}/t", "layout_again", buckets=3, parts=2)
    none, no_news = spark.createDataFrame([], BARS), spark.createDataFrame([], NEWS)
    for frame in (spark.createDataFrame([(1, "A", T0, 1.0, 1.0, 1.0)], BARS), none):
        made.write_predictions(frame)
        made.write_sentiment(no_news)
        assert made.joined().count() == made.predictions().count() == frame.count()
    assert made.joined_of("A").count() == 0
    made.drop()


def scanned(df):
    """Rows that the scan of a frame without a shuffle gave."""
    df.collect()
    node = df._jdf.queryExecution().executedPlan()
    while node.children().size():
        node = node.children().head()
    return node.metrics().apply("numOutputRows").value()


def test_a_filter_skips_row_groups(spark, tmp_path):
    """A value that lies between the least and the greatest, but does not occur, costs no rows."""
    rows_ = spark.range(40_000).select(F.md5(F.col("id").cast("string")).alias("url"), (F.col("id") % 5).cast("string").alias("k"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = {}
        for name, bloom in (("with", {"url": 40_000}), ("without", None)):
            layout.store_bucketed(rows_, f"bloom_{name}", f"{tmp_path}/{name}", "k", 2, bloom=bloom)
            got[name] = scanned(spark.table(f"bloom_{name}").filter("url = '80000000000000000000000000000000'"))
            assert spark.table(f"bloom_{name}").filter(F.col("url") == F.md5(F.lit("77"))).count() == 1
            spark.sql(f"DROP TABLE bloom_{name}")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert got["with"] == 0 and got["without"] > 1000
