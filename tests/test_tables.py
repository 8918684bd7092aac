"""Upserts, serving joins, calibration."""

import datetime as dt

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens.operators import calibrate, lookup, serving, upsert
from marketlens.sources import landed
from tests.conftest import rows

T0 = dt.datetime(2024, 1, 1)
PREDICTION = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("prediction", T.FloatType()),
        T.StructField("price", T.FloatType()),
        T.StructField("volume", T.IntegerType()),
    ]
)
SCORED = "symbol string, timestamp timestamp, prediction double, price double, volume double"


def log(path):
    return upsert.VersionedLog(str(path / "log"), PREDICTION, ["symbol", "timestamp"])


def scored(spark, *made):
    return spark.createDataFrame([(s, T0 + dt.timedelta(hours=h), p, y, v) for s, h, p, y, v in made], SCORED)


def test_log_replay_and_versions(spark, tmp_path):
    table = log(tmp_path)
    first = upsert.prediction_rows(scored(spark, ("A", 0, 1.0, 2.0, 3.9), ("A", 30, 1.0, 2.0, 5.0)))
    table.append(first, 0)
    table.append(upsert.prediction_rows(scored(spark, ("A", 0, 9.0, 2.0, 7.0))), 1)
    want = [("A", T0, 9.0, 2.0, 7), ("A", T0 + dt.timedelta(hours=30), 1.0, 2.0, 5)]
    assert rows(table.current(spark), "timestamp") == want
    table.append(first, 0)  # an old batch again does not win
    table.append(first.limit(0), 2)
    assert rows(table.current(spark), "timestamp") == want
    assert table.versions(spark).count() == 3
    assert rows(table.current(spark, days=("2024-01-02", "2024-01-02"))) == want[1:]
    compacted = table.compact_to(spark, str(tmp_path / "small"))
    assert rows(compacted.current(spark), "timestamp") == want and compacted.versions(spark).count() == 2


def test_a_shorter_try_replaces_the_longer(spark, tmp_path):
    table = log(tmp_path)
    first = upsert.prediction_rows(scored(spark, ("A", 0, 1.0, 2.0, 3.0), ("A", 30, 1.0, 2.0, 5.0)))
    table.append(first, 0)
    table.append(first.filter(F.col("timestamp") == F.lit(T0)), 0)
    assert table.versions(spark).count() == 1
    table.append(first.limit(0), 0)
    assert table.current(spark).count() == 0


def test_days_do_not_bring_back_old_versions(spark, tmp_path):
    table = upsert.VersionedLog(str(tmp_path / "log"), PREDICTION, ["symbol"])
    table.append(upsert.prediction_rows(scored(spark, ("A", 0, 1.0, 2.0, 3.0), ("B", 0, 1.0, 2.0, 3.0))), 0)
    table.append(upsert.prediction_rows(scored(spark, ("A", 30, 5.0, 2.0, 3.0))), 1)
    assert [r.symbol for r in table.current(spark, days=("2024-01-01", "2024-01-01")).collect()] == ["B"]


def test_partial_writes_keep_other_columns(spark, tmp_path):
    table = log(tmp_path)
    table.append(upsert.prediction_rows(scored(spark, ("A", 0, 1.0, 2.0, 3.0))), 0)
    table.append(upsert.prediction_file_rows(scored(spark, ("A", 0, 4.0, 5.0, 6.0))), 1)
    assert rows(table.current(spark, by_column=True).select("prediction", "price", "volume")) == [(4.0, 5.0, 3)]
    assert rows(table.current(spark).select("volume")) == [(None,)]


def test_too_large_volume_is_null(spark):
    assert upsert.prediction_rows(scored(spark, ("A", 0, 1.0, 2.0, 3e12))).first()["volume"] is None


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.permutations(list(range(12))))
def test_last_write_wins_in_any_order(spark, order):
    made = [("AB"[i % 2], i % 3, i, None if i % 5 == 0 else float(i)) for i in order]
    df = spark.createDataFrame(made + made, "k string, t int, version int, x double")
    got = rows(upsert.latest_per_key(df, ["k", "t"], ["version"]))
    newest = {}
    for row in sorted(made, key=lambda r: r[2]):
        newest[row[:2]] = row
    assert got == sorted(newest.values(), key=repr)


def test_snapshot(spark):
    got = upsert.snapshot(scored(spark, ("A", 0, 1.0, 2.0, 3.0), ("A", 1, 1.0, 4.0, 5.0))).first()
    assert (got["symbol"], got["timestamp"], got["data"]) == ("A", "2024-01-01 01:00:00", {"price": 4.0, "volume": 5.0})


def news(spark, *made):
    return spark.createDataFrame(
        [(c, T0 + dt.timedelta(hours=h), i, s) for c, h, i, s in made],
        "company string, timestamp timestamp, id int, overall_sentiment double",
    )


def test_latest_sentiment_join(spark):
    bars = scored(spark, *[(s, 5, 10.0, 9.0, 1.0) for s in ("A", "B", "C", "D", "E")])
    articles = news(
        spark, ("A", 0, 1, 0.9), ("A", 3, 2, 0.1), ("A", 3, 3, 0.4), ("B", 1, 4, 0.5), ("B", 2, 5, None),
        ("C", 2, 6, float("nan")), ("E", 9, 7, -0.3),
    )
    got = rows(serving.join_latest_sentiment(bars, articles, ties=["id"]).select("symbol", "sentiment"))
    assert got == [("A", 0.4), ("B", 0.0), ("C", 0.0), ("D", 0.0), ("E", -0.3)]


def test_asof_join_has_no_look_ahead(spark):
    bars = scored(spark, *[("A", h, 1.0, 1.0, 1.0) for h in (0, 2, 3, 9)], ("B", 1, 1.0, 1.0, 1.0))
    articles = news(spark, ("A", 2, 1, 0.2), ("A", 4, 2, None), ("A", 1, 3, 0.1), ("C", 0, 4, 0.7))
    for limit in (1, 2, 100):
        got = serving.join_sentiment_asof(bars, articles, news_ties=["id"], rows_per_segment=limit)
        assert rows(got.select("symbol", F.hour("timestamp"), "sentiment")) == [
            ("A", 0, None), ("A", 2, 0.2), ("A", 3, 0.2), ("A", 9, None), ("B", 1, None)
        ]


def test_daily_join(spark):
    bars = scored(spark, ("A", 1, 1.0, 1.0, 1.0), ("A", 25, 1.0, 1.0, 1.0))
    got = serving.join_daily_sentiment(bars, news(spark, ("A", 0, 1, 0.2), ("A", 5, 2, 0.4)))
    assert [(d, round(s, 9)) for d, s in rows(got.select("date", "sentiment"))] == [
        ("2024-01-01", 0.3), ("2024-01-02", 0.0)
    ]


def test_market_data_for_one_symbol(spark):
    bars = scored(spark, ("A", 1, 10.0, 9.0, 2.5), ("A", 0, 20.0, 8.0, 1.0), ("B", 0, 1.0, 1.0, 1.0))
    got = serving.market_data_for("a", bars, news(spark, ("A", 0, 1, 0.5))).collect()
    assert [tuple(r) for r in got] == [
        ("2024-01-01", 8.0, "A", 1, 20.0, 0.5, 20.0), ("2024-01-01", 9.0, "A", 2, 10.0, 0.5, 10.0)
    ]
    nothing = serving.market_data_for("zz", bars, news(spark, ("A", 0, 1, 0.5)))
    assert nothing.count() == 0 and nothing.columns == [*got[0].asDict()]


def test_chart_pages_hold_the_whole_series(spark):
    made = scored(spark, *[("A", h, float(h), float(-h), float(h)) for h in range(25)], ("B", 0, 1.0, 1.0, 1.0))
    records = serving.serving_records(made.withColumn("sentiment", F.lit(0.0)), keep=["timestamp"])
    for limit in (5, 1000):
        pages = rows(serving.chart_pages(records, points=10, rows_per_segment=limit), "symbol", "page")
        assert [(p[0], p[1], len(p[2])) for p in pages] == [("A", 0, 10), ("A", 1, 10), ("A", 2, 5), ("B", 0, 1)]
        assert [x for p in pages[:3] for x in p[5]] == [float(h) for h in range(25)]
        assert [x for p in pages[:3] for x in p[3]] == [float(-h) for h in range(25)]


def test_gauges_without_rows(spark):
    empty = spark.createDataFrame([], "symbol string, timestamp timestamp, sentiment double")
    assert serving.sentiment_gauges(empty).count() == 0


def test_company_names(spark):
    df = spark.createDataFrame([("AAPL",), ("XX",)], "symbol string")
    got = serving.join_company_name(df, landed.company_dimension(spark, landed.DASHBOARD_COMPANIES))
    assert rows(got) == [("AAPL", "Apple Inc."), ("XX", None)]


def test_lookup_join_beyond_the_bound(spark):
    big = spark.range(100).select((F.col("id") % 5).alias("k"), "id")
    table = spark.range(5).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    small = lookup.lookup_join(big, table, ["k"])
    beyond = lookup.lookup_join(big, table.withColumn("v", F.col("v") + 0), ["k"], max_rows=2)
    assert rows(small) == rows(beyond)
    assert "ResolvedHint" not in beyond._jdf.queryExecution().analyzed().toString()


def points(spark, y, a, s):
    return spark.createDataFrame(
        [tuple(map(float, r)) for r in zip(y, a, s, strict=True)], "price double, rawPrediction double, sentiment double"
    )


def normed(s):
    return (s - s.min()) / (s.max() - s.min()) if s.max() > s.min() else s


@pytest.mark.parametrize("shape", ["free", "constant sentiment", "collinear", "two rows", "one row"])
def test_fit_equals_least_squares(spark, shape):
    rng = np.random.default_rng(5)
    n = {"two rows": 2, "one row": 1}.get(shape, 60)
    a, s = rng.normal(100, 9, n), rng.uniform(-1, 1, n)
    if shape == "constant sentiment":
        s = np.full(n, 0.3)
    if shape == "collinear":
        s = a * 2 - 5
    y = 3 * a - 7 * s + rng.normal(0, 1, n)
    b = normed(s)
    x = np.column_stack([a - a.mean(), b - b.mean()])
    want, *_ = np.linalg.lstsq(x, y - y.mean(), rcond=1e-10)
    got = calibrate.fit_blend(points(spark, y, a, s)).first()
    assert (got["alpha"], got["beta"]) == pytest.approx(tuple(want), rel=1e-6, abs=1e-8)
    assert got["intercept"] == pytest.approx(y.mean() - want[0] * a.mean() - want[1] * b.mean(), rel=1e-6, abs=1e-6)


def test_fit_equals_mllib(spark):
    rng = np.random.default_rng(8)
    a, s = rng.normal(50, 5, 200), rng.uniform(-1, 1, 200)
    df = points(spark, 2 * a + 4 * s + rng.normal(0, 1, 200), a, s)
    scaled = calibrate.minmax_scaled(df, "sentiment", "b")
    lr = LinearRegression(solver="normal", labelCol="price")
    model = lr.fit(VectorAssembler(inputCols=["rawPrediction", "b"], outputCol="features").transform(scaled))
    got = calibrate.fit_blend(df).first()
    assert (got["alpha"], got["beta"]) == pytest.approx(tuple(model.coefficients), rel=1e-6)


@pytest.mark.parametrize("constant", [False, True])
def test_blend_by_a_stored_fit_is_the_least_squares_prediction(spark, tmp_path, constant):
    rng = np.random.default_rng(3)
    a, s = rng.normal(100, 9, 40), np.full(40, 0.3) if constant else rng.uniform(-0.4, 0.2, 40)
    y = 3 * a - 7 * s + rng.normal(0, 1, 40)
    records = points(spark, y, a, s)
    calibrate.write_fit(calibrate.fit_blend(records), str(tmp_path / "fit"))
    blended = serving.blend_fitted(records, calibrate.read_fit(spark, str(tmp_path / "fit")))
    x = np.column_stack([a, s, np.ones(40)])
    want = x @ np.linalg.lstsq(x, y, rcond=1e-10)[0]
    got = {r["price"]: r["finalPrediction"] for r in blended.collect()}
    assert [got[v] for v in y] == pytest.approx(list(want), rel=1e-9)


def test_fit_of_nothing(spark):
    assert calibrate.fit_blend(points(spark, [], [], [])).count() == 0


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1, 1), min_size=1, max_size=20))
def test_minmax_in_unit_range(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "s double")
    got = [r[1] for r in calibrate.minmax_scaled(df, "s", "n").collect()]
    if max(values) > min(values):
        assert all(0 <= g <= 1 for g in got)
    else:
        assert got == values


def test_compaction_in_place(spark, tmp_path):
    table = log(tmp_path)

    def batch(*made):
        return upsert.prediction_rows(scored(spark, *made))

    def held():
        return rows(table.current(spark).select("symbol", "prediction"))

    table.append(batch(("A", 0, 1.0, 2.0, 3.0), ("B", 0, 1.0, 2.0, 3.0)), 0)
    table.append(batch(("A", 0, 2.0, 2.0, 3.0)), 1)
    table.append(batch(("C", 0, 5.0, 2.0, 3.0)), 2)
    before = table.current(spark)
    table.compact(spark, 1)
    assert held() == rows(before.select("symbol", "prediction")) == [("A", 2.0), ("B", 1.0), ("C", 5.0)]
    table.append(batch(("B", 0, 9.0, 2.0, 3.0)), 3)  # others go on writing, and run a later batch again
    table.append(batch(("C", 0, 6.0, 2.0, 3.0)), 2)
    assert held() == [("A", 2.0), ("B", 9.0), ("C", 6.0)]
    with pytest.raises(ValueError):
        table.append(batch(("A", 0, 7.0, 2.0, 3.0)), 1)
    table.remove_compacted(spark)
    assert held() == [("A", 2.0), ("B", 9.0), ("C", 6.0)]
    assert table.versions(spark).count() == 4
    table.compact(spark, 3)
    table.remove_compacted(spark)
    table.compact(spark, 2)  # nothing left to do
    assert held() == [("A", 2.0), ("B", 9.0), ("C", 6.0)]
    assert sorted(p.name for p in (tmp_path / "log-base").iterdir()) == ["upto-3"]


def test_compaction_by_column_and_of_deleted_keys(spark, tmp_path):
    table = log(tmp_path)
    table.append(upsert.prediction_rows(scored(spark, ("A", 0, 1.0, 2.0, 3.0))), 0)
    table.append(upsert.prediction_rows(scored(spark, ("A", 0, 4.0, None, None))), 1)
    table.compact(spark, 1, by_column=True)
    table.append(upsert.prediction_rows(scored(spark, ("A", 0, None, 8.0, None))), 2)
    assert rows(table.current(spark, by_column=True).select("prediction", "price", "volume")) == [(4.0, 8.0, 3)]
    marked = upsert.VersionedLog(str(tmp_path / "marked"), PREDICTION, ["symbol", "timestamp"], deletes=True)
    made = upsert.prediction_rows(scored(spark, ("A", 0, 1.0, 2.0, 3.0), ("B", 0, 1.0, 2.0, 3.0)))
    marked.append(made, 0)
    marked.append(made.filter("symbol = 'A'").withColumn(upsert.DELETED, F.lit(True)), 1)
    marked.compact(spark, 1)
    assert marked.versions(spark).count() == 1
    assert rows(marked.current(spark).select("symbol")) == [("B",)]
