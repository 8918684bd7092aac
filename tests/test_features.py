import datetime as dt

import pytest
from pyspark.sql import functions as F

from marketlens.operators import features, forecast
from tests.conftest import rows

START = dt.datetime(2024, 1, 7, 10)  # a Sunday
SCHEMA = "timestamp timestamp, symbol string, price double, volume double"


def bars(spark, prices, symbol="A", start=0):
    made = [(START + dt.timedelta(minutes=start + i), symbol, p, 1.0 + i) for i, p in enumerate(prices)]
    return spark.createDataFrame(made, SCHEMA)


@pytest.mark.parametrize("count, left", [(1, 0), (3, 0), (4, 1), (7, 4)])
def test_first_three_rows_are_dropped(spark, count, left):
    assert features.feature_table(bars(spark, [float(i) for i in range(count)])).count() == left


def test_values(spark):
    table = features.feature_table(bars(spark, [1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0]))
    assert table.columns == ["timestamp", "symbol", "price", "volume", *features.FEATURE_NAMES]
    last = rows(table, F.desc("timestamp"))[0]
    assert last[2:] == (64.0, 7.0, 32.0, 16.0, 8.0, 6.0, 32.0, 1.0, 10, 7, 1, 21.0, 4.5)
    first = rows(table, "timestamp")[0]
    assert first[-2:] == (15.0 / 4, 2.5)


def test_null_and_nan_prices_cost_the_rows_that_look_back(spark):
    table = features.feature_table(bars(spark, [1.0, 2.0, 3.0, 4.0, None, 6.0, 7.0, 8.0, 9.0]))
    assert [r[2] for r in rows(table, "timestamp")] == [4.0, 9.0]
    nan = features.feature_table(bars(spark, [1.0, 2.0, 3.0, 4.0, float("nan"), *map(float, range(6, 15))]))
    assert [r[2] for r in rows(nan, "timestamp")] == [4.0, 11.0, 12.0, 13.0, 14.0]


def test_symbols_do_not_mix(spark):
    both = bars(spark, [1.0, 2.0, 3.0, 4.0]).unionByName(bars(spark, [10.0, 20.0, 30.0, 40.0], "B"))
    table = features.feature_table(both)
    assert rows(table.select("symbol", "price_lag1")) == [("A", 3.0), ("B", 30.0)]


def test_empty_input(spark):
    assert features.feature_table(bars(spark, [1.0]).limit(0)).count() == 0


@pytest.mark.parametrize("count, passes", [(10, False), (11, True)])
def test_gate(spark, count, passes):
    df = bars(spark, [1.0] * count)
    assert features.has_enough_rows(df) is passes
    assert features.symbols_with_enough_rows(df).count() == int(passes)


def test_forest_is_deterministic_and_gated(spark):
    wave = [100 + (i * 37 % 23) + i / 10 for i in range(80)]
    table = features.feature_table(bars(spark, wave))
    assert forecast.train_and_score(table.limit(10)) is None
    first = forecast.train_and_score(table, trees=5, depth=4)
    again = forecast.train_and_score(table, trees=5, depth=4)
    kept = rows(first.select("timestamp", "prediction"))
    assert kept == rows(again.select("timestamp", "prediction"))
    assert len(kept) == table.count() - int(table.count() * 0.8)
    error = forecast.rmse(first).first()[0]
    assert 0 < error < 50
    stats = forecast.error_statistics(first).first()
    assert stats[2] <= stats[0] <= stats[1]
    assert forecast.latest_predictions(first).count() == 5


def test_saved_model_scores_alike(spark, tmp_path):
    table = features.feature_table(bars(spark, [float(i * 7 % 13) for i in range(40)]))
    model = forecast.train_forest(table, trees=3, depth=3)
    forecast.save_model(model, str(tmp_path / "m"))
    loaded = forecast.load_model(str(tmp_path / "m"))
    assert rows(forecast.score(model, table)) == rows(forecast.score(loaded, table))


def test_statistics_of_nothing(spark):
    empty = spark.createDataFrame([], "symbol string, price double, prediction double")
    assert forecast.rmse(empty).first()[0] is None
    assert tuple(forecast.error_statistics(empty).first()) == (None, None, None)


def test_hash_split_is_stable(spark):
    df = bars(spark, [float(i) for i in range(2000)])
    marked = forecast.split_by_hash(df, ["symbol", "timestamp"])
    share = marked.agg(F.avg(F.col("is_train").cast("double"))).first()[0]
    assert 0.75 < share < 0.85
    assert rows(marked.repartition(7)) == rows(marked)


def test_forecast_of_the_next_price(spark):
    table = features.next_price_label(features.feature_table(bars(spark, [float(i * 7 % 13) for i in range(40)])))
    assert table.filter("next_price IS NULL").count() == 1
    scored = forecast.train_and_score(table, label="next_price", trees=3, depth=3)
    assert scored.count() == 8
    model = forecast.train_forest(table, label="next_price", trees=3, depth=3)
    assert forecast.score(model, table).filter("prediction IS NULL").count() == 0
