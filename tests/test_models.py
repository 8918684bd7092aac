"""Stored trees evaluated by hand, rolling origins, and model versions under a stream."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens import schemas
from marketlens.operators import evaluate, features, forecast
from marketlens.operators.upsert import VersionedLog
from marketlens.streaming import versions
from marketlens.streaming.runner import run_stream
from tests.conftest import rows

T0 = dt.datetime(2024, 1, 1)
BARS = "n long, symbol string, timestamp timestamp, price double, volume double"


def walk(count, symbols="AB", seed=5, step=1.0):
    dice, price = random.Random(seed), dict.fromkeys(symbols, 100.0)
    out = []
    for i in range(count):
        symbol = symbols[i % len(symbols)]
        price[symbol] += dice.gauss(0, step)
        out.append((i, symbol, T0 + dt.timedelta(hours=i), price[symbol], dice.random() * 10))
    return out


def table(spark, bars):
    return features.feature_table(spark.createDataFrame(bars, BARS), ties=["n"])


def stored_trees(spark, path):
    """Trees of a saved forest as ``tree -> node -> row``."""
    import glob

    [place] = glob.glob(f"{path}/stages/*RandomForest*/data")
    nodes = spark.read.parquet(place).collect() if not glob.glob(f"{place}/*.json") else spark.read.json(place).collect()
    trees = {}
    for row in nodes:
        node = row["nodeData"] if "nodeData" in row.__fields__ else row
        trees.setdefault(row["treeID"], {})[node["id"]] = node
    return trees


def walk_down(tree, values):
    node = tree[0]
    while node["leftChild"] >= 0:
        split = node["split"]
        [border] = split["leftCategoriesOrThreshold"]
        node = tree[node["leftChild"] if values[split["featureIndex"]] <= border else node["rightChild"]]
    return node["prediction"]


def by_hand(trees, row):
    values = [float(row[n]) for n in features.FEATURE_NAMES]
    return sum(walk_down(t, values) for t in trees.values()) / len(trees)


def test_predictions_equal_the_stored_trees(spark, tmp_path):
    marked = forecast.split_by_time(table(spark, walk(400)), ties=["n"])
    model = forecast.train_forest(marked.filter("is_train"), trees=7, depth=4)
    forecast.save_model(model, f"{tmp_path}/model")
    trees = stored_trees(spark, f"{tmp_path}/model")
    assert len(trees) == 7
    scored = forecast.score(forecast.load_model(f"{tmp_path}/model"), marked.filter("NOT is_train")).collect()
    assert len(scored) > 70 and len({r.prediction for r in scored}) > 10
    for r in scored:
        assert r.prediction == pytest.approx(by_hand(trees, r), rel=1e-9)


def test_forecasts_of_noise_beat_the_last_price(spark):
    """Around a fixed level the last price is off by the noise twice, the level once."""
    dice = random.Random(3)
    bars = [(i, "AB"[i % 2], T0 + dt.timedelta(hours=i), 100 + dice.gauss(0, 5), 1 + dice.random()) for i in range(1500)]
    got = evaluate.rolling_forecasts(table(spark, bars), [1, 3], 2, ties=["n"], trees=20, depth=4)
    for r in evaluate.forecast_errors(got).collect():
        assert r.scored == r.examples > 100
        assert r.rmse < 0.9 * r.naive_rmse and r.error_percentage < r.naive_error_percentage


def plain_examples(found, horizons):
    out = []
    for symbol in sorted({r.symbol for r in found}):
        own = sorted((r for r in found if r.symbol == symbol), key=lambda r: (r.timestamp, r.n))
        out += [(a.n, h, b.price, b.timestamp) for h in horizons for a, b in zip(own, own[h:])]
    return sorted(out)


@pytest.mark.parametrize("limit", [3, 10**6])
def test_examples_do_not_depend_on_the_cut(spark, limit):
    bars = [(i, "AB"[i > 70], T0 + dt.timedelta(hours=i // 3), float(i), 1.0) for i in range(90)]
    made = spark.createDataFrame(bars, BARS)
    got = evaluate.horizon_examples(made, [1, 4], ties=["n"], rows_per_segment=limit)
    shown = got.select("n", "horizon", "target", "target_time")
    assert rows(shown, "n", "horizon") == plain_examples(made.collect(), [1, 4])


def test_examples_of_copies(spark):
    """Copies that nothing tells apart follow each other."""
    made = spark.createDataFrame([(0, "A", T0, 5.0, 1.0)] * 20 + [(1, "A", T0 + dt.timedelta(1), 6.0, 1.0)], BARS)
    whole, cut = (evaluate.horizon_examples(made, [2], ties=["n"], rows_per_segment=k) for k in (10**6, 4))
    assert rows(whole) == rows(cut)
    assert [r.target for r in cut.orderBy("target").collect()] == [5.0] * 18 + [6.0]


def test_a_fold_sees_nothing_later(spark):
    """Other prices from an origin on leave its training rows as they are."""
    bars = walk(300)
    first = evaluate.horizon_examples(table(spark, bars), [1, 5], ties=["n"])
    origins = evaluate.fold_origins(first, 3)
    for origin in origins:
        at = dt.datetime.fromtimestamp(origin / 1e6, dt.timezone.utc).replace(tzinfo=None)
        changed = [(n, s, t, p if t < at else p * 7 + 1, v if t < at else v + 3) for n, s, t, p, v in bars]
        second = evaluate.horizon_examples(table(spark, changed), [1, 5], ties=["n"])
        known = [rows(x.filter(evaluate.in_training(origin))) for x in (first, second)]
        assert known[0] == known[1] and known[0]
    sides = evaluate.fold_rows(first, origins)
    tests = sides.filter("NOT is_train").groupBy("n", "horizon").count()
    assert tests.filter("count > 1").count() == 0  # no example is tested twice


def test_folds_of_few_and_odd_rows(spark):
    empty = table(spark, walk(40)).limit(0)
    got = evaluate.rolling_forecasts(empty, [1], 2, ties=["n"])
    assert got.count() == 0 and evaluate.forecast_errors(got).count() == 0
    few = evaluate.rolling_forecasts(table(spark, walk(30, "A")), [1], 2, ties=["n"], trees=2)
    by_fold = {r.fold: r for r in evaluate.forecast_errors(few).collect()}
    assert by_fold[0].scored == 0 and by_fold[0].rmse is None and by_fold[0].examples > 0  # nine rows before the origin
    assert by_fold[1].scored == by_fold[1].examples
    same_time = evaluate.horizon_examples(table(spark, [(i, "A", T0, 1.0, 1.0) for i in range(9)]), [1], ties=["n"])
    sides = evaluate.fold_rows(same_time, evaluate.fold_origins(same_time, 2))
    assert rows(sides.select("fold", "is_train").distinct()) == [(1, False)]  # nothing lies before any origin
    with pytest.raises(ValueError, match="horizons"):
        evaluate.horizon_examples(empty, [0])


STORED = T.StructType([*schemas.PREDICTION.fields, T.StructField("n", T.LongType()), T.StructField("model_version", T.LongType())])


def shelf_and_scoring(spark, place):
    shelf = versions.ModelShelf(spark, f"{place}/models")
    log = VersionedLog(f"{place}/log", STORED, ["n"])
    return shelf, log, versions.VersionedScoring(shelf, log, f"{place}/uses", extra=("n",))


def test_the_pointer_moves(spark, tmp_path):
    shelf, _, _ = shelf_and_scoring(spark, tmp_path)
    model = forecast.train_forest(table(spark, walk(60)), trees=2, depth=2)
    assert shelf.current() is None and shelf.used() == set()
    shelf.publish(model, 1)
    shelf.publish(model, 2)
    assert shelf.current() == 2
    shelf.point_to(1)
    assert shelf.current() == 1 and shelf.used() == {1, 2}
    for bad in (0, 1, 2):
        with pytest.raises(ValueError, match="model version"):
            shelf.publish(model, bad)


def test_a_replay_scores_with_the_model_first_used(spark, tmp_path):
    found = table(spark, walk(200)).persist()
    low, high = found.filter("n < 100"), found.filter("n >= 100")
    models = [forecast.train_forest(found.withColumn("price", F.lit(v)), trees=2, depth=2) for v in (10.0, 20.0)]
    shelf, log, scoring = shelf_and_scoring(spark, tmp_path)
    scoring(low.limit(3), 0)  # before there is a model
    shelf.publish(models[0], 1)
    scoring(low, 1)
    shelf.publish(models[1], 2)
    scoring(low, 1)
    again = versions.VersionedScoring(shelf, log, scoring.uses, extra=("n",))  # after a restart
    again(low.limit(3), 0)
    again(low, 1)
    again(high, 2)
    got = log.versions(spark).groupBy("log_batch", "model_version").agg(F.min("prediction"), F.max("prediction"), F.count("*"))
    assert rows(got, "log_batch") == [
        (0, None, None, None, 3), (1, 1, 10.0, 10.0, low.count()), (2, 2, 20.0, 20.0, high.count())]


def test_a_batch_that_fails_keeps_its_model(spark, tmp_path):
    """The model changes between the failure of a batch and its second try."""
    found = table(spark, walk(60))
    models = [forecast.train_forest(found.withColumn("price", F.lit(v)), trees=2, depth=2) for v in (10.0, 20.0)]
    shelf, log, scoring = shelf_and_scoring(spark, tmp_path)
    shelf.publish(models[0], 1)
    found.write.parquet(f"{tmp_path}/in/0")

    def run(handle):
        source = spark.readStream.schema(found.schema).parquet(f"{tmp_path}/in/*")
        run_stream(source, handle, f"{tmp_path}/checkpoint", trigger=None).awaitTermination()

    def fail(rows_, batch_id):
        scoring._version_of(batch_id)
        raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        run(fail)
    shelf.publish(models[1], 2)
    run(scoring)
    assert rows(log.current(spark).select("model_version", "prediction").distinct()) == [(1, 10.0)]


def test_a_training_has_partitions_for_its_rows_and_keeps_nodes(spark, monkeypatch):
    """Statistics of all nodes come from every partition, so their number follows the rows, not the shuffle setting."""
    found = spark.range(1000)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        cores = spark.sparkContext.defaultParallelism
        assert forecast.spread_evenly(found, ["id"]).rdd.getNumPartitions() == cores
        monkeypatch.setattr(forecast, "ROWS_PER_PART", 50)
        assert forecast.spread_evenly(found, ["id"]).rdd.getNumPartitions() == max(20, cores)
        assert forecast.spread_evenly(found, ["id"], 5000).rdd.getNumPartitions() == 100
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    model = forecast.train_forest(table(spark, walk(60)), trees=2, depth=2)
    assert model.stages[-1].getCacheNodeIds()
