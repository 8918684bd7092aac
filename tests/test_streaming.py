import datetime as dt
import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens import schemas, session
from marketlens.operators import features, forecast, upsert
from marketlens.plans.stream_queries import _FEATURES
from marketlens.sources import landed, topics
from marketlens.streaming import incremental, jobs, windows
from marketlens.streaming.runner import run_stream
from tests.conftest import rows
from tests.test_tables import PREDICTION

T0 = dt.datetime(2024, 1, 1)
BARS = schemas.BAR
FEATURES = T.StructType([f for f in _FEATURES.fields if f.name != "event_id"])


def bars(spark, *made):
    """(symbol, minute) bars with a price and volume that follow from the minute."""
    return spark.createDataFrame(
        [(T0 + dt.timedelta(minutes=m), s, float(m * 37 % 101), float(m % 7)) for s, m in made], BARS
    )


def handler(spark, path, lateness="0 seconds"):
    keys = ["symbol", "timestamp"]
    return incremental.FeatureStream(
        spark, str(path / "state"), upsert.VersionedLog(str(path / "out"), FEATURES, keys, deletes=True),
        upsert.VersionedLog(str(path / "late"), BARS, keys), BARS, lateness=lateness,
    )


def shown(df):
    means = ("rolling_mean_price", "rolling_mean_volume")
    return rows(df.select(*[F.round(c, 9).alias(c) if c in means else c for c in FEATURES.fieldNames()]))


def feed(stream, spark, batches):
    for i, batch in enumerate(batches):
        stream(bars(spark, *batch), i)


def test_features_across_batches(spark, tmp_path):
    made = [("A", m) for m in range(30)] + [("B", m) for m in range(0, 30, 4)]
    made.sort(key=lambda b: b[1])
    stream = handler(spark, tmp_path)
    cuts = [0, 1, 4, 9, 25, len(made)]
    feed(stream, spark, [made[a:b] for a, b in zip(cuts, cuts[1:], strict=False)])
    whole = features.feature_table(bars(spark, *made))
    assert shown(stream.output.current(spark)) == shown(whole)
    stream(bars(spark, *made[25:]), 4)  # the last batch again
    assert shown(stream.output.current(spark)) == shown(whole)
    assert stream.late.versions(spark).count() == 0


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.permutations(list(range(14))), st.lists(st.integers(1, 13), min_size=1, max_size=2, unique=True))
def test_any_arrival_within_the_allowance(spark, tmp_path_factory, order, cuts):
    made = [("A", m) for m in order]
    bounds = [0, *sorted(cuts), len(made)]
    stream = handler(spark, tmp_path_factory.mktemp("late"), "1 hour")
    feed(stream, spark, [made[a:b] for a, b in zip(bounds, bounds[1:], strict=False)])
    assert shown(stream.output.current(spark)) == shown(features.feature_table(bars(spark, *made)))


def test_bars_beyond_the_allowance_are_set_aside(spark, tmp_path):
    stream = handler(spark, tmp_path, "5 minutes")
    feed(stream, spark, [[("A", m) for m in range(20)], [("A", 20), ("A", 3), ("B", 1)]])
    assert [r["symbol"] for r in stream.late.versions(spark).collect()] == ["A"]
    assert shown(stream.output.current(spark)) == shown(features.feature_table(bars(spark, *[("A", m) for m in range(21)])))


def test_sent_again_bars_change_nothing(spark, tmp_path):
    stream = handler(spark, tmp_path, "1 hour")
    feed(stream, spark, [[("A", m) for m in range(10)], [("A", m) for m in range(5, 14)]])
    assert shown(stream.output.current(spark)) == shown(features.feature_table(bars(spark, *[("A", m) for m in range(14)])))


def test_a_correction_takes_features_back(spark, tmp_path):
    stream = handler(spark, tmp_path, "1 hour")
    made = bars(spark, *[("A", m) for m in range(10)])
    stream(made, 0)
    again = made.filter(F.minute("timestamp") == 7).withColumn("price", F.lit(None).cast("double"))
    stream(again, 1)
    corrected = made.filter(F.minute("timestamp") != 7).unionByName(again)
    assert shown(stream.output.current(spark)) == shown(features.feature_table(corrected))
    assert [r["timestamp"].minute for r in stream.output.current(spark).orderBy("timestamp").collect()] == [3, 4, 5, 6]
    stream(made.filter(F.minute("timestamp") == 7), 2)  # and gives them back
    assert shown(stream.output.current(spark)) == shown(features.feature_table(made))


def test_bars_without_symbol_or_time_are_set_aside(spark, tmp_path):
    stream = handler(spark, tmp_path)
    good = bars(spark, *[("A", m) for m in range(6)])
    bad = spark.createDataFrame([(T0, None, 1.0, 1.0), (None, "A", 2.0, 1.0), (None, None, 3.0, 1.0)], BARS)
    stream(good.unionByName(bad), 0)
    assert shown(stream.output.current(spark)) == shown(features.feature_table(good))
    assert [r["price"] for r in stream.late.versions(spark).orderBy("price").collect()] == [1.0, 2.0, 3.0]


def test_missing_context_is_an_error(spark, tmp_path):
    with pytest.raises(RuntimeError, match="no context"):
        handler(spark, tmp_path)(bars(spark, ("A", 1)), 3)


def land(path, batch, name):
    lines = [json.dumps({"timestamp": str(T0 + dt.timedelta(minutes=m)), "symbol": s, "price": float(m * 37 % 101),
                         "volume": float(m % 7)}) for s, m in batch]
    (path / name).write_text("\n".join(lines) + "\n")


def test_stream_of_files_survives_a_restart(spark, tmp_path):
    topic = tmp_path / "topic"
    topic.mkdir()
    stream = handler(spark, tmp_path)

    def run():
        source = topics.decode_bars(spark.readStream.text(str(topic)))
        run_stream(source, stream, str(tmp_path / "checkpoint"), trigger=None).awaitTermination()

    land(topic, [("A", m) for m in range(8)], "1.json")
    run()
    land(topic, [("A", m) for m in range(8, 16)], "2.json")
    run()
    run()  # nothing new
    assert shown(stream.output.current(spark)) == shown(features.feature_table(bars(spark, *[("A", m) for m in range(16)])))


def test_errors_end_the_query(spark, tmp_path):
    (tmp_path / "topic").mkdir()
    land(tmp_path / "topic", [("A", 1)], "1.json")

    def fail(rows, batch_id):
        raise ValueError("no store")

    query = run_stream(spark.readStream.text(str(tmp_path / "topic")), fail, str(tmp_path / "c"), trigger=None)
    with pytest.raises(Exception, match="no store"):
        query.awaitTermination()


def test_training_and_scoring_handlers(spark, tmp_path):
    seen = []
    log = upsert.VersionedLog(str(tmp_path / "log"), PREDICTION, ["symbol", "timestamp"])
    train = jobs.training_handler(log, trees=3, depth=3, report=lambda r, i: seen.append(r.rmse.first()[0]))
    train(bars(spark, *[("A", m) for m in range(13)]), 0)  # 10 feature rows: below the gate
    assert seen == []
    train(bars(spark, *[("A", m) for m in range(33)]), 1)
    assert len(seen) == 1 and log.current(spark).count() == 6
    table = features.feature_table(bars(spark, *[("B", m) for m in range(20)]))
    model = forecast.train_forest(table, trees=3, depth=3)
    score = jobs.scoring_handler(model, log, report=lambda r, i: seen.append(r.latest.count()))
    score(table, 2)
    assert seen[1] == 5 and log.current(spark).filter("symbol = 'B'").count() == 17


def test_prediction_files(spark, tmp_path):
    made = [(T0, "A", 2.0, 1.0), (T0 + dt.timedelta(hours=1), "A", 3.0, 2.5)]
    spark.createDataFrame(made, schemas.PREDICTION_FILE).write.parquet(str(tmp_path / "files"))
    log = upsert.VersionedLog(str(tmp_path / "log"), PREDICTION, ["symbol", "timestamp"])
    source = landed.stream_scored_files(spark, str(tmp_path / "files"))
    run_stream(source, jobs.partial_handler(log), str(tmp_path / "c"), trigger=None).awaitTermination()
    assert rows(log.current(spark, by_column=True), "timestamp") == [
        ("A", made[0][0], 1.0, 2.0, None), ("A", made[1][0], 2.5, 3.0, None)
    ]


def test_news_handler(spark, tmp_path):
    lexicon = spark.createDataFrame([("good", 0.5, 0.6)], schemas.LEXICON)
    log = upsert.VersionedLog(str(tmp_path / "log"), schemas.STORED_NEWS, ["company", "url"])
    seen = []
    handle = jobs.news_handler(
        lexicon, log, lambda r, i: seen.append((rows(r.companies), r.positive.count(), r.negative.count())), ("url",)
    )
    article = lambda url, title: (title, "good", "s", url, T0, T0, "A")
    handle(spark.createDataFrame([article("u1", "bad"), article("u2", "good")], schemas.NEWS), 0)
    handle(spark.createDataFrame([article("u1", "good")], schemas.NEWS), 1)
    got = {r["url"]: r for r in log.current(spark).collect()}
    assert got["u1"]["title_sentiment"] == pytest.approx(0.4) and got["u1"]["sentiment_label"] == "positive"
    assert seen[0][0][0][:1] + seen[0][0][0][2:] == ("A", 2, 1.0, 0.0) and seen[0][1:] == (2, 2)


def test_repeats_within_and_outside_the_watermark(spark, tmp_path):
    topic = tmp_path / "topic"
    topic.mkdir()
    for spread, name in ((None, "plain"), (F.col("volume"), "spread")):
        out = tmp_path / name

        def run():
            decoded = topics.decode_bars(spark.readStream.text(str(topic)))
            kept = windows.drop_repeats(decoded, delay="1 hour", spread=spread)
            writer = kept.writeStream.format("parquet").option("path", str(out))
            writer.option("checkpointLocation", f"{out}-c").trigger(availableNow=True).start().awaitTermination()

        land(topic, [("A", 0), ("A", 0), ("A", 1), ("B", 0)], f"{name}1.json")
        run()
        land(topic, [("A", 1), ("A", 50)], f"{name}2.json")
        run()
        assert rows(spark.read.parquet(str(out)).select("symbol", F.minute("timestamp"))) == [
            ("A", 0), ("A", 1), ("A", 50), ("B", 0)
        ]


def test_sliding_windows(spark):
    rolled = windows.ohlc_bars(bars(spark, ("A", 0), ("A", 40), ("A", 70)), slide="30 minutes")
    got = rows(rolled.select(F.date_format("window_start", "HH:mm"), "ticks", "open", "close"), "window_start")
    assert [r[:2] for r in got] == [("23:30", 1), ("00:00", 2), ("00:30", 2), ("01:00", 1)]
    scored = spark.createDataFrame([("A", T0, 0.5), ("A", T0, None)], "company string, published_at timestamp, overall_sentiment double")
    assert rows(windows.sentiment_windows(scored).select("avg_sentiment", "article_count")) == [(0.5, 2)]


def test_shared_root_comes_from_the_session(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    root = session.shared_root(spark)
    assert root == configured.rstrip("/") if configured else root
    assert session.shared_path(spark, "x") != session.shared_path(spark, "x")


def test_handlers_accept_empty_batches(spark, tmp_path):
    log = upsert.VersionedLog(str(tmp_path / "log"), PREDICTION, ["symbol", "timestamp"])
    jobs.training_handler(log)(bars(spark, ("A", 0)).limit(0), 0)
    lexicon = spark.createDataFrame([("good", 0.5, 0.6)], schemas.LEXICON)
    stored = upsert.VersionedLog(str(tmp_path / "news"), schemas.STORED_NEWS, ["company", "url"])
    empty = spark.createDataFrame([], schemas.NEWS)
    jobs.news_handler(lexicon, stored, extra=("url",))(empty, 0)
    stream = handler(spark, tmp_path)
    feed(stream, spark, [[("A", m) for m in range(5)]])
    stream(bars(spark, ("A", 0)).limit(0), 1)
    stream(bars(spark, ("A", 5)), 2)
    assert stream.output.current(spark).count() == 3


def test_articles_of_one_millisecond_overwrite_each_other(spark):
    at = T0.replace(microsecond=250_100)
    made = [("A", at, "d", 0.1, 0.1, "neutral", t, 0.1) for t in ("x", "y")]
    shape = """company string, fetch_timestamp timestamp, description string, description_sentiment double,
        overall_sentiment double, sentiment_label string, title string, title_sentiment double"""
    rows_ = upsert.sentiment_rows(spark.createDataFrame(made, shape), whole_millis=True)
    kept = upsert.latest_per_key(rows_, ["company", "timestamp"], ["title"])
    assert rows(kept.select("timestamp", "title")) == [(T0.replace(microsecond=250_000), "y")]


def test_partitions_follow_from_the_input():
    assert session.shuffle_partitions(1) == 8
    assert session.shuffle_partitions(10**12) == 3726
    assert session.shuffle_partitions(100 * 10**12) == 372530


def repeat_filter(spark, path, delay="10 minutes"):
    keys = ["symbol", "timestamp"]
    logs = [upsert.VersionedLog(str(path / n), BARS, keys) for n in ("first", "late")]
    return windows.RepeatFilter(spark, str(path / "state"), *logs, keys, delay=delay)


def minutes(log, spark):
    found = rows(log.versions(spark).select("symbol", "timestamp"))
    return [(s, None if t is None else (t - T0).total_seconds() / 60) for s, t in found]


def test_repeats_beyond_the_delay_are_set_aside(spark, tmp_path):
    stream = repeat_filter(spark, tmp_path)
    untimed = spark.createDataFrame([(None, "A", 1.0, 1.0)], BARS)
    batches = [
        bars(spark, ("A", 0), ("A", 0), ("A", 30), ("B", 1)).union(untimed),
        bars(spark, ("A", 30), ("A", 21), ("A", 5), ("B", 1), ("A", 40)),  # 30 again; 5 and 1 are behind 20
        bars(spark),
        bars(spark, ("A", 40), ("A", 30), ("A", 29)),  # 30 is still known, both are behind 30 or at it
    ]
    for i, batch in enumerate(batches):
        stream(batch, i)
    first = [("A", 0.0), ("A", 21.0), ("A", 30.0), ("A", 40.0), ("B", 1.0)]
    late = sorted([("A", 29.0), ("A", 5.0), ("A", None), ("B", 1.0)], key=repr)
    assert sorted(minutes(stream.output, spark), key=repr) == sorted(first, key=repr)
    assert sorted(minutes(stream.late, spark), key=repr) == late
    stream(batches[3], 3)  # the last batch again
    assert len(minutes(stream.output, spark)) == 5 and len(minutes(stream.late, spark)) == 4


def test_repeats_without_the_keys_of_the_batch_before(spark, tmp_path):
    with pytest.raises(RuntimeError):
        repeat_filter(spark, tmp_path)(bars(spark, ("A", 0)), 4)


def test_parts_of_windows_take_late_bars(spark, tmp_path):
    made = [("A", m) for m in range(0, 200, 7)] + [("B", m) for m in range(3, 150, 11)]
    log = upsert.VersionedLog(str(tmp_path / "log"), windows.PARTS, ["window_start", "symbol"], "window_start")
    for i, batch in enumerate((made[20:], made[:20], made[:0])):
        log.append(windows.ohlc_parts(bars(spark, *batch)), i)
    log.append(windows.ohlc_parts(bars(spark, *made[:20])), 1)  # run again
    whole = windows.ohlc_bars(bars(spark, *made))
    assert rows(windows.merged_ohlc(log, spark).select(*whole.columns)) == rows(whole)


def test_a_table_in_slices_goes_through_several_runs(spark, tmp_path):
    from marketlens.plans.stream_queries import RUNS, run_in_slices, sliced_ticks
    from tests.conftest import SMALL

    sizes = {}

    def handle(batch, batch_id):
        sizes[batch_id] = batch.count()

    table = sliced_ticks(spark, SMALL)
    run_in_slices(table, str(tmp_path), lambda source: run_stream(source, handle, str(tmp_path / "checkpoint"), trigger=None))
    assert sorted(sizes) == list(range(RUNS)) and all(sizes.values())
    assert sum(sizes.values()) == table.count()
