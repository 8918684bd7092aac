"""Change feed, statistics that follow it, mergeable moments, winners within a batch."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketlens.operators import calibrate, changes, sentiment, upsert
from tests.conftest import rows

T0 = dt.datetime(2024, 1, 1)
ROW = "url string, timestamp timestamp, company string, overall_sentiment double, sentiment_label string, log_deleted boolean"


@pytest.fixture
def following(spark, tmp_path):
    shape = spark.createDataFrame([], ROW).drop("log_deleted").schema
    log = upsert.VersionedLog(str(tmp_path / "log"), shape, ["url", "timestamp"], deletes=True)
    feed = changes.ChangeFeed(log, str(tmp_path / "feed"))
    return log, feed, changes.CompanyTotals(feed, str(tmp_path / "totals"))


def batch(spark, rnd, size=25):
    made = []
    for _ in range(size):
        n = rnd.randrange(30)
        score = rnd.choice([None, 0.1, -0.3, 0.7, float("nan"), 1 / 3])
        label = rnd.choice(["positive", "negative", "neutral", None])
        at = None if n == 5 else T0 + dt.timedelta(hours=7 * n)
        made.append((f"u{n}" if n else None, at, rnd.choice(["A", "B", None]), score, label, rnd.random() < 0.2))
    return spark.createDataFrame(made, ROW)


def statistics(df):
    shown = ["company", "article_count", *[F.round(c, 9) for c in ("avg_sentiment", "positive_ratio", "negative_ratio")]]
    return rows(df.select(*shown))


def wanted(log, spark):
    clean = log.current(spark).withColumn("overall_sentiment", F.nanvl("overall_sentiment", F.lit(None).cast("double")))
    # the shares of the plain statistics leave rows without a label out; the totals count them as neither
    return statistics(sentiment.company_statistics(clean.fillna({"sentiment_label": "neutral"})))


def test_totals_follow_corrections_replays_and_compaction(spark, following):
    log, feed, totals = following
    rnd = random.Random(7)
    for n in range(5):
        log.append(batch(spark, rnd), n)
        feed.record(spark, n)
        if n == 2:
            log.compact(spark, 1)
        if n != 3:  # two batches at once
            totals.advance(spark, n)
            assert statistics(totals.current(spark)) == wanted(log, spark), n
    # the last but one runs again, with other rows; what stands on it is taken back
    log.append(batch(spark, rnd, 10), 3)
    totals.rewind(spark, 3)
    feed.record(spark, 3)
    totals.advance(spark, 4)
    assert statistics(totals.current(spark)) == wanted(log, spark)
    totals.advance(spark, 4)
    assert statistics(totals.current(spark)) == wanted(log, spark)


def test_feed_tells_what_happened_and_reads_only_its_batches(spark, following):
    log, feed, totals = following
    first = spark.createDataFrame([("a", T0, "A", 0.5, "positive", False), ("b", T0, "A", 0.5, "positive", False)], ROW)
    second = spark.createDataFrame([("a", T0, "B", 0.5, "positive", False), ("b", T0, "A", 0.5, "positive", False),
                                    ("c", T0, "A", None, None, True)], ROW)
    third = spark.createDataFrame([("a", T0, "B", 0.5, "positive", True), ("c", T0, "C", 1.0, "positive", False)], ROW)
    for n, made in enumerate((first, second, third, third.limit(0))):
        log.append(made, n)
        feed.record(spark, n)
    told = rows(feed.between(spark, -1, 9).select(upsert.BATCH, "url", "change", "before.company", "after.company"))
    assert told == [(0, "a", "inserted", None, "A"), (0, "b", "inserted", None, "A"), (1, "a", "replaced", "A", "B"),
                    (2, "a", "removed", "B", None), (2, "c", "inserted", None, "C")]
    read = feed.between(spark, 0, 1).inputFiles()
    assert read and all(f"{upsert.BATCH}=1/" in f for f in read)
    assert feed.between(spark, 9, 12).count() == 0
    with pytest.raises(ValueError):
        totals.current(spark)
    totals.advance(spark, 3)
    assert rows(totals.current(spark).select("company", "article_count")) == [("A", 1), ("C", 1)]


@pytest.mark.parametrize("ties", [[], ["volume"]])
def test_winner_within_a_batch_does_not_depend_on_the_deal(spark, tmp_path, ties):
    made = [("A", T0, float(i), None if i % 3 == 0 else i) for i in range(40)] + [("A", T0, None, 39)]
    got = set()
    for seed in range(4):
        random.Random(seed).shuffle(made)
        frame = spark.createDataFrame(made, "symbol string, timestamp timestamp, price double, volume int")
        log = upsert.VersionedLog(str(tmp_path / f"log{seed}"), frame.schema, ["symbol", "timestamp"], ties=ties)
        log.append(frame.repartition(seed + 1), 0)
        got |= {("row", *rows(log.current(spark))[0]), ("column", *rows(log.current(spark, by_column=True).select("price", "volume"))[0])}
    best = ("row", "A", T0, 39.0, None) if not ties else ("row", "A", T0, None, 39)
    assert {g[0]: g for g in got}["row"] == best or ties == []
    assert len(got) == 2


def test_map_columns_have_no_order_and_do_no_harm(spark, tmp_path):
    frame = spark.createDataFrame([("A", T0, {"x": 1.0}, 1), ("A", T0, {"x": 2.0}, 2)], "symbol string, timestamp timestamp, data map<string,double>, n int")
    log = upsert.VersionedLog(str(tmp_path / "log"), frame.schema, ["symbol", "timestamp"])
    log.append(frame, 0)
    assert rows(log.current(spark).select("n")) == [(2,)]
    assert rows(log.current(spark, by_column=True).select("n")) == [(2,)]


def points(n=400, shift=1e3, seed=1):
    rng = np.random.default_rng(seed)
    a, s = shift + rng.normal(0, 3, n), rng.uniform(-1, 1, n)
    return [(float(2 * x - 5 * z + e), float(x), float(z)) for x, z, e in zip(a, s, rng.normal(0, 0.1, n))]


SHAPE = "price double, rawPrediction double, sentiment double"


def fit_of(df):
    return df.first().asDict()


@pytest.mark.parametrize("cuts", [[], [1], [0, 0, 200], list(range(0, 400, 7)), [399]])
def test_merged_fit_equals_the_fit_over_rows(spark, tmp_path, cuts):
    data = points()
    want = fit_of(calibrate.fit_blend(spark.createDataFrame(data, SHAPE).repartition(4)))
    log = calibrate.MomentLog(str(tmp_path / "moments"))
    edges = [0, *cuts, len(data)]
    for i, (low, high) in enumerate(zip(edges, edges[1:])):
        log.append(spark.createDataFrame(data[low:high], SHAPE), i)
    assert fit_of(log.fit(spark)) == pytest.approx(want, rel=1e-9)
    x = np.array(data)
    scaled = (x[:, 2] - x[:, 2].min()) / np.ptp(x[:, 2])
    centre = x[:, 1].mean()
    solved = np.linalg.lstsq(np.column_stack([x[:, 1] - centre, scaled, np.ones(len(x))]), x[:, 0], rcond=None)[0]
    assert [want["alpha"], want["beta"], want["intercept"]] == pytest.approx([solved[0], solved[1], solved[2] - solved[0] * centre], rel=1e-6)


def test_missing_numbers_are_left_out(spark):
    data = points(30, 10)
    odd = [(float("nan"), 1.0, 1.0), (1.0, float("nan"), 1.0), (1.0, 1.0, float("nan")), (None, 1.0, 1.0), (1.0, None, 2.0)]
    want = fit_of(calibrate.fit_blend(spark.createDataFrame(data, SHAPE)))
    assert fit_of(calibrate.fit_blend(spark.createDataFrame(data + odd, SHAPE))) == pytest.approx(want, rel=1e-12)
    assert calibrate.fit_blend(spark.createDataFrame(odd, SHAPE)).count() == 0
    scaled = calibrate.minmax_scaled(spark.createDataFrame([(0.0,), (4.0,), (1.0,), (float("nan"),), (None,)], "x double"), "x", "y")
    assert [repr(r["y"]) for r in scaled.collect()] == ["0.0", "1.0", "0.25", "nan", "None"]


def test_fading_weighs_batches(spark, tmp_path):
    log = calibrate.MomentLog(str(tmp_path / "moments"), fading=0.5)
    assert log.fit(spark).count() == 0
    halves = points(50, 10, 1), points(50, 10, 2)
    for i, half in enumerate(halves):
        log.append(spark.createDataFrame(half, SHAPE), i)
    # fading by a half is the same as the later rows twice
    want = fit_of(calibrate.fit_blend(spark.createDataFrame(halves[0] + halves[1] * 2, SHAPE)))
    got = fit_of(log.fit(spark))
    assert [got[k] for k in ("alpha", "beta", "intercept")] == pytest.approx([want[k] for k in ("alpha", "beta", "intercept")], rel=1e-9)
    log.append(spark.createDataFrame([], SHAPE), 1)  # runs again without rows
    assert log.fit(spark).first()["rows"] == 50
