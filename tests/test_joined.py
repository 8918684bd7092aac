"""The serving join over two streams: restarts, late rows, bounded state."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from marketlens.operators.upsert import VersionedLog
from marketlens.streaming import joined
from marketlens.streaming.runner import run_stream
from tests.conftest import rows

T0 = dt.datetime(2024, 1, 1)
BARS, NEWS = "id long, symbol string, timestamp timestamp, price double", "n long, company string, published_at timestamp, overall_sentiment double"
FAR = dt.datetime(2100, 1, 1)


def hours(h):
    return T0 + dt.timedelta(hours=h)


def frames(spark, bars, news):
    return spark.createDataFrame(bars, BARS), spark.createDataFrame(news, NEWS)


def plain(bars, news, hours_back):
    out = []
    for i, symbol, at, price in sorted(set(bars), key=repr):
        near = [(t, n, s) for n, c, t, s in news if c is not None and c == symbol and at is not None and t is not None
                and t <= at and t > at - dt.timedelta(hours=hours_back)]
        out.append((i, symbol, at, price, max(near, key=lambda r: r[:2])[2] if near else None))
    return sorted(out, key=repr)


ODD_BARS = [(0, "A", hours(5), 1.0), (1, "A", hours(5), 1.0), (1, "A", hours(5), 1.0), (2, None, hours(5), 1.0), (3, "B", None, 1.0), (4, "C", hours(9), None)]
ODD_NEWS = [(0, "A", hours(5), 0.5), (1, "A", hours(5), None), (2, "A", hours(3), 0.1), (3, None, hours(4), 0.9), (4, "B", None, 0.9), (5, "C", hours(1), 0.7)]


@pytest.mark.parametrize("spread", [1, 3])
def test_tables(spark, spread):
    bars, news = frames(spark, ODD_BARS, ODD_NEWS)
    got = joined.serve(bars, news, "8 hours", news_ties=["n"], spread=spread)
    assert rows(got) == plain(ODD_BARS, ODD_NEWS, 8)
    assert rows(got)[0][4] is None  # the newest article of the hour has no score
    assert joined.serve(bars.limit(0), news, "1 hour").count() == 0
    assert rows(joined.serve(bars, news.limit(0), "1 hour").select("sentiment").distinct()) == [(None,)]


def test_many_articles_in_the_interval_make_no_pairs(spark):
    """Times across 1970, on the interval's and the slots' borders, and copies; no plan that pairs bars with all articles before them."""
    bars = [(i, "AB"[i % 2], dt.datetime(1969, 12, 30) + dt.timedelta(minutes=i * 15 % 6000), float(i)) for i in range(500)]
    news = [(i, "A" if i % 3 else "B", dt.datetime(1969, 12, 31) + dt.timedelta(minutes=i * 45 % 2000), i / 7) for i in range(200)]
    for spread in (1, 4):
        got = joined.serve(*frames(spark, bars + bars[:9], news), "9 hours", news_ties=["n"], spread=spread)
        assert rows(got) == plain(bars, news, 9)
        assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


def test_restarted_streams_equal_the_tables_and_drop_their_state(spark, tmp_path):
    bars = [(i, "AB"[i % 2], hours(i), float(i)) for i in range(48)]
    news = [(i, "AB"[i // 2 % 2], hours(1.5 * i), i / 100) for i in range(32)]
    late_bar, late_news = (99, "A", hours(1), 0.0), (99, "A", hours(1), 0.99)
    batches = [(bars[:20], news[:10]), (bars[20:40], [*news[10:28]]), ([*bars[40:], late_bar], [*news[28:], late_news]),
               ([(-1, "", FAR, 0.0)], [(-1, "", FAR, 0.0)])]
    splits = {}
    for name, shape, ts, key in (("bars", BARS, "timestamp", "id"), ("news", NEWS, "published_at", "n")):
        schema = spark.createDataFrame([], shape).schema
        late = VersionedLog(str(tmp_path / f"{name}-late"), schema, [key], ts)
        splits[name] = joined.LateSplit(spark, str(tmp_path / name), late, ts, "12 hours"), schema
    log = VersionedLog(str(tmp_path / "served"), spark.createDataFrame([], f"{BARS}, sentiment double").schema, ["id"])
    states = []
    for k, made in enumerate(batches):
        for (split, schema), part in zip(splits.values(), made):
            split(spark.createDataFrame(part, schema), k)
            if k == 2:
                split(spark.createDataFrame(part, schema), k)  # the batch runs again
        served = joined.serve(splits["bars"][0].staged(splits["bars"][1]), splits["news"][0].staged(splits["news"][1]),
                              "6 hours", "12 hours", news_ties=["n"])
        query = run_stream(served, log.append, str(tmp_path / "checkpoint"), trigger=None, output_mode="append", keep=False)
        query.awaitTermination()
        states.append([s["numRowsTotal"] for s in query.lastProgress["stateOperators"]])
    assert rows(log.current(spark).filter("id >= 0")) == plain(bars, news, 6)
    assert [rows(s.late.current(spark))[0][0] for s, _ in splits.values()] == [99, 99]
    assert all(s.late.current(spark).count() == 1 for s, _ in splits.values())
    assert log.versions(spark).filter("id >= 0").count() == len(bars)  # each emitted once
    assert sum(states[1]) > 10 and sum(states[-1]) <= 4  # what is past is gone, only the far rows are open


def test_rows_without_time_are_late_and_lost_state_is_an_error(spark, tmp_path):
    frame = spark.createDataFrame([(1, "A", None, 1.0), (2, "A", T0, 1.0)], BARS)
    late = VersionedLog(str(tmp_path / "late"), frame.schema, ["id"])
    split = joined.LateSplit(spark, str(tmp_path / "rows"), late)
    split(frame, 0)
    assert rows(late.current(spark).select("id")) == [(1,)]
    assert spark.read.parquet(str(tmp_path / "rows/rows/batch=0")).agg(F.sum("id")).first()[0] == 2
    with pytest.raises(RuntimeError):
        split(frame, 5)
