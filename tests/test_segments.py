"""Windows over large keys equal plain windows."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from marketlens.operators import segments
from marketlens.operators.features import add_features, next_price_label
from tests.conftest import rows

START = dt.datetime(2024, 1, 1)
SCHEMA = "symbol string, timestamp timestamp, id long, price double, volume double"


def frame(spark, triples):
    """Bars from (symbol, second, id)."""
    made = [
        (s, None if t is None else START + dt.timedelta(seconds=t), i, float((i * 37) % 101), float(i % 13))
        for s, t, i in triples
    ]
    return spark.createDataFrame(made, SCHEMA)


def plain_features(df):
    w = Window.partitionBy("symbol").orderBy("timestamp", "id")
    return df.select(
        "symbol", "timestamp", "id",
        F.lag("price", 3).over(w).alias("price_lag3"),
        F.avg("price").over(w.rowsBetween(-5, 0)).alias("rolling_mean_price"),
    )


def shown(df):
    return rows(df.select("symbol", "id", "price_lag3", F.round("rolling_mean_price", 9)))


SHAPES = {
    "even": [("A", t, t) for t in range(400)] + [("B", t, 1000 + t) for t in range(7)],
    "one instant holds a third": [("A", 5, i) for i in range(200)] + [("A", 10 * i, 500 + i) for i in range(150)],
    "far outlier": [("A", -10**9, 0)] + [("A", t, t + 1) for t in range(300)],
    "bursts": [("A", (t // 60) * 10**6 + t % 60, t) for t in range(360)],
    "ids beyond doubles": [("A", 5, 2**62 + i) for i in range(50)] + [("A", 6, 4000 * i) for i in range(100)],
    "null time and null symbol": [("A", None, i) for i in range(30)] + [("A", t, 100 + t) for t in range(100)]
    + [(None, t, 300 + t) for t in range(60)],
}


def test_features_of_cut_keys(spark):
    for name, triples in SHAPES.items():
        df = frame(spark, triples)
        cut = add_features(df, ["price_lag3", "rolling_mean_price"], ties=["id"], rows_per_segment=20)
        assert shown(cut) == shown(plain_features(df)), name


def test_segments_are_small(spark):
    for name, triples in SHAPES.items():
        if name == "ids beyond doubles":
            continue
        seg = segments.split_large_keys(frame(spark, triples), ["symbol"], ["timestamp", "id"], 20)
        assert seg.split
        largest = seg.frame.groupBy("symbol", segments.SEGMENT).count().agg(F.max("count")).first()[0]
        assert largest <= 20, name


def test_no_split_without_large_key(spark):
    seg = segments.split_large_keys(frame(spark, SHAPES["even"]), ["symbol"], ["timestamp", "id"])
    assert not seg.split
    plan = add_features(frame(spark, SHAPES["even"]), ties=["id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "Join" not in plan


def test_segment_count_is_bounded(spark):
    df = frame(spark, [("A", t, t) for t in range(1000)])
    seg = segments.split_large_keys(df, ["symbol"], ["timestamp", "id"], rows_per_segment=1, max_segments=10)
    assert seg.frame.select(segments.SEGMENT).distinct().count() <= 4 * 10


COPIES = [("A", 1, 1)] * 3 + [("A", 2, 7)] * 90 + [("A", 3, 8)] * 4 + [("A", t, t) for t in range(9, 60)] + [("A", 99, 5)] * 25


def test_copies_are_reported(spark):
    seg = segments.split_large_keys(frame(spark, COPIES), ["symbol"], ["timestamp", "id"], 20)
    assert seg.split and seg.crowded


def test_features_of_copies(spark):
    df = frame(spark, COPIES)
    cut = add_features(df, ["price_lag3", "rolling_mean_price"], ties=["id"], rows_per_segment=20)
    assert cut.columns == [*df.columns, "price_lag3", "rolling_mean_price"]
    assert shown(cut) == shown(plain_features(df))


def test_order_columns_beyond_doubles_are_not_skipped(spark):
    """Ids that differ only beyond double precision come before the price in the order."""
    made = [("A", START, 2**62 + i, float(-i), 1.0) for i in range(60)]
    df = spark.createDataFrame(made, SCHEMA)
    got = add_features(df, ["price_lag3"], ties=["id", "price"], rows_per_segment=20)
    w = Window.partitionBy("symbol").orderBy("timestamp", "id", "price")
    want = df.select("id", F.lag("price", 3).over(w))
    assert rows(got.select("id", "price_lag3")) == rows(want)


def test_clock_changes_of_the_session_zone(spark):
    night = dt.datetime(2024, 3, 10, 1, 30)
    made = [("A", night + dt.timedelta(minutes=i), i, float(i), 1.0) for i in range(120)]
    df = spark.createDataFrame(made, SCHEMA.replace("timestamp timestamp", "timestamp timestamp_ntz"))
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = rows(add_features(df, ["price_lag3"], rows_per_segment=10).select("id", "price_lag3"))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == sorted([(i, float(i - 3) if i > 2 else None) for i in range(120)], key=repr)


def test_crowd_at_one_instant_is_cut_by_price(spark):
    df = frame(spark, [("A", 5, i) for i in range(200)])
    seg = segments.split_large_keys(df, ["symbol"], ["timestamp", "price"], 20)
    assert seg.split and not seg.crowded


def test_ranks_and_next_prices_of_copies(spark):
    df = frame(spark, COPIES)
    w = Window.partitionBy("symbol").orderBy("timestamp", "id")
    ranks = segments.number_rows(df, ["symbol"], ["timestamp", "id"], rows_per_segment=20)
    want = df.select("symbol", "id", F.row_number().over(w), F.count("*").over(Window.partitionBy("symbol")))
    assert rows(ranks.select("symbol", "id", "rank", "size")) == rows(want)
    following = next_price_label(df, ties=["id"], rows_per_segment=20)
    assert following.columns == [*df.columns, "next_price"]
    assert rows(following.select("symbol", "id", "next_price")) == rows(df.select("symbol", "id", F.lead("price").over(w)))


def test_carry_forward_of_copies(spark):
    df = frame(spark, COPIES)
    w = Window.partitionBy("symbol").orderBy("timestamp", "id")
    present = F.col("id").isin(7, 30)
    want = df.select("symbol", "id", F.last(F.when(present, F.col("price")), ignorenulls=True).over(w))
    got = segments.carry_forward(df, ["symbol"], ["timestamp", "id"], F.col("price"), present, "v", 20)
    assert rows(got.select("symbol", "id", "v")) == rows(want)


def test_number_rows(spark):
    for name, triples in SHAPES.items():
        df = frame(spark, triples)
        w = Window.partitionBy("symbol")
        want = df.select("symbol", "id", F.row_number().over(w.orderBy("timestamp", "id")), F.count("*").over(w))
        got = segments.number_rows(df, ["symbol"], ["timestamp", "id"], rows_per_segment=20)
        assert rows(got.select("symbol", "id", "rank", "size")) == rows(want), name


def test_next_price_of_cut_keys(spark):
    for name, triples in SHAPES.items():
        df = frame(spark, triples)
        w = Window.partitionBy("symbol").orderBy("timestamp", "id")
        want = df.select("symbol", "id", F.lead("price").over(w))
        got = next_price_label(df, ties=["id"], rows_per_segment=20)
        assert rows(got.select("symbol", "id", "next_price")) == rows(want), name


def test_carry_forward_of_cut_keys(spark):
    for name, triples in SHAPES.items():
        df = frame(spark, triples)
        w = Window.partitionBy("symbol").orderBy("timestamp", "id")
        present = F.col("id") % 17 == 3
        held = F.when(present, F.struct(F.when(F.col("id") % 2 == 0, F.col("price")).alias("v")))
        want = df.select("symbol", "id", F.last(held, ignorenulls=True).over(w)["v"])
        value = F.when(F.col("id") % 2 == 0, F.col("price"))
        got = segments.carry_forward(df, ["symbol"], ["timestamp", "id"], value, present, "v", 20)
        assert rows(got.select("symbol", "id", "v")) == rows(want), name


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(st.tuples(st.sampled_from(["A", "A", "B"]), st.integers(0, 40)), min_size=1, max_size=60),
    st.integers(1, 9),
)
def test_any_cut_gives_the_same_features(spark, places, limit):
    df = frame(spark, [(s, t, i) for i, (s, t) in enumerate(places)])
    cut = add_features(df, ["price_lag3", "rolling_mean_price"], ties=["id"], rows_per_segment=limit)
    assert shown(cut) == shown(plain_features(df))


TEXTS = {
    "long shared beginning": [("A", "https://example.org/news/" + f"{i:05d}") for i in range(150)],
    "beginnings of each other": [("A", "ab" * i) for i in range(60)] + [("A", "abab\0" + "\0" * i) for i in range(40)],
    "nulls, empty and copies": [("A", None)] * 8 + [("A", "")] * 5 + [("A", "x")] * 9 + [("A", f"é{i}") for i in range(90)],
    "two keys": [("A", f"{i % 40}") for i in range(120)] + [(None, f"n{i}") for i in range(50)] + [("B", "b")],
}


def test_keys_are_cut_by_a_text(spark):
    for name, made in TEXTS.items():
        df = spark.createDataFrame([(s, t, i) for i, (s, t) in enumerate(made)], "symbol string, url string, id long")
        w = Window.partitionBy("symbol")
        want = df.select("symbol", "id", F.row_number().over(w.orderBy("url", "id")), F.count("*").over(w))
        got = segments.number_rows(df, ["symbol"], ["url", "id"], rows_per_segment=10)
        assert rows(got.select("symbol", "id", "rank", "size")) == rows(want), name
        seg = segments.split_large_keys(df, ["symbol"], ["url", "id"], 10)
        assert seg.split and not seg.crowded, name
        assert seg.frame.groupBy("symbol", segments.SEGMENT).count().agg(F.max("count")).first()[0] <= 10, name


def test_numbers_take_one_sort_whatever_the_texts(spark):
    """Texts that begin alike and copies of them cost no round of cuts each; small keys are beside large ones."""
    made = [("A", "ab" * (i % 250)) for i in range(500)] + [(None, "x" * 90 + str(i)) for i in range(70)] + [("B", "b")] * 3
    df = spark.createDataFrame([(s, t, i) for i, (s, t) in enumerate(made)], "symbol string, url string, id long")
    w = Window.partitionBy("symbol")
    want = rows(df.select("symbol", "id", F.row_number().over(w.orderBy("url", "id")), F.count("*").over(w)))
    spark.sparkContext.setJobGroup("numbers", "numbers")
    try:
        got = segments.number_rows(df, ["symbol"], ["url", "id"], rows_per_segment=5, without=["url"])
        assert got.columns == ["symbol", "id", "rank", "size"]
        assert rows(got) == want
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("numbers")) < 25
    finally:
        spark.sparkContext.setJobGroup("default", "default")


def test_documents_in_the_default_order_cut_a_hot_symbol(spark):
    from marketlens.sources import landed

    made = [("A", f"2024-01-01 {i // 60:02d}:{i % 60:02d}", float(i)) for i in range(300)]
    served = spark.createDataFrame(made, "symbol string, date string, price double").withColumns(
        {c: F.lit(1).cast(t) for c, t in (("volume", "int"), ("rawPrediction", "double"), ("sentiment", "double"),
                                          ("finalPrediction", "double"))})
    seg = segments.split_large_keys(served, ["symbol"], ["date"], 40)
    assert seg.split and not seg.crowded
    paged = landed.market_documents(served, records=25, rows_per_segment=40).orderBy("page").collect()
    assert [[r["price"] for r in p["d"]["data"]] for p in paged] == [
        [float(i) for i in range(p * 25, p * 25 + 25)] for p in range(12)]


def test_longs_beyond_doubles_are_cut(spark):
    made = [(2**60 + i * step, i) for step in (1, 3) for i in range(50)] + [(None, -1), (2**32 * 7 - 2, -2), (2**32 * 7 + 2, -3), (-(2**62) - 1, -4), (-(2**62), -5)]
    df = spark.createDataFrame([("A", *m) for m in made], "k string, at long, id int")
    seg = segments.split_large_keys(df, ["k"], ["at", "id"], 10)
    assert seg.split and not seg.crowded
    assert seg.frame.groupBy(segments.SEGMENT).count().agg(F.max("count")).first()[0] <= 10
    got = segments.number_rows(df, ["k"], ["at", "id"], rows_per_segment=5)
    w = Window.partitionBy("k").orderBy("at", "id")
    want = df.select("*", F.row_number().over(w).cast("long").alias("rank"), F.count("*").over(Window.partitionBy("k")).alias("size"))
    assert sorted(map(repr, map(tuple, got.select("at", "id", "rank").collect()))) == sorted(
        map(repr, map(tuple, want.select("at", "id", "rank").collect())))


def test_copies_keep_their_bits_and_maps(spark):
    """Above the limit a crowd of copies is the same, to the bit, as below it, and columns of maps do no harm."""
    odd = [-0.0, 0.0, float("nan"), None, 1.5]
    made = [("A", START, odd[i % 5], {"x": odd[i % 3], "y": None}, [odd[i % 2]]) for i in range(60)]
    df = spark.createDataFrame(made, "symbol string, timestamp timestamp, price double, data map<string,double>, more array<double>")
    def text(frame):
        return sorted(repr(tuple(r)) for r in frame.collect())

    shown = ["price", "data", "more"]
    assert text(segments.expand_copies(segments.collapse_copies(df, kept=2)).select(*shown)) == text(df.select(*shown))
    for limit in (10, 1000):
        ranked = segments.number_rows(df, ["symbol"], ["timestamp"], rows_per_segment=limit)
        assert text(ranked.select(*shown)) == text(df.select(*shown))
        assert sorted(r["rank"] for r in ranked.collect()) == list(range(1, 61))
        carried = segments.carry_forward(df, ["symbol"], ["timestamp"], F.lit(1), F.lit(True), "v", limit)
        assert text(carried.select(*shown)) == text(df.select(*shown))
        wide = add_features(df.withColumn("volume", F.lit(1.0)), ["price_lag1"], rows_per_segment=limit)
        assert text(wide.select(*shown)) == text(df.select(*shown))


def test_nested_and_binary_columns_count_in_size(spark):
    from marketlens.operators import lookup

    wide = spark.range(2000).select("id", F.sequence(F.lit(1), F.lit(500)).alias("a"))
    assert not lookup.is_small(wide, max_bytes=2_000_000) and lookup.is_small(wide.select("id"), max_bytes=2_000_000)
    blobs = spark.range(2000).select("id", F.repeat(F.lit("x"), 2000).cast("binary").alias("a"))
    assert not lookup.is_small(blobs, max_bytes=2_000_000)
    maps = spark.range(2000).select("id", F.create_map(F.lit("k"), F.repeat(F.lit("x"), 2000)).alias("a"), F.struct(F.col("id")).alias("s"))
    assert not lookup.is_small(maps, max_bytes=2_000_000)
