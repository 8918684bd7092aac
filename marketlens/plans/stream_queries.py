"""Streaming runs over the given tables.

Most tables arrive in slices: each is landed as files and handled by a run that
goes on from the checkpoint of the one before, so state, watermarks and logs
carry over batches and restarts. Results are written below the shared folder
and read back; nothing passes through the driver.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens import schemas
from marketlens.operators import features, forecast, upsert
from marketlens.operators.upsert import VersionedLog
from marketlens.plans.catalog import query
from marketlens.plans.tick_queries import COMPLETE, FEATURE_TABLE_SQL, FEATURES_SQL, TIES, rounded
from marketlens.plans.views import NEWS_START, SCORED, TICK_COMPANIES_SQL, TICKS, lexicon, table, tick_companies, ticks
from marketlens.session import shared_path
from marketlens.sources import landed, topics
from marketlens.streaming import incremental, jobs, joined, versions, windows
from marketlens.streaming.runner import run_stream

TICK = T.StructType([T.StructField("event_id", T.LongType()), *schemas.BAR.fields])
TICK_SLICES = 4
#: Runs in which a table arrives.
RUNS = 3


def stream_table(spark, sf_dir, name):
    """One table of the folder as a stream."""
    shape = table(spark, sf_dir, name).schema
    return spark.readStream.schema(shape).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def stream_ticks(spark, sf_dir):
    return stream_table(spark, sf_dir, "events").select(
        "event_id",
        F.col("event_type").alias("symbol"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.col("value").alias("price"),
        F.get_json_object("props", "$.k").try_cast("double").alias("volume"),
    )


def sliced_ticks(spark, sf_dir, slices=RUNS):
    """Ticks with the ``slice`` of the time that they belong to; those without a time come first."""
    return placed(ticks(spark, sf_dir).withColumn("timestamp", F.col("timestamp").cast("timestamp")), slices)


def placed(rows, slices=RUNS):
    """Rows with the ``slice`` of the time that they belong to; those without a time come first."""
    bounds = rows.agg(F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi"))
    lo, hi = (F.unix_micros(bounds.select(c).scalar()) for c in ("lo", "hi"))
    position = (F.unix_micros("timestamp") - lo) / (hi - lo)
    return rows.withColumn("slice", F.coalesce(F.least(F.floor(position * slices), F.lit(slices - 1)), F.lit(0)))


def run_in_slices(rows, out, start, runs=RUNS):
    """Land the rows of one ``slice`` after the other below ``out``, each followed by a run of the stream.

    ``start(source)`` starts a query over all landed files that stops when it
    has handled what is there, always with the same checkpoint.
    """
    spark, shape = rows.sparkSession, rows.drop("slice").schema
    rows = rows.persist()
    for k in range(runs):
        rows.filter(F.col("slice") == k).drop("slice").write.parquet(f"{out}/landed/{k}")
        start(spark.readStream.schema(shape).parquet(f"{out}/landed/*")).awaitTermination()
    rows.unpersist()


def later(slice_, runs=RUNS):
    """The slice after, for rows that come late."""
    return F.least(slice_ + 1, F.lit(runs - 1))


def plain(df, *names):
    """Timestamps as they are stored, without a zone."""
    return df.withColumns({n: F.col(n).cast("timestamp_ntz") for n in names})


@query("stream_dedup", f'WITH {TICKS} SELECT event_id, symbol, "timestamp", price, volume FROM ticks')
def stream_dedup(spark, sf_dir):
    """Each bar arrives three times, once with the bars of the next run; copies are told apart by a copy number."""
    out = shared_path(spark, "dedup")
    copies = sliced_ticks(spark, sf_dir).withColumn("copy", F.explode(F.array(*map(F.lit, range(3)))))
    copies = copies.withColumn("slice", F.when(F.col("copy") == 2, later(F.col("slice"))).otherwise(F.col("slice")))

    def start(source):
        kept = windows.drop_repeats(source, delay="40 days", spread=F.col("copy")).drop("copy")
        return (
            kept.writeStream.format("parquet")
            .option("path", f"{out}/kept")
            .option("checkpointLocation", f"{out}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )

    run_in_slices(copies, out, start)
    return plain(spark.read.schema(TICK).parquet(f"{out}/kept"), "timestamp")


@query(
    "stream_dedup_late",
    f"""WITH {TICKS}, bounds AS (SELECT epoch_us(min("timestamp")) AS lo, epoch_us(max("timestamp")) AS hi FROM ticks),
    placed AS (
      SELECT ticks.*, least(floor((epoch_us("timestamp") - lo) / (hi - lo) * {RUNS}), {RUNS - 1}) AS slice FROM ticks, bounds),
    tops AS (SELECT slice, max(max("timestamp")) OVER (ORDER BY slice) AS top FROM placed GROUP BY slice)
    SELECT event_id, symbol, "timestamp", price, volume, false AS late FROM ticks
    UNION ALL
    SELECT event_id, symbol, "timestamp", price, volume, true AS late FROM placed JOIN tops USING (slice)
    WHERE slice < {RUNS - 1} AND "timestamp" < top - INTERVAL '1 day'""",
)
def stream_dedup_late(spark, sf_dir):
    """Each bar arrives again with the bars of the next run; a copy beyond the delay is set aside, not dropped."""
    out = shared_path(spark, "dedup-late")
    copies = sliced_ticks(spark, sf_dir).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    copies = copies.withColumn("slice", F.when(F.col("copy") == 1, later(F.col("slice"))).otherwise(F.col("slice")))
    keys = ["symbol", "timestamp"]
    handler = windows.RepeatFilter(
        spark, f"{out}/state", VersionedLog(f"{out}/first", TICK, keys), VersionedLog(f"{out}/late", TICK, keys), keys,
        delay="1 day",
    )
    run_in_slices(copies.drop("copy"), out, lambda source: run_stream(source, handler, f"{out}/checkpoint", trigger=None))
    first, late = (log.versions(spark).select(*TICK.fieldNames()) for log in (handler.output, handler.late))
    both = first.withColumn("late", F.lit(False)).unionByName(late.withColumn("late", F.lit(True)))
    return plain(both, "timestamp")


_OHLC = T.StructType(
    [
        T.StructField("window_start", T.TimestampType()),
        T.StructField("window_end", T.TimestampType()),
        T.StructField("symbol", T.StringType()),
        *[T.StructField(n, T.DoubleType()) for n in ("open", "high", "low", "close", "volume")],
        T.StructField("ticks", T.LongType()),
    ]
)


_OHLC_SQL = f"""WITH {TICKS} SELECT time_bucket(INTERVAL '1 hour', "timestamp") AS window_start,
      time_bucket(INTERVAL '1 hour', "timestamp") + INTERVAL '1 hour' AS window_end, symbol,
      arg_min(price, "timestamp") AS "open", max(price) AS high, min(price) AS low,
      arg_max(price, "timestamp") AS "close", round(sum(volume) + 1e-10, 6) AS volume, count(*) AS ticks
    FROM ticks GROUP BY ALL"""


@query("stream_window_ohlc", _OHLC_SQL)
def stream_window_ohlc(spark, sf_dir):
    """Changed windows of each batch go to a log; its latest versions are the table, open windows included."""
    out = shared_path(spark, "ohlc")
    log = VersionedLog(f"{out}/log", _OHLC, ["window_start", "symbol"], "window_start")

    def start(source):
        rolled = windows.ohlc_bars(source.withWatermark("timestamp", "1 hour"))
        return run_stream(rolled, log.append, f"{out}/checkpoint", trigger=None)

    run_in_slices(sliced_ticks(spark, sf_dir), out, start)
    return plain(rounded(log.current(spark), ("volume",)), "window_start", "window_end")


@query("stream_window_ohlc_late", _OHLC_SQL)
def stream_window_ohlc_late(spark, sf_dir):
    """Every tenth bar comes a run late, far behind any watermark; parts of windows take it in all the same."""
    out = shared_path(spark, "ohlc-late")
    log = VersionedLog(f"{out}/log", windows.PARTS, ["window_start", "symbol"], "window_start")
    late = F.col("event_id") % 10 == 3
    rows = sliced_ticks(spark, sf_dir)
    rows = rows.withColumn("slice", F.when(late, later(F.col("slice"))).otherwise(F.col("slice")))

    def handle(bars, batch_id):
        log.append(windows.ohlc_parts(bars), batch_id)

    run_in_slices(rows, out, lambda source: run_stream(source, handle, f"{out}/checkpoint", trigger=None))
    return plain(rounded(windows.merged_ohlc(log, spark), ("volume",)), "window_start", "window_end")


_FEATURES = T.StructType(
    [
        *TICK.fields,
        *[T.StructField(n, T.DoubleType()) for n in
          ("price_lag1", "price_lag2", "price_lag3", "volume_lag1", "price_change", "volume_change")],
        *[T.StructField(n, T.IntegerType()) for n in ("hour", "day", "day_of_week")],
        *[T.StructField(n, T.DoubleType()) for n in ("rolling_mean_price", "rolling_mean_volume")],
    ]
)


_CORRECTED_TICKS = """ticks AS (
  SELECT event_id, symbol, "timestamp", CASE WHEN event_id % 29 = 7 THEN NULL ELSE price END AS price, volume
  FROM raw_ticks)"""


def _feature_stream(spark, out, lateness):
    keys = ["symbol", "timestamp", "event_id"]
    return incremental.FeatureStream(
        spark,
        f"{out}/state",
        VersionedLog(f"{out}/features", _FEATURES, keys, deletes=True),
        VersionedLog(f"{out}/late", TICK, keys),
        TICK,
        ties=TIES,
        lateness=lateness,
    )


def _in_slices(spark, sf_dir, out, slice_of):
    """Ticks cut into slices, each handled as one micro-batch."""
    handler = _feature_stream(spark, out, "2 days")
    rows = ticks(spark, sf_dir).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    bounds = rows.agg(F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi"))
    lo, hi = (F.unix_micros(bounds.select(c).scalar()) for c in ("lo", "hi"))
    position = (F.unix_micros("timestamp") - lo) / (hi - lo)
    sliced = rows.withColumn("slice", slice_of(position)).persist()
    for batch_id in range(TICK_SLICES):
        handler(sliced.filter(F.col("slice") == batch_id).select(*TICK.fieldNames()), batch_id)
    sliced.unpersist()
    return rounded(plain(handler.output.current(spark), "timestamp"))


@query("feature_table_incremental", FEATURE_TABLE_SQL)
def feature_table_incremental(spark, sf_dir):
    """The feature table from micro-batches cut along time."""
    return _in_slices(
        spark, sf_dir, shared_path(spark, "features"),
        lambda position: F.least(F.floor(position * TICK_SLICES), F.lit(TICK_SLICES - 1)),
    )


@query("feature_table_late_bars", FEATURE_TABLE_SQL)
def feature_table_late_bars(spark, sf_dir):
    """As feature_table_incremental, with every tenth bar up to a day late.

    Late bars reach the batch after their own, within the allowance; features
    of the bars that follow them are emitted again.
    """
    day = 1 / 31
    late = F.when(F.col("event_id") % 10 == 3, F.lit(day)).otherwise(F.lit(0.0))
    return _in_slices(
        spark, sf_dir, shared_path(spark, "late-features"),
        lambda position: F.least(F.floor((position + late) * TICK_SLICES), F.lit(TICK_SLICES - 1)),
    )


@query(
    "feature_table_corrected",
    FEATURE_TABLE_SQL.replace(TICKS, f"{TICKS.replace('ticks AS', 'raw_ticks AS')}, {_CORRECTED_TICKS}"),
)
def feature_table_corrected(spark, sf_dir):
    """Every 29th bar comes again in the last batch without a price, which takes features back."""
    handler = _feature_stream(spark, shared_path(spark, "corrected-features"), "60 days")
    rows = ticks(spark, sf_dir).withColumn("timestamp", F.col("timestamp").cast("timestamp")).select(*TICK.fieldNames())
    wrong = rows.filter("event_id % 29 = 7").withColumn("price", F.lit(None).cast("double"))
    handler(rows, 0)
    handler(wrong, 1)
    return rounded(plain(handler.output.current(spark), "timestamp"))


@query("stream_features", FEATURE_TABLE_SQL)
def stream_features(spark, sf_dir):
    """The feature table from a running stream."""
    out = shared_path(spark, "stream-features")
    handler = _feature_stream(spark, out, "1 hour")
    rows = sliced_ticks(spark, sf_dir)
    run_in_slices(rows, out, lambda source: run_stream(source, handler, f"{out}/checkpoint", trigger=None))
    return rounded(plain(handler.output.current(spark), "timestamp"))


@query(
    "stream_bars",
    f"""WITH {TICKS} SELECT symbol, date_trunc('second', "timestamp") AS "timestamp", price, volume FROM ticks""",
)
def stream_bars(spark, sf_dir):
    """Bars through JSON messages and the streaming decoder into files."""
    out = shared_path(spark, "bars")
    decoded = topics.decode_bars(topics.encode_bars(stream_ticks(spark, sf_dir)))
    run = (
        decoded.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", f"{out}-checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    return plain(spark.read.schema(schemas.BAR).parquet(out), "timestamp")


@query(
    "stream_news",
    f"""WITH {SCORED} SELECT company, published_at AS "timestamp", description, title, sentiment_label,
    round(CAST(overall_sentiment::FLOAT AS DOUBLE), 4) AS overall_sentiment, CAST(doc_id AS VARCHAR) AS url FROM scored""",
)
def stream_news(spark, sf_dir):
    """Articles through JSON messages, the decoder, the news job and its log."""
    out = shared_path(spark, "news")
    text = F.col("text")
    title = F.split_part(text, F.lit("\n"), F.lit(1))
    at = F.lit(NEWS_START).cast("timestamp") + F.make_dt_interval(mins=F.col("doc_id").cast("int"))
    articles = table(spark, sf_dir, "documents").select(
        title.alias("title"), F.substr(text, F.length(title) + 2).alias("description"), "source",
        F.col("doc_id").cast("string").alias("url"), at.alias("published_at"), at.alias("fetch_timestamp"),
        F.col("source").alias("company"), F.coalesce(F.pmod("doc_id", F.lit(RUNS)), F.lit(0)).alias("slice"),
    )
    log = VersionedLog(f"{out}/log", schemas.STORED_NEWS, ["company", "url"])
    handler = jobs.news_handler(lexicon(spark), log, extra=("url",))

    def start(source):
        decoded = topics.decode_news(topics.encode_news(source))
        return run_stream(decoded, handler, f"{out}/checkpoint", trigger=None)

    run_in_slices(articles, out, start)
    stored = log.current(spark).select(
        "company", "timestamp", "description", "title", "sentiment_label",
        F.round(F.col("overall_sentiment").cast("double"), 4).alias("overall_sentiment"), "url",
    )
    return plain(stored, "timestamp")


@query(
    "stream_parquet_scores",
    f"""WITH {TICKS} SELECT symbol, "timestamp", CAST(CAST(price * 1.01::DOUBLE AS FLOAT) AS DOUBLE) AS prediction,
    CAST(CAST(price AS FLOAT) AS DOUBLE) AS price, trunc(volume) AS volume FROM ticks""",
)
def stream_parquet_scores(spark, sf_dir):
    """Prediction files without volumes streamed into a log that has them from an earlier writer."""
    out = shared_path(spark, "scores")
    rows = ticks(spark, sf_dir).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    log = VersionedLog(f"{out}/log", schemas.PREDICTION, ["symbol", "timestamp"])
    log.append(upsert.prediction_rows(rows.withColumn("prediction", F.col("price"))), 0)
    rows.select("timestamp", "symbol", "price", (F.col("price") * 1.01).alias("prediction")).write.parquet(f"{out}/files")
    source = landed.stream_scored_files(spark, f"{out}/files")
    handler = jobs.partial_handler(log, first_batch=1)
    run_stream(source, handler, f"{out}/checkpoint", trigger=None).awaitTermination()
    merged = plain(log.current(spark, by_column=True), "timestamp")
    return merged.withColumns({c: F.col(c).cast("double") for c in ("prediction", "price", "volume")})


_SERVED_TICK = "event_id long, symbol string, timestamp timestamp, price double"
_SERVED_NEWS = "doc_id long, company string, published_at timestamp, overall_sentiment double"
_MONTH = 30 * 24 * 60


@query(
    "stream_serving_join",
    f"""WITH {SCORED}, {TICKS}, {TICK_COMPANIES_SQL},
    articles AS (SELECT doc_id, company, overall_sentiment, TIMESTAMP '{NEWS_START}' + to_minutes((doc_id * 37) % {_MONTH}) AS told FROM scored),
    mapped AS (SELECT event_id, coalesce(company, t.symbol) AS symbol, "timestamp", price FROM ticks t LEFT JOIN tick_companies c ON c.symbol = t.symbol),
    newest AS (
      SELECT event_id, overall_sentiment AS s FROM (
        SELECT m.event_id, a.overall_sentiment, row_number() OVER (PARTITION BY m.event_id ORDER BY a.told DESC, a.doc_id DESC) AS n
        FROM mapped m JOIN articles a ON a.company = m.symbol AND a.told <= m."timestamp" AND a.told > m."timestamp" - INTERVAL '2 days')
      WHERE n = 1)
    SELECT m.*, round(s + 1e-10, 6) AS sentiment FROM mapped m LEFT JOIN newest n ON n.event_id = m.event_id""",
)
def stream_serving_join(spark, sf_dir):
    """Bars and scored articles as two streams in slices; each run goes on where the one before stopped.

    Every eleventh article comes a slice late, but within the delay of the
    staged stream; at the end a row far ahead on both sides closes what is open.
    """
    from marketlens.plans.news_queries import scored_articles

    out = shared_path(spark, "serving")
    bars = sliced_ticks(spark, sf_dir).join(F.broadcast(tick_companies(spark)), "symbol", "left").select(
        "event_id", F.coalesce("company", "symbol").alias("symbol"), "timestamp", "price", F.col("slice").cast("int").alias("slice"))
    minutes = F.pmod(F.col("doc_id") * 37, F.lit(_MONTH)).cast("int")
    at = F.lit(NEWS_START).cast("timestamp") + F.make_dt_interval(mins=minutes)
    slice_ = F.least(F.floor(minutes * RUNS / _MONTH), F.lit(RUNS - 1))
    news = scored_articles(spark, sf_dir, ("company",)).select("doc_id", "company", at.alias("published_at"), "overall_sentiment", F.when(
        F.col("doc_id") % 11 == 0, later(slice_)).otherwise(slice_).cast("int").alias("slice"))
    far = "timestamp '2100-01-01 00:00:00'"
    bars = bars.unionByName(spark.sql(f"SELECT -1L AS event_id, '' AS symbol, {far} AS timestamp, 0D AS price, {RUNS} AS slice"))
    news = news.unionByName(spark.sql(f"SELECT -1L AS doc_id, '' AS company, {far} AS published_at, 0D AS overall_sentiment, {RUNS} AS slice"))
    sides = []
    for name, rows, ts in (("bars", bars, "timestamp"), ("news", news, "published_at")):
        shape = rows.drop("slice").schema
        late = VersionedLog(f"{out}/{name}-late", shape, [shape.fieldNames()[0]], ts)
        split = joined.LateSplit(spark, f"{out}/{name}", late, ts, delay="15 days")
        run_in_slices(rows, f"{out}/{name}-in", lambda source, s=split, n=name: run_stream(
            source, s, f"{out}/{n}-in/checkpoint", trigger=None), runs=RUNS + 1)
        sides.append(split)
    log = VersionedLog(f"{out}/served", T.StructType.fromDDL(f"{_SERVED_TICK}, sentiment double"), ["event_id"])
    for _ in range(2):  # the second run finds nothing new and changes nothing
        served = joined.serve(sides[0].staged(_SERVED_TICK), sides[1].staged(_SERVED_NEWS), "2 days", "15 days", news_ties=["doc_id"])
        run_stream(served, log.append, f"{out}/served-checkpoint", trigger=None, output_mode="append", keep=False).awaitTermination()
    return rounded(plain(log.current(spark).filter("event_id >= 0"), "timestamp"), ("sentiment",))


_VERSIONED = T.StructType([
    *schemas.PREDICTION.fields, T.StructField("event_id", T.LongType()), T.StructField(versions.VERSION, T.LongType())])


@query(
    "stream_model_versions",
    f"""WITH {TICKS}, {FEATURES_SQL}, complete AS (SELECT * FROM features WHERE {COMPLETE}),
    bounds AS (SELECT epoch_us(min("timestamp")) AS lo, epoch_us(max("timestamp")) AS hi FROM complete),
    placed AS (
      SELECT complete.*, least(floor((epoch_us("timestamp") - lo) / (hi - lo) * {RUNS}), {RUNS - 1}) AS slice
      FROM complete, bounds)
    SELECT event_id, symbol, "timestamp", CASE WHEN slice > 0 THEN CAST(slice AS BIGINT) END AS model_version,
      slice > 0 AS predicted, CASE WHEN slice > 0 THEN true END AS in_range FROM placed""",
)
def stream_model_versions(spark, sf_dir):
    """Rows are scored by the model trained on the slices before theirs; none is there for the first slice.

    A forest's prediction is a mean of training prices, so those of a version
    lie within the prices of the slices it was trained on.
    """
    out = shared_path(spark, "versions")
    shelf = versions.ModelShelf(spark, f"{out}/models")
    log = VersionedLog(f"{out}/log", _VERSIONED, ["event_id"])
    scoring = versions.VersionedScoring(shelf, log, f"{out}/uses", extra=("event_id",))
    complete = features.feature_table(ticks(spark, sf_dir), ties=TIES).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    sliced = placed(complete).persist()
    runs = iter(range(RUNS))

    def start(source):
        run = next(runs)
        if run:
            known = forecast.spread_evenly(sliced.filter(F.col("slice") < run), ["event_id"]).persist()
            shelf.publish(forecast.train_forest(known, trees=10, depth=5), run)
            known.unpersist()
        return run_stream(source, scoring, f"{out}/checkpoint", trigger=None)

    run_in_slices(sliced, out, start)
    ranges = [
        landed_prices.agg(F.min("price").alias("lo"), F.max("price").alias("hi")).withColumn("of", F.lit(run).cast("long"))
        for run in range(1, RUNS)
        for landed_prices in [spark.read.parquet(*[f"{out}/landed/{k}" for k in range(run)])]
    ]
    bounds = ranges[0]
    for more in ranges[1:]:
        bounds = bounds.unionByName(more)
    p = F.col("prediction")
    scored = log.current(spark).join(F.broadcast(bounds), F.col(versions.VERSION) == F.col("of"), "left")
    return plain(scored.select(
        "event_id", "symbol", "timestamp", versions.VERSION, p.isNotNull().alias("predicted"),
        p.between(F.col("lo") - 1e-3, F.col("hi") + 1e-3).alias("in_range")), "timestamp")
