"""Queries over results that follow a log instead of being computed anew."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlens.functions import columns as C
from marketlens.operators import calibrate, changes, upsert
from marketlens.operators.lookup import hold
from marketlens.plans.catalog import query
from marketlens.plans.news_queries import _STATS, _STATS_SQL, scored_articles
from marketlens.plans.serving_queries import _FIT_SQL, _rounded_fit
from marketlens.plans.tick_queries import rounded
from marketlens.plans.views import SCORED, table
from marketlens.session import shared_path


def _corrected_log(spark, sf_dir):
    """Articles in three batches: new ones, corrected scores, moved and deleted ones; feed and totals follow.

    The last batch runs twice, first with rows that the second try does not
    have; the first batch is compacted in between.
    """
    scored = scored_articles(spark, sf_dir, ("company", "published_at")).filter("doc_id IS NOT NULL").select(
        "doc_id", F.col("published_at").alias("timestamp"), "company", "overall_sentiment", "sentiment_label")
    scored = hold(scored)
    path = shared_path(spark, "changes")
    log = upsert.VersionedLog(f"{path}/log", scored.schema, ["doc_id", "timestamp"], deletes=True)
    feed = changes.ChangeFeed(log, f"{path}/feed")
    totals = changes.CompanyTotals(feed, f"{path}/totals")

    def run(batch, rows):
        totals.rewind(spark, batch)
        log.append(rows, batch)
        feed.record(spark, batch)
        totals.advance(spark, batch)

    doc = F.col("doc_id")
    turned = scored.withColumn("overall_sentiment", -F.col("overall_sentiment"))
    turned = turned.withColumn("sentiment_label", C.sentiment_label("overall_sentiment"))
    run(0, scored.filter(doc % 4 != 3))
    run(1, scored.filter((doc % 4 == 3) & (doc % 6 != 1)).unionByName(turned.filter(doc % 6 == 1)))
    log.compact(spark, 0)
    moved = scored.withColumn("company", F.lit("moved")).filter(doc % 10 == 2).withColumn(upsert.DELETED, F.lit(False))
    gone = scored.filter(doc % 10 == 7).withColumn(upsert.DELETED, F.lit(True))
    run(2, scored.withColumn(upsert.DELETED, doc % 2 == 0))
    run(2, moved.unionByName(gone))
    return feed, totals


_CORRECTED = f"""{SCORED},
  turned AS (SELECT doc_id, company, doc_id % 6 = 1 AND doc_id % 10 <> 2 AS turned, overall_sentiment FROM scored WHERE doc_id IS NOT NULL),
  corrected AS (
    SELECT doc_id, CASE WHEN doc_id % 10 = 2 THEN 'moved' ELSE company END AS company,
           CASE WHEN turned THEN -overall_sentiment ELSE overall_sentiment END AS overall_sentiment
    FROM turned WHERE doc_id % 10 <> 7),
  labelled AS (SELECT *, CASE WHEN overall_sentiment >= 0.1 THEN 'positive' WHEN overall_sentiment <= -0.1 THEN 'negative'
                              ELSE 'neutral' END AS sentiment_label FROM corrected)"""


@query("company_statistics_incremental", f"WITH {_CORRECTED} SELECT company, {_STATS_SQL} FROM labelled GROUP BY company")
def company_statistics_incremental(spark, sf_dir):
    """Statistics that only read what each batch changed."""
    return rounded(_corrected_log(spark, sf_dir)[1].current(spark), _STATS)


@query(
    "log_changes",
    f"""WITH {SCORED}, all_ AS (SELECT doc_id, doc_id % 6 = 1 AS turned, overall_sentiment AS s FROM scored WHERE doc_id IS NOT NULL)
    SELECT 0::BIGINT AS batch, doc_id, 'inserted' AS change FROM all_ WHERE doc_id % 4 <> 3
    UNION ALL SELECT 1, doc_id, CASE WHEN doc_id % 4 = 3 THEN 'inserted' ELSE 'replaced' END FROM all_
      WHERE doc_id % 4 = 3 OR (turned AND s <> 0)
    UNION ALL SELECT 2, doc_id, CASE WHEN doc_id % 10 = 7 THEN 'removed' ELSE 'replaced' END FROM all_ WHERE doc_id % 10 IN (2, 7)""",
)
def log_changes(spark, sf_dir):
    """What each batch inserted, replaced and removed."""
    feed, _ = _corrected_log(spark, sf_dir)
    return feed.between(spark, -1, 2).select(F.col(upsert.BATCH).alias("batch"), "doc_id", "change")


@query(
    "calibrate_merged",
    f"""WITH points AS (SELECT value AS y, user_id AS a,
      (hour(ts) - (SELECT min(hour(ts)) FROM events)) / (SELECT max(hour(ts)) - min(hour(ts)) FROM events)::DOUBLE AS b
      FROM events), {_FIT_SQL}""",
)
def calibrate_merged(spark, sf_dir):
    """The fit over seven batches of events from their moments alone; one batch runs twice."""
    points = table(spark, sf_dir, "events").select("event_id", "value", "user_id", F.hour("ts").alias("hour"))
    log = calibrate.MomentLog(shared_path(spark, "moments"))
    part = F.coalesce(F.pmod("event_id", F.lit(7)), F.lit(0))
    log.append(points, 3, "value", "user_id", "hour")  # a try with too much
    for batch in range(7):
        log.append(points.filter(part == batch), batch, "value", "user_id", "hour")
    return _rounded_fit(log.fit(spark))
