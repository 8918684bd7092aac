"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the data, ``BENCH_CPUS`` the local cores. Arguments name
other queries to time, ``all`` times every registered one.
"""

from __future__ import annotations

import json
import os
import sys
import time

from marketlens.operators.lookup import release_measured
from marketlens.plans.registry import QUERIES
from marketlens.session import build_session

HEADLINE = (
    "feature_table",
    "feature_table_bucketed",
    "feature_table_incremental",
    "stream_window_ohlc",
    "dedup_last_write",
    "upsert_predictions",
    "window_ohlc",
    "split_train_test",
    "sentiment_two_fields",
    "agg_company_sentiment",
    "news_job",
    "top_positive",
    "serve_market_data",
    "join_sentiment_by_day",
    "join_sentiment_asof",
    "series_arrays",
    "calibrate_blend",
    "score_forest",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    if list(names) == ["all"]:
        names = list(QUERIES)
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="16g",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    # start the JVM's code paths on one cheap query
    QUERIES["feat_calendar"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        release_measured()
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
