"""Run registered queries beside their SQL twins and report differences."""

from __future__ import annotations

import argparse
import math
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def _norm(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(_norm(v) for v in value)
    return value


def _sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def duck(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def compare(spark, sf_dir: str, name: str, con=None) -> tuple[bool, str]:
    from marketlens.plans.registry import QUERIES, TWINS

    df = QUERIES[name](spark, sf_dir)
    got = _sorted_rows(df.columns, df.collect())
    if name not in TWINS:
        return len(got) > 0, f"{len(got)} rows, no twin"
    run = (con or duck(sf_dir)).execute(TWINS[name])
    columns = [d[0] for d in run.description]
    want = _sorted_rows(columns, run.fetchall())
    if sorted(df.columns) != sorted(columns):
        return False, f"columns {sorted(df.columns)} != {sorted(columns)}"
    if got != want:
        extra, missing = set(map(repr, got)) - set(map(repr, want)), set(map(repr, want)) - set(map(repr, got))
        return False, f"{len(got)} vs {len(want)} rows; only spark {sorted(extra)[:2]}; only sql {sorted(missing)[:2]}"
    return True, f"{len(got)} rows"


def main() -> None:
    from marketlens.plans.registry import QUERIES
    from marketlens.session import build_session

    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark = build_session("check", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                          spark__driver__memory="8g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(args.sf)
    bad = 0
    for name in args.names or QUERIES:
        start = time.time()
        try:
            ok, note = compare(spark, args.sf, name, con)
        except Exception as error:  # report and go on with the next query
            ok, note = False, f"{type(error).__name__}: {str(error)[:600]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:32s} {time.time() - start:6.2f}s {note}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
