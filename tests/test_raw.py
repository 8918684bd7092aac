"""Messages kept whole as variants, fields taken out later, drift of the schema."""

import json

import pytest
from pyspark.sql import types as T

from marketlens.sources import raw
from tests.conftest import rows

LINES = [
    '{"a": 1, "b": "x"}', '{"a": 1.5, "b": null, "c": {"d": [1, {"e": true}]}}', '{"a": "1", "A": 2, "x.y\'z": []}', "{}",
    '{"a": null, "b": "y", "big": 123456789012345678901234567890}', " ", "", None, "{", '{"a": 1', "[1, 2]", "7", '"{}"', "null",
    '{"a": 1, "a": 2}', '{"a": 1} trailing',
    '{"a": 1}] [', '{"a": 1}} {', '{"a": 1}, {"b": 2}', '{"a": 1}, "b": 2', '{"a": 1}{"b": 2}', '{"a": 1},', ']', '},{',
]
DECLARED = T.StructType().add("a", "long").add("b", "string").add("gone", "timestamp").add("c", T.MapType(T.StringType(), T.LongType()))


@pytest.fixture
def frames(spark):
    messages = spark.createDataFrame([(i, x, "kept") for i, x in enumerate(LINES)], "n long, value string, body string")
    return raw.read_raw(messages, ("n",))


def test_bad_messages_are_set_aside_whole(frames):
    good, bad = frames
    assert good.columns == ["n", "body"] and [r.n for r in good.orderBy("n").collect()] == [0, 1, 2, 3, 4]
    got = {r.n: (r.rejected, r.reason) for r in bad.collect()}
    want = {5: "empty", 6: "empty", 7: "empty", 8: "malformed", 9: "malformed", 10: "no object", 11: "no object",
            12: "no object", 13: "no object", **dict.fromkeys(range(14, 24), "malformed")}
    assert got == {n: (LINES[n], reason) for n, reason in want.items()}


def test_fields_come_out_late(frames, tmp_path, spark):
    good, _ = frames
    good.write.parquet(f"{tmp_path}/raw")
    stored = spark.read.schema(good.schema).parquet(f"{tmp_path}/raw")
    assert {r.n: json.loads(r.t) for r in stored.selectExpr("n", "to_json(body) t").collect()} == {
        n: json.loads(LINES[n]) for n in range(5)}
    found = raw.extract(stored, {"a": ("$.a", "long"), "e": ("$.c.d[1].e", "boolean"), "b": ("$.b", "string"), "o": ("$.c", "int")})
    assert rows(found.select("n", "a", "e", "b", "o"), "n") == [
        (0, 1, None, "x", None), (1, 1, True, None, None), (2, 1, None, None, None), (3, None, None, None, None),
        (4, None, None, "y", None)]


def plain_drift(lines, declared):
    kinds = {dict: "object", list: "array", str: "string", bool: "boolean", type(None): "null", int: "number", float: "number"}
    seen = {}
    for line in map(json.loads, lines):
        for name, value in line.items():
            seen[name, kinds[type(value)]] = seen.get((name, kinds[type(value)]), 0) + 1
    out = []
    for (name, kind), count in seen.items():
        known = declared.get(name)
        out.append((name, kind, count, known, "new" if known is None else None if kind in ("null", known) else "other kind"))
    for name, known in declared.items():
        lack = len(lines) - sum(c for (n, _), c in seen.items() if n == name)
        out += [(name, None, lack, known, "missing")] * (lack > 0)
    return sorted(out, key=repr)


def test_drift_equals_the_plain_count(frames):
    got = raw.schema_drift(frames[0], DECLARED)
    assert rows(got) == plain_drift(LINES[:5], {"a": "number", "b": "string", "gone": "string", "c": "object"})


def test_drift_by_batch_and_of_no_messages(frames, spark):
    good, _ = frames
    per = raw.fields_of(good.selectExpr("n % 2 AS batch", "body"), "batch")
    assert per.filter("field = 'b' AND batch = 1").count() == 1
    assert raw.schema_drift(good.limit(0), DECLARED).count() == 0
    assert raw.schema_drift(good.filter("n = 3"), DECLARED).filter("drift = 'missing'").count() == 4
    assert raw.schema_drift(good, T.StructType()).filter("drift <> 'new'").count() == 0


def test_fields_are_counted_before_they_move(frames):
    plan = raw.fields_of(frames[0])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "partial_count" in plan and "Python" not in plan
