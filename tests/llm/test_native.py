"""Shards, quality rules and license scans, which run on column functions alone."""

import zlib

import pytest
from pyspark.sql import functions as F

from marketlens.llm import licenses, quality, shards
from tests.llm import brute
from tests.llm.conftest import LONG


def python_free(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return not any(x in plan for x in ("Python", "Pandas", "Arrow"))


# -- shards


@pytest.mark.parametrize("n", [1, 2, 3, 5, 24, 100, 1000, 1025])
def test_permutation_is_a_bijection(spark, n):
    got = spark.range(n).select(shards.permuted(F.col("id"), n).alias("p")).collect()
    assert sorted(r.p for r in got) == list(range(n))


def test_shards_are_even_and_gapless(documents):
    got = shards.shard_rows(shards.text_keys(documents), 24)
    assert python_free(got)
    slots = {}
    for r in got.collect():
        slots.setdefault(r.shard, []).append(r.slot)
    n = documents.count()
    assert len(slots) == 24 and {len(x) for x in slots.values()} <= {n // 24, n // 24 + 1}
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_shards_do_not_depend_on_files_or_order(documents):
    keys = shards.text_keys(documents)
    one = shards.shard_rows(keys, 5).collect()
    two = shards.shard_rows(keys.repartition(13).sort(F.desc("doc_id")), 5).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, two))
    assert sorted(map(tuple, one)) != sorted(map(tuple, shards.shard_rows(keys, 5, seed=8).collect()))


def test_shards_equal_the_plain_ones(documents, odd):
    for docs in (documents, odd.select("doc_id", "text")):
        keys = shards.text_keys(docs)
        got = sorted((tuple(r) for r in shards.shard_rows(keys, 24).collect()), key=repr)
        want = brute.shard_table([tuple(r) for r in keys.collect()], 24, shards.MIN_BUCKETS)
        assert got == sorted(want, key=repr)


def test_shards_of_odd_rows(odd, none):
    got = shards.shard_rows(shards.text_keys(odd), 3).collect()
    assert len(got) == odd.count() and sorted(r.slot * 3 + r.shard for r in got) == list(range(len(got)))
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    assert (by_id[3].size, by_id[3].text_crc32) == (8, 0)
    assert by_id[7].size == len(LONG.encode()) + 8 and by_id[7].text_crc32 == zlib.crc32(LONG.encode())
    assert shards.shard_rows(odd, 3).columns[-2:] == ["shard", "slot"]
    assert shards.shard_rows(shards.text_keys(none), 3).count() == 0


def test_many_copies_are_numbered_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(shards, "COPIES_PER_BLOCK", 7)
    rows = spark.range(50).select(F.lit("same").alias("a"))
    assert sorted(r.n for r in shards.numbered(rows, "n").collect()) == list(range(50))


# -- quality


def test_statistics_equal_brute_force(documents, odd):
    for frame in (documents, odd):
        s = F.col("s")
        got = frame.select("text", quality.text_stats(F.col("text")).alias("s")).select(
            "text", *[s[c] for c in quality.BASE], quality.base_failed(s).alias("f"))
        assert python_free(got)
        for text, *found in got.collect():
            assert tuple(found) == brute.stats(text)


def test_repeats_that_overlap(spark):
    texts = ["a " * 30, "a b c d e f g h " * 2, "x " + "a b c d e f g h i " * 3, " ".join("abcdefgh")]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    got = frame.select("text", quality.text_stats(F.col("text"))["n_repeat_words"].alias("n")).collect()
    assert [(r.text, r.n) for r in got] == [(t, brute.stats(t)[4]) for t in texts]


def test_rules_separate_the_labelled(spark, documents):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rules = quality.learn(docs, labels)
    assert rules.rules
    s = F.col("s")
    got = docs.join(labels, "doc_id").select("quality", quality.text_stats(F.col("text")).alias("s")).select(
        "quality", (~quality.base_failed(s) & rules.verdict(s)).alias("kept"))
    assert python_free(got)
    rows = got.collect()
    good = [r.kept for r in rows if r.quality == 1]
    bad = [r.kept for r in rows if r.quality == 0]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.3 * len(bad)


def test_fit_finds_a_planted_rule(spark):
    rows = [(i % 4 == 0, i % 3 > 0, float(i % 4 == 0) * 5 + i % 7 / 10, float(i % 11)) for i in range(600)]
    rules = quality.fit(spark.createDataFrame(rows, "bad boolean, grow boolean, x double, y double"))
    assert len(rules.rules) == 1 and [(c.feature, c.above) for c in rules.rules[0]] == [("x", True)]


def test_quality_without_labels_and_rows(spark, odd, none, documents):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.learn(odd, empty).rules == ()
    nulls = spark.createDataFrame([(None, 0), (1, None), (2, 1), (2, 0)], "doc_id long, quality int")
    rules = quality.learn(odd, nulls)
    assert quality.keep_good(none, rules).count() == 0
    kept = quality.keep_good(odd, rules)
    assert kept.columns == odd.columns and kept.count() == 0  # all short, or made of repeats


# -- licenses


def test_phrases_equal_brute_force(documents, odd, spark):
    own = spark.createDataFrame([(1, "The MIT  license, mit-License. GNU General\nPublic license! apachelicense Apache License"),
                                 (1, "license"), (None, "mit license"), (2, "ÀMIT license")], "doc_id long, text string")
    for frame in (documents, odd, own):
        got = licenses.report(frame)
        assert python_free(got)
        want = sorted((repr((r.doc_id, *brute.licenses(r.text))) for r in frame.collect()))
        rows = got.collect()
        assert sorted(repr((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)) for r in rows) == want
        assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in rows)


def test_a_copy_with_a_word_put_in_is_one_span(spark):
    grant = dict(licenses.TEMPLATES)["mit-grant"]
    words = grant.split()
    text = "some words before " + " ".join(words[:20] + ["really"] + words[20:]) + " and behind"
    frame = spark.createDataFrame([(1, text), (2, " ".join(words[:12])), (3, f"{grant} x {grant}")], "doc_id long, text string")
    rows, spans = licenses.scan(frame)
    got = spans.join(rows, "row").select("doc_id", "label", "first_word", "end_word", "share").collect()
    found = sorted((r.doc_id, r.first_word, r.share > 0.9) for r in got if r.label == "mit-grant")
    n = len(words)
    assert [f[0] for f in found] == [1, 3, 3] and found[0][1] == 3 and all(f[2] for f in found)
    assert {f[1] for f in found[1:]} == {0, n + 1} or len(found) == 3


def test_licenses_of_no_rows(none):
    assert licenses.report(none).count() == 0


def test_words_between_hits_are_compared(spark):
    rows = [(1, "x Licensed under the Apache Licence, Version 2.0 y"), (2, "Licensed under the Apache thing, edition 2.1"),
            (3, "This program is free software: you can spread it and/or change it under all terms of any GNU General Public License "
                "as printed by the Free Software Group, either version 3 of that License, or (at your choice) any later version")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found, spans = licenses.scan(frame)
    got = {(r.doc_id, r.label): (r.share, r.first_word, r.end_word) for r in spans.join(found, "row").collect()}
    assert got[1, "apache-2.0-notice"] == (7 / 8, 1, 9)
    assert got[3, "gpl-3.0-header"][0] >= 0.75 and not any(d == 2 for d, _ in got)
    assert {r.doc_id: "apache-2.0-notice" in r.labels for r in licenses.report(frame).collect()} == {1: True, 2: False, 3: False}
