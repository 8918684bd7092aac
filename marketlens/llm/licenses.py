"""License texts found by diagonal voting.

Every window of k words of a document is hashed and joined to the places of the
templates where that hash stands. A hit lies on a diagonal, document place less
template place; a copied passage puts its hits on one. Neighbouring diagonals,
where a word was put in or left out, are merged, and all words along them are
compared with the template one by one, also where no window hit.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketlens.llm.common import let, rolling_hashes, stored

K = 4
#: Diagonals at most this far apart belong to one copy.
SLACK = 4
#: Share of a template's words that a copy must hold.
MIN_SHARE = 0.75
#: Up to so many template windows the hits are picked out of the arrays before the join.
MAX_LISTED = 20_000

# Phrases and labels that are always reported.
PHRASES = (
    (("mit", "license"), "mit"),
    (("apache", "license"), "apache"),
    (("general", "public", "license"), "gpl"),
)

# Notices of public licenses, label and text.
TEMPLATES = (
    ("mit-notice", "Released under the MIT License."),
    ("apache-2.0-notice", "Licensed under the Apache License, Version 2.0"),
    ("gpl-3.0-notice", "This work is licensed under the GNU General Public License, version 3."),
    ("cc-by-nc-4.0-notice", "Licensed under CC BY-NC 4.0."),
    ("mit-grant",
     "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
     "documentation files (the Software), to deal in the Software without restriction, including without limitation "
     "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("mit-warranty",
     "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO "
     "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT"),
    ("apache-2.0-header",
     "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance "
     "with the License. You may obtain a copy of the License at"),
    ("gpl-3.0-header",
     "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
     "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
     "option) any later version"),
    ("bsd-header",
     "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
     "the following conditions are met"),
    ("cc-by-4.0-notice",
     "This work is licensed under a Creative Commons Attribution 4.0 International License"),
)


def license_words(text: Column) -> Column:
    """Words after A-Z are lower-cased: runs of a-z, 0-9 and everything beyond ASCII."""
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def template_table(spark: SparkSession, templates: Sequence[tuple[str, str]], k: int = K) -> DataFrame:
    """One row per template: ``label``, ``words``, ``grams``; templates shorter than ``k`` words find nothing."""
    rows = spark.createDataFrame(list(templates), "label string, text string")
    return rows.select("label", license_words(F.col("text")).alias("words")).select(
        "label", "words", rolling_hashes(F.col("words"), k).alias("grams"))


def _places(words: Column, phrase: Sequence[str]) -> Column:
    """Where the phrase stands, from 0, in a text that has its last word at all."""
    *front, last = phrase
    def ends(w: Column, i: Column) -> Column:
        here = w == last
        for back, word in enumerate(reversed(front), 1):
            here = here & (F.get(words, i - back) == word)
        return F.when(here, i - len(front))

    found = F.filter(F.transform(words, ends), lambda i: i.isNotNull())
    return F.when(F.array_contains(words, last), found).otherwise(F.array().cast("array<int>"))


def scan(
    documents: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES,
    phrases: Sequence[tuple[Sequence[str], str]] = PHRASES, k: int = K,
    slack: int = SLACK, min_share: float = MIN_SHARE,
) -> tuple[DataFrame, DataFrame]:
    """Documents with their findings, and the verified spans.

    The first frame has ``doc_id``, ``n_words``, ``places`` (phrase places with
    label) and ``row``, the second ``row``, ``label``, ``first_word``,
    ``end_word`` and ``share`` per copy of a template. Null and empty texts have no
    findings; rows that share an id are told apart by ``row``. Only the columns
    ``doc_id`` and ``text`` are read.
    """
    spark = documents.sparkSession
    table = template_table(spark, templates, k)
    # the templates come from the caller, not from the corpus
    grams = sorted({h for row in table.select("grams").collect() for h in row["grams"]})

    def of_words(words: Column) -> Column:
        def pick(g: Column) -> Column:
            hits = F.transform(g, lambda h, i: F.struct(i.alias("at"), h.alias("gram")))
            if len(grams) > MAX_LISTED:
                return hits
            some = F.exists(g, lambda h: h.isin(grams)) if grams else F.lit(False)
            return F.when(some, F.filter(hits, lambda x: x["gram"].isin(grams)))

        hits = let(rolling_hashes(words, k), pick)
        def labelled(phrase: Sequence[str], label: str) -> Column:
            return F.transform(_places(words, phrase), lambda i: F.struct(i.alias("at"), F.lit(label).alias("label")))

        places = F.concat(*[labelled(p, label) for p, label in phrases])
        return let(hits, lambda h: F.struct(
            F.size(words).cast("long").alias("n_words"), places.alias("places"),
            h.alias("hits"), F.when(F.size(h) > 0, words).alias("words")))

    scanned = documents.select("doc_id", let(license_words(F.col("text")), of_words).alias("s"))
    rows = stored(scanned.select("doc_id", "s.*", F.monotonically_increasing_id().alias("row")), "licenses")
    at = table.select("label", F.size("words").alias("length"), F.col("words").alias("template"),
                      F.posexplode("grams").alias("place", "gram"))
    at = F.broadcast(at) if len(grams) <= MAX_LISTED else at
    found = rows.select("row", F.explode("hits").alias("hit")).select("row", "hit.at", "hit.gram").join(at, "gram")
    votes = found.select("row", "label", "length", "template", (F.col("at") - F.col("place")).alias("diagonal")).distinct()
    every = F.sequence(F.lit(0), F.col("length") - 1)
    verified = votes.join(rows.select("row", "words"), "row").select(
        "row", "label", "length", "diagonal",
        F.filter(every, lambda p: F.get("words", p + F.col("diagonal")) == F.get("template", p)).alias("same"))
    order = Window.partitionBy("row", "label").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > slack, F.lit(True))
    copies = (
        verified.filter(F.size("same") > 0).withColumn("copy", F.sum(apart.cast("int")).over(order))
        .select("row", "label", "length", "copy", "diagonal", F.explode("same").alias("place"))
        .groupBy("row", "label", "length", "copy")
        .agg(F.count_distinct("place").alias("n"), F.min(F.col("diagonal") + F.col("place")).alias("first_word"),
             (F.max(F.col("diagonal") + F.col("place")) + 1).alias("end_word"))
    )
    spans = copies.withColumn("share", F.col("n") / F.col("length")).filter(F.col("share") >= min_share).select(
        "row", "label", "first_word", "end_word", "share")
    return rows.select("row", "doc_id", "n_words", "places"), spans


def report(
    documents: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES,
    phrases: Sequence[tuple[Sequence[str], str]] = PHRASES,
) -> DataFrame:
    """One row per document: ``doc_id``, ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``,
    ``labels``, ``score``.

    ``n_base`` counts the places of all phrases, ``first_word`` and ``last_word``
    are the smallest and largest of them (null without one), ``base_labels`` are
    their labels and ``labels`` those and the templates', distinct, sorted and
    joined by commas. ``score`` is 1 with a phrase, else the share of the best
    template copy's words, 0 without one.
    """
    rows, spans = scan(documents, templates, phrases)
    best = spans.groupBy("row").agg(F.collect_set("label").alias("found"), F.max("share").alias("best"))
    at = F.col("places.at")
    base = F.array_sort(F.array_distinct("places.label"))
    return rows.join(best, "row", "left").select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min(at).cast("long").alias("first_word"), F.array_max(at).cast("long").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, F.coalesce("found", F.array().cast("array<string>"))))), ",")
        .alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
