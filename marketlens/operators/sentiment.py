"""Sentiment of articles by lexicon lookup, and what is derived from it."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketlens import schemas
from marketlens.functions import columns as C
from marketlens.operators.lookup import is_small, lookup_join

# The terms of the article search.
FINANCE_TERMS = ("stock", "shares", "market", "trading", "earnings", "investor", "financial")

WORD_PATTERN = r"\p{L}+"
_BETWEEN_WORDS = r"\P{L}+"
_NO_WORD = ""
_TEXTS_AT_ONCE = 256


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """A lexicon from a CSV file with a header; a word's senses are averaged."""
    senses = spark.read.csv(path, header=True, schema=schemas.LEXICON)
    return senses.groupBy(F.lower("word").alias("word")).agg(
        F.avg("polarity").alias("polarity"), F.avg("subjectivity").alias("subjectivity")
    )


def one_per_word(lexicon: DataFrame) -> DataFrame:
    """One row per word with the means of its entries.

    A null or empty word, or one without a polarity or subjectivity, is none of
    the lexicon.
    """
    means = lexicon.filter(F.col("word") != _NO_WORD).groupBy("word").agg(*[F.avg(F.nanvl(c, F.lit(None).cast("double"))).alias(c) for c in ("polarity", "subjectivity")])
    return means.dropna()


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD_PATTERN), F.lit(0))


@dataclass(frozen=True)
class Scorer:
    """A lexicon that was looked at once; ``in_place`` scores a lowered text where it is, if the lexicon is small."""

    words: DataFrame
    in_place: Callable[[Column], Column] | None


def scorer(lexicon: DataFrame | Scorer) -> Scorer:
    """Reduce a lexicon to one row per word and take its size; what it gives can be used for many batches."""
    if isinstance(lexicon, Scorer):
        return lexicon
    words = one_per_word(lexicon)
    if not is_small(words):
        return Scorer(words, None)
    entries = sorted((r["word"], r["polarity"], r["subjectivity"]) for r in words.collect())
    return Scorer(words, _in_place_scorer(entries))


def _in_place_scorer(entries: list[tuple[str, float, float]]) -> Callable[[Column], Column]:
    known = [e[0] for e in entries]
    polarity, subjectivity = (np.array([e[i] for e in entries], "float64") for i in (1, 2))

    def score_some(texts: pa.Array, words: pa.Array) -> pa.Array:
        split = pc.split_pattern_regex(texts.fill_null(""), _BETWEEN_WORDS)
        at = pc.index_in(pc.list_flatten(split), value_set=words)
        hit = pc.is_valid(at)
        of = pc.list_parent_indices(split).filter(hit).to_numpy(zero_copy_only=False)
        at = at.filter(hit).to_numpy(zero_copy_only=False)
        n = np.bincount(of, minlength=len(texts))
        p, s = (np.bincount(of, weights=w[at], minlength=len(texts)) for w in (polarity, subjectivity))
        some = np.maximum(n, 1)
        scores = np.where(n > 0, p / some * (0.5 + 0.5 * s / some), 0.0)
        return pa.array(scores, mask=pc.is_null(texts).to_numpy(zero_copy_only=False))

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        words = pa.array(known, texts.type)
        # some texts at a time, so that the words in memory are few
        parts = [score_some(texts.slice(i, _TEXTS_AT_ONCE), words) for i in range(0, len(texts), _TEXTS_AT_ONCE)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.float64())

    return score


def score_texts(
    articles: DataFrame, lexicon: DataFrame | Scorer, fields: Sequence[str] = ("title", "description"),
) -> DataFrame:
    """The articles with a score ``<field>_sentiment`` for each text field.

    A text's polarity and subjectivity are the means over its words found in
    ``lexicon`` (word, polarity, subjectivity); the score is the polarity
    weighted by subjectivity. Words are runs of letters. A text without words
    of the lexicon scores 0, a null text scores null. An entry that repeats
    counts with its means.

    The words of a text are all in its row, so the row is scored where it is, in
    Arrow batches, and nothing is shuffled. A lexicon beyond the broadcast
    bounds goes through :func:`score_by_join`.
    """
    known = scorer(lexicon)
    if known.in_place:
        return articles.withColumns({f"{name}_sentiment": known.in_place(F.lower(name)) for name in fields})
    # articles with the same content share a key; each copy stays a row
    keyed = articles.withColumn("__content", F.sha2(F.to_json(F.struct(*fields)), 256))
    scores = score_by_join(keyed, known.words, ["__content"], fields)
    return keyed.join(scores, "__content", "left").drop("__content")


def score_articles(
    articles: DataFrame, lexicon: DataFrame | Scorer, key: Sequence[str],
    fields: Sequence[str] = ("title", "description"), carry: Sequence[str] = (),
) -> DataFrame:
    """The scores of :func:`score_texts` without the texts: a short row per article."""
    columns = list(dict.fromkeys([*key, *carry]))
    scored = score_texts(articles.select(*dict.fromkeys([*columns, *fields])), lexicon, fields)
    return scored.select(*columns, *[f"{name}_sentiment" for name in fields])


def score_by_join(
    articles: DataFrame, lexicon: DataFrame, key: Sequence[str], fields: Sequence[str] = ("title", "description"),
) -> DataFrame:
    """Scores as :func:`score_texts` gives them, one row per key, for a lexicon of any size.

    Rows with equal keys must hold equal texts. Words meet the lexicon in a
    join. The aggregation that follows combines an article's words within its
    own task where the lexicon is broadcast, so no text is shuffled.
    """
    stacked = [part for name in fields for part in (F.lit(name), F.col(name))]
    texts = articles.select(
        *key, F.stack(F.lit(len(fields)), *stacked).alias("__field", "__text")
    )
    # a blank word per text keeps texts without a match in an inner join
    words = texts.select(
        *key,
        "__field",
        F.col("__text").isNull().alias("__missing"),
        F.explode(
            F.concat(F.array(F.lit(_NO_WORD)), F.coalesce(_words(F.col("__text")), F.array().cast("array<string>")))
        ).alias("word"),
    )
    blank = lexicon.sparkSession.createDataFrame([(_NO_WORD, None, None)], schemas.LEXICON)
    known = one_per_word(lexicon).select("word", "polarity", "subjectivity").unionByName(blank)
    found = lookup_join(words, known, ["word"], "inner")

    means = []
    for name in fields:
        here = F.col("__field") == name
        means += [
            F.avg(F.when(here, F.col("polarity"))).alias(f"__{name}_p"),
            F.avg(F.when(here, F.col("subjectivity"))).alias(f"__{name}_s"),
            F.bool_or(here & F.col("__missing")).alias(f"__{name}_null"),
        ]
    grouped = found.groupBy(*key).agg(*means)
    return grouped.select(
        *key,
        *[
            F.when(
                ~F.col(f"__{name}_null"),
                F.coalesce(C.subjectivity_weighted(f"__{name}_p", f"__{name}_s"), F.lit(0.0)),
            ).alias(f"{name}_sentiment")
            for name in fields
        ],
    )


def with_overall(scored: DataFrame) -> DataFrame:
    """Add the mean of title and description score, and its label."""
    overall = C.overall_sentiment("title_sentiment", "description_sentiment")
    return scored.withColumn("overall_sentiment", overall).withColumn(
        "sentiment_label", C.sentiment_label("overall_sentiment")
    )


def score_news(news: DataFrame, lexicon: DataFrame | Scorer) -> DataFrame:
    """The articles, texts included, with both field scores, overall score and label."""
    return with_overall(score_texts(news, lexicon))


def company_statistics(scored: DataFrame) -> DataFrame:
    """Mean score, article count and label shares per company.

    The mean skips null scores; the count and the shares do not.
    """
    def share(label: str) -> Column:
        return F.avg((F.col("sentiment_label") == label).cast("double"))

    return scored.groupBy("company").agg(
        F.avg("overall_sentiment").alias("avg_sentiment"),
        F.count(F.lit(1)).alias("article_count"),
        share("positive").alias("positive_ratio"),
        share("negative").alias("negative_ratio"),
    )


def most_positive(scored: DataFrame, count: int = 3, ties: Sequence[str] = ()) -> DataFrame:
    """The ``count`` articles with the highest overall score."""
    return _ranked(scored, F.desc("overall_sentiment"), count, ties)


def most_negative(
    scored: DataFrame, count: int = 3, ties: Sequence[str] = (), nulls_first: bool = False
) -> DataFrame:
    """The ``count`` articles with the lowest overall score.

    ``nulls_first`` puts unscored articles at the head, as a plain ascending
    sort does.
    """
    low = F.asc_nulls_first if nulls_first else F.asc_nulls_last
    return _ranked(scored, low("overall_sentiment"), count, ties)


def _ranked(scored: DataFrame, by: Column, count: int, ties: Sequence[str]) -> DataFrame:
    return (
        scored.orderBy(by, *ties).select("company", "title", "overall_sentiment", *ties).limit(count)
    )


def newest_per_company(
    articles: DataFrame, count: int, published: str = "published_at", ties: Sequence[str] = ()
) -> DataFrame:
    """The ``count`` newest articles of each company.

    The rank limit runs before the shuffle too, so each map task sends at most
    ``count`` articles of a company however many it holds.
    """
    newest = Window.partitionBy("company").orderBy(F.desc(published), *ties)
    return (
        articles.withColumn("__rank", F.row_number().over(newest))
        .filter(F.col("__rank") <= count)
        .drop("__rank")
    )


def relevant_articles(
    articles: DataFrame,
    as_of: str,
    days_back: int = 7,
    language: str = "en",
    text: str = "text",
    phrase: str = "company",
    terms: Sequence[str] = FINANCE_TERMS,
    published: str = "published_at",
) -> DataFrame:
    """Articles of the window that name the phrase and one of the terms.

    ``as_of`` is the last day (``yyyy-MM-dd``) of a window of ``days_back``
    days before it. Terms match whole words; a word is bounded by anything
    but a letter, digit or underscore.
    """
    last = F.to_date(F.lit(as_of))
    lowered = F.lower(text)
    whole_word = r"(^|[^\p{L}\p{N}_])(" + "|".join(terms) + r")([^\p{L}\p{N}_]|$)"
    return articles.filter(
        # bounds on the plain column reach the scan
        (F.col(published) >= F.date_sub(last, days_back))
        & (F.col(published) < F.date_add(last, 1))
        & (F.col("lang") == language)
        & lowered.contains(F.lower(phrase))
        & lowered.rlike(whole_word)
    )
