import datetime as dt

import pytest
from pyspark.sql import functions as F

from marketlens import schemas
from marketlens.operators import lookup, sentiment
from marketlens.plans import views
from tests.conftest import SMALL, rows

LEXICON = [("good", 0.5, 0.6), ("bad", -0.7, 0.4), ("fine", 0.25, 0.0)]


@pytest.fixture(scope="module")
def lexicon(spark):
    return spark.createDataFrame(LEXICON, schemas.LEXICON)


TEXTS = [
    (1, "A", "Good good BAD", ""),
    (2, "A", None, "fine"),
    (3, "B", "no hit here", "   "),
    (4, "B", "fine", "fine"),
    (5, "B", "goods, rebad", "good\n\tbad!good"),
]


def news(spark):
    return spark.createDataFrame(TEXTS, "id int, company string, title string, description string")


def expected(text):
    if text is None:
        return None
    scores = {w: (p, s) for w, p, s in LEXICON}
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    hits = [scores[w] for w in words if w in scores]
    if not hits:
        return 0.0
    return sum(p for p, _ in hits) / len(hits) * (0.5 + 0.5 * sum(s for _, s in hits) / len(hits))


def test_scores(spark, lexicon):
    got = rows(sentiment.score_articles(news(spark), lexicon, ["id"]), "id")
    for row, (i, _, title, description) in zip(got, TEXTS, strict=True):
        assert row[0] == i
        assert row[1] == pytest.approx(expected(title)) if title is not None else row[1] is None
        assert row[2] == pytest.approx(expected(description))


def test_overall_and_label_with_null_title(spark, lexicon):
    row = sentiment.score_news(news(spark), lexicon).filter("id = 2").first()
    assert row["title_sentiment"] is None and row["overall_sentiment"] is None
    assert row["sentiment_label"] == "neutral"


def test_in_place_equals_join_and_fallback(spark, lexicon, monkeypatch):
    shown = ["id", *[F.round(c, 9) for c in ("title_sentiment", "description_sentiment", "overall_sentiment")]]
    twice = news(spark).unionByName(news(spark))  # copies keep their own rows
    in_place = rows(sentiment.score_news(twice, lexicon).select(*shown))
    monkeypatch.setattr(sentiment, "is_small", lambda df: False)
    monkeypatch.setattr(lookup, "is_small", lambda df, rows: False)
    joined = rows(sentiment.score_news(twice, lexicon).select(*shown))
    assert in_place == joined and len(joined) == 10


def test_words_are_runs_of_any_letters(spark, lexicon, monkeypatch):
    made = [(1, "éfine fineñ", "¿GOOD? bad\u2003fine"), (2, "fine1good", "ФINE fine_good")]
    texts = spark.createDataFrame(made, "id int, title string, description string")
    shown = ["id", F.round("title_sentiment", 9).alias("t"), F.round("description_sentiment", 9).alias("d")]
    got = rows(sentiment.score_texts(texts, lexicon).select(*shown), "id")
    assert got == [(i, round(expected(t), 9), round(expected(d), 9)) for i, t, d in made] and got[0][1] == 0.0
    monkeypatch.setattr(sentiment, "is_small", lambda df: False)
    assert rows(sentiment.score_texts(texts, lexicon).select(*shown), "id") == got


def test_in_place_equals_join_on_documents(spark):
    articles = views.news(spark, SMALL)
    words = views.lexicon(spark)
    joined = sentiment.score_by_join(articles, words, ["doc_id"])
    in_place = sentiment.score_news(articles, words)
    shown = ["doc_id", F.round("title_sentiment", 9), F.round("description_sentiment", 9)]
    assert rows(joined.select(*shown)) == rows(in_place.select(*shown))


def test_scoring_shuffles_no_text(spark, lexicon):
    plan = sentiment.score_news(news(spark), lexicon)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_statistics_count_unscored_articles(spark, lexicon):
    got = {r[0]: r for r in rows(sentiment.company_statistics(sentiment.score_news(news(spark), lexicon)))}
    assert got["A"][2] == 2
    first = (expected("Good good BAD") + 0.0) / 2
    assert got["A"][1] == pytest.approx(first)
    assert got["B"][3] == pytest.approx(1 / 3)


def test_ranked_and_nulls(spark, lexicon):
    scored = sentiment.score_news(news(spark), lexicon)
    best = [r["id"] for r in sentiment.most_positive(scored, 3, ["id"]).collect()]
    assert best[0] == 4
    worst = [r["id"] for r in sentiment.most_negative(scored, 5, ["id"]).collect()]
    assert worst[-1] == 2
    assert sentiment.most_negative(scored, 1, ["id"], nulls_first=True).first()["id"] == 2


def test_newest_per_company_limits_before_the_shuffle(spark):
    day = dt.datetime(2024, 1, 1)
    made = [("A", i, day + dt.timedelta(hours=i)) for i in range(50)] + [("B", 1, day)]
    df = spark.createDataFrame(made, "company string, id int, published_at timestamp")
    newest = sentiment.newest_per_company(df, 3, ties=["id"])
    assert rows(newest.select("company", "id")) == [("A", 47), ("A", 48), ("A", 49), ("B", 1)]
    plan = newest._jdf.queryExecution().executedPlan().toString()
    assert "row_number(), 3, Partial" in plan


def test_relevant_articles(spark):
    at = dt.datetime(2024, 1, 5, 12)
    made = [
        (1, "Acme stock rises", "en", at),
        (2, "Acme stockings", "en", at),
        (3, "ACME: earnings!", "en", at),
        (4, "Acme shares", "de", at),
        (5, "Other shares", "en", at),
        (6, "Acme market", "en", at - dt.timedelta(days=9)),
        (7, "Acme market", "en", at + dt.timedelta(days=1)),
    ]
    df = spark.createDataFrame(made, "id int, text string, lang string, published_at timestamp").withColumn(
        "company", F.lit("Acme")
    )
    kept = sentiment.relevant_articles(df, "2024-01-05")
    assert [r[0] for r in rows(kept.select("id"))] == [1, 3]


def test_read_lexicon(spark, tmp_path):
    path = tmp_path / "words.csv"
    path.write_text("word,polarity,subjectivity\ngood,0.5,0.5\nbad,-1,1\nGood,1,1\n")
    assert rows(sentiment.read_lexicon(spark, str(path))) == [("bad", -1.0, 1.0), ("good", 0.75, 0.75)]


def test_both_scorers_take_any_lexicon_alike(spark, monkeypatch):
    lexicon = spark.createDataFrame(
        [("good", 0.5, 1.0), ("good", -0.25, None), ("bad", None, 0.5), ("odd", float("nan"), 0.1), ("fine", 1.0, 0.0)],
        "word string, polarity double, subjectivity double")
    news = spark.createDataFrame([("good bad fine", None), ("odd", "fine fine")], "title string, description string")
    small = rows(sentiment.score_news(news, lexicon).select("title", "title_sentiment", "description_sentiment"))
    monkeypatch.setattr(sentiment, "is_small", lambda df: False)
    assert small == rows(sentiment.score_news(news, lexicon).select("title", "title_sentiment", "description_sentiment"))
