import datetime as dt
import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from marketlens import schemas
from marketlens.operators import features, serving
from marketlens.sources import landed, topics
from tests.conftest import rows

AT = dt.datetime(2024, 3, 1, 12, 30, 15)
BAR = {"timestamp": "2024-03-01 12:30:15", "symbol": "A", "price": 1.5, "volume": 10.0}


def messages(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string").select(F.encode("value", "UTF-8").alias("value"))


BAD = ["not json", "", None, "[1]", json.dumps({**BAR, "price": "much"}), json.dumps({"symbol": "B"})]


def test_decode_bars(spark):
    got = topics.decode_bars(messages(spark, json.dumps({**BAR, "more": [1]}), *BAD)).collect()
    assert tuple(got[0]) == (AT, "A", 1.5, 10.0)
    assert [tuple(r) for r in got[1:5]] == [(None, None, None, None)] * 4
    assert got[5]["price"] is None and got[6]["symbol"] == "B"
    kept = features.drop_incomplete(topics.decode_bars(messages(spark, json.dumps(BAR), *BAD)))
    assert kept.count() == 1


def test_nan_price_is_dropped(spark):
    text = json.dumps({**BAR, "price": float("nan")})
    assert features.drop_incomplete(topics.decode_bars(messages(spark, text))).count() == 0


def test_decode_news_ignores_other_fields_and_bad_values(spark):
    good = {
        "title": "t", "description": None, "source": "s", "url": "u", "published_at": "2024-03-01T12:30:15Z",
        "fetch_timestamp": "2024-03-01T12:30:15.250000", "company": "A", "kafka_timestamp": "x", "company_symbol": "A",
    }
    got = topics.decode_news(messages(spark, json.dumps(good), json.dumps({**good, "title": 5, "published_at": "xx"})))
    assert got.columns == schemas.NEWS.fieldNames()
    first, second = got.collect()
    assert first["published_at"] == AT and first["fetch_timestamp"] == AT.replace(microsecond=250000)
    assert second["title"] == "5" and second["published_at"] is None


def test_quarantine(spark):
    checked = topics.decode_checked(messages(spark, json.dumps(BAR), *BAD), schemas.BAR, ("timestamp", "symbol"))
    good, bad = topics.quarantine(checked)
    assert rows(good) == [(AT, "A", 1.5, 10.0)]
    assert sorted(map(str, [r["rejected"] for r in bad.collect()])) == sorted(map(str, BAD))


def test_encode_round_trip(spark):
    bars = spark.createDataFrame([(AT, "A", 1.5, 10.0)], schemas.BAR)
    encoded = topics.encode_bars(bars)
    assert json.loads(encoded.first()["value"]) == BAR
    assert rows(topics.decode_bars(encoded)) == rows(bars)


def test_encode_news(spark):
    article = [("t", "d", "s", "u", AT, AT, "Ä")]
    encoded = topics.encode_news(spark.createDataFrame(article, schemas.NEWS), F.lit(AT))
    row = encoded.first()
    body = json.loads(bytes(row["value"]).decode())
    assert bytes(row["key"]).decode() == "Ä"
    assert body["kafka_timestamp"] == "2024-03-01T12:30:15.000000" and body["company_symbol"] == "Ä"
    assert rows(topics.decode_news(encoded)) == article
    defaulted = json.loads(bytes(topics.encode_news(spark.createDataFrame(article, schemas.NEWS)).first()["value"]))
    assert defaulted["kafka_timestamp"] > "2024"


def test_topics_need_only_the_connector(spark):
    with pytest.raises(AnalysisException, match="kafka"):
        topics.read_topic(spark, "host:9092", topics.BAR_TOPIC)
    with pytest.raises(AnalysisException, match="kafka"):
        topics.write_topic(messages(spark, "{}"), "host:9092", topics.NEWS_TOPIC)


PAGES = [
    ("A", {"status": "ok", "articles": [
        {"title": "t", "source": {"name": "s"}, "url": "u", "publishedAt": "2024-03-01T12:30:15Z"},
        {"description": "d", "publishedAt": "soon"}]}),
    ("B", {"status": "error", "message": "limit"}),
    ("C", {"articles": []}),
    ("D", {"status": "ok", "articles": []}),
]


def pages(spark):
    raw = spark.createDataFrame([(c, json.dumps(p)) for c, p in PAGES], "company string, body string")
    return raw.select("company", F.from_json("body", schemas.ARTICLE_PAGE).alias("p")).select("company", "p.*")


def test_article_pages(spark):
    flat = landed.flatten_articles(pages(spark), fetched_at=F.lit(AT))
    assert flat.columns == schemas.NEWS.fieldNames()
    assert sorted(map(tuple, flat.collect()), key=repr) == sorted(
        [("t", None, "s", "u", AT, AT, "A"), (None, "d", None, None, None, AT, "A")], key=repr
    )
    assert rows(landed.rejected_pages(pages(spark)).select("company", "reason")) == [
        ("B", "limit"), ("C", "Unknown error")
    ]
    listed = spark.createDataFrame([(c,) for c in "ABCD"], "company string")
    assert rows(landed.articles_by_company(listed, flat)) == [("A", 2), ("B", 0), ("C", 0), ("D", 0)]


def test_normalise_ohlcv(spark):
    df = spark.createDataFrame([(AT, 1, 2, 3, 4, 500)], "Datetime timestamp, Open int, High int, Low int, Close int, Volume int")
    got = landed.normalise_ohlcv(df, F.lit("A"), source_zone="America/New_York").first()
    assert tuple(got) == ("2024-03-01 17:30:15", "A", 4.0, 500.0)


def records(spark, count=25):
    made = [("2024-03-01", float(i), "AB"[i % 2], i, float(i) / 2, 0.1, float(i)) for i in range(count)]
    return spark.createDataFrame(made, schemas.SERVING_RECORD)


def test_market_json_round_trip(spark, tmp_path):
    path = str(tmp_path / "market")
    landed.export_market_json(records(spark), path, ties=("price",), records=10)
    assert rows(landed.read_market_json(spark, path)) == rows(records(spark))
    lines = [json.loads(r[0]) for r in spark.read.text(path).collect()]
    assert len(lines) == 4 and all(d["status"] == "success" and len(d["data"]) <= 10 for d in lines)


def test_market_json_single_document_and_missing(spark, tmp_path):
    body = {"status": "success", "data": [r.asDict() for r in records(spark, 3).collect()]}
    (tmp_path / "one.json").write_text(json.dumps(body, indent=2))
    got = landed.read_market_json(spark, str(tmp_path / "one.json"), one_document=True)
    assert rows(got) == rows(records(spark, 3))
    missing = landed.read_market_json(spark, str(tmp_path / "none.json"))
    assert missing.schema == schemas.SERVING_RECORD and missing.count() == 0


def test_coefficients(spark, tmp_path):
    assert tuple(landed.read_coefficients(spark).first()) == (0.5, 0.3, 0.2)
    assert tuple(landed.read_coefficients(spark, str(tmp_path / "none.json")).first()) == (0.5, 0.3, 0.2)
    (tmp_path / "c.json").write_text('{\n"x": 2.0,\n"z": 0.0}')
    stored = landed.read_coefficients(spark, str(tmp_path / "c.json"))
    assert tuple(stored.first()) == (2.0, 0.3, 0.0)
    blended = serving.blend_with_coefficients(records(spark, 2), stored)
    assert [round(r["finalPrediction"], 9) for r in blended.orderBy("price").collect()] == [0.03, 1.03]


def test_company_list(spark):
    assert landed.company_dimension(spark).count() == 8
    assert rows(landed.company_dimension(spark, landed.DASHBOARD_COMPANIES).select("symbol"))[0] == ("AAPL",)
