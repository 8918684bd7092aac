import math
import random
import re

import pytest
from pyspark.sql import functions as F

from marketlens import schemas
from marketlens.operators import context, lookup
from tests.conftest import rows

PHRASES = [
    ("good", "value", 0.7, 0.6, None, None), ("bad", "value", -0.7, 0.7, None, None), ("not", "negator", None, None, -0.5, 3),
    ("not good at all", "value", -0.9, 0.9, None, None), ("good at", "value", 0.4, 0.3, None, None),
    ("very", "intensifier", None, None, 1.3, 1), ("terribly", "intensifier", None, None, 1.6, 2), ("terribly", "value", -0.6, 0.8, None, None),
    ("hardly ever", "negator", None, None, -0.8, 4), ("ever so", "intensifier", None, None, 1.2, 2),
]
VALENCES = [("good", "value", 1.9), ("bad", "value", -2.5), ("great", None, 3.1), ("but", "turn", None), ("yet", "turn", None), ("yet", "value", 0.5)]


def in_context(text):
    if text is None:
        return None
    tokens = re.findall(r"[^\W\d_]+|[.!?;]", text.lower())
    known = {}
    for phrase, role, *numbers in PHRASES:
        known.setdefault(tuple(phrase.split()), {})[role] = numbers
    found = [(i, i + n, known[tuple(tokens[i : i + n])]) for n in (1, 2, 3, 4) for i in range(len(tokens) - n + 1) if tuple(tokens[i : i + n]) in known]
    found = [o for o in found if not any(x[0] <= o[0] and x[1] >= o[1] and x[1] - x[0] > o[1] - o[0] for x in found)]
    ps, ss = [], []
    for start, _, roles in found:
        if "value" not in roles:
            continue
        p, s = roles["value"][:2]
        for role in ("negator", "intensifier"):
            for _, end, others in found:
                if role in others and 0 <= start - end < others[role][3] and not set(tokens[end:start]) & set(".!?;"):
                    p *= others[role][2]
                    s *= others[role][2] if role == "intensifier" else 1
        ps.append(max(-1, min(1, p)))
        ss.append(max(0, min(1, s)))
    return sum(ps) / len(ps) * (0.5 + 0.5 * sum(ss) / len(ss)) if ps else 0.0


def valence(text):
    if text is None:
        return None
    words = re.findall(r"[^\W\d_]+", text)
    known, turns = {"good": 1.9, "bad": -2.5, "great": 3.1, "but": 0.0, "yet": 0.5}, ("but", "yet")
    last = max((i for i, w in enumerate(words) if w.lower() in turns), default=None)
    total = 0.0
    for i, w in enumerate(words):
        v = known.get(w.lower(), 0.0)
        if len(w) > 1 and w == w.upper() and w != w.lower() and text != text.upper():
            v += 0.6 * ((v > 0) - (v < 0))
        total += v * (1 if last is None else 0.5 if i < last else 1.5 if i > last else 0)
    total += ((total > 1e-12) - (total < -1e-12)) * (0.25 * min(4, text.count("!")) + 0.2 * (text.count("?") > 1))
    return total / math.sqrt(total**2 + 16)


def texts():
    rnd = random.Random(4)
    parts = ["good", "bad", "Not", "not", "good at", "not good at all", "very", "terribly", "hardly", "ever", "so", "hardly ever", "GOOD", "Great",
             "GREAT", "but", "yet", "x", "é", "1", ".", "!", "?", "??", ";", ",", "!!!!!"]
    made = [rnd.choice((" ", " ", "")).join(rnd.choices(parts, k=rnd.randint(0, 14))) for _ in range(600)]
    fixed = ["not good", "not. good", "not very good", "not good at all", "not good at", "hardly ever so good", "GOOD BAD", "GOOD bad", "good but bad!",
             "", "  ", "!!!", "it is", "terribly terribly good", "x " * 5000 + "not good. " * 3000]
    return [(i, t, None if i % 7 == 0 else t[::-1]) for i, t in enumerate(made + fixed)] + [(-1, None, None), (-1, None, None)]


@pytest.fixture(params=["in place", "by join"])
def size(request, monkeypatch):
    if request.param == "by join":
        monkeypatch.setattr(context, "is_small", lambda df: False)
        monkeypatch.setattr(lookup, "MAX_BROADCAST_ROWS", 0)
    return request.param


def close(got, want):
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[0] == w[0]
        assert g[1:] == pytest.approx(w[1:], abs=1e-9)


def test_context(spark, size):
    data = texts() if size == "in place" else [r for r in texts() if len(r[1] or "") < 2000]
    frame = spark.createDataFrame(data, "id int, title string, description string").repartition(3)
    lexicon = spark.createDataFrame(PHRASES, schemas.CONTEXT_LEXICON)
    got = rows(context.score_in_context(frame, lexicon).select("id", "title_sentiment", "description_sentiment"))
    want = sorted(((i, in_context(a), in_context(b)) for i, a, b in data), key=lambda r: repr(r[0]))
    close(sorted(got, key=lambda r: repr(r[0])), want)


def test_valence(spark, size):
    data = texts()
    frame = spark.createDataFrame(data, "id int, title string, description string").repartition(3)
    got = rows(context.score_valence(frame, spark.createDataFrame(VALENCES, schemas.VALENCE_LEXICON)).select("id", "title_valence", "description_valence"))
    close(sorted(got, key=lambda r: repr(r[0])), sorted(((i, valence(a), valence(b)) for i, a, b in data), key=lambda r: repr(r[0])))


def test_odd_entries_and_no_rows(spark):
    odd = [(None, "value", 1.0, 1.0, None, None), (" ", "value", 1.0, 1.0, None, None), ("good", "unknown", 1.0, 1.0, None, None),
           ("Good,  NEWS", "value", 1.0, 1.0, None, None), ("good news", "value", 0.0, float("nan"), None, None), ("not", "negator", None, None, None, None)]
    lexicon = spark.createDataFrame(odd, schemas.CONTEXT_LEXICON)
    assert rows(context.entries(lexicon)) == [("good news", "value", 0.5, 1.0, 1.0, 0), ("not", "negator", 0.0, 0.0, 1.0, 0)]
    frame = spark.createDataFrame([("not good news", None, "kept")], "title string, description string, phrase string")
    scored = context.score_in_context(frame, lexicon)
    assert rows(scored) == [("not good news", None, "kept", 0.5, None)]
    assert rows(context.score_in_context(frame, lexicon.limit(0)).select("title_sentiment")) == [(0.0,)]
    assert context.score_in_context(frame.limit(0), lexicon).count() == 0
    none = spark.createDataFrame([], schemas.VALENCE_LEXICON)
    assert rows(context.score_valence(frame, none).select("title_valence", "description_valence")) == [(0.0, None)]


def test_no_text_passes_an_exchange(spark):
    frame = spark.range(10).select(F.col("id"), F.lit("good").alias("title"), F.lit("bad").alias("description"))
    for scored in (context.score_in_context(frame, spark.createDataFrame(PHRASES, schemas.CONTEXT_LEXICON)),
                   context.score_valence(frame, spark.createDataFrame(VALENCES, schemas.VALENCE_LEXICON))):
        assert "Exchange" not in scored._jdf.queryExecution().executedPlan().toString()
