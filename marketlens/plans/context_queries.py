"""Queries over texts whose words are weighed by what stands around them."""

from __future__ import annotations

from marketlens import schemas
from marketlens.operators import context
from marketlens.plans.catalog import query
from marketlens.plans.tick_queries import rounded
from marketlens.plans.views import NEWS, news

# Test lexicons; frequent words of the invented texts stand in for opinions.
PHRASES = (
    ("the", "value", 0.1, 0.2, None, None),
    ("and", "value", -0.3, 0.5, None, None),
    ("worthless", "value", -0.8, 0.9, None, None),
    ("des", "value", -0.2, 0.4, None, None),
    ("best", "value", 1.0, 0.3, None, None),
    ("of the", "value", 0.6, 0.7, None, None),
    ("de la", "value", -0.5, 0.5, None, None),
    ("is", "negator", None, None, -0.5, 3),
    ("it is", "negator", None, None, -0.8, 2),
    ("not", "negator", None, None, -0.5, 3),
    ("with", "intensifier", None, None, 1.5, 2),
    ("der", "intensifier", None, None, 0.7, 2),
    ("des", "intensifier", None, None, 2.5, 4),
)
VALENCES = (
    ("the", "value", 0.6), ("and", "value", -0.9), ("worthless", "value", -3.1), ("best", "value", 3.2), ("stupid", "value", -2.4),
    ("de", "value", 0.4), ("und", "value", -0.7), ("der", "value", 1.1), ("en", "value", -1.3), ("that", "turn", None), ("aber", "turn", None),
    ("que", "turn", None),
)


def _values(rows) -> str:
    def one(v):
        return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else f"{v}::DOUBLE" if isinstance(v, float) else str(v)

    return ", ".join(f"({', '.join(map(one, r))})" for r in rows)


_PARTS = f"""{NEWS},
parts AS (SELECT doc_id, 'title' AS part, title AS text FROM news UNION ALL SELECT doc_id, 'description', description FROM news)"""


def _both(name: str) -> str:
    return ", ".join(f"round(any_value(score) FILTER (part = '{p}') + 1e-10, 6) AS {p}_{name}" for p in ("title", "description"))


@query(
    "sentiment_in_context",
    f"""WITH {_PARTS},
    lexicon(phrase, role, polarity, subjectivity, factor, reach) AS (VALUES {_values(PHRASES)}),
    tokens AS (SELECT doc_id, part, regexp_extract_all(lower(text), '\\p{{L}}+|[.!?;]') AS t FROM parts),
    placed AS (SELECT doc_id, part, t, unnest(generate_series(1, len(t))) AS i FROM tokens),
    sentences AS (SELECT *, sum(CASE WHEN t[i] IN ('.', '!', '?', ';') THEN 1 ELSE 0 END)
                   OVER (PARTITION BY doc_id, part ORDER BY i) AS sentence FROM placed),
    runs AS (SELECT doc_id, part, i, n, i + n - 1 AS e, sentence, array_to_string(t[i : i + n - 1], ' ') AS phrase
             FROM sentences, (VALUES (1), (2)) g(n) WHERE i + n - 1 <= len(t)),
    found AS (SELECT *, max(e) OVER (PARTITION BY doc_id, part ORDER BY i, n DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
              FROM runs WHERE phrase IN (SELECT phrase FROM lexicon)),
    whole AS (SELECT f.*, l.* EXCLUDE (phrase) FROM found f JOIN lexicon l ON l.phrase = f.phrase WHERE before IS NULL OR before < e),
    changed AS (
      SELECT v.doc_id, v.part, v.i, any_value(v.polarity) AS p, any_value(v.subjectivity) AS s,
             coalesce(product(m.factor) FILTER (m.role = 'negator'), 1) AS negated,
             coalesce(product(m.factor) FILTER (m.role = 'intensifier'), 1) AS raised
      FROM whole v LEFT JOIN whole m ON m.doc_id = v.doc_id AND m.part = v.part AND m.role <> 'value' AND m.sentence = v.sentence
           AND v.i - m.e BETWEEN 1 AND m.reach
      WHERE v.role = 'value' GROUP BY ALL),
    scores AS (
      SELECT doc_id, part, avg(greatest(-1, least(1, p * negated * raised))) * (0.5 + 0.5 * avg(greatest(0, least(1, s * raised)))) AS score
      FROM changed GROUP BY ALL)
    SELECT doc_id, {_both('sentiment')} FROM (
      SELECT p.doc_id, p.part, CASE WHEN p.text IS NOT NULL THEN coalesce(s.score, 0.0) END AS score
      FROM parts p LEFT JOIN scores s ON s.doc_id = p.doc_id AND s.part = p.part) GROUP BY doc_id""",
)
def sentiment_in_context(spark, sf_dir):
    texts = news(spark, sf_dir).select("doc_id", "title", "description")
    scored = context.score_in_context(texts, spark.createDataFrame(list(PHRASES), schemas.CONTEXT_LEXICON))
    return rounded(scored.drop("title", "description"), ("title_sentiment", "description_sentiment"))


_RULES = context.ValenceRules()


@query(
    "sentiment_valence",
    f"""WITH {_PARTS},
    lexicon(word, role, valence) AS (VALUES {_values(VALENCES)}),
    words AS (SELECT doc_id, part, text, w, unnest(generate_series(1, len(w))) AS i
              FROM (SELECT *, regexp_extract_all(text, '\\p{{L}}+') AS w FROM parts)),
    found AS (
      SELECT doc_id, part, i, coalesce(valence, 0) + CASE WHEN w[i] = upper(w[i]) AND w[i] <> lower(w[i]) AND length(w[i]) >= 2
               AND text <> upper(text) THEN sign(coalesce(valence, 0)) * {_RULES.capitals} ELSE 0 END AS v,
             max(CASE WHEN role = 'turn' THEN i END) OVER (PARTITION BY doc_id, part) AS turn
      FROM words JOIN lexicon ON lower(w[i]) = word),
    sums AS (
      SELECT doc_id, part, sum(v * CASE WHEN turn IS NULL THEN 1 WHEN i < turn THEN {_RULES.before_turn}
                                        WHEN i > turn THEN {_RULES.after_turn} ELSE 0 END) AS total FROM found GROUP BY ALL),
    marked AS (
      SELECT p.doc_id, p.part, p.text, coalesce(total, 0) AS total,
             {_RULES.exclamation} * least({_RULES.most_exclamations}, length(text) - length(replace(text, '!', '')))
             + CASE WHEN length(text) - length(replace(text, '?', '')) > 1 THEN {_RULES.question} ELSE 0 END AS more
      FROM parts p LEFT JOIN sums s ON s.doc_id = p.doc_id AND s.part = p.part),
    raised AS (SELECT *, (total + sign(round(total, 12)) * more)::DOUBLE AS x FROM marked)
    SELECT doc_id, {_both('valence')} FROM (
      SELECT doc_id, part, CASE WHEN text IS NOT NULL THEN x / sqrt(x * x + {_RULES.scale ** 2}) END AS score FROM raised) GROUP BY doc_id""",
)
def sentiment_valence(spark, sf_dir):
    texts = news(spark, sf_dir).select("doc_id", "title", "description")
    scored = context.score_valence(texts, spark.createDataFrame(list(VALENCES), schemas.VALENCE_LEXICON))
    return rounded(scored.drop("title", "description"), ("title_valence", "description_valence"))
