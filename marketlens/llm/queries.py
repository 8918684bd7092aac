"""The registered queries of the corpus operators and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.llm import (
    chat, divergence, hamming, langid, licenses, mainpage, near, packing, periods, quality, secret_scan, shards, subwords,
)
from marketlens.llm.common import table

QUERIES: dict = {}
TWINS: dict[str, str] = {}


def _query(run):
    QUERIES[run.__name__] = run
    return run


@_query
def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shards.shard_rows(shards.text_keys(table(spark, sf_dir, "documents")), 24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


@_query
def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"),
                                                         F.col("turn").cast("long").alias("turn"), "role", "text")
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], turns.schema)
    return chat.read_back(chat.format_chats(chat.turn_log(turns.union(own))))


@_query
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN,
        added=packing.added_tokens(public_tokenizers.path("byte_bpe_50k.json")),
    ).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@_query
def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


@_query
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    rules = quality.learn(documents, table(spark, sf_dir, "labels"))
    s = F.col("s")
    return documents.select("doc_id", quality.text_stats(F.col("text")).alias("s")).select(
        "doc_id", *[s[c].alias(c) for c in quality.BASE], quality.base_failed(s).alias("base_failed"),
        (~quality.base_failed(s) & rules.verdict(s)).alias("kept"))


@_query
def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return subwords.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@_query
def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(table(spark, sf_dir, "documents"))


@_query
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = langid.train(documents)
    return langid.identify(documents.select("doc_id", "text"), model).select(
        "doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


@_query
def op9_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), hamming.sign_code("embedding").alias("code"))
    return hamming.nearest(codes, codes.filter("id % 50 = 0")).select(
        F.col("query_id").alias("vec_id"), "rank", "neighbor_id", "distance")


@_query
def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return mainpage.extract(pages, mainpage.learn(pages))


@_query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.run_digests(table(spark, sf_dir, "documents"), plant=True)


@_query
def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(table(spark, sf_dir, "documents"))


@_query
def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


TWINS["op9_topk_search"] = """
WITH codes AS (
  SELECT vec_id, array_to_string(list_transform(embedding, lambda x: CASE WHEN x > 0 AND NOT isnan(x) THEN '1' ELSE '0' END), '')::BIT AS code
  FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) BETWEEN 1 AND 64),
pairs AS (
  SELECT q.vec_id, c.vec_id AS neighbor_id, bit_count(xor(q.code, c.code))::INTEGER AS distance
  FROM codes q JOIN codes c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (
  SELECT vec_id, (row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbor_id))::INTEGER AS rank, neighbor_id, distance
  FROM pairs)
SELECT vec_id, rank, neighbor_id, distance FROM ranked WHERE rank <= 10
"""

TWINS["op4_ngram_jaccard"] = r"""
WITH RECURSIVE worded AS (
  SELECT row_number() OVER () AS i, doc_id,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
grams AS (
  SELECT DISTINCT i, array_to_string(w[p : p + 4], ' ') AS g
  FROM worded, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS t(p) WHERE len(w) > 0),
sizes AS (SELECT i, count(*) AS n FROM grams GROUP BY i),
common AS (
  SELECT a.i AS x, b.i AS y, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.i <> b.i GROUP BY ALL),
links AS (
  SELECT x, y FROM common JOIN sizes s ON x = s.i JOIN sizes t ON y = t.i WHERE 5 * c >= 4 * (s.n + t.n - c)),
reach(i, j) AS (
  SELECT i, i FROM worded
  UNION
  SELECT r.i, l.y FROM reach r JOIN links l ON r.j = l.x),
class AS (SELECT r.i, min(d.doc_id) AS class_id FROM reach r JOIN worded d ON r.j = d.i GROUP BY r.i)
SELECT d.doc_id, c.class_id, (SELECT count(*) FROM links l WHERE l.x = d.i) AS n_links
FROM worded d JOIN class c ON c.i = d.i
"""

TWINS["op13_source_divergence"] = r"""
WITH docs AS (
  SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents),
words AS (SELECT i, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term FROM words GROUP BY ALL HAVING count(DISTINCT i) >= 10),
sizes AS (SELECT d.lang, (SELECT count(*) FROM kept k WHERE k.lang = d.lang)::HUGEINT AS v FROM (SELECT DISTINCT lang FROM docs) d),
used AS (SELECT w.lang, w.source, w.term, count(*)::HUGEINT AS c FROM words w SEMI JOIN kept k ON w.lang = k.lang AND w.term = k.term GROUP BY ALL),
groups AS (
  SELECT g.lang, g.source, coalesce(sum(u.c), 0)::HUGEINT AS n
  FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN used u ON u.lang = g.lang AND u.source = g.source GROUP BY ALL),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(u.c, 0) AS c, 1 + 1000000000 * (coalesce(u.c, 0) + 2) // (g.n + 2 * s.v) AS p
  FROM groups g JOIN sizes s ON s.lang = g.lang JOIN kept k ON k.lang = g.lang
  LEFT JOIN used u ON u.lang = g.lang AND u.source = g.source AND u.term = k.term),
whole AS (
  SELECT u.lang, u.term, 1 + 1000000000 * (sum(u.c)::HUGEINT + 2) // (any_value(t.n) + 2 * any_value(s.v)) AS q
  FROM used u JOIN sizes s ON s.lang = u.lang JOIN (SELECT lang, sum(n)::HUGEINT AS n FROM groups GROUP BY lang) t ON t.lang = u.lang
  GROUP BY u.lang, u.term),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
         coalesce((SELECT sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) FROM shares x JOIN shares y ON x.term = y.term AND x.lang = y.lang
                   WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source),
terms AS (
  SELECT s.lang, s.source, 'term' AS part, s.term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value
  FROM shares s JOIN whole w ON w.lang = s.lang AND w.term = s.term WHERE s.c > 0 AND p > q)
SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
QUALIFY part = 'pair' OR rank <= 10
"""

TWINS["op2_chat_formatting"] = r"""
WITH own(said) AS (VALUES ('</s>[INST] ok [/INST]')),
turns AS (
  SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, role AS r, text AS t FROM conversations
  UNION ALL SELECT -1, 0, 'user', said FROM own
  UNION ALL SELECT -1, 1, 'assistant', said FROM own),
messages AS (SELECT *, coalesce(r, '') AS role, coalesce(t, '') AS text FROM turns),
sized AS (
  SELECT *, list_sum(list_transform(
      [text, role], lambda s: length(s) + (length(s) - length(replace(s, '\', ''))) + 3 * list_sum(list_transform(
        ['<|im_start|>', '<|im_end|>', '<|endoftext|>', '<s>', '</s>', '[INST]', '[/INST]', '<<SYS>>', '<</SYS>>'],
        lambda c: (length(s) - length(replace(s, c, ''))) // length(c)))))
    + 3 * (length(role) - length(replace(role, chr(10), ''))) + length('<|im_start|>' || '<|im_end|>') + 2 AS chars
  FROM messages)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r NULLS FIRST, t NULLS FIRST)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, r NULLS FIRST, t NULLS FIRST) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""
