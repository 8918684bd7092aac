"""From raw documents to packed training sequences.

Each stage applies one corpus operator to all that the stage before it kept and
is written as Parquet before the next one reads it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.llm import langid, near, packing, quality
from marketlens.llm.common import stored, table

#: A prediction less sure than this is no language.
MIN_LANGUAGE_SCORE = 0.25


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base checks and the rules learned from the labelled ones among them."""
    return quality.keep_good(docs, quality.learn(docs, table(spark, sf_dir, "labels")))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learned; those without letters, between languages or unlike all of them go."""
    found = langid.identify(docs, langid.train(docs), "__lang", "__score", "__fits")
    sure = (F.col("__lang") != langid.UNKNOWN) & (F.col("__score") >= MIN_LANGUAGE_SCORE)
    return found.filter(sure & F.col("__fits")).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the least id."""
    return near.one_of_each(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents with their sequences and offsets."""
    return packing.pack_documents(
        docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN,
        added=packing.added_tokens(public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("quality rules", quality_rules),
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("best-fit packing", best_fit_packing),
]

#: The rules, the language machines and the token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
