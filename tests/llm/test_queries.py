"""The registered queries, their twins, and the pipeline."""

import pytest

import corpus_pipeline
from marketlens.llm.queries import QUERIES, TWINS
from marketlens.plans import check
from tests.llm.conftest import SF


def test_all_operators():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(TWINS))
def test_twins(spark, name):
    sf = "/root/testdata/sf0.01"
    df, run = QUERIES[name](spark, sf), check.duck(sf).execute(TWINS[name])
    columns = [d[0] for d in run.description]
    assert sorted(columns) == sorted(df.columns)
    assert check._sorted_rows(df.columns, df.collect()) == check._sorted_rows(columns, run.fetchall())


def test_stages(spark, documents):
    docs, seen = documents, [documents.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, SF), "test")
        assert docs.columns == documents.columns, name
        seen.append(docs.count())
    assert seen == sorted(seen, reverse=True) and seen[-1] < seen[0]
    packed = corpus_pipeline.run(spark, SF)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    assert corpus_pipeline.ORACLE_SQL is None


def test_stages_of_no_rows(spark, documents):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, documents.limit(0), SF).count() == 0
