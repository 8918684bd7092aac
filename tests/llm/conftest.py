import pytest

SF = "/root/testdata/sf0.001"
LONG = "word and more of it, Zoë said; " * 4000

#: Rows that every operator has to take: nulls in each column, empty and blank texts, ties, repeated rows, one very long text.
ODD = [
    (1, "one two three four five six seven", "en", "a"),
    (2, "one two three four five six seven", "en", "a"),
    (2, "one two three four five six seven", "en", "a"),
    (None, "one two three four five six seven", None, None),
    (None, None, None, None),
    (3, None, "de", "b"),
    (4, "", "de", "b"),
    (5, " \n\t ", "de", None),
    (6, "12 34 !!", None, "c"),
    (7, LONG, "en", "c"),
    (8, "kurz", "de", "c"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """The odd rows with extra columns under names that operators like to use."""
    from pyspark.sql import functions as F

    frame = spark.createDataFrame(ODD, SCHEMA)
    for name in ("shard", "slot", "node", "row", "score", "ids", "offset", "words", "lang_pred", "sequence_id"):
        frame = frame.withColumn(name, F.lit("x"))
    return frame


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
