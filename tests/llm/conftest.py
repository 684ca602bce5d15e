import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside; they must not disturb.
CLASH = ["h", "t", "s", "n", "cls", "key", "row", "w", "size", "least", "cluster", "task", "node", "pos", "ids", "runs", "base", "x"]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing columns."""
    from pyspark.sql import functions as F

    long = "the quick brown fox jumps over a lazy dog " * 6000
    rows = [
        (1, "the cat sat on the mat and looked at the dog", "en", "a", 1), (2, "the  cat\tsat on the mat and looked at the dog", "en", "a", None),
        (3, None, None, None, None), (4, "", "en", "b", 0), (5, long, "en", "b", 1), (6, long, "en", None, 1),
        (7, "le chat est sur la table et regarde le chien", "fr", "c", 1), (7, "le chat est sur la table et regarde le chien", "fr", "c", 1),
        (None, "no id here but some words", "en", "a", 1), (None, None, None, None, None), (8, "12345 !!! 678", "en", "c", 1), (9, "▁ 日本語 text\r\n\x00", "fr", "d", 1), (10, "one", None, "d", 1),
    ]
    df = spark.createDataFrame(rows, DOC)
    for c in CLASH:
        df = df.withColumn(c, F.lit("other"))
    return df


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="session")
def corpus():
    """The smallest driver tables."""
    return "/root/testdata/sf0.001"
