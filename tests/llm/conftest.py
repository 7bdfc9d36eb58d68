import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """A frame of documents from (id, text, lang, source) with a column that clashes with what operators add."""

    def make(rows, clash=True):
        df = spark.createDataFrame([(i, t, la, s, None if t is None else len(t)) for i, t, la, s in rows], DOCS)
        if clash:
            from pyspark.sql import functions as F

            for name in ("score", "size", "rows", "start", "count", "fp", "key", "words", "gone", "n_words", "u", "v", "id", "copies", "component_id"):
                df = df.withColumn(name, F.lit("mine"))
        return df

    return make


LONG = " ".join(f"w{i % 977}" for i in range(60_000))


@pytest.fixture(scope="session")
def odd():
    """Nulls everywhere, empty and very long texts, repeated rows and ties."""
    return [
        (1, None, None, None),
        (2, "", "en", "a"),
        (3, "one", "en", "a"),
        (4, "the same words in two rows of the table", "en", "b"),
        (4, "the same words in two rows of the table", "en", "b"),
        (5, "the same words in two rows of the table", "en", "b"),
        (None, "a row without an id and some more words", "fr", None),
        (None, None, None, "b"),
        (6, LONG, None, "a"),
        (7, LONG + " tail", "en", "c"),
        (8, "\t\n 12 34 !! ", "fr", "c"),
    ]
