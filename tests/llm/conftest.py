import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a documents table of (doc_id, text, lang, source) rows, with a column named like an operator's own."""

    def make(rows):
        return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t), 7) for i, t, lang, s in rows], DOCUMENTS + ", size long")

    return make
