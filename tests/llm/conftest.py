import pytest

#: Columns with names that operators use inside, to be ignored.
EXTRA = "id long, n long, digest string, key string, rep string, hash string, bytes string, spans string, length string"
SCHEMA = f"doc_id long, text string, lang string, source string, {EXTRA}"


@pytest.fixture
def docs(spark):
    """Makes a documents table of (doc_id, text) pairs, with more columns of clashing names."""

    def make(*pairs):
        rows = [(i, t, "en", "s", i, 1, "x", "x", "x", "x", "x", "x", "x") for i, t in pairs]
        return spark.createDataFrame(rows, SCHEMA).repartition(3)

    return make
