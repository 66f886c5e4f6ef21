import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """A table of documents from (doc_id, text) pairs, with columns whose names the operators use inside."""

    def make(rows):
        rows = [(i, t, "en", None, 1, 2, "x", "y") for i, t in rows]
        return spark.createDataFrame(
            rows, "doc_id bigint, text string, lang string, source string, th int, d int, _id string, _row string")

    return make
