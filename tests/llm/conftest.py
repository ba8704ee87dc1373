import pytest


@pytest.fixture()
def frame(spark):
    """A DataFrame of documents with columns whose names clash with what operators use inside."""

    def make(rows):
        full = [(k, t, "x", 1, "y", 2.0) for k, t in rows]
        return spark.createDataFrame(full, "doc_id bigint, text string, node string, h bigint, key string, score double")

    return make
