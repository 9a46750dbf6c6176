import pytest


@pytest.fixture
def frame(spark):
    """A frame of documents from (doc_id, text, lang, source) tuples."""
    def make(rows, schema="doc_id long, text string, lang string, source string"):
        return spark.createDataFrame(rows, schema)
    return make
