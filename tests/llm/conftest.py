import pytest


@pytest.fixture
def documents(spark):
    """Rows of (doc_id, text, source, more) as a documents table; extra columns carry names used inside operators."""

    def build(rows):
        ddl = "doc_id long, text string, lang string, source string, n_chars long, size long, key string, h long, score double"
        full = [(i, t, "en", s, None if t is None else len(t), 7, "k", 1, 0.5) for i, t, s in rows]
        return spark.createDataFrame(full, ddl)

    return build
