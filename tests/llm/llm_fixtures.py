"""Fixtures of the corpus tests (a second conftest would hide the first)."""

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make_docs(spark):
    """Documents table from texts (or (id, text) pairs), with a clashing extra column on request."""
    def make(texts, lang="en", extra=False):
        rows = [(t if isinstance(t, tuple) else (i, t)) for i, t in enumerate(texts)]
        df = spark.createDataFrame([(i, t, lang, "s", None if t is None else len(t)) for i, t in rows], DOCS)
        if extra:
            from pyspark.sql import functions as F
            for name in ("score", "node", "key", "window", "len", "_rid", "label", "text_key", "doc", "sequence_id"):
                df = df.withColumn(name, F.lit("clash"))
        return df
    return make
