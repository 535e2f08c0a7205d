from __future__ import annotations

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """A table of (doc_id, text) with the columns of documents, and some of the operators'
    own column names beside them."""

    def make(rows, clash=()):
        full = [(i, t, "en", "src0" if (i or 0) % 3 else None, len(t or "")) for i, t in rows]
        df = spark.createDataFrame(full, DOCUMENTS)
        return df.selectExpr("*", *[f"'x' as `{name}`" for name in clash])

    return make


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}
