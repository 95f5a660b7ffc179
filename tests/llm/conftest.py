from __future__ import annotations

import pytest
from pyspark.sql import functions as F

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """A table of documents from (id, text) or (id, text, source) rows; with a column whose name clashes on request."""

    def make(rows, clash: bool = False):
        full = [(r[0], r[1], None, r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DOCUMENTS)
        if clash:
            for name in ("n_tokens", "kept", "id", "key", "_words", "size", "start"):
                df = df.withColumn(name, F.lit("x"))
        return df

    return make


@pytest.fixture(scope="session")
def odd(documents):
    """Nulls everywhere, empty, blank, long and repeated texts, equal ids, clashing columns."""
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    rows = [(None, None, None), (1, None, None), (2, "", "a"), (3, " \t\n", "a"), (4, long, "b"), (5, "x" * 50_000, "b")]
    rows += [(6, "one two three four five six"), (6, "one two three four five six"), (None, "one two three four five six")]
    rows += [(7, "á ß İ 𝒳 é́"), (7, "another text under the same id")]
    return documents(rows, clash=True)
