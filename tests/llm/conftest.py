from __future__ import annotations

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture()
def docs(spark):
    """Make documents of (doc_id, text, lang, source) rows; extra columns have names that operators use."""

    def make(rows, clashing=True):
        from pyspark.sql import functions as F

        rows = [(*r, *(None,) * (4 - len(r))) for r in rows]
        df = spark.createDataFrame([(i, t, la, s, len(t or "")) for i, t, la, s in rows], SCHEMA)
        if clashing:
            for name in ("score", "n", "id", "print", "row", "host", "u", "q", "key", "__kept", "n_tokens", "held_out", "spans", "media", "size", "drop"):
                df = df.withColumn(name, F.lit("x"))
        return df

    return make


#: Nulls in every column, empty and blank texts, repeated rows, a long text.
ODD = [(None, None, None, None), (1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t", None, None), (4, "same text here", "en", "a"), (4, "same text here", "en", "a"), (5, "word " * 30_000, "en", "b"), (6, "é漢字 😀 ß", "de", "b")]
