from __future__ import annotations

import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Documents with nulls, empty texts, ties, repeats and a column named like a result column."""

    def make(rows, schema="doc_id long, text string, lang string, source string, kept string"):
        width = len(schema.split(","))
        return spark.createDataFrame([tuple(r) + (None,) * (width - len(r)) for r in rows], schema)

    return make
