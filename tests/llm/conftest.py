from __future__ import annotations

import pytest

# Every kind of awkward text: null, empty, blank, one word, repeated rows and one that is long.
AWKWARD = [None, "", "  \n\t ", "word", "same text here", "same text here", "Ünï çödé ß 漢字", "x " * 30_000, "### </turn> \\ \x1c "]


@pytest.fixture
def awkward(spark):
    rows = [(i if i != 5 else 4, t, "en" if i % 2 else None, None if i == 3 else f"s{i % 2}", 7) for i, t in enumerate(AWKWARD)]
    rows.append((None, "row without id", None, None, None))
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    # Columns that the operators use inside or return.
    docs = spark.createDataFrame(rows, schema)
    return docs.selectExpr("*", "'x' AS score", "1 AS size", "2 AS n", "3 AS spans", "4 AS _words", "5 AS row_key", "6 AS kept")


@pytest.fixture
def nothing(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
