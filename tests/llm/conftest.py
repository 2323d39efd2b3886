from __future__ import annotations

import pytest
from pyspark.sql import functions as F

LONG = "The quick brown fox jumps. " * 6000


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows and
    columns whose names clash with those the operators use."""
    rows = [
        (1, None, "en", None, None, "x", 1),
        (2, "", None, "s", 0, "x", 2),
        (3, "   \n\t", "en", "s", 5, None, 3),
        (4, LONG, "en", "s", len(LONG), "x", 4),
        (5, LONG, "fr", "s", len(LONG), "x", 4),
        (5, LONG, "fr", "s", len(LONG), "x", 4),
        (6, "one two three", "de", "s", 13, "x", 6),
        (7, "One TWO three", None, None, 13, "x", 6),
        (8, "😀 é漢 \x00 ok", "fr", "s", 9, "x", 7),
        (None, "no id here at all, only words and words", "en", "s", 3, "x", 8),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string, node long")
    return docs.withColumns({c: F.lit("mine") for c in ("leaks", "ids", "decoded", "sketch", "range", "tail", "pii", "secrets", "lang_pred", "h1", "n", "component_id")})


@pytest.fixture
def tables(odd, tmp_path):
    """A folder of tables as the queries read them."""
    spark = odd.sparkSession

    def make(docs=odd, labels=None, benchmark=None):
        docs.write.parquet(f"{tmp_path}/documents.parquet")
        labels = labels or spark.createDataFrame([(4, 1, 0), (6, 1, 1), (None, None, 1), (8, None, None)], "doc_id long, quality int, toxic int")
        labels.write.parquet(f"{tmp_path}/labels.parquet")
        benchmark = benchmark or spark.createDataFrame([(1, None), (2, ""), (None, "null id")], "item_id long, text string")
        benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
        return str(tmp_path)

    return make
