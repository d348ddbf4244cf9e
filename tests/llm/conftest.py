"""Rows that every operator must take: nulls, empty and long texts, ties, repeats, clashing columns."""

from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "lorem ipsum dolor " * 60_000
ODD = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, "   \n\t ", "en", "a", 6),
    (4, LONG, "en", "a", len(LONG)),
    (5, "the same text here", "en", "a", 18),
    (5, "the same text here", "en", "a", 18),
    (6, "the same text here", "en", "b", 18),
    (None, "the same text here", "en", "b", 18),
    (7, "Ünïcödé 東京 🎉 text with odd\x00 signs", "de", None, 30),
]
#: Names that operators use inside, as columns of the input.
EXTRA = ("score", "fp", "h", "key", "n", "size", "_id", "_row", "line", "taken", "_text", "label", "hit", "word")


@pytest.fixture
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], DOCS)


def clash(df):
    from pyspark.sql import functions as F

    return df.select("*", *(F.lit("x").alias(c) for c in EXTRA))


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
