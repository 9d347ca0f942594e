"""Odd documents that every operator must take: null, empty and very long texts, repeated rows, clashing columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

LONG = "the quick brown fox " * 5000
ROWS = [
    (1, "Hello world, this is a small text with ten words."),
    (2, None),
    (3, ""),
    (4, " \t\n "),
    (5, LONG),
    (6, "naïve café ÀÉÎ ß 日本語 🎉 <|endoftext|> ▁x"),
    (7, "one"),
    (7, "one"),
    (None, "a row without an id"),
]


def odd_docs(spark: SparkSession, **more: str) -> DataFrame:
    """Rows with extra columns whose names clash with results and helpers."""
    extra = {"score": "0.5D", "kept": "true", "n_tokens": "1L", "key": "'k'", "bucket": "1L", "rate": "1D", "n_words": "1L", "line_row": "1L", "mix_p": "1", "n": "1"} | more
    return spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "'en' AS lang", "CASE WHEN doc_id = 3 THEN NULL ELSE 's' END AS source", *(f"{v} AS {k}" for k, v in extra.items()))


def no_docs(spark: SparkSession) -> DataFrame:
    return odd_docs(spark).limit(0)


def labels(spark: SparkSession, rows=()) -> DataFrame:
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")
