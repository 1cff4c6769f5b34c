from __future__ import annotations

import pytest
from pyspark.sql import types as T

LONG = " ".join(f"word{i % 977} filler{i % 31}" for i in range(25_000))
ODD = [
    (1, None, "a", "en"),
    (None, "A null id with some words in it, enough of them to count as a text of its own.", "a", None),
    (2, "", None, "en"),
    (3, " \t\n\x0b\f\r ", "b", "en"),
    (4, LONG, "b", "en"),
    (5, "One row that comes twice, word for word.", "b", "fr"),
    (5, "One row that comes twice, word for word.", "b", "fr"),
    (6, "One id with two texts: the first.", "c", "fr"),
    (6, "One id with two texts: the second.", "c", "fr"),
    (7, 'Größe İstanbul 中文 \x85 \xa0 é "quoted" <|endoftext|> | # $ %', "c", "de"),
    (8, LONG, "c", "de"),
    (9, "x", "a", "de"),
]
FIELDS = [
    T.StructField("doc_id", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("lang", T.StringType()),
    T.StructField("n_chars", T.LongType()),
    T.StructField("TEXT", T.StringType()),
    T.StructField("row", T.LongType()),
    T.StructField("_row", T.LongType()),
    T.StructField("shard", T.LongType()),
]
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, extra columns with clashing names."""
    rows = [(i, t, s, lang, len(t or ""), "other", 0, 0, 7) for i, t, s, lang in ODD]
    return spark.createDataFrame(rows, T.StructType(FIELDS))


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], T.StructType(FIELDS))


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {row.doc_id: row.text or "" for row in documents.collect()}


@pytest.fixture(scope="session")
def labels(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet")
