from __future__ import annotations

import pytest
from pyspark.sql import types as T

DOC = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("score", T.StringType()), T.StructField("n_chars", T.LongType()),
])  # fmt: skip  # "score" clashes with result columns


@pytest.fixture(scope="session")
def docs_of(spark):
    def make(texts):
        """texts: {id: text} or a list of (id, text)."""
        pairs = texts.items() if isinstance(texts, dict) else texts
        return spark.createDataFrame([(i, t, "en", "x", len(t or "")) for i, t in pairs], DOC)

    return make


@pytest.fixture(scope="session")
def labels_of(spark):
    def make(rows):
        return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")

    return make


@pytest.fixture(scope="session")
def folder():
    return "/root/testdata/sf0.001"
