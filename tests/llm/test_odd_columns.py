"""Operators that carry columns along do so whatever these are called."""

import pytest
from pyspark.sql import functions as F

from lakeloom.llm import jaccard, mixing, stages, substring

NAMES = ("row", "key", "size", "spans", "ord", "a", "c0", "label", "score", "twice", "slot", "n")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"these are the words of text {i % 3} and a few more of them to fill it up well over what one window takes, that is a hundred", "en", f"s{i % 2}", 5, *(f"x{i}" for _ in NAMES)) for i in range(8)]
    return spark.createDataFrame(rows, ["doc_id", "text", "lang", "source", "n_chars", *NAMES]).repartition(3)


def test_jaccard(docs):
    out = jaccard.deduplicate(docs)
    assert out.columns == docs.columns and out.count() == 3


def test_substring(docs):
    out = substring.without_repeats(docs)
    assert out.columns == docs.columns and {r.row for r in out.collect()} <= {f"x{i}" for i in range(8)}


def test_mixing(docs, spark):
    out = stages.mix_sources(spark, docs, "")
    assert out.columns == docs.columns and out.where(F.col("size") != F.col("row")).count() == 0
    assert mixing.mix(docs, carry=tuple(docs.columns)).select("row.slot").count() >= out.count()


def test_quality(docs, spark, tmp_path):
    spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    assert stages.keep_quality(spark, docs, str(tmp_path)).columns == docs.columns
