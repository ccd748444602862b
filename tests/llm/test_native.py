"""Operators that are to be DataFrame or SQL functions only have no Python in their plans."""

import re

import pytest

from lakeloom.llm import common
from lakeloom.llm.queries import QUERIES


@pytest.mark.parametrize("name", ["op2_mixing_sources", "op4_license_scans"])
def test_no_python(spark, name, monkeypatch):
    """Neither in the result's plan nor in that of any step that is stored or cached on the way."""
    plans = []
    noted = lambda df: plans.append(df._jdf.queryExecution().toString())
    plain = common.stored
    monkeypatch.setattr(common, "stored", lambda df, *a, **b: noted(df) or plain(df, *a, **b))
    cache = type(spark.range(1)).cache
    monkeypatch.setattr(type(spark.range(1)), "cache", lambda df: noted(df) or cache(df))
    noted(QUERIES[name](spark, "/root/testdata/sf0.001"))
    assert len(plans) > 1
    for plan in plans:
        assert not re.search(r"Python|Pandas|Arrow|CartesianProduct|BroadcastNestedLoop", plan)


def test_queries_take_whole_tables(spark):
    n = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    for name in ("op3_document_fingerprints", "op4_license_scans", "op10_lm_scoring"):  # the others: test_contracts.py
        got = QUERIES[name](spark, "/root/testdata/sf0.001")
        assert got.select("doc_id").distinct().count() == n, name
