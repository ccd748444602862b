"""The corpus pipeline: stages over documents, each one an operator of lakeloom.llm."""

from __future__ import annotations

from lakeloom.llm.stages import STAGES

#: Learned models and packing are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    from lakeloom.llm import common

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    made = common.made()
    for _, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir))
        common.clear(made)  # what only led to this table, the one before it included
        made = common.made() - 1
    return STAGES[-1][1](spark, docs, sf_dir)
