"""The operators as stages over documents: each takes (spark, docs, sf_dir) and returns a DataFrame. All but packing return the
columns of documents."""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, jaccard, mixing, packing, quality, substring

#: Documents that score less are rejected.
QUALITY = 0.3


def _released(stage):
    """stage, which begins by having the executors give back the memory that the one before it left."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.release_executors(spark)
        return stage(spark, docs, sf_dir)

    return run


@_released
def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier, trained on the labels of the table beside them, rejects. Null and empty texts: scored by the
    bias alone. Null ids: scored as any. Very long texts: read whole. Repeated rows: each for itself. Empty table: no rows. No labels:
    every score is 0.5, so all stay. Other columns: kept, whatever their names."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    names = [f"_ll_{i}" for i in range(len(docs.columns))]  # the caller's may be any
    scored = quality.score(docs.select("*"), model).toDF(*names, "_ll_score")
    return scored.where(F.col("_ll_score") >= QUALITY).select(*names).toDF(*docs.columns)


@_released
def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of exact and near copies the document of the least id. Null and empty texts: one group. Null ids: the last to be
    kept. Very long texts: compared whole. Repeated rows: one of them stays. Empty table: no rows. Other columns: kept."""
    return jaccard.deduplicate(docs)


@_released
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages out of texts that stand in an earlier document or earlier in the same one; a document of which no word is left goes.
    Null text: empty. Null ids: the first in order. Ties of ids: by the text's hash. Very long texts: whole. Empty table: no rows. Other
    columns: kept."""
    return substring.without_repeats(docs)


@_released
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws documents, whole, to the sources' target weights: some more than once, some not at all. A source's last block, which the
    target cuts, counts if more than half of it is taken. Rows come shard by shard of the splitting tree, each in its shuffled order.
    Null text or one without words: never drawn, so it goes. Null source: one of its own. Very long texts: whole. Repeated rows: each is
    drawn for itself. Empty table: no rows. Other columns: kept, but for names that occur twice, which are refused."""
    blocks = mixing.mix(docs, carry=tuple(docs.columns))
    drawn = blocks.where(F.col("words") * 2 > F.col("size"))
    return drawn.sortWithinPartitions("shard", "slot").select("row.*")


@_released
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' token ids into sequences. Null text: one end id. Null ids: as any. Very long texts: in pieces. Repeated rows:
    each packed. Empty table: no rows. Other columns: not read."""
    special = packing.special_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, special=special)


STAGES = [("quality", keep_quality), ("near_copies", keep_one_of_each_group), ("repeats", cut_repeats), ("mix", mix_sources), ("pack", pack_sequences)]
