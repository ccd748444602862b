"""The operators' registered queries, with production parameters over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprint, jaccard, licences, lm, media, mixing, packing, quality, sharding, substring


def _table(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    special = packing.special_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack(_table(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, special=special)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir)
    scored = quality.score(docs.select("doc_id", "text"), quality.fit(docs, _table(spark, sf_dir, "labels")))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir)
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    held = F.coalesce(fold, F.lit(False))
    return lm.score(docs.select("doc_id", held.alias("held_out"), "text"), docs.where(~fold))


def op2_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = mixing.mix(_table(spark, sf_dir), keep_undrawn=True)
    place = F.when(F.col("shard").isNotNull(), F.struct("epoch", "shard", "slot", "words"))
    by = blocks.groupBy("key", "place", "row", "size", "source_size", "target").agg(F.array_sort(F.collect_list(place)).alias("blocks"))
    taken = F.aggregate("blocks", F.lit(0).cast("long"), lambda a, b: a + b["words"])
    return by.select("row.doc_id", "size", "source_size", "target", taken.alias("taken"), "blocks")


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.against_next(_table(spark, sf_dir))


def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.by_document(_table(spark, sf_dir))


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeats(_table(spark, sf_dir))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(_table(spark, sf_dir)).select("doc_id", "class_id", "n_links")


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tensors", "segments")
    made = media.audio(_table(spark, sf_dir).select("doc_id", "text"), "text", digest)
    return made.select("doc_id", *digest[:-2], F.sha2("tensors", 256).alias("tensors_sha256"), F.octet_length("tensors").alias("tensors_bytes"), F.size("segments").alias("n_segments"), F.xxhash64("segments").alias("segments_hash"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = _table(spark, sf_dir).select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    shards = 40
    out = sharding.reshard(docs, shards, F.pmod("text_crc32", F.lit(shards)).cast("int"), F.col("size"), F.col("text_crc32"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op1_best_fit_packing": op1_best_fit_packing, "op5_quality_classifier": op5_quality_classifier, "op10_lm_scoring": op10_lm_scoring, "op2_mixing_sources": op2_mixing_sources, "op3_document_fingerprints": op3_document_fingerprints, "op4_license_scans": op4_license_scans, "op6_suffix_array_dedup": op6_suffix_array_dedup, "op7_ngram_jaccard_join": op7_ngram_jaccard_join, "op8_media_columns": op8_media_columns, "op9_sharding": op9_sharding}
ORACLES: dict[str, str] = {}
