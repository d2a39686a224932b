"""The queries of this folder's operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanspark.llm.codes import compressed
from gleanspark.llm.host_rules import host_rules
from gleanspark.llm.minhash import near_duplicates
from gleanspark.llm.mixing import TARGET_WEIGHTS, mixed
from gleanspark.llm.negatives import hard_negatives
from gleanspark.llm.neighbours import nearest
from gleanspark.llm.packing import pack
from gleanspark.llm.passages import repeated_passages
from gleanspark.llm.pii import personal_data
from gleanspark.llm.quality_model import classify
from gleanspark.llm.sharding import shard
from gleanspark.llm.token_count import token_counts
from gleanspark.llm.vectors import top_k

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), width=2)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixed(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"), weights=TARGET_WEIGHTS)
    return rows.select("doc_id", "source", "mix_phase", "mix_block", "mix_release", "mix_deadline", "mix_slot")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard(_table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return found.select("doc_id", F.round("low_posterior", 6).alias("low_posterior"), F.round("toxic_posterior", 6).alias("toxic_posterior"), "kept")


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(_table(spark, sf_dir, "embeddings"))


def op9_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(_table(spark, sf_dir, "documents"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(_table(spark, sf_dir, "documents"))


def op11_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_table(spark, sf_dir, "embeddings"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("long")
    return hard_negatives(_table(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)))


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compressed(_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Query]:
    return {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()}
