"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. The first four return the columns of documents: the quality classifier and near-dedup drop rows, personal
data is masked in the texts, mixing orders the rows (the table, read in order, interleaves the sources by the target
weights, and drops none). The last returns the packed pieces; its sequences are numbered in the order of the rows that
opened them, so that reading sequence after sequence meets the sources by weight.

Empty tables pass through; null texts are texts without words (rejected as such by a classifier that learnt so), null
sources are one source. Rows that repeat an id are one document: they are rejected together, and one row of it stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanspark.llm.common import file_order, materialize, without
from gleanspark.llm.minhash import near_duplicates
from gleanspark.llm.mixing import TARGET_WEIGHTS, in_order, mixed
from gleanspark.llm.packing import pack
from gleanspark.llm.pii import masked
from gleanspark.llm.quality_model import classify


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return without(docs, judged.where("not kept").select("doc_id"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five words, similarity 0.8: of each component the row with the smallest doc_id."""
    found = materialize(near_duplicates(docs).select("doc_id", "kept"), "pipeline-dedup")
    left = without(docs, found.where("not kept").select("doc_id"))
    again = found.where("kept").groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id")
    if again.isEmpty():
        return left
    twice = left.join(again, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id"])
    return without(left, again).unionByName(twice)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return masked(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return in_order(mixed(docs, weights=TARGET_WEIGHTS)).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(file_order(docs, "_place"), order_column="_place")


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("personal_data", personal_data), ("mixing", mixing), ("packing", packing)]

#: Classifier, components, transducers and packing are beyond SQL: tests hold each against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents of sf_dir, each one's table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
