"""Cleaning of a training corpus in five stages, each an operator of ``depotlens.llm``.

Each stage takes (spark, docs, folder) and works on all that the stage before kept; the stages are written as
Parquet in the shared folder and read again.  All but the last return the columns of ``documents``.  Rows with
NULL or repeated ids pass through like others; of equal or near texts one row stays.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depotlens.llm import bpe, decontam, near, pii, toxicity
from depotlens.session import materialise


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, trained on the labelled ones among these, doesn't reject."""
    return toxicity.kept(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal and near texts."""
    return near.kept(docs)


def not_in_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontam.kept(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    return pii.redacted(docs, pii.train(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token ids, and whether their decoding gives the text again."""
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    named = docs.select(F.struct("doc_id", "lang", "source", "n_chars", F.sha2("text", 256).alias("sha")).alias("row"), "text")
    small = bpe.Settings(block_bytes=12_000_000)  # the executors' memory also holds what earlier stages left
    made = bpe.digests(named.withColumnRenamed("row", "doc_id"), ranks, public_tokenizers.PATTERN, small, keep_ids=True)
    return made.select(
        "doc_id.doc_id", "doc_id.lang", "doc_id.source", "doc_id.n_chars", "n_tokens", "ids", "ids_sha256",
        (F.col("decoded_sha256") == F.coalesce("doc_id.sha", F.sha2(F.lit(""), 256))).alias("round_trip"))


STAGES = [
    ("toxicity", not_toxic),
    ("ngram_jaccard_join", one_of_each_group),
    ("benchmark_decontamination", not_in_benchmark),
    ("personal_data", without_personal_data),
    ("byte_level_bpe", tokens),
]

# Models and hashed sketches have no SQL form; tests/llm/test_pipeline.py holds the result against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
