"""The registered query of each operator: (spark, folder) to a DataFrame, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depotlens.llm import alignment, bpe, decontam, lm, multi_index, near, oracles, packing, pii, revisits, secret_scan, token_counts, toxicity, variants
from depotlens.llm.text import crc_of


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return lm.scores(table(spark, folder, "documents"), lambda doc_id: crc_of(doc_id, 7) == 2)


def op2_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.findings(table(spark, folder, "documents"))


def op3_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.digests(table(spark, folder, "documents"), ranks, public_tokenizers.PATTERN)


def op4_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return near.joined(table(spark, folder, "documents").select("doc_id", "text"))


def op5_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return token_counts.counted(table(spark, folder, "documents"), ranks, public_tokenizers.PATTERN)


def op6_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return pii.detected(docs, pii.train(docs))


def op7_warc_revisits(spark: SparkSession, folder: str) -> DataFrame:
    found = revisits.resolved(revisits.captures_of_pages(table(spark, folder, "pages")))
    entries = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"])))
    return found.withColumn("headers", F.array_join(entries, "\n"))


def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    machine = toxicity.train(docs, table(spark, folder, "labels"))
    return toxicity.scored(docs, machine).select(
        "doc_id", F.coalesce(crc_of("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_inverted_multi_index(spark: SparkSession, folder: str) -> DataFrame:
    return multi_index.search(table(spark, folder, "embeddings"), lambda vec_id: vec_id % 100 == 0)


def op10_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = decontam.matched(docs, table(spark, folder, "benchmark")).select("doc_id", F.explode("found").alias("hit"))
    return found.select("doc_id", "hit.item_id", F.col("hit.first").alias("first_word"), F.col("hit.words").alias("n_words"), F.col("hit.equal").alias("n_equal"))


def op11_sequence_packing(spark: SparkSession, folder: str) -> DataFrame:
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return packing.packed(table(spark, folder, "documents"), f.read())


def op12_tokenizer_alignment(spark: SparkSession, folder: str) -> DataFrame:
    both = alignment.Tokenizers.read(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return alignment.aligned(table(spark, folder, "documents"), both)


def op13_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return variants.grouped(table(spark, folder, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_lm_scoring, op2_secret_scan, op3_byte_bpe, op4_ngram_jaccard_join, op5_token_counts, op6_personal_data, op7_warc_revisits, op8_toxicity,
    op9_inverted_multi_index, op10_decontamination, op11_sequence_packing, op12_tokenizer_alignment, op13_spelling_variants)}
ORACLES: dict[str, str] = {"op7_warc_revisits": oracles.OP7}
