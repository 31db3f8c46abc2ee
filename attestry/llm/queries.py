"""Queries that apply the operators of this subpackage to whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.llm import toxicity
from attestry.llm.fingerprint import edited_fingerprints
from attestry.llm.langid import fit, identify
from attestry.llm.line_dedup import line_dedup
from attestry.llm.mixing import mixing_rates
from attestry.llm.negatives import hard_negatives
from attestry.llm.ngram_join import ngram_join
from attestry.llm.oracles import ORACLE_SQL
from attestry.llm.packing import pack
from attestry.llm.pieces import encode_decode
from attestry.llm.pii import pseudonymise
from attestry.llm.quality import quality_rules
from attestry.llm.sessions import sessionise
from attestry.llm.substring_dedup import substring_dedup


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


#: Stands for a key that a real run takes from its secret store.
PII_KEY = b"a key for tests and checks only"


def op2_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(documents(spark, sf_dir), PII_KEY)


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(documents(spark, sf_dir)).drop("next_fingerprint")


#: Shares of the tokens that the domains of the labelled table shall have.
MIX = {"good": 0.86, "low": 0.07, "toxic": 0.07}


def domain_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled table with a domain: toxic, else low quality, else good."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "good")
    return labels.select("doc_id", domain.alias("domain"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return mixing_rates(docs, domain_labels(spark, sf_dir), MIX)[0]


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    breaks = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    found = line_dedup(docs.withColumn("n_lines", (F.coalesce(breaks, F.lit(0)) + 1).cast("long")))
    lost = F.aggregate(F.transform("_bitmap", lambda x, i: F.when(i % 2 == 1, x).otherwise(0)), F.lit(0), lambda a, x: a + x)
    return found.select(
        "doc_id",
        "n_lines",
        F.coalesce(lost, F.lit(0)).cast("long").alias("n_dropped"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    model = toxicity.fit(docs, labels.where(~held_out))
    return toxicity.toxicity(docs.withColumn("held_out", held_out), model).select("doc_id", "held_out", "score", "predicted")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = fit(docs.where(~held_out))
    return identify(docs.select("doc_id", "text", held_out.alias("held_out")), model).drop("text")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(documents(spark, sf_dir))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(documents(spark, sf_dir))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encode_decode(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
    return found.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op13_gap_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sessionise(spark.read.parquet(f"{sf_dir}/clicks.parquet"))
    return found.select(
        F.col("client").alias("client_id"),
        F.col("session").alias("session_id"),
        F.col("start").alias("start_us"),
        F.col("end").alias("end_us"),
        "n_clicks",
        "n_late",
        F.col("cents").alias("value_cents"),
        "closed_by",
        F.sha2("path", 256).alias("path_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_pii_pseudonyms": op2_pii_pseudonyms,
    "op3_document_fingerprints": op3_document_fingerprints,
    "op4_mixing": op4_mixing,
    "op5_line_dedup": op5_line_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_language_id": op7_language_id,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_ngram_join": op9_ngram_join,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_sentencepiece": op12_sentencepiece,
    "op13_gap_sessions": op13_gap_sessions,
}

__all__ = ["ORACLE_SQL", "QUERIES"]
