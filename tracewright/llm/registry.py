"""The numbered queries and their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import (
    chat_format, decontamination, license_scan, mixing, near_dedup, packing, quality_classifier, quality_rules, secret_scan, spelling, sql, substring_dedup, token_alignment, top_k,
)

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.dedup_substrings(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


def tokenizer_folder() -> str:
    """The folder of the public tokenizers' files, which are installed on every machine."""
    import public_tokenizers

    return os.path.dirname(public_tokenizers.path("byte_bpe_50k.json"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(_table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_folder())


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k.top_k(_table(spark, sf_dir, "embeddings"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality_classifier.score_quality(docs, quality_classifier.train(docs, _table(spark, sf_dir, "labels")))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge_quality(_table(spark, sf_dir, "documents"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.link_turns(_table(spark, sf_dir, "conversations"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = license_scan.scan_licenses(_table(spark, sf_dir, "documents"))
    text = F.concat_ws(",", F.transform("spans", lambda s: F.concat_ws(":", s["license"], s["start"].cast("string"), s["end"].cast("string"))))
    return spans.select("doc_id", F.size("spans").cast("long").alias("n_spans"), F.coalesce(F.array_max(F.transform("spans", lambda s: s["coverage"])), F.lit(0.0)).alias("coverage"), text.alias("spans"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align_tokens(_table(spark, sf_dir, "documents"), tokenizer_folder())


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("spans", "items")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    found = (
        op1_substring_dedup, op2_mixing, op3_secret_scan, op4_packing, op5_top_k,
        op6_quality_classifier, op7_quality_rules, op8_chat_format, op9_license_scan, op10_near_dedup,
        op11_token_alignment, op12_decontamination, op13_spelling,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_substring_dedup": sql.OP1_SQL,
        "op2_mixing": sql.OP2_SQL,
        "op5_top_k": sql.OP5_SQL,
        "op7_quality_rules": sql.OP7_SQL,
        "op8_chat_format": sql.OP8_SQL,
        "op10_near_dedup": sql.OP10_SQL,
        "op12_decontamination": sql.OP12_SQL,
        "op13_spelling": sql.OP13_SQL,
    }
