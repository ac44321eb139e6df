"""The registered queries of this subpackage: thin forms of its operators over the whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, fingerprint, html_text, langid, ngram_join, secrets, substring_dedup, token_store, toxicity
from .common import documents


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(documents(spark, sf_dir)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(documents(spark, sf_dir))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.find(documents(spark, sf_dir))


def op4_weighted_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint(documents(spark, sf_dir))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(documents(spark, sf_dir))


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.store(documents(spark, sf_dir), keep_ids=False)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_byte_bpe, op2_secret_scan, op3_substring_dedup, op4_weighted_fingerprint, op5_language_id, op6_decontaminate, op7_html_text, op8_ngram_join, op9_token_store, op10_toxicity)}


def oracle_sql() -> dict[str, str]:
    return {}
