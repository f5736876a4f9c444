"""The ``opN_<name>`` queries: each applies one operator with production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hexflow.llm import decontam, hnsw, html_extract, license_scan, minhash, mixing, substring, token_store, toxicity, warc

Query = Callable[[SparkSession, str], DataFrame]


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), window=13)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return decontam.leaks(docs, items)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("blocks")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.token_store(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path())


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return toxicity.classify(docs.select("doc_id", "text", "lang"), labels).select("doc_id", "held_out", "score", "predicted", "threshold", "rejected")


def op9_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.build(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES: dict[str, Query] = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_embedding_near_dedup": op2_embedding_near_dedup,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_decontamination": op4_decontamination,
    "op5_mixing": op5_mixing,
    "op6_html_extraction": op6_html_extraction,
    "op7_token_store": op7_token_store,
    "op8_toxicity": op8_toxicity,
    "op9_warc_derivatives": op9_warc_derivatives,
    "op10_license_scan": op10_license_scan,
}

ORACLES: dict[str, str] = {"op5_mixing": mixing.ORACLE}
