"""Corpus pipeline: documents pass five operators; every stage is written and read again.

Each stage takes (spark, docs, sf_dir) and returns the columns of ``documents``, the last one the
documents' places in the token store.  Null and empty texts pass every stage: they score like other
texts, are near duplicates of nothing, hold no benchmark item, keep one copy and become the end id
alone.  Rows without a doc_id pass too; rows that share one are judged together where a stage
removes or repeats by doc_id.  Of near duplicates the smallest doc_id stays, so there are no ties.
An empty table gives an empty result, and columns beyond those of ``documents`` are carried along.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hexflow.llm import decontam, minhash, mixing, token_store, toxicity
from hexflow.llm.queries import tokenizer_path
from hexflow.llm.scratch import Scratch

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose score reaches their language's threshold."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.without_toxic(docs, model)


def minhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group of near duplicates (0.8); rows without a doc_id stay."""
    gone = minhash.near_duplicates(docs, minhash.STAGE).filter("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item."""
    return decontam.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that every source comes to its target."""
    return mixing.mixed(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token store and returns doc_id, start, n_tokens and ids_crc32, read back from it."""
    return token_store.token_store(docs, tokenizer_path())


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity_stage),
    ("minhash_near_dedup", minhash_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("token_store", token_stage),
]

#: SQL expresses neither the classifier nor the tokenizer.  tests/llm compares every stage with a version that
#: takes no part of its method: direct convolution, all pairs of shingle sets, all pairs of pieces and passages,
#: SQL for the mix, and whole texts through the tokenizer.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"{k}-{name}")
        if k:
            scratch.drop(f"{k - 1}-{STAGES[k - 1][0]}")
    return docs
