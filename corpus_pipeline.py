"""Corpus pipeline: language identification, near duplicates, decontamination, secrets, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns the columns of
documents, but for the last one, which returns the packed pieces. SQL can express neither the language model nor
the tokenizer, so there is no ORACLE_SQL; the tests compare stages with brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quadrille.llm import decontamination, jaccard_join, language_id, packing, secrets
from quadrille.llm.common import stored, tune

ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without letters and those in none of the languages that the labelled rows teach."""
    tune(spark)
    return language_id.keep_identified(docs, language_id.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of every group of near duplicates."""
    tune(spark)
    return jaccard_join.keep_first(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    tune(spark)
    return decontamination.remove_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts."""
    tune(spark)
    return secrets.redact_secrets(docs, count_col="n_chars")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens into sequences."""
    tune(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("redact", redact),
    ("pack", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to documents; what each returns is written and read again."""
    tune(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
