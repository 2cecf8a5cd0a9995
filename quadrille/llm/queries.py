"""One query for each corpus operator, over whole tables, and the SQL that gives the same rows where SQL can.

Three more queries return those columns of an operator that SQL can express, so that they can be compared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, fingerprints, html_extract, jaccard_join, language_id, lm_scoring, packing, secrets, simhash_join, spelling, token_files, url_filters
from .common import tables, tune
from .oracles import ORACLE_SQL

#: (verdict, host, path) as the contract of op10 has them. url_filters.RULES, from which its SQL is made, blocks net/de/ instead.
URL_RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]


def op1_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    (docs,) = tables(sf_dir, spark, "documents")
    return language_id.identify(docs, language_id.fit(docs))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    docs, items = tables(sf_dir, spark, "documents", "benchmark")
    return decontamination.find_leaks(docs, items)


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    (docs,) = tables(sf_dir, spark, "documents")
    return lm_scoring.score_texts(docs)


def op4_html_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    (pages,) = tables(sf_dir, spark, "pages")
    return html_extract.extract_text(pages)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    (docs,) = tables(sf_dir, spark, "documents")
    return secrets.scan_secrets(docs)


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    (docs,) = tables(sf_dir, spark, "documents")
    return jaccard_join.near_duplicates(docs)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    (docs,) = tables(sf_dir, spark, "documents")
    return token_files.read_token_table(token_files.write_token_table(docs))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    (docs,) = tables(sf_dir, spark, "documents")
    return fingerprints.fingerprint_edits(docs)


def op9_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    (docs,) = tables(sf_dir, spark, "documents")
    return packing.pack_documents(docs)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    pages, labels = tables(sf_dir, spark, "pages", "labels")
    judged = url_filters.judge_urls(pages, url_filters.page_outcomes(pages, labels), URL_RULES)
    return judged.drop("lower_bad").withColumn("p_bad", F.round("p_bad", 6) + F.lit(0.0))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    (docs,) = tables(sf_dir, spark, "documents")
    return spelling.spelling_groups(docs)


def op12_simhash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    (docs,) = tables(sf_dir, spark, "documents")
    return simhash_join.near_duplicates(docs)


def lm_base_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op3 that SQL can check."""
    out = op3_lm_scoring(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score")
    return out.withColumn("base_score", F.round("base_score", 6))


def secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op5 that SQL can check."""
    return op5_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def edited_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op8 that SQL can check."""
    return op8_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_crf": op1_language_crf,
    "op2_decontamination": op2_decontamination,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_html_tree": op4_html_tree,
    "op5_secret_scan": op5_secret_scan,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_token_files": op7_token_files,
    "op8_fingerprints": op8_fingerprints,
    "op9_best_fit": op9_best_fit,
    "op10_url_filter": op10_url_filter,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_simhash_join": op12_simhash_join,
    "lm_base_scores": lm_base_scores,
    "secret_counts": secret_counts,
    "edited_digests": edited_digests,
}

__all__ = ["ORACLE_SQL", "QUERIES"]
