"""The corpus operators as queries over the given tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tideline.llm import ann, exact, importance, minhash, mixing, packing, periodic, quality, rules, sql, suffix, token_counts, toxicity, warc
from tideline.llm.common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "toxic"))


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(table(spark, sf_dir, "documents", "doc_id", "source", "text"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counts(table(spark, sf_dir, "documents", "doc_id", "text"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "quality"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents", "doc_id", "text"))


def op8_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.verdicts(table(spark, sf_dir, "documents", "doc_id", "text"))


def rules_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of each policy adds, over the ledger of the whole table."""
    return rules.ablations(rules.ledger(table(spark, sf_dir, "documents", "doc_id", "text")))


def op9_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.digest(table(spark, sf_dir, "documents", "doc_id", "text"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages", "page_id", "url", "html")).drop("html")


def op11_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digest(table(spark, sf_dir, "documents", "doc_id", "text"))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.digest(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "text"))


def op13_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.digest(table(spark, sf_dir, "documents", "doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_toxicity, op2_nearest, op3_mixing, op4_minhash, op5_token_counts, op6_quality, op7_packing, op8_rules, rules_ablations, op9_suffixes, op10_warc, op11_periodic, op12_importance, op13_exact)
}
SQL: dict[str, str] = {
    "op4_minhash": sql.NEAR_DUPLICATES, "op8_rules": rules.SQL, "rules_ablations": rules.ABLATIONS_SQL, "op9_suffixes": sql.SUFFIXES, "op10_warc": sql.WARC, "op11_periodic": sql.RUNS, "op13_exact": sql.EXACT,
}
