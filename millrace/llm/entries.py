"""The queries of this subpackage, as the driver registers them: production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import decontamination, language_id, license_scan, quality_classifier, quality_rules, secret_scan, shared, simhash_dedup, source_mixing, sql, token_counts, url_filter


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(shared.table(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(shared.table(spark, sf_dir, "documents"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages to target shares of the tokens at hand; low quality is aimed at so few that rates go to 0."""
    docs = shared.table(spark, sf_dir, "documents")
    labelled = source_mixing.labelled_table(docs, shared.table(spark, sf_dir, "labels"), source_mixing.language_or_low())
    return source_mixing.rates(docs, labelled, source_mixing.WEIGHTS)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(shared.table(spark, sf_dir, "documents"), shared.table(spark, sf_dir, "benchmark"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a cache of its own, empty at first, so that a run does not depend on the runs before it."""
    import public_tokenizers

    return token_counts.count_tokens(shared.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(shared.table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model is trained on the labelled table's rows that are not held out."""
    return url_filter.judge(shared.table(spark, sf_dir, "pages"), url_filter.labelled_urls(spark).where("NOT held_out"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(shared.table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(shared.table(spark, sf_dir, "documents"))


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_copies(shared.table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_quality_rules, op2_secret_scan, op3_source_mixing, op4_decontamination, op5_token_counts, op6_quality_classifier, op7_url_filter, op8_license_scan, op9_language_id, op10_simhash_dedup]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    """The others are iterative fits, library tokenizers, or rest on hashes that SQL lacks; they are tested against brute force."""
    return {"op2_secret_scan": sql.secret_sql(), "op8_license_scan": sql.license_sql()}
