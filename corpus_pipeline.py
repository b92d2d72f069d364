"""A corpus pipeline of five stages over documents, each of which reads what its predecessor wrote.

Quality rules drop documents; of each group of near copies one stays; documents that hold benchmark items go; secrets are replaced by a mark;
the mix adds each document's rate, its whole copies and its domain, and drops none. Every stage keeps extra columns, whatever their names, takes nulls in any
column and texts of any length, and gives an empty result for an empty table. ORACLE_SQL is None: EM, SimHash and the fits are iterative, and are
tested against brute force instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import decontamination, quality_rules, secret_scan, shared, simhash_dedup, source_mixing


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the base rules and the posterior pass; a null, empty or wordless text fails. Repeated rows share a verdict."""
    return quality_rules.filter_documents(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least doc_id of each group of similar texts. Null and wordless texts are one group; of repeated rows one stays, and of a group whose rows all lack a
    doc_id, one."""
    return simhash_dedup.filter_documents(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item; null texts hold none. Without a benchmark all rows stay."""
    return decontamination.filter_documents(docs, shared.table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, secrets replaced; null texts stay null."""
    return secret_scan.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with rate, copies, domain and n_tokens, under other names where these are taken. Needs the column lang; a null lang is no label."""
    labelled = source_mixing.labelled_table(docs, shared.table(spark, sf_dir, "labels"), source_mixing.language_or_low())
    return source_mixing.mixed(docs, labelled, source_mixing.WEIGHTS)


STAGES = [
    ("quality_rules", quality),
    ("near_copies", near_copies),
    ("decontamination", benchmark_leaks),
    ("secret_scan", secrets),
    ("source_mixing", mix),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written as Parquet to the shared folder and read again."""
    docs = shared.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = shared.written(stage(spark, docs, sf_dir), name)
    return docs
