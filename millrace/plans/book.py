"""A book of queries: each with a name, a function of session and folder, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Book:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable[[Query], Query]:
        """Registers a function under its name."""

        def put(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql
            return f

        return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: SQL of a draw from 0 to 1: hash of the seed and a key.
def uniform_sql(seed: int, key: str) -> str:
    return f"(('0x' || substr(md5('{seed}:' || {key}), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"


def digest_sql(seed: int, key: str) -> str:
    return f"md5('{seed}:' || {key})"


#: SQL of a text's words.
WORDS_SQL = "regexp_extract_all(text, '\\S+')"
