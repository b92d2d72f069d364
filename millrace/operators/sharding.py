"""Shards: contiguous and strided row splits, nested ranks, slices along a sequence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.ordering import ordinal


def contiguous(df: DataFrame, key: str, world: int) -> DataFrame:
    """Chunks of ceil(n / world) rows in the order of key."""
    n = df.count()
    return ordinal(df, key, "__o").withColumn("shard", F.floor(F.col("__o") / max(-(-n // world), 1))).drop("__o")


def strided(df: DataFrame, key: str, world: int) -> DataFrame:
    """Row i goes to i mod world."""
    return ordinal(df, key, "__o").withColumn("shard", F.col("__o") % world).drop("__o")


def nested_rank(rank: Column, degree: int, replica: Column, replicas: int) -> tuple[Column, Column]:
    """(rank over all replicas, their world size)."""
    return replica * degree + rank, F.lit(degree * replicas)


def slice_of(values: Column, rank: Column, world: int) -> Column:
    size = F.ceil(F.size(values) / world).cast("int")
    return F.slice(values, (rank * size + 1).cast("int"), size)


def head_tail(values: Column, rank: Column, world: int) -> Column:
    """Of 2 * world equal chunks, the rank-th from the front and from the back."""
    size = F.floor(F.size(values) / (2 * world)).cast("int")
    chunk = lambda i: F.slice(values, (i * size + 1).cast("int"), size)
    return F.concat(chunk(rank), chunk(F.lit(2 * world - 1) - rank))
