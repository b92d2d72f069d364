"""Rollouts: advantages, statistics, the clipped surrogate loss and the parity of log-probabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def advantages(df: DataFrame, group: str, reward: str) -> DataFrame:
    """Reward less the group's mean; not divided by a deviation."""
    return df.withColumn("advantage", F.col(reward) - F.avg(reward).over(Window.partitionBy(group)))


def reward_stats(df: DataFrame, reward: str, by: list[str] | None = None) -> DataFrame:
    """Mean and sample deviation."""
    return df.groupBy(*(by or [])).agg(F.avg(reward).alias("mean"), F.stddev_samp(reward).alias("std"))


def surrogate(df: DataFrame, logprobs: str, advantage: str, eps: float = 0.2) -> DataFrame:
    """(pg_loss, ratio_mean, ratio_clipped_frac): ratio is e to the mean policy log-probability."""
    mean = F.aggregate(logprobs, F.lit(0.0), lambda s, x: s + x.cast("double")) / F.size(logprobs)
    r = F.exp(mean)
    rows = df.select(r.alias("r"), F.greatest(F.least(r, F.lit(1 + eps)), F.lit(1 - eps)).alias("c"), F.col(advantage).alias("a"))
    return rows.agg((-F.avg(F.least(F.col("r") * F.col("a"), F.col("c") * F.col("a")))).alias("pg_loss"), F.avg("r").alias("ratio_mean"), F.avg(F.when(F.abs(F.col("r") - F.col("c")) > 1e-6, 1.0).otherwise(0.0)).alias("ratio_clipped_frac"))


def parity(df: DataFrame, generator: str, trainer: str) -> DataFrame:
    """One row: tokens checked and different, deltas over samples that differ anywhere, log ratios over all."""
    pairs = F.zip_with(generator, trainer, lambda g, t: F.struct(g.cast("double").alias("g"), t.cast("double").alias("t")))
    cells = df.select(F.exists(pairs, lambda x: x["g"] != x["t"]).alias("differs"), F.explode(pairs).alias("x"))
    delta, ratio = F.abs(F.col("x.g") - F.col("x.t")), F.col("x.t") - F.col("x.g")
    return cells.agg(
        (~F.bool_or("differs")).alias("identical"), F.count(F.lit(1)).alias("tokens"), F.count_if(F.col("x.g") != F.col("x.t")).alias("different"),
        F.coalesce(F.max(F.when(F.col("differs"), delta)), F.lit(0.0)).alias("max_delta"), F.coalesce(F.avg(F.when(F.col("differs"), delta)), F.lit(0.0)).alias("avg_delta"),
        F.avg(ratio).alias("ratio_mean"), F.max(F.abs(ratio)).alias("ratio_max"),
    )


def episodes(df: DataFrame, shard: Column, order: str, prompt: str, response: str) -> DataFrame:
    """(shard, tokens, prompt_lengths, response_lengths): prompts and responses end to end, in order, round-robin by shard. A shard is one
    trainer's batch of a step, so its size is the batch's."""
    rows = df.select(shard.alias("shard"), F.struct(F.col(order).alias("o"), F.col(prompt).alias("p"), F.col(response).alias("r")).alias("x"))
    held = rows.groupBy("shard").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return held.select("shard", F.flatten(F.transform("x", lambda x: F.concat(x["p"], x["r"]))).alias("tokens"), F.transform("x", lambda x: F.size(x["p"])).alias("prompt_lengths"), F.transform("x", lambda x: F.size(x["r"])).alias("response_lengths"))
