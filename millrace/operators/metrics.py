"""Training metrics: losses over valid tokens, throughput, comparison of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def global_average(loss: Column, valid: Column) -> Column:
    """Token-weighted: sum of losses over sum of valid tokens."""
    return F.sum(loss) / F.sum(valid)


def rank_losses(df: DataFrame, by: list[str], rank: str, loss: str, valid: str) -> DataFrame:
    """Each rank's sums: what the largest rank loss and the mean of batch means are made of."""
    return df.groupBy(*by, rank).agg(F.sum(loss).alias("loss"), F.sum(valid).alias("valid"))


def losses(df: DataFrame, by: list[str], rank: str, loss: str, valid: str) -> DataFrame:
    """(by, avg_loss, max_loss, mean_of_means): weighted by tokens; the largest over ranks of its own mean; and the plain mean of ranks' means, as
    validation takes it over batches."""
    r = rank_losses(df, by, rank, loss, valid)
    own = F.col("loss") / F.col("valid")
    return r.groupBy(*by).agg((F.sum("loss") / F.sum("valid")).alias("avg_loss"), F.max(own).alias("max_loss"), F.avg(own).alias("mean_of_means"))


def masked_mean(loss: Column, mask: Column) -> Column:
    return F.sum(loss * mask) / F.greatest(F.sum(mask), F.lit(1))


def long_format(df: DataFrame, keys: list[str], values: list[str], tag: str = "") -> DataFrame:
    """(keys, name, value): one row per metric, its name after an optional tag."""
    prefix = f"{tag}/" if tag else ""
    return df.unpivot(keys, [F.col(v).cast("double").alias(prefix + v) for v in values], "name", "value")


def compared(a: DataFrame, b: DataFrame) -> DataFrame:
    """(step, baseline, test, diff) for steps that both runs have. a, b: (step, loss)."""
    j = a.select("step", F.col("loss").alias("baseline")).join(b.select("step", F.col("loss").alias("test")), "step")
    return j.withColumn("diff", F.col("test") - F.col("baseline"))


def only_one(a: DataFrame, b: DataFrame) -> DataFrame:
    """Steps that one run lacks; empty if both have the same."""
    j = a.select("step", F.lit(1).alias("x")).join(b.select("step", F.lit(1).alias("y")), "step", "full_outer")
    return j.where(F.col("x").isNull() | F.col("y").isNull()).select("step", F.when(F.col("y").isNull(), "baseline").otherwise("test").alias("only_in"))


def run_averages(a: DataFrame, b: DataFrame) -> DataFrame:
    """Each run's mean over its own steps, and their difference."""
    x, y = a.agg(F.avg("loss").alias("baseline"), F.count(F.lit(1)).alias("n_baseline")), b.agg(F.avg("loss").alias("test"), F.count(F.lit(1)).alias("n_test"))
    one = F.lit(1).alias("__one")
    return x.select("*", one).join(y.select("*", one), "__one").drop("__one").withColumn("diff", F.col("test") - F.col("baseline"))


def metric_rank(world: Column, stages: Column) -> Column:
    """The rank that logs: the first of the last pipeline stage; without stages, 0."""
    return F.floor(world / stages) * (stages - 1)
