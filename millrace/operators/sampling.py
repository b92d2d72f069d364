"""Sampling by stateless draws: weighted cluster draws with cursors, caps, shuffles, assignments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.hashing import digest, draw_int, uniform
from millrace.operators.ordering import first_per_group, ordinal, shuffled_ordinal

#: Parts of the unit interval by which draws and clusters are joined.
BUCKETS = 4096


def proportional(sizes: DataFrame, size: str = "n") -> DataFrame:
    """Weights by size; evenly if all sizes are 0. One row per cluster, so one task."""
    w = Window.partitionBy()
    total, k = F.sum(size).over(w), F.count(F.lit(1)).over(w)
    return sizes.withColumn("weight", F.when(total > 0, F.col(size) / total).otherwise(1.0 / k))


def renormalised(weights: DataFrame, weight: str = "weight") -> DataFrame:
    """Weights that add up to 1; evenly over all if they add up to 0 or less."""
    w = Window.partitionBy()
    total, k = F.sum(weight).over(w), F.count(F.lit(1)).over(w)
    return weights.withColumn(weight, F.when(total > 0, F.col(weight) / total).otherwise(1.0 / k))


def draw(spark: SparkSession, weights: DataFrame, n: int, seed: int, per_step: int) -> DataFrame:
    """n draws with replacement: (draw, step, i, cluster_id). A draw's number from 0 to 1 falls in one cluster's interval of the running sum
    of weights. The unit interval is cut to BUCKETS; an interval has a row for each bucket that it touches, so draws join by bucket."""
    order = Window.orderBy("cluster_id")
    hi = F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, 0))
    ends = weights.where("weight > 0").select("cluster_id", hi.alias("hi"))
    # From the end before, to the next; the last one takes what rounding leaves.
    ends = ends.select("cluster_id", F.coalesce(F.lag("hi").over(order), F.lit(0.0)).alias("lo"), F.when(F.lead("hi").over(order).isNull(), F.lit(2.0)).otherwise(F.col("hi")).alias("hi"))
    last = F.lit(BUCKETS - 1)
    ends = ends.withColumn("bucket", F.explode(F.sequence(F.least(F.floor(F.col("lo") * BUCKETS), last), F.least(F.floor(F.col("hi") * BUCKETS), last))))
    draws = spark.range(n).select(F.col("id").alias("draw"), F.floor(F.col("id") / per_step).alias("step"), (F.col("id") % per_step).alias("i"), uniform(seed, F.col("id")).alias("u"))
    found = draws.withColumn("bucket", F.floor(F.col("u") * BUCKETS)).join(ends, "bucket").where((F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi")))
    return found.select("draw", "step", "i", "cluster_id")


def with_cursors(draws: DataFrame) -> DataFrame:
    """Each draw's number within its cluster over all steps (cursor), and within its step (offset)."""
    out = ordinal(draws, "draw", "cursor", by=["cluster_id"])
    return ordinal(out, "draw", "offset", by=["step", "cluster_id"])


def with_lines(draws: DataFrame, lines: DataFrame, sizes: DataFrame) -> DataFrame:
    """Each draw with the line that it reads: cursor modulo the cluster's size; no line gives nulls. lines: (cluster_id, line_no, ...)."""
    placed = draws.join(sizes, "cluster_id", "left").withColumn("line_no", F.when(F.col("n") > 0, F.pmod(F.col("cursor"), F.col("n"))))
    return placed.join(lines, ["cluster_id", "line_no"], "left")


def numbered_lines(docs: DataFrame, cluster: str, key: str) -> DataFrame:
    return ordinal(docs, key, "line_no", by=[cluster])


def without_replacement(docs: DataFrame, by: list[str], n: int, seed: int, key: str) -> DataFrame:
    """min(n, size) rows of each group, by digest."""
    return first_per_group(docs, by, [digest(seed, F.col(key)), F.col(key)], n)


def capped(docs: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """n rows, without replacement; all if there are no more."""
    return docs.orderBy(digest(seed, F.col(key)), key).limit(n)


def balanced(docs: DataFrame, k: int, seed: int, key: str) -> DataFrame:
    """Random clusters whose sizes differ by 1 at most."""
    return shuffled_ordinal(docs, digest(seed, F.col(key)), "__o", ties=[key]).withColumn("cluster_id", F.col("__o") % k).drop("__o")


def independent(docs: DataFrame, k: int, seed: int, key: str) -> DataFrame:
    """Random clusters, each row for itself."""
    return docs.withColumn("cluster_id", draw_int(seed, k, F.col(key)))


def epoch_order(docs: DataFrame, epoch: int, key: str, seed: int = 42) -> DataFrame:
    """Each row's place in an epoch: in its own order in epoch 0, reshuffled with seed + epoch in others."""
    if epoch == 0:
        return ordinal(docs, key, "place")
    return shuffled_ordinal(docs, digest(seed + epoch, F.col(key)), "place", ties=[key])
