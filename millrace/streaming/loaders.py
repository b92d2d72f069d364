"""Loader state as tables: epochs, cursors of clusters, weights by version, and what is read next.

With stateless draws a loader's state is small: the step, each cluster's cursor and the weights. States are rows, so a run of any number of
shards can go on from them; nothing is bound to the number of ranks that wrote them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import sampling


def epochs(docs: DataFrame, n: int, key: str, reshuffle: bool, seed: int = 42) -> DataFrame:
    """docs for n passes, with epoch and place: text is read in its own order each time, chat data are reshuffled after the first pass."""
    parts = [sampling.epoch_order(docs, e if reshuffle else 0, key, seed).withColumn("epoch", F.lit(e).cast("bigint")) for e in range(n)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def remaining(epoch_rows: DataFrame, epoch: int, place: int) -> DataFrame:
    """What a loader that stopped before (epoch, place) reads next."""
    return epoch_rows.where((F.col("epoch") > epoch) | ((F.col("epoch") == epoch) & (F.col("place") >= place)))


def cursors(draws: DataFrame, before_step: int) -> DataFrame:
    """(cluster_id, cursor): draws of each cluster before a step."""
    return draws.where(F.col("step") < before_step).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("cursor"))


def state_of(draws: DataFrame, weights: DataFrame, step: int) -> DataFrame:
    """The loader's state before a step: (step, cluster_id, cursor, weight)."""
    c = weights.join(cursors(draws, step), "cluster_id", "left")
    return c.select(F.lit(step).cast("bigint").alias("step"), "cluster_id", F.coalesce("cursor", F.lit(0).cast("bigint")).alias("cursor"), "weight")


def resumed_draws(spark: SparkSession, state: DataFrame, n: int, seed: int, per_step: int) -> DataFrame:
    """Draws of the next n, from a state: numbered on, with cursors that go on from the state's."""
    step = state.agg(F.max("step")).first()[0]
    first = step * per_step
    drawn = sampling.draw(spark, state.select("cluster_id", "weight"), first + n, seed, per_step).where(F.col("draw") >= first)
    return sampling.with_cursors(drawn).join(state.select("cluster_id", F.col("cursor").alias("__c")), "cluster_id").withColumn("cursor", F.col("cursor") + F.col("__c")).drop("__c")


def full_steps(draws: DataFrame, size: int) -> DataFrame:
    """Without the last step if it lacks rows: the whole step is dropped."""
    n = draws.groupBy("step").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") == size)
    return draws.join(n.select("step"), "step", "left_semi")


def saves(steps: DataFrame, step: str, interval: int, last: int, first: bool = False) -> DataFrame:
    """Steps at which a checkpoint is written: every `interval`, the last one, and the first if wanted."""
    s = F.col(step)
    return steps.where((s % interval == 0) | (s == last) | (F.lit(first) & (s == 1)))


def resume_from(checkpoints: DataFrame, wanted: int | None = None) -> int | None:
    """The step to load: the wanted one, which must be there, or the last usable one; None without any. checkpoints: (step, usable)."""
    if wanted is not None:
        if checkpoints.where(F.col("step") == wanted).isEmpty():
            raise ValueError(f"no checkpoint of step {wanted}")
        return wanted
    return checkpoints.where("usable").agg(F.max("step")).first()[0]


def save_state(state: DataFrame, path: str) -> None:
    """A version of the state, as a partition by step; a version that is written again is replaced as a whole."""
    state.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("step").parquet(path)


def load_state(spark: SparkSession, path: str, step: int | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    wanted = step if step is not None else df.agg(F.max("step")).first()[0]
    return df.where(F.col("step") == wanted).withColumn("step", F.col("step").cast("bigint"))
