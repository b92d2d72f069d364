"""Clusters: sizes, sketches, contributions, and weights that follow them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.hashing import digest
from millrace.functions.numbers import softmax_weights
from millrace.operators import sampling


def number_of_clusters(n: int, size: int = 500) -> int:
    return max(1, n // size)


def dense_counts(spark: SparkSession, assigned: DataFrame, cluster: str, value: Column | None = None, k: int | None = None) -> DataFrame:
    """(cluster_id, n) over 0 .. k - 1; k defaults to the largest id plus 1, so that clusters above it vanish and gaps count 0."""
    n = F.count(F.lit(1)) if value is None else F.sum(value)
    counts = assigned.groupBy(F.col(cluster).cast("bigint").alias("cluster_id")).agg(n.cast("bigint").alias("n"))
    if k is None:
        k = (assigned.agg(F.max(cluster)).first()[0] or 0) + 1 if not assigned.isEmpty() else 0
    return spark.range(k).select(F.col("id").alias("cluster_id")).join(counts, "cluster_id", "left").select("cluster_id", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


def sketch(vectors: DataFrame, by: list[str], name: str, vector: str, m: int, seed: int = 0) -> DataFrame:
    """(by, bucket, v): CountSketch. Element i of the vector called `name` goes to bucket h with sign g, both from a digest of seed, name and i;
    sums are linear, so sketches of parts add up. Null vectors are skipped."""
    if m <= 0:
        raise ValueError("a sketch needs a positive number of buckets")
    cells = vectors.where(F.col(vector).isNotNull()).select(*by, F.col(name).alias("__name"), F.posexplode(vector).alias("i", "x"))
    h = digest(seed, F.col("__name"), F.col("i"))
    number = F.conv(F.substring(h, 1, 13), 16, 10).cast("bigint")
    sign = F.when(F.conv(F.substring(h, 14, 1), 16, 10).cast("int") % 2 == 0, 1.0).otherwise(-1.0)
    return cells.groupBy(*by, (number % m).alias("bucket")).agg(F.sum(F.col("x").cast("double") * sign).alias("v"))


def mean_sketch(sketches: DataFrame, batches: int) -> DataFrame:
    """The mean over batches; `batches` counts those without an entry too."""
    return sketches.groupBy("bucket").agg((F.sum("v") / max(batches, 1)).alias("q"))


def contributions(sketches: DataFrame, dev: DataFrame, clusters: DataFrame, rate: float = 1.0) -> DataFrame:
    """(cluster_id, delta): rate times the dot product with the dev sketch; clusters without a sample have 0."""
    dots = sketches.join(dev, "bucket").groupBy("cluster_id").agg(F.sum(F.col("v") * F.col("q")).alias("dot"))
    return clusters.join(dots, "cluster_id", "left").select("cluster_id", (F.coalesce("dot", F.lit(0.0)) * rate).alias("delta"))


def streaks(deltas: DataFrame, patience: int) -> DataFrame:
    """(cluster_id, streak, dead) after all updates: a negative delta counts up, a positive one starts anew, 0 changes nothing; at `patience`
    the cluster is dead and stays so. deltas: (update_id, cluster_id, delta)."""
    ordered = deltas.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("update_id", "delta"))).alias("d"))
    zero = F.struct(F.lit(0).alias("streak"), F.lit(False).alias("dead"))

    def step(acc: Column, x: Column) -> Column:
        n = F.when(x["delta"] < 0, acc["streak"] + 1).when(x["delta"] > 0, F.lit(0)).otherwise(acc["streak"])
        return F.when(acc["dead"], acc).otherwise(F.struct(n.alias("streak"), (n >= patience).alias("dead")))

    return ordered.select("cluster_id", F.aggregate("d", zero, step).alias("s")).select("cluster_id", F.col("s.streak").cast("bigint").alias("streak"), F.col("s.dead").alias("dead"))


def updated_weights(deltas: DataFrame, temperature: float = 1.0, least: float = 1e-6, patience: int = 3, accumulate: bool = True) -> DataFrame:
    """(cluster_id, gamma, streak, dead, weight) after all updates. A positive gamma lowers a weight, as exp(-gamma / T) is meant to."""
    gamma = F.sum("delta") if accumulate else F.max_by("delta", "update_id")
    state = deltas.groupBy("cluster_id").agg(gamma.alias("gamma")).join(streaks(deltas, patience), "cluster_id")
    return state.withColumn("weight", softmax_weights(F.col("gamma"), F.col("dead"), Window.partitionBy(), temperature, least))


def weights_at(versions: DataFrame, steps: DataFrame) -> DataFrame:
    """Steps with the weights that hold at them: those of the last update before the step. versions: (update_step, cluster_id, weight)."""
    until = F.lead("update_step").over(Window.partitionBy("cluster_id").orderBy("update_step"))
    ranges = versions.withColumn("until", until)
    return steps.join(ranges, (F.col("step") > F.col("update_step")) & (F.col("until").isNull() | (F.col("step") <= F.col("until")))).drop("until")


def cluster(df: DataFrame, vector: str, k: int, method: str = "kmeans", seed: int = 42, restarts: int = 1, rounds: int = 20, key: str | None = None) -> DataFrame:
    """df with cluster_id. kmeans, minibatch and faiss are all Spark's KMeans (the best of `restarts` seeds); random assigns row by row."""
    if method == "random":
        return sampling.independent(df, k, seed, key)
    if method not in ("kmeans", "minibatch", "faiss"):
        raise ValueError(f"unknown method: {method}")
    fed = df.withColumn("__v", array_to_vector(F.col(vector).cast("array<double>")))
    models = [KMeans(k=k, seed=seed + r, maxIter=rounds, featuresCol="__v", predictionCol="cluster_id").fit(fed) for r in range(restarts)]
    return min(models, key=lambda m: m.summary.trainingCost).transform(fed).drop("__v")


#: Bytes of centroids that go to every task.
MOST_BYTES = 64 << 20


def nearest(df: DataFrame, vector: str, centroids: DataFrame) -> DataFrame:
    """df's rows with the id of the nearest centroid (the least id of equals). centroids: (cluster_id, centroid array); their bytes are checked before they
    are gathered, and each task multiplies batches of vectors with them. A null vector has a null id."""
    size = centroids.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("centroid")), F.lit(0)).alias("d")).first()
    if 8 * size["n"] * size["d"] > MOST_BYTES:
        raise ValueError(f"{size['n']} centroids of {size['d']} numbers are too many for every task")
    held = sorted((r["cluster_id"], r["centroid"]) for r in centroids.select("cluster_id", "centroid").collect())
    ids, c = np.array([k for k, _ in held], np.int64), np.array([v for _, v in held], float).reshape(len(held), size["d"])
    squares = (c * c).sum(axis=1)

    @F.arrow_udf("bigint")
    def of(vectors: pa.Array) -> pa.Array:
        out: list[int | None] = []
        for at in range(0, len(vectors), 1024):
            rows = vectors[at : at + 1024]
            known = [x.as_py() for x in rows]
            x = np.array([v for v in known if v is not None], float).reshape(-1, c.shape[1])
            d = squares[None, :] - 2 * (x @ c.T)
            # What rounding may have put in another order is compared again, difference by difference.
            close = d <= d.min(axis=1, keepdims=True) + 1e-9 * (1 + (x * x).sum(axis=1, keepdims=True) + squares.max(initial=0))
            best = d.argmin(axis=1)
            for i in np.flatnonzero(close.sum(axis=1) > 1):
                some = np.flatnonzero(close[i])
                best[i] = some[((x[i] - c[some]) ** 2).sum(axis=1).argmin()]
            found = iter(ids[best].tolist())
            out += [None if v is None else next(found) for v in known]
        return pa.array(out, pa.int64())

    return df.withColumn("cluster_id", of(F.col(vector)) if len(ids) else F.lit(None).cast("bigint"))
