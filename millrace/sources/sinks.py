"""Writers: slim JSON lines, cluster buckets with metadata, token files, tar shards, metric fan-out, loss tables."""

from __future__ import annotations

import io
import json
import tarfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.hashing import digest
from millrace.operators.ordering import prefix_sum, shuffled_ordinal
from millrace.operators.weighting import dense_counts


def put_text(spark: SparkSession, path: str, content: str) -> None:
    """A small file on any file system."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(p, True)
    out.write(bytearray(content.encode()))
    out.close()


def slim_json(df: DataFrame, path: str, keep_url: bool = False, overwrite: bool = False) -> bool:
    """Lines with the text, and the URL where it is there; the commit of the whole folder is atomic. A finished folder is left as it is
    unless it is to be written anew; says whether it was written."""
    spark = df.sparkSession
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not overwrite and p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return False
    df.select("text", *(["url"] if keep_url and "url" in df.columns else [])).write.mode("overwrite").option("ignoreNullFields", "true").json(path)
    return True


def write_buckets(df: DataFrame, path: str, key: str, k: int | None = None, shuffle: bool = False, seed: int = 42) -> dict:
    """A Parquet table (line_no, key, text) partitioned by cluster_id, lines numbered in the order of key or of a seeded digest; and meta.json with the
    dense sizes. A large cluster is dealt over tasks by ranges of lines."""
    spark = df.sparkSession
    own = digest(seed, F.col("cluster_id"), F.col(key)) if shuffle else F.lpad(F.hex(F.col(key).cast("bigint")), 16, "0")
    lines = shuffled_ordinal(df, own, "line_no", by=["cluster_id"], ties=[key])
    lines.repartition("cluster_id", F.floor(F.col("line_no") / 1_000_000)).sortWithinPartitions("cluster_id", "line_no").write.mode("overwrite").partitionBy("cluster_id").parquet(path)
    counts = dense_counts(spark, spark.read.parquet(path), "cluster_id", k=k).orderBy("cluster_id").collect()
    meta = {"num_clusters": len(counts), "cluster_sizes": [r["n"] for r in counts], "total": sum(r["n"] for r in counts)}
    put_text(spark, f"{path}/_meta.json", json.dumps(meta))
    return meta


def write_assignment(df: DataFrame, path: str, key: str) -> None:
    df.select(key, "cluster_id").write.mode("overwrite").parquet(path)


def write_token_files(df: DataFrame, path: str) -> dict:
    """(cluster_id, tokens) as rows (cluster_id, payload) of little-endian 32-bit ids, in Parquet; and meta.json with counts and format. The payload of a
    cluster without tokens is empty."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = [np.asarray(x.as_py() or [], "<i4").tobytes() for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(d) // 4 for d in data], pa.int64()), pa.array(data, pa.binary())], names=["cluster_id", "n_tokens", "payload"])

    spark = df.sparkSession
    df.select(F.col("cluster_id").cast("bigint").alias("cluster_id"), F.col("tokens").cast("array<int>")).mapInArrow(packed, "cluster_id bigint, n_tokens bigint, payload binary").write.mode("overwrite").parquet(path)
    n = {r["cluster_id"]: r["n_tokens"] for r in spark.read.parquet(path).select("cluster_id", "n_tokens").collect()}
    meta = {"format": "bin", "token_dtype": "int32", "cluster_token_counts": [n.get(k, 0) for k in range(max(n, default=-1) + 1)]}
    put_text(spark, f"{path}/_meta.json", json.dumps(meta))
    return meta


def write_bucket_files(df: DataFrame, key: str, path: str) -> None:
    """bucket_NNNN.jsonl files of rows (cluster_id, key, text), a line each, in order of key. A file is one task's, as its lines are in one order: clusters
    beyond a task are for write_buckets(), whose table is dealt."""
    lines = df.select(F.col("cluster_id").cast("bigint").alias("cluster_id"), key, F.to_json(F.struct("text")).alias("value"))
    # Sorted first by the very column that parts the files: the writer sorts anew by any other, and that sort replaces this one.
    sorted_ = lines.repartition("cluster_id").sortWithinPartitions("cluster_id", key)
    sorted_.select("cluster_id", "value").write.partitionBy("cluster_id").mode("overwrite").text(f"{path}/parts")
    context = df.sparkSession.sparkContext
    jvm = context._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{path}/parts")
    fs = folder.getFileSystem(context._jsc.hadoopConfiguration())
    for status in fs.listStatus(folder):
        name = status.getPath().getName()
        if name.startswith("cluster_id="):
            number = name.partition("=")[2]
            bucket = f"bucket_{int(number):04d}" if number.lstrip("-").isdigit() else "bucket_null"
            for file in fs.listStatus(status.getPath()):
                if file.getPath().getName().startswith("part-"):
                    fs.rename(file.getPath(), jvm.org.apache.hadoop.fs.Path(f"{path}/{bucket}.jsonl"))
    fs.delete(folder, True)


#: Tokens in one part of a cluster's stream.
PART = 1 << 20


def write_token_parts(df: DataFrame, key: str, path: str, part: int = PART) -> None:
    """(cluster_id, part, first, payload) as Parquet: each cluster's token stream, its rows (cluster_id, key, tokens) end to end in the order of key, in
    parts of `part` tokens at most as little-endian 32-bit ids, so that no cluster is in one row or task. first: the place of a part's first token."""
    laid = prefix_sum(df.select("cluster_id", key, F.col("tokens").cast("array<int>").alias("t")).where(F.size("tokens") > 0), key, F.size("t").cast("bigint"), "at", by=["cluster_id"])
    n = F.size("t")
    cut = laid.withColumn("part", F.explode(F.sequence(F.floor(F.col("at") / part), F.floor((F.col("at") + n - 1) / part))))
    low, high = F.greatest(F.col("part") * part, F.col("at")), F.least((F.col("part") + 1) * part, F.col("at") + n)
    pieces = cut.select("cluster_id", "part", low.alias("at"), F.slice("t", (low - F.col("at") + 1).cast("int"), (high - low).cast("int")).alias("t"))
    whole = pieces.groupBy("cluster_id", "part").agg(F.array_sort(F.collect_list(F.struct("at", "t"))).alias("p"))

    @F.arrow_udf("binary")
    def payload(tokens: pa.Array) -> pa.Array:
        return pa.array([np.asarray(x.values.to_numpy(zero_copy_only=False), "<i4").tobytes() for x in tokens], pa.binary())

    flat = F.flatten(F.transform("p", lambda x: x["t"]))
    whole.select("cluster_id", "part", F.col("p")[0]["at"].alias("first"), payload(flat).alias("payload")).write.mode("overwrite").parquet(path)


def tar_rows(df: DataFrame, shard: str) -> DataFrame:
    """(shard, tar): members key.txt, key.jpg and key.json of each row, in one tar per shard. A shard's number is the caller's, so its size is too."""
    held = df.groupBy(shard).agg(F.array_sort(F.collect_list(F.struct("key", "txt", "jpg", "json"))).alias("m"))

    @F.arrow_udf("binary")
    def tar(groups: pa.Array) -> pa.Array:
        out = []
        for g in groups:
            buffer = io.BytesIO()
            with tarfile.open(fileobj=buffer, mode="w") as t:
                for row in g.as_py():
                    for ext in ("txt", "jpg", "json"):
                        if row[ext] is not None:
                            data = row[ext] if isinstance(row[ext], bytes) else row[ext].encode()
                            info = tarfile.TarInfo(f"{row['key']}.{ext}")
                            info.size = len(data)
                            t.addfile(info, io.BytesIO(data))
            out.append(buffer.getvalue())
        return pa.array(out, pa.binary())

    return held.select(F.col(shard).alias("shard"), tar("m").alias("tar"))


def fan_out(stream: DataFrame, writers: list[Callable[[DataFrame, int], None]], checkpoint: str):
    """Every writer gets the same batch of a stream of metrics; without writers the batch is dropped."""

    def each(batch: DataFrame, number: int) -> None:
        for w in writers or [lambda b, _: b.write.format("noop").mode("overwrite").save()]:
            w(batch, number)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_losses(df: DataFrame, path: str) -> None:
    """`step loss` by line, in order of steps. One row per step, so one file."""
    df.select("step", "loss").orderBy("step").coalesce(1).write.mode("overwrite").csv(path, sep=" ")


def write_report(lines: DataFrame, path: str) -> None:
    lines.select("line").coalesce(1).write.mode("append").text(path)


def generation_report(df: DataFrame, batch: int, tokens: int, seconds: float) -> DataFrame:
    """One JSON document: metadata with the rate (prompt tokens counted too), and each response."""
    rows = df.agg(F.array_sort(F.collect_list(F.struct("id", "input", "output"))).alias("responses"))
    return rows.select(F.to_json(F.struct(F.struct(F.lit(batch).alias("batch_size"), F.lit(batch * tokens / seconds).alias("tokens_per_sec")).alias("metadata"), "responses")).alias("report"))


def checkpoint_path(folder: str, step: int) -> str:
    return f"{folder}/global_step{step}"


def write_settings(spark: SparkSession, settings: dict, path: str) -> None:
    """A tree of settings as resolved, as one JSON file."""
    put_text(spark, path, json.dumps(settings, indent=2, sort_keys=True, default=str))
