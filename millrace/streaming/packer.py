"""A packer over a stream of documents: each shard's rest of tokens is kept as state, so a stopped stream goes on where it was."""

from __future__ import annotations

import time
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from millrace.operators.ordering import prefix_sum_wide

OUTPUT = StructType([StructField("shard", LongType()), StructField("window_id", LongType()), StructField("tokens", ArrayType(StringType())), StructField("positions", ArrayType(LongType()))])

#: Windows in one batch that is given out.
ROWS = 1024
#: Bytes of text in one file of a feed, and files that one trigger takes: a trigger's texts are what the packer's Python holds.
FILE_BYTES, FILES = 16 << 20, 8


def feed(docs: DataFrame, key: str, text: str, path: str, size: int = FILE_BYTES) -> None:
    """docs as Parquet files for a stream: each holds a range of keys and about `size` bytes of text (one row at least), and times of change are in order of
    keys, which is the order in which a stream takes files."""
    spark = docs.sparkSession
    laid = prefix_sum_wide(docs, key, F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint"), "__at", "__n")
    dealt = laid.withColumn("file", F.floor(F.col("__at") / size)).drop("__at", "__n").repartition("file").sortWithinPartitions("file")
    dealt.write.partitionBy("file").parquet(path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    parts = [(int(f.getPath().getName().partition("=")[2]), x.getPath()) for f in fs.listStatus(folder) if f.getPath().getName().startswith("file=") for x in fs.listStatus(f.getPath()) if x.getPath().getName().startswith("part-")]
    begin = int(time.time()) - len(parts)
    for i, (_, part) in enumerate(sorted(parts, key=lambda p: p[0])):
        fs.setTimes(part, (begin + i) * 1000, -1)


def fed(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The stream of a feed, FILES files at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", FILES).parquet(path)


class _Packer(StatefulProcessor):
    """Windows of length + 1 from the tokens of a shard; what does not fill one stays as state, with its positions."""

    def __init__(self, length: int) -> None:
        self.size = length + 1

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rest = handle.getValueState("rest", StructType([StructField("window_id", LongType()), StructField("tokens", ArrayType(StringType())), StructField("positions", ArrayType(LongType()))]))
        self.last = handle.getValueState("last", StructType([StructField("order_key", LongType())]))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        number, tokens, positions = self.rest.get() if self.rest.exists() else (0, [], [])
        # Order within a trigger is put back by the order key; how much a trigger takes is the source's to bound.
        parts = list(rows)
        texts = [t for p in parts for t in p["tokens"]]
        keys = np.concatenate([p["order_key"].to_numpy() for p in parts])
        if len(known := keys[~pd.isna(keys)]):
            if self.last.exists() and known.min() < self.last.get()[0]:
                raise ValueError(f"key {known.min()} of shard {key[0]} comes after {self.last.get()[0]}, in a later trigger")
            self.last.update((int(known.max()),))
        order = np.argsort(keys, kind="stable")
        sizes = np.array([len(t) for t in texts], np.int64)[order]
        stream = np.concatenate([np.array(list(tokens), object), *[np.asarray(texts[i], object) for i in order]])
        begins = np.repeat(np.cumsum(sizes) - sizes, sizes)
        at = np.concatenate([np.array(list(positions), np.int64), np.arange(sizes.sum()) - begins])
        n = len(stream) // self.size
        for low in range(0, n, ROWS):
            ends = [(k * self.size, (k + 1) * self.size) for k in range(low, min(low + ROWS, n))]
            yield pd.DataFrame({"shard": key[0], "window_id": range(number + low, number + low + len(ends)), "tokens": [stream[a:b].tolist() for a, b in ends], "positions": [_from_zero(at[a:b]) for a, b in ends]})
        self.rest.update((number + n, stream[n * self.size :].tolist(), at[n * self.size :].tolist()))

    def close(self) -> None:
        pass


def _from_zero(at: np.ndarray) -> list[int]:
    """Positions of a document that goes on from the window before start at 0; those of later documents stay."""
    fresh = np.flatnonzero(at == 0)
    end = int(fresh[0]) if len(fresh) else len(at)
    return np.concatenate([at[:end] - at[0], at[end:]]).tolist()


def packed(stream: DataFrame, length: int) -> DataFrame:
    """(shard, window_id, tokens, positions) of a stream of (shard, order_key, tokens)."""
    return stream.groupBy("shard").transformWithStateInPandas(statefulProcessor=_Packer(length), outputStructType=OUTPUT, outputMode="append", timeMode="None")
