"""What the operators of this subpackage share: tables in the shared folder, Arrow functions over one text column, and unused names."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the cluster's spark.checkpoint.dir. Where it is unset, a local master gets a temporary folder (tests);
    any other raises, as its executors would not find it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="millrace-"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/millrace-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: later reads neither recompute it nor depend on the executors that made it."""
    path = new_path(df.sparkSession, name)
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Removes a table made by written() that no later plan reads."""
    context = df.sparkSession.sparkContext
    for file in df.inputFiles()[:1]:
        folder = context._jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def texts_of(values: pa.Array) -> Iterable[bytes]:
    """The UTF-8 of each value, one at a time; a null counts as empty."""
    for x in values.cast(pa.large_binary()):
        yield x.as_py() or b""


def per_text(fn: Callable[[bytes], object], kind: str, arrow: pa.DataType, column: str | Column = "text") -> Column:
    """An Arrow function of one text column; fn gets a text's UTF-8 bytes (empty for null)."""

    @F.arrow_udf(kind)
    def run(values: pa.Array) -> pa.Array:
        return pa.array([fn(x) for x in texts_of(values)], arrow)

    return run(F.col(column) if isinstance(column, str) else column)


def unused(df: DataFrame, stem: str) -> str:
    """A column name that df does not have, whatever columns it has."""
    have = {c.lower() for c in df.columns}
    while stem.lower() in have:
        stem += "_"
    return stem


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_sample(texts: DataFrame, keys: DataFrame, most: int) -> DataFrame:
    """One text for each of at most `most` rows of keys (h, ...): those first by h, the digest xxhash64 of the text (empty for null), and then
    by their other columns. So few keys are broadcast; copies of a text fall together within each task, before they are shuffled."""
    first = keys.distinct().orderBy(*keys.columns).limit(most)
    found = texts.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), "text").join(F.broadcast(first), "h")
    return found.groupBy(*keys.columns).agg(F.first("text").alias("text"))


class Dealt:
    """Rows to be joined by a key of which some values may hold a large part of all rows. Such a value's rows are dealt over as many salts as
    it has times `most` rows, by a digest of the whole row; what they are joined with is repeated for each salt of these values alone."""

    def __init__(self, rows: DataFrame, key: list[str], most: int = 2000) -> None:
        self.key = key
        hot = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > most)
        self.hot = written(hot.select(*key, F.ceil(F.col("__n") / most).alias("__salts")), "hot")
        self.rows = rows
        if not self.hot.isEmpty():
            salt = F.coalesce(F.pmod(F.xxhash64(*rows.columns), F.col("__salts")), F.lit(0))
            self.rows = rows.join(self.hot, key, "left").withColumn("__salt", salt).drop("__salts")

    def join(self, values: DataFrame, how: str = "inner") -> DataFrame:
        """The rows with values, of which a key has few rows."""
        if "__salt" not in self.rows.columns:
            return self.rows.join(values, self.key, how)
        salts = F.sequence(F.lit(0).cast("bigint"), F.coalesce(F.col("__salts"), F.lit(1)).cast("bigint") - 1)
        repeated = values.join(self.hot, self.key, "left").withColumn("__salt", F.explode(salts)).drop("__salts")
        return self.rows.join(repeated, [*self.key, "__salt"], how).drop("__salt")
