"""Readers: a registry of named datasets, JSON corpora of any layout, cluster buckets, token files, tar shards, tables of losses."""

from __future__ import annotations

import io
import json
import tarfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import numbers as N
from millrace.functions import text as T
from millrace.functions.hashing import digest, draw_int
from millrace.operators.ordering import ordinal


@dataclass(frozen=True)
class Dataset:
    """A named dataset: where it is by default, how it is read, and how a row becomes a sample (a column of it)."""

    path: str
    load: Callable[..., DataFrame]
    sample: Callable[[DataFrame], Column]
    kind: str = "text"


REGISTRY: dict[str, Dataset] = {}


def register(name: str, dataset: Dataset) -> None:
    REGISTRY[name.lower()] = dataset


def lookup(name: str, path: str | None = None, kind: str | None = None) -> tuple[str, Dataset]:
    """(path, dataset) of a name in any case; a given path goes before the default; unknown names raise, with the known ones."""
    known = {k: d for k, d in REGISTRY.items() if kind in (None, d.kind)}
    if name.lower() not in known:
        raise ValueError(f"no dataset is registered as {name!r}; there are {sorted(known)}")
    found = known[name.lower()]
    return path or found.path, found


def samples(spark: SparkSession, name: str, path: str | None = None, **options) -> DataFrame:
    """All rows of a named dataset with their `sample`."""
    where, d = lookup(name, path)
    df = d.load(spark, where, **options)
    return df.withColumn("sample", d.sample(df))


def json_table(spark: SparkSession, path: str, schema: str | None = None, multiline: bool = False, **options) -> DataFrame:
    """JSON lines, or whole files with multiline; compressed files (gzip, zstd) too. Malformed lines are kept in _corrupt_record if the schema
    names it, and dropped otherwise."""
    reader = spark.read.options(multiLine=multiline, mode="PERMISSIVE" if not schema or "_corrupt_record" in schema else "DROPMALFORMED", **options)
    return (reader.schema(schema) if schema else reader).json(path)


def parquet_table(spark: SparkSession, path: str, **options) -> DataFrame:
    return spark.read.options(**options).parquet(path)


def generic(spark: SparkSession, path: str, fmt: str = "json", **options) -> DataFrame:
    return spark.read.format(fmt).options(**options).load(path)


for _name, _kind in (("c4", "text"), ("c4_test", "text"), ("c4_validation", "text"), ("documents", "text")):
    register(_name, Dataset(f"data/{_name}", parquet_table if _name == "documents" else json_table, lambda df: df["text"], _kind))
register("chat", Dataset("data/chat", json_table, lambda df: T.qa_messages(df["question"], df["answer"]), "chat"))
register("math_qa", Dataset("data/math_qa", json_table, lambda df: F.struct(*T.split_reasoning(df["answer"])), "chat"))
register("interleaved", Dataset("data/interleaved", parquet_table, lambda df: F.struct(df["texts"], df["images"]), "multimodal"))
register("captions", Dataset("data/captions", parquet_table, lambda df: caption(df), "image"))


def caption(df: DataFrame) -> Column:
    """The caption; of a list, the first."""
    c = df["caption"]
    return F.try_element_at(c, F.lit(1)) if dict(df.dtypes)["caption"].startswith("array") else c


#: Keys under which a file may hold its records, in the order in which they are looked for. Fixed values.
RECORD_KEYS = ("data", "items", "records", "samples")


def json_texts(spark: SparkSession, folder: str, field: str = "text") -> DataFrame:
    """(path, ordinal, text) of all *.json and *.jsonl files below a folder, in order of path and place. A file of which any line is a JSON value is read as
    lines (lines that are no objects, or lack the field, give nothing: so a list on one line gives nothing); any other file as one
    JSON value: a list of records, the first of RECORD_KEYS that is a list, or one record. Texts that are empty or no strings are dropped."""
    files = spark.read.options(recursiveFileLookup=True, pathGlobFilter="*.{json,jsonl}").text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[str, int, str]] = []
            for path, value in zip(batch.column(0), batch.column(1), strict=True):
                out += [(path.as_py(), i, t) for i, t in enumerate(_records(value.as_py(), field))]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.string())], names=["path", "ordinal", "text"])

    return files.mapInArrow(parsed, "path string, ordinal bigint, text string")


def _records(content: str, field: str) -> list[str]:
    found, any_line = [], False
    for line in content.splitlines():
        if line.strip():
            try:
                x = json.loads(line)
            except ValueError:
                continue
            any_line = True
            found.append(x)
    if not any_line:
        try:
            whole = json.loads(content)
        except ValueError:
            return []
        if isinstance(whole, dict):
            whole = next((whole[k] for k in RECORD_KEYS if isinstance(whole.get(k), list)), [whole])
        found = whole if isinstance(whole, list) else []
    return [x[field] for x in found if isinstance(x, dict) and isinstance(x.get(field), str) and x[field]]


def embedded_records(column: Column, field: str = "text") -> Column:
    """array of the texts of one JSON value: a list, the first list among RECORD_KEYS, or one record. With built-in functions."""
    record = f"struct<{field}:string>"
    lists = [F.from_json(column, f"array<{record}>")] + [F.from_json(column, f"struct<{k}:array<{record}>>")[k] for k in RECORD_KEYS]
    single = F.when(F.get_json_object(column, f"$.{field}").isNotNull(), F.array(F.struct(F.get_json_object(column, f"$.{field}").alias(field))))
    first = F.when(F.trim(column).startswith("["), lists[0])
    return F.filter(F.transform(F.coalesce(first, *lists[1:], single), lambda x: x[field]), lambda t: t.isNotNull() & (t != ""))


def sharded_corpus(spark: SparkSession, root: str, globals_: list[int] | None = None, locals_: list[int] | None = None, seed: int = 42, shuffle: bool = True) -> DataFrame:
    """(path, global_shard, local_shard) of *.jsonl.zst files in root/global-shard_GG_of_10/local-shard_L_of_10, in a seeded order; a part of the
    shards on request."""
    files = spark.read.format("binaryFile").options(recursiveFileLookup=True, pathGlobFilter="*.jsonl.zst").load(root).select("path")
    part = lambda p: F.regexp_extract("path", p, 1).cast("int")
    df = files.select("path", part(r"global-shard_(\d+)_of").alias("global_shard"), part(r"local-shard_(\d+)_of").alias("local_shard"))
    if globals_:
        df = df.where(F.col("global_shard").isin(globals_))
    if locals_:
        df = df.where(F.col("local_shard").isin(locals_))
    return df.orderBy(digest(seed, F.element_at(F.split("path", "/"), -1)), "path") if shuffle else df.orderBy("path")


def listed(names: DataFrame, patterns: list[str]) -> DataFrame:
    """names (path) that a pattern wants: its base name exactly, or by * and ?. Patterns are lower-cased and names are not, as in the
    behaviour that this matches."""
    base = F.element_at(F.split("path", "/"), -1)
    ok = F.lit(False)
    for p in patterns:
        ok = ok | (base.rlike(T.glob_pattern(p)) if "*" in p or "?" in p else base == p.lower())
    return names.where(ok)


def unmatched(names: DataFrame, patterns: list[str]) -> DataFrame:
    """Patterns that want none of the names."""
    spark = names.sparkSession
    p = spark.createDataFrame([(x, T.glob_pattern(x)) for x in patterns], "pattern string, regex string")
    base = F.element_at(F.split("path", "/"), -1)
    hit = names.select(base.alias("base")).distinct()
    return p.join(hit, F.expr("base rlike regex"), "left_anti").select("pattern")


def buckets(spark: SparkSession, folder: str, expected: int | None = None) -> DataFrame:
    """(cluster_id, line_no, text) of a bucket table. Raises if it lacks one of the expected clusters."""
    df = spark.read.parquet(folder)
    if expected is not None and (n := df.select("cluster_id").distinct().count()) != expected:
        raise ValueError(f"{n} buckets, not {expected}")
    return df


def bucket_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(cluster_id, line_no, text) of bucket_NNNN.jsonl files: lines are numbered without blank ones; a line that is no object with a text is null. A file is
    read in blocks by many tasks: lines are counted by block first, and numbered within their block."""
    raw = spark.read.options(pathGlobFilter="bucket_*.jsonl").text(folder)
    cluster = F.regexp_extract("_metadata.file_name", r"bucket_(\d+)", 1).cast("bigint")
    lines = raw.select(cluster.alias("cluster_id"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line")).where(F.trim("line") != "")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n")).select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    # Rows of one block are in one task, in their order.
    number = F.row_number().over(Window.partitionBy("file", "block").orderBy("at")) - 1
    out = lines.withColumn("number", number).join(blocks, ["file", "block"])
    return out.select("cluster_id", (F.col("before") + F.col("number")).cast("bigint").alias("line_no"), F.get_json_object("line", "$.text").alias("text"))


def line_at(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """wanted (cluster_id, line_no, ...) with the text of that line, null where there is none."""
    return wanted.join(bucket_lines(spark, folder), ["cluster_id", "line_no"], "left")


def union(*registries: dict[str, Dataset]) -> dict[str, Dataset]:
    """All names of several registries; a name that two of them have raises."""
    names = [k for r in registries for k in r]
    twice = sorted({k for k in names if names.count(k) > 1})
    if twice:
        raise ValueError(f"names in two registries: {twice}")
    return {k: d for r in registries for k, d in r.items()}


def token_files(spark: SparkSession, folder: str) -> DataFrame:
    """(cluster_id, n_tokens, tokens) of bucket_NNNN.bin files: little-endian 32-bit ids. An absent or
    empty file has no row: its cluster reads as null."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "bucket_*.bin").load(folder)
    ids = F.regexp_extract("path", r"bucket_(\d+)\.bin", 1).cast("bigint")

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            arrays = [np.frombuffer(x.as_py(), "<i4") for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(a) for a in arrays], pa.int64()), pa.array(arrays, pa.list_(pa.int32()))], names=["cluster_id", "n_tokens", "tokens"])

    return raw.select(ids.alias("cluster_id"), "content").mapInArrow(parsed, "cluster_id bigint, n_tokens bigint, tokens array<int>")


def token_parts(spark: SparkSession, path: str) -> DataFrame:
    """(cluster_id, part, first, n_tokens, payload, tokens) of a table of parts of token streams."""

    @F.arrow_udf("array<int>")
    def tokens(payloads: pa.Array) -> pa.Array:
        return pa.array([np.frombuffer(x.as_py(), "<i4") for x in payloads], pa.list_(pa.int32()))

    parts = spark.read.parquet(path)
    return parts.select("cluster_id", "part", "first", F.floor(F.octet_length("payload") / 4).alias("n_tokens"), "payload", tokens("payload").alias("tokens"))


def is_token_format(meta: dict | None) -> bool:
    """Do bucket metadata say that token files are there? No metadata: no."""
    return bool(meta) and meta.get("format") == "bin"


def metadata(spark: SparkSession, path: str) -> dict | None:
    """A JSON file on any file system; None if it is not there."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def tar_shards(spark: SparkSession, path: str) -> DataFrame:
    """(shard, key, txt, jpg, json) of tar files whose members are grouped by the name before the first dot. A shard is read by one task."""
    raw = spark.read.format("binaryFile").options(pathGlobFilter="*.tar", recursiveFileLookup=True).load(path).select("path", "content")
    return opened_tars(raw, "path").withColumnRenamed("path", "shard")


def opened_tars(raw: DataFrame, shard: str) -> DataFrame:
    """(shard, key, txt, jpg, json) of the members of tars in rows (shard, content)."""
    kind = raw.schema[shard].dataType.simpleString()

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0), b.column(1), strict=True):
                rows: dict[str, dict[str, bytes]] = {}
                with tarfile.open(fileobj=io.BytesIO(content.as_py())) as tar:
                    for m in tar:
                        if m.isfile():
                            key, _, ext = m.name.rpartition("/")[2].partition(".")
                            rows.setdefault(key, {})[ext] = tar.extractfile(m).read()
                get = lambda r, k: r[k].decode() if k in r else None
                kept = list(rows.items())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name.as_py()] * len(kept), b.column(0).type), pa.array([k for k, _ in kept], pa.string()), pa.array([get(r, "txt") for _, r in kept], pa.string()), pa.array([r.get("jpg") for _, r in kept], pa.binary()), pa.array([get(r, "json") for _, r in kept], pa.string())],
                    names=[shard, "key", "txt", "jpg", "json"],
                )

    return raw.select(shard, "content").mapInArrow(opened, f"{shard} {kind}, key string, txt string, jpg binary, json string")


def losses(spark: SparkSession, path: str) -> DataFrame:
    """(step, loss) of a text file with both in each line."""
    return spark.read.csv(path, sep=" ", schema="step bigint, loss double")


def scalar_losses(events: DataFrame, tag: str) -> DataFrame:
    """(step, loss) of one tag in long metric rows; raises unless they are of one run."""
    runs = events.select("run").distinct().limit(2).count()
    if runs != 1:
        raise ValueError(f"one run is needed, not {runs}")
    return events.where(F.col("name") == tag).select("step", F.col("value").alias("loss"))


def sum_digit_questions(spark: SparkSession, n: int, seed_numbers: int = 3, seed_count: int = 2) -> DataFrame:
    """(id, numbers, question, answer): two to four numbers from 10 to 99, and the sum of all their digits."""
    count = draw_int(seed_count, 3, F.col("id")) + 2
    numbers = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("count") - 1), lambda j: draw_int(seed_numbers, 90, F.col("id"), j) + 10)
    d = spark.range(n).withColumn("count", count).withColumn("numbers", numbers).drop("count")
    said = F.array_join(F.transform("numbers", lambda x: x.cast("string")), ", ")
    return d.select("id", "numbers", F.concat(F.lit("What is the total digit sum of ["), said, F.lit("]?")).alias("question"), N.digit_sum(said).alias("answer"))


def decoded_images(df: DataFrame, content: str) -> DataFrame:
    """df with (height, width, pixels) of binary PPM pictures (P6), decoded in Arrow batches; what cannot be decoded is null. Other
    formats need a decoder that is not installed here, and are null too."""

    @F.arrow_udf("struct<height:int,width:int,pixels:binary>")
    def decode(values: pa.Array) -> pa.Array:
        return pa.array([_ppm(x.as_py()) for x in values], pa.struct([("height", pa.int32()), ("width", pa.int32()), ("pixels", pa.binary())]))

    return df.withColumn("image", decode(F.col(content)))


def _ppm(data: bytes | None) -> dict | None:
    if not data or not data.startswith(b"P6"):
        return None
    parts = data.split(maxsplit=4)
    if len(parts) < 5:
        return None
    w, h = int(parts[1]), int(parts[2])
    return {"height": h, "width": w, "pixels": data[-3 * w * h :]}


def numbered(df: DataFrame, key: str, out: str = "row") -> DataFrame:
    """An explicit order of rows, in place of the order of a file's lines."""
    return ordinal(df, key, out)
