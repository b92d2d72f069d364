"""Readers and writers round trip; streams go on where they stopped."""

from __future__ import annotations

import io
import json
import tarfile

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import packing, sampling
from millrace.sources import readers, sinks
from millrace.streaming import loaders, packer


def test_registry(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"text":"x"}\n{"text":"y"}\n')
    assert sorted(r["sample"] for r in readers.samples(spark, "C4_Test", str(tmp_path)).collect()) == ["x", "y"]
    with pytest.raises(ValueError, match="registered.*c4_test"):
        readers.lookup("missing")
    with pytest.raises(ValueError, match="registered"):
        readers.lookup("captions", kind="text")
    readers.register("Mine", readers.Dataset(str(tmp_path), readers.json_table, lambda df: F.upper("text")))
    assert sorted(r["sample"] for r in readers.samples(spark, "mine").collect()) == ["X", "Y"]
    (tmp_path / "qa").mkdir()
    (tmp_path / "qa" / "d.json").write_text(json.dumps([{"question": "1+1", "answer": "so #### 2"}]))
    chat = readers.samples(spark, "chat", str(tmp_path / "qa"), multiline=True).first()["sample"]
    assert [m["role"] for m in chat] == ["user", "assistant"] and chat[1]["content"] == "so #### 2"


def test_compressed_shards_in_seeded_order(spark, tmp_path):
    for g in (1, 2):
        for n in (0, 1):
            d = tmp_path / f"global-shard_0{g}_of_10" / f"local-shard_{n}_of_10"
            d.mkdir(parents=True)
            (d / f"shard_0000000{n}_processed.jsonl.zst").write_bytes(zstandard.compress(f'{{"text":"t{g}{n}"}}\nbroken\n\n'.encode()))
    df = readers.sharded_corpus(spark, str(tmp_path))
    assert df.count() == 4 and readers.sharded_corpus(spark, str(tmp_path), globals_=[2], locals_=[1]).count() == 1
    names = sorted(r["n"] for r in df.select(T.shard_name(F.col("path")).alias("n")).collect())
    assert names == [f"dclm_g0{g}_l{n}_s0000000{n}.jsonl" for g in (1, 2) for n in (0, 1)]
    texts = readers.json_table(spark, f"{tmp_path}/*/*/*.zst", "text string, _corrupt_record string")
    assert sorted(r["text"] for r in texts.where("_corrupt_record IS NULL").collect()) == ["t10", "t11", "t20", "t21"]


def test_slim_json_is_written_once(spark, tmp_path):
    df = spark.createDataFrame([("é", "u"), ("b", None)], "text string, url string")
    assert sinks.slim_json(df, f"{tmp_path}/o", keep_url=True) and not sinks.slim_json(df, f"{tmp_path}/o")
    lines = sorted(r["value"] for r in spark.read.text(f"{tmp_path}/o").collect())
    assert lines == ['{"text":"b"}', '{"text":"é","url":"u"}']


def test_buckets_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(i, i % 3 if i % 3 != 1 else 4, f"t{i}") for i in range(30)], "doc_id long, cluster_id long, text string")
    meta = sinks.write_buckets(df, f"{tmp_path}/b", "doc_id")
    assert meta == {"num_clusters": 5, "cluster_sizes": [10, 0, 10, 0, 10], "total": 30} == readers.metadata(spark, f"{tmp_path}/b/_meta.json")
    back = readers.buckets(spark, f"{tmp_path}/b", 3)
    assert [r["text"] for r in back.where("cluster_id = 2").orderBy("line_no").collect()] == [f"t{i}" for i in range(2, 30, 3)]
    with pytest.raises(ValueError, match="buckets"):
        readers.buckets(spark, f"{tmp_path}/b", 5)
    sinks.write_buckets(df, f"{tmp_path}/s", "doc_id", shuffle=True)
    mixed = [r["text"] for r in readers.buckets(spark, f"{tmp_path}/s").where("cluster_id = 2").orderBy("line_no").collect()]
    assert mixed != sorted(mixed, key=lambda t: int(t[1:])) and sorted(mixed) == sorted(f"t{i}" for i in range(2, 30, 3))
    assert readers.metadata(spark, f"{tmp_path}/none.json") is None and not readers.is_token_format(None) and not readers.is_token_format(meta)


def test_bucket_files(spark, tmp_path):
    (tmp_path / "bucket_0000.jsonl").write_text('{"text":"a"}\n\nbroken\n{"text":"b"}\n')
    (tmp_path / "bucket_0001.jsonl").write_text("")
    np.array([1, 2, 70000], "<i4").tofile(tmp_path / "bucket_0003.bin")
    (tmp_path / "bucket_0004.bin").write_bytes(b"")
    rows = sorted((r["cluster_id"], r["line_no"], r["text"]) for r in readers.bucket_lines(spark, str(tmp_path)).collect())
    assert rows == [(0, 0, "a"), (0, 1, None), (0, 2, "b")]
    bins = sorted((r["cluster_id"], r["n_tokens"], r["tokens"]) for r in readers.token_files(spark, str(tmp_path)).collect())
    assert bins == [(3, 3, [1, 2, 70000])]  # the empty file's cluster has no tokens, so no row


def test_token_table(spark, tmp_path):
    df = spark.createDataFrame([(0, [1, 2]), (2, []), (3, [9])], "cluster_id long, tokens array<int>")
    meta = sinks.write_token_files(df, f"{tmp_path}/t")
    assert meta["cluster_token_counts"] == [2, 0, 0, 1] and readers.is_token_format(meta)
    payload = {r["cluster_id"]: bytes(r["payload"]) for r in spark.read.parquet(f"{tmp_path}/t").collect()}
    assert payload == {0: np.array([1, 2], "<i4").tobytes(), 2: b"", 3: np.array([9], "<i4").tobytes()}


def test_tar_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(i // 2, f"k{i}", f"text {i}", bytearray([i]), None if i == 1 else "{}") for i in range(4)], "shard long, key string, txt string, jpg binary, json string")
    for r in sinks.tar_rows(df, "shard").collect():
        (tmp_path / f"{r['shard']}.tar").write_bytes(r["tar"])
    with tarfile.open(fileobj=io.BytesIO((tmp_path / "0.tar").read_bytes())) as t:
        assert t.getnames() == ["k0.txt", "k0.jpg", "k0.json", "k1.txt", "k1.jpg"]
    back = readers.tar_shards(spark, str(tmp_path)).orderBy("key").collect()
    assert [(r["key"], r["txt"], bytes(r["jpg"]), r["json"]) for r in back] == [(f"k{i}", f"text {i}", bytes([i]), None if i == 1 else "{}") for i in range(4)]


def test_losses_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(2, 0.1 + 0.2), (1, 8.0481)], "step long, loss double")
    sinks.write_losses(df, f"{tmp_path}/l")
    assert [tuple(r) for r in readers.losses(spark, f"{tmp_path}/l").orderBy("step").collect()] == [(1, 8.0481), (2, 0.1 + 0.2)]
    events = df.selectExpr("'r1' run", "'loss' name", "step", "loss value")
    assert readers.scalar_losses(events, "loss").count() == 2
    with pytest.raises(ValueError, match="one run"):
        readers.scalar_losses(events.unionByName(events.withColumn("run", F.lit("r2"))), "loss")


def test_images(spark):
    ppm = b"P6 2 1 255\n" + bytes(range(6))
    df = readers.decoded_images(spark.createDataFrame([(bytearray(ppm),), (bytearray(b"junk"),), (None,)], "content binary"), "content")
    got = [r["image"] for r in df.collect()]
    assert (got[0]["height"], got[0]["width"], bytes(got[0]["pixels"])) == (1, 2, bytes(range(6))) and got[1:] == [None, None]


def test_unmatched_patterns(spark):
    names = spark.createDataFrame([("a/x.json",), ("b/y.bin",)], "path string")
    assert [r["pattern"] for r in readers.unmatched(names, ["*.json", "*.txt", "y.bin"]).collect()] == ["*.txt"]


def test_fan_out(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"step":1,"loss":2.0}\n')
    seen: list = []
    stream = spark.readStream.schema("step long, loss double").json(str(tmp_path / "in"))
    sinks.fan_out(stream, [lambda b, n: seen.append(b.count()), lambda b, n: b.write.mode("append").json(f"{tmp_path}/o")], f"{tmp_path}/c").awaitTermination()
    assert seen == [1] and spark.read.json(f"{tmp_path}/o").count() == 1


def test_state_round_trip_and_retention(spark, tmp_path):
    w = spark.createDataFrame([(0, 0.5), (1, 0.5)], "cluster_id long, weight double")
    draws = sampling.draw(spark, w, 40, 3, 4)
    for step in (4, 8):
        loaders.save_state(loaders.state_of(draws, w, step), f"{tmp_path}/s")
    assert loaders.load_state(spark, f"{tmp_path}/s").select(F.sum("cursor")).first()[0] == 32
    assert loaders.load_state(spark, f"{tmp_path}/s", 4).select(F.sum("cursor")).first()[0] == 16
    whole = {(r["draw"], r["cluster_id"], r["cursor"]) for r in sampling.with_cursors(draws).collect()}
    rest = {(r["draw"], r["cluster_id"], r["cursor"]) for r in loaders.resumed_draws(spark, loaders.load_state(spark, f"{tmp_path}/s"), 8, 3, 4).collect()}
    assert rest == {x for x in whole if x[0] >= 32}
    points = spark.createDataFrame([(0, True), (10, True), (20, False)], "step long, usable boolean")
    assert loaders.resume_from(points) == 10 and loaders.resume_from(points.limit(0)) is None and loaders.resume_from(points, 20) == 20
    with pytest.raises(ValueError, match="no checkpoint"):
        loaders.resume_from(points, 30)


def test_stream_packer_goes_on_after_a_stop(spark, tmp_path):
    """Two runs over one checkpoint give the windows of one run, with the rest of tokens carried over."""
    docs = [(k % 2, k, [f"{k}.{i}" for i in range(7 + k % 5)]) for k in range(24)]
    df = spark.createDataFrame(docs, "shard long, order_key long, tokens array<string>")
    (tmp_path / "in").mkdir()

    def run():
        s = packer.packed(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), 9)
        s.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()

    df.where("order_key < 11").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run()
    first = spark.read.parquet(f"{tmp_path}/out").count()
    df.where("order_key >= 11").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run()
    got = {(r["shard"], r["window_id"]): (r["tokens"], list(r["positions"])) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert 0 < first < len(got)
    for shard in (0, 1):
        want = packing.concat_and_chunk(df.where(F.col("shard") == shard), "tokens", "order_key", 9).collect()
        assert {r["window_id"]: (r["tokens"], list(r["positions"])) for r in want} == {w: x for (s, w), x in got.items() if s == shard}


def test_lines_of_one_file_over_many_tasks(spark, tmp_path):
    """Blocks of 200 bytes give the same lines and numbers as one read; any line is found by its number."""
    lines = [json.dumps({"text": f"é{i} " + "w" * (i % 40)}) for i in range(300)]
    lines[7], lines[120] = "  ", "not json"
    (tmp_path / "bucket_0003.jsonl").write_text("\n".join(lines) + "\n", encoding="utf-8")
    want = [(3, n, json.loads(x)["text"] if x.startswith("{") else None) for n, x in enumerate(x for x in lines if x.strip())]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "200b")
        df = readers.bucket_lines(spark, str(tmp_path))
        assert sorted(tuple(r) for r in df.select("cluster_id", "line_no", "text").collect()) == want
        asked = spark.createDataFrame([(3, 250, "x"), (3, 0, "y"), (3, 999, "z"), (4, 0, "z")], "cluster_id long, line_no long, tag string")
        got = {(r["cluster_id"], r["line_no"]): r["text"] for r in readers.line_at(spark, str(tmp_path), asked).collect()}
        assert got == {(3, 250): want[250][2], (3, 0): want[0][2], (3, 999): None, (4, 0): None}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_registries_are_joined():
    d = readers.Dataset("p", lambda spark, path: None, lambda df: None)
    assert set(readers.union({"a": d}, {"b": d})) == {"a", "b"}
    with pytest.raises(ValueError, match="two registries: .'a'"):
        readers.union({"a": d}, {"a": d})


def test_times_are_formatted(spark):
    got = spark.sql("SELECT TIMESTAMP '2024-03-05 16:07:09' AS t").select(T.strftime(F.col("t"), "100%% on %A %d %B %Y at %I:%M %p, day %j"), T.strftime(None, "%Y")).first()
    assert got[0] == "100% on Tuesday 05 March 2024 at 04:07 PM, day 065" and int(got[1]) >= 2024
    with pytest.raises(ValueError, match="%Q"):
        T.strftime(None, "%Q")
