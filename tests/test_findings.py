"""What the findings of a round were about, on small tables."""

import __spark_entry__ as entry
import duckdb
import pyarrow as pa
from pyspark.sql import functions as F

from millrace.functions import tokenizer
from millrace.operators import packing, vocabulary
from millrace.sources import readers, sinks
from millrace.streaming import packer


def test_bucket_files_are_in_order_of_keys(spark, tmp_path):
    """Rows come to the writer's task from many tasks, and in no order."""
    d = spark.range(0, 4000, 1, 16).select((F.col("id") * 7 % 4000).alias("doc_id"), (F.col("id") * 7 % 4000 % 3).alias("cluster_id")).withColumn("text", F.concat(F.lit("t"), F.col("doc_id").cast("string")))
    sinks.write_bucket_files(d.repartition(9), "doc_id", str(tmp_path))
    got = [(r["cluster_id"], r["line_no"], r["text"]) for r in readers.bucket_lines(spark, str(tmp_path)).collect()]
    assert sorted(got) == [(c, i, f"t{k}") for c in range(3) for i, k in enumerate(range(c, 4000, 3))]


def test_token_payloads_multiply_as_floats(spark, tmp_path):
    """0.29 * 100 is 29 in 32 bits, and less than 29 in 64."""
    rows = [(i, [0.29, -0.57, 0.58, 1.13] * 16, i % 2) for i in range(6)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = {r[0]: r[1:] for r in db.execute("SELECT cluster_id, n_tokens, n_bytes, checksum FROM (" + entry.oracle_sql()["token_payloads"] + ")").fetchall()}
    assert {r["cluster_id"]: (r["n_tokens"], r["n_bytes"], r["checksum"]) for r in entry.queries()["token_payloads"](spark, str(tmp_path)).collect()} == want


def test_library_gets_a_bounded_run_of_texts(spark):
    """A call of the library takes a run of a batch; what comes back is each text's, in order, nulls and longer texts too."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    model = Tokenizer(models.WordLevel({"a": 0, "b": 1, "?": 2}, unk_token="?"))
    model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    texts = ["a b", None, "", "b " * tokenizer.CALL, *["a c b"] * 60000]
    runs = list(tokenizer._calls(pa.array(texts), ""))
    assert [x for r in runs for x in r] == [t or "" for t in texts]
    assert all(len(r) == 1 or sum(map(len, r)) <= tokenizer.CALL for r in runs) and len(runs) > 4
    t = tokenizer.Described(model)
    d = spark.createDataFrame(list(enumerate(texts)), "i int, text string").coalesce(1)
    ids = d.select("i", t.encode(F.col("text")).alias("ids"))
    got = {r["i"]: (r["ids"], r["back"]) for r in ids.select("i", "ids", t.decode(F.col("ids")).alias("back")).collect()}
    assert got == {i: (model.encode(x or "").ids, model.decode(model.encode(x or "").ids)) for i, x in enumerate(texts)}


def test_window_reads_are_not_broadcast(spark):
    """Reads exploded from one row look as small as that row to the planner."""
    docs = spark.range(0, 2000).select(F.lit(1).cast("bigint").alias("cluster_id"), F.col("id").alias("doc_id"), F.array_repeat(F.col("id").cast("string"), 13).alias("w"))
    draws = spark.range(1).select(F.lit(1).cast("bigint").alias("cluster_id"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(399).cast("bigint"))).alias("c")).withColumn("offset", F.col("c") * 65)
    out = packing.window_reads(docs, "doc_id", "w", draws, 64, F.lit("0"))
    got = {r["c"]: r["window"] for r in out.collect()}
    assert got == {c: [str(i // 13) for i in range(c * 65, c * 65 + 65)] for c in range(400)}
    plan = out._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
    assert plan.count("SortMergeJoin") >= 2
    for part in plan.split("BroadcastExchange")[1:]:
        assert "Generate" not in part.split("ShuffleQueryStage")[0]


def test_windows_from_texts_and_from_lengths(spark):
    """Windows within a document, over several and of null, equal and sparse keys; texts are sent as they are, and lengths alone give the same positions."""
    keys = [None, -(1 << 62), 3, 3, 3, 4, 70000, 1 << 40, 1 << 62]
    docs = [(k, " ".join(f"{i}.{j}" for j in range(n))) for i, (k, n) in enumerate(zip(keys, [4, 33, 0, 7, 21, 1, 1, 40, 10], strict=True))]
    d = spark.createDataFrame(docs, "k bigint, text string").repartition(3)
    t = F.filter(F.split("text", " "), lambda x: x != "")
    got = {r["window_id"]: r for r in packing.concat_and_chunk(d, t, "k", 9).collect()}
    stream = [(i, j) for i, (_, text) in enumerate(docs) for j in range(len(text.split()))]
    assert len(stream) == 117 and set(got) == set(range(11))
    for w, r in got.items():
        part = stream[w * 10 : w * 10 + 10]
        begins = {i: min(j for x, j in part if x == i) for i, _ in part}
        assert r["tokens"] == [f"{i}.{j}" for i, j in part] and r["positions"] == [j - begins[i] for i, j in part] and r["n_docs"] == len(begins)
    lengths = packing.chunk_positions(d, F.size(t), "k", 9)
    assert {r["window_id"]: (r["positions"], r["n_docs"]) for r in lengths.collect()} == {w: (r["positions"], r["n_docs"]) for w, r in got.items()}
    plan = packing.concat_and_chunk(d, t, "k", 9)._jdf.queryExecution().executedPlan().toString()
    # A document's text meets its place once, and only slices at its ends are dealt to windows.
    assert plan.count("hashpartitioning(window_id") == 1 and plan.count("Union") == 1


def test_stream_is_fed_in_order_and_bounded_parts(spark, tmp_path):
    """Files hold a range of keys and a bounded number of bytes, and triggers take a few of them, in order of keys."""
    d = spark.range(0, 300).select((F.col("id") * 7 % 300).alias("k"), F.repeat(F.lit("ab "), (F.col("id") % 5 * 10).cast("int")).alias("text")).repartition(6)
    packer.feed(d, "k", "text", str(tmp_path / "feed"), 500)
    rows = spark.read.parquet(str(tmp_path / "feed")).groupBy("file").agg(F.min("k").alias("low"), F.max("k").alias("high"), F.sum(F.octet_length("text")).alias("n")).orderBy("file").collect()
    assert len(rows) > 20 and all(r["n"] <= 500 + 120 for r in rows) and all(a["high"] < b["low"] for a, b in zip(rows, rows[1:], strict=False))
    fed = packer.fed(spark, str(tmp_path / "feed"), d.schema).select((F.col("k") % 2).alias("shard"), F.col("k").alias("order_key"), F.split(F.trim("text"), " ").alias("tokens"))
    q = packer.packed(fed, 9).writeStream.format("memory").queryName("packed_feed").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert len([p for p in q.recentProgress if p["numInputRows"]]) >= 3
    for shard in (0, 1):
        want = packing.concat_and_chunk(d.where(F.col("k") % 2 == shard), F.split(F.trim("text"), " "), "k", 9).collect()
        got = spark.table("packed_feed").where(F.col("shard") == shard).collect()
        assert {(r["window_id"], tuple(r["tokens"]), tuple(r["positions"])) for r in got} == {(r["window_id"], tuple(r["tokens"]), tuple(r["positions"])) for r in want}


def test_frequent_and_rare_words_get_their_ids(spark, tmp_path):
    """Ids are the same however many words tasks look up by themselves; long words, empty lists and empty tables too."""
    texts = ["b a b", "", "c " + "z" * 100 + " a", "é b b", "d"]
    docs = [(i, t.split()) for i, t in enumerate(texts)]
    words = sorted({w for _, ws in docs for w in ws})
    want = {i: [words.index(w) for w in ws] for i, ws in docs}
    d = spark.createDataFrame(docs, "doc_id bigint, w array<string>")
    for frequent in (0, 2, 100):
        rows = vocabulary.ids(d, "doc_id", "w", frequent).collect()
        assert {r["doc_id"]: r["ids"] for r in rows} == want and {r["vocab_size"] for r in rows} == {len(words)}
    assert vocabulary.ids(d.where("doc_id < 0"), "doc_id", "w").collect() == []
