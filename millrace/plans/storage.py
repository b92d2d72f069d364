"""Round trips through sinks and readers, and look-ups that are joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import arrays as A
from millrace.functions import text as T
from millrace.functions.hashing import uniform
from millrace.functions.tokenizer import Described, dual
from millrace.operators import filters, metrics
from millrace.plans.book import WORDS_SQL, Book, table, uniform_sql
from millrace.sources import readers, scratch, sinks

BOOK = Book()
add = BOOK.add
W = WORDS_SQL


@add("SELECT md5(html) AS text_md5, url FROM pages")
def json_lines_round_trip(spark, sf):
    """Slim lines written and read again by a registered reader."""
    path = scratch.new_path(spark, "slim")
    sinks.slim_json(table(spark, sf, "pages").select(F.col("html").alias("text"), "url"), path, keep_url=True)
    readers.register("written_pages", readers.Dataset(path, readers.json_table, lambda df: F.md5(df["text"])))
    return readers.samples(spark, "written_pages", schema="text string, url string").select(F.col("sample").alias("text_md5"), "url")


@add("SELECT substr(source, 4)::BIGINT AS cluster_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS line_no, doc_id, md5(text) AS text_md5 FROM documents")
def bucket_round_trip(spark, sf):
    """Buckets keyed by assignment, with numbered lines and metadata."""
    path = scratch.new_path(spark, "buckets")
    d = table(spark, sf, "documents").withColumn("cluster_id", F.substring("source", 4, 9).cast("bigint"))
    meta = sinks.write_buckets(d.select("doc_id", "cluster_id", "text"), path, "doc_id")
    if readers.is_token_format(meta):
        raise ValueError("text buckets are no token files")
    out = readers.buckets(spark, path, sum(n > 0 for n in meta["cluster_sizes"]))
    return out.select(F.col("cluster_id").cast("bigint").alias("cluster_id"), "line_no", "doc_id", F.md5("text").alias("text_md5"))


@add("""WITH e AS (SELECT label::BIGINT AS cluster_id, unnest(embedding) AS x, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) * 64 + unnest(range(0, 64)) AS i FROM embeddings)
SELECT cluster_id, count(*)::BIGINT AS n_tokens, count(*)::BIGINT * 4 AS n_bytes, sum(trunc(x * 100::FLOAT)::BIGINT * (i % 1009 + 1))::BIGINT AS checksum FROM e GROUP BY 1""")
def token_payloads(spark, sf):
    """Each cluster's token stream as parts of 32-bit payloads, whose size gives the count; contents by a checksum over places."""
    path = scratch.new_path(spark, "tokens")
    e = table(spark, sf, "embeddings").select(F.col("label").cast("bigint").alias("cluster_id"), "vec_id", F.transform("embedding", lambda x: (x * F.lit(100.0).cast("float")).cast("int")).alias("tokens"))
    sinks.write_token_parts(e, "vec_id", path)
    p = readers.token_parts(spark, path)
    return p.groupBy("cluster_id").agg(F.sum("n_tokens").alias("n_tokens"), F.sum(F.octet_length("payload")).cast("bigint").alias("n_bytes"), F.sum(F.aggregate(F.zip_with("tokens", F.sequence(F.col("first"), F.col("first") + F.col("n_tokens") - 1), lambda t, i: t.cast("bigint") * (i % 1009 + 1)), F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("checksum"))


@add("SELECT item_id % 4 AS shard, lpad(item_id::VARCHAR, 9, '0') AS key, text AS txt, '{\"n\":' || length(text) || '}' AS json FROM benchmark")
def tar_round_trip(spark, sf):
    """Members grouped by key in tar shards, and read again."""
    b = table(spark, sf, "benchmark")
    d = b.select((F.col("item_id") % 4).alias("shard"), T.padded(F.col("item_id"), 9).alias("key"), F.col("text").alias("txt"), F.lit(None).cast("binary").alias("jpg"), F.concat(F.lit('{"n":'), F.length("text").cast("string"), F.lit("}")).alias("json"))
    tars = sinks.tar_rows(d, "shard").select("shard", F.col("tar").alias("content"))
    return readers.opened_tars(tars, "shard").select("shard", "key", "txt", "json")


@add("SELECT dayofyear(ts)::BIGINT AS step, round(avg(value), 6) AS loss FROM events GROUP BY 1")
def loss_file_round_trip(spark, sf):
    """Losses in order of steps, at full precision."""
    path = scratch.new_path(spark, "losses")
    d = table(spark, sf, "events").groupBy(F.dayofyear("ts").cast("bigint").alias("step")).agg(F.avg("value").alias("loss"))
    sinks.write_losses(d, path)
    return readers.losses(spark, path).select("step", F.round("loss", 6).alias("loss"))


@add("WITH m AS (SELECT dayofyear(ts)::BIGINT AS step, avg(value) AS loss FROM events GROUP BY 1) SELECT 'step ' || step || ': ' || round(loss, 3) AS line FROM m WHERE step % 7 = 0")
def report_lines(spark, sf):
    """A report, appended line by line; a sink that keeps nothing."""
    path = scratch.new_path(spark, "report")
    m = table(spark, sf, "events").groupBy(F.dayofyear("ts").cast("bigint").alias("step")).agg(F.avg("value").alias("loss")).where("step % 7 = 0")
    lines = m.select(F.concat(F.lit("step "), F.col("step").cast("string"), F.lit(": "), F.round("loss", 3).cast("string")).alias("line"))
    sinks.write_report(lines, path)
    lines.write.format("noop").mode("overwrite").save()
    return spark.read.text(path).withColumnRenamed("value", "line")


@add(f"SELECT doc_id FROM documents WHERE len({W}) <= 300 AND substr(source, 4)::INT NOT IN (3, 7)")
def excluded_clusters(spark, sf):
    """Over-long samples go, and so do those of dead clusters, by an anti-join."""
    d = table(spark, sf, "documents").where(T.token_count(F.col("text")) <= 300).withColumn("cluster_id", F.substring("source", 4, 9).cast("int"))
    dead = spark.createDataFrame([(3,), (7,)], "cluster_id int")
    return d.join(dead, "cluster_id", "left_anti").select("doc_id")


@add("SELECT doc_id % 3 AS rank, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS ids FROM documents GROUP BY 1")
def ordered_concatenation(spark, sf):
    """Parts joined end to end in order of an explicit key."""
    d = table(spark, sf, "documents").select("doc_id", (F.col("doc_id") % 3).alias("rank"))
    parts = d.where("doc_id % 2 = 0").unionByName(d.where("doc_id % 2 = 1"))
    held = parts.groupBy("rank").agg(F.array_sort(F.collect_list("doc_id")).alias("i"))
    return held.select("rank", F.array_join(F.transform("i", lambda x: x.cast("string")), ",").alias("ids"))


@add("SELECT * FROM (VALUES ('batch_size'), ('seq_len')) t(unknown)")
def unknown_settings(spark, sf):
    """Settings that are given but not known."""
    given = spark.createDataFrame([(x,) for x in ("batch_size", "path", "seq_len", "seed")], "unknown string")
    return given.subtract(spark.createDataFrame([("path",), ("seed",), ("infinite",)], "unknown string"))


@add("SELECT w AS world, p AS stages, CASE WHEN p = 1 THEN 0 ELSE w // p * (p - 1) END AS metric_rank FROM (SELECT unnest([8, 16])::BIGINT AS w), (SELECT unnest([1, 2, 4])::BIGINT AS p)")
def metric_rank(spark, sf):
    """P25: the first rank of the last stage logs; without stages, rank 0."""
    d = spark.createDataFrame([(w, p) for w in (8, 16) for p in (1, 2, 4)], "world long, stages long")
    return d.select("world", "stages", metrics.metric_rank(F.col("world"), F.col("stages")).alias("metric_rank"))


@add(f"SELECT doc_id, array_to_string(list_concat({W}, ['0' FOR i IN range(0, 12)])[1:12], ' ') AS first, array_to_string(list_concat({W}, ['0' FOR i IN range(0, 20)])[1:20], ' ') AS second FROM documents")
def dual_encoders(spark, sf):
    """two encoders' tokens, each clipped or padded to its own length."""
    w = T.words(F.col("text"))
    d = table(spark, sf, "documents").select("doc_id", dual(A.fitted(w, 12, F.lit("0")), A.fitted(w, 20, F.lit("0"))).alias("d"))
    return d.select("doc_id", F.array_join("d.clip", " ").alias("first"), F.array_join("d.t5", " ").alias("second"))


@add(f"""WITH t AS (SELECT doc_id, {W} AS w, doc_id % 3 + 3 AS n FROM documents)
SELECT doc_id, '<v>' || repeat('<i>', (doc_id % 3 + 1)::INT) || '</v>' || coalesce(array_to_string(w, ' '), '') || '</s>' AS sample, n + len(w) + 1 AS n_tokens, n + 1 AS n_masked FROM t""")
def multimodal_samples(spark, sf):
    """A picture's placeholder and a text as one sample, split to pieces, with marks masked in the labels."""
    texts, _ = filters.interleaved(F.array_join(T.words(F.col("text")), " "), F.lit("img"))
    s = T.placeholders(texts, F.array(F.col("doc_id") % 3 + 1), "<v>", "<i>", "</v>", "</s>")
    d = table(spark, sf, "documents").select("doc_id", s.alias("sample"))
    # Marks are pieces of their own; between them, words are.
    pieces = F.filter(F.split(F.regexp_replace("sample", r"(</?v>|<i>|</s>)", " $1 "), " +"), lambda x: x != "")
    masked = A.member_mask(pieces, ["<v>", "<i>", "</v>", "</s>"], F.lit("-100"))
    return d.select("doc_id", "sample", F.size(pieces).cast("bigint").alias("n_tokens"), F.size(F.filter(masked, lambda x: x == "-100")).cast("bigint").alias("n_masked"))


U = uniform_sql


@add(f"SELECT doc_id, round(sqrt(-2 * ln({U(7, 'doc_id')} + 1.0 / 9007199254740992)) * cos(2 * pi() * {U(8, 'doc_id')}), 9) AS noise, {U(9, 'doc_id')} AS t FROM documents")
def gaussian_noise(spark, sf):
    """Noise and a timestep per document, from digests of its id, so that they are the same for any partitioning."""
    k = F.col("doc_id")
    noise = F.sqrt(-2 * F.ln(uniform(7, k) + 1.0 / 9007199254740992)) * F.cos(2 * F.pi() * uniform(8, k))
    return table(spark, sf, "documents").select("doc_id", F.round(noise, 9).alias("noise"), uniform(9, k).alias("t"))


@add()
def library_tokens(spark, sf):
    """Ids from a library tokenizer and back; its file is that of public_tokenizers, and without it this raises."""
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Described(Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")))
    ids = table(spark, sf, "documents").select("doc_id", "text", t.encode(F.col("text")).alias("ids"))
    return ids.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), (t.decode(F.col("ids")) == F.col("text")).alias("same"))


CONFIG_SQL = """'{"bos_token": "<' || lang || '>", "eos_token": {"content": "</' || lang || '>", "lstrip": false}' || CASE WHEN doc_id % 2 = 0 THEN ', "pad_token": "<pad' || (doc_id % 5) || '>"' ELSE '' END || ', "model_max_length": 4096}'"""


@add("SELECT doc_id, '<' || lang || '>' AS bos, '</' || lang || '>' AS eos, CASE WHEN doc_id % 2 = 0 THEN '<pad' || (doc_id % 5) || '>' END AS pad, CASE WHEN doc_id % 2 = 0 THEN 3 ELSE 2 END::BIGINT AS n FROM documents")
def special_token_map(spark, sf):
    """special tokens of configurations, as strings or objects."""
    m = T.special_tokens(F.expr(CONFIG_SQL))
    d = table(spark, sf, "documents").select("doc_id", m.alias("m"))
    return d.select("doc_id", F.col("m")["bos_token"].alias("bos"), F.col("m")["eos_token"].alias("eos"), F.col("m")["pad_token"].alias("pad"), F.size("m").cast("bigint").alias("n"))


@add("SELECT event_id, strftime(ts, '%d %b %Y, %H:%M:%S') AS said FROM events")
def formatted_times(spark, sf):
    """F23."""
    return table(spark, sf, "events").select("event_id", T.strftime(F.col("ts"), "%d %b %Y, %H:%M:%S").alias("said"))


@add("SELECT substr(source, 4)::BIGINT AS cluster_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS line_no, md5(text) AS text_md5 FROM documents")
def bucket_file_lines(spark, sf):
    """Lines of bucket files, numbered over blocks that many tasks read."""
    path = scratch.new_path(spark, "lines")
    d = table(spark, sf, "documents").select(F.substring("source", 4, 9).cast("bigint").alias("cluster_id"), "doc_id", "text")
    # One file per cluster, as files are named by cluster; its lines are in order of doc_id.
    sinks.write_bucket_files(d, "doc_id", path)
    return readers.bucket_lines(spark, path).select("cluster_id", "line_no", F.md5("text").alias("text_md5"))


@add("SELECT min(doc_id)::BIGINT AS least, max(doc_id)::BIGINT AS most, count(DISTINCT source)::BIGINT AS sources FROM documents")
def settings_round_trip(spark, sf):
    """Resolved settings as one JSON file, and back."""
    d = table(spark, sf, "documents").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.countDistinct("source").alias("sources")).first()
    path = scratch.new_path(spark, "settings")
    sinks.write_settings(spark, {"data": {"ids": [d["least"], d["most"]]}, "sources": d["sources"]}, path)
    return spark.read.schema("data struct<ids:array<bigint>>, sources bigint").json(path, multiLine=True).select(F.col("data.ids")[0].alias("least"), F.col("data.ids")[1].alias("most"), "sources")
