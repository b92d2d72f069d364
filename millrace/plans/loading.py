"""Loaders: epochs, state, resumption, and streams that carry state."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import sampling, weighting
from millrace.plans.book import WORDS_SQL, Book, digest_sql, table
from millrace.plans.clusters import BATCH, DRAW_SQL, DRAWS
from millrace.sources import scratch
from millrace.streaming import events, loaders, packer

BOOK = Book()
add = BOOK.add
W = WORDS_SQL


@add("SELECT e AS epoch, doc_id, row_number() OVER (PARTITION BY e ORDER BY doc_id) - 1 AS place FROM documents, range(0, 3) r(e)")
def text_epochs(spark, sf):
    """The same order in each pass."""
    return loaders.epochs(table(spark, sf, "documents").select("doc_id"), 3, "doc_id", False).select("epoch", "doc_id", "place")


@add(f"WITH e AS (SELECT 0::BIGINT AS epoch, doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS place FROM documents UNION ALL SELECT 1, doc_id, row_number() OVER (ORDER BY {digest_sql(43, 'doc_id')}, doc_id) - 1 FROM documents) SELECT * FROM e WHERE epoch > 0 OR place >= 70")
def resumed_epochs(spark, sf):
    """What is left of two passes after 70 rows of the first."""
    rows = loaders.epochs(table(spark, sf, "documents").select("doc_id"), 2, "doc_id", True)
    return loaders.remaining(rows, 0, 70).select("epoch", "doc_id", "place")


def _weights(spark, sf):
    d = table(spark, sf, "documents").withColumn("cluster_id", F.substring("source", 4, 9).cast("bigint"))
    return sampling.proportional(weighting.dense_counts(spark, d, "cluster_id"))


@add(DRAW_SQL + "SELECT 100::BIGINT AS step, s.cluster_id, count(c.draw)::BIGINT AS cursor, round(any_value(s.n) / (SELECT sum(n) FROM s), 6) AS weight FROM s LEFT JOIN c ON c.cluster_id = s.cluster_id AND c.step < 100 GROUP BY s.cluster_id")
def loader_state(spark, sf):
    """Cursors and weights before step 100."""
    w = _weights(spark, sf)
    out = loaders.state_of(sampling.draw(spark, w, DRAWS, 11, BATCH), w, 100)
    return out.select("step", "cluster_id", "cursor", F.round("weight", 6).alias("weight"))


@add(DRAW_SQL + "SELECT draw, cluster_id, cursor FROM c WHERE step >= 100")
def resumed_draws(spark, sf):
    """A run that goes on from the state of step 100 draws what an unbroken one draws."""
    w = _weights(spark, sf)
    state = loaders.state_of(sampling.draw(spark, w, 100 * BATCH, 11, BATCH), w, 100)
    return loaders.resumed_draws(spark, state, DRAWS - 100 * BATCH, 11, BATCH).select("draw", "cluster_id", "cursor")


@add(DRAW_SQL + f"SELECT step, count(*)::BIGINT AS n FROM c GROUP BY step HAVING count(*) = {BATCH}")
def exhausted_step(spark, sf):
    """An incomplete last step is dropped as a whole."""
    return loaders.full_steps(sampling.draw(spark, _weights(spark, sf), DRAWS, 11, BATCH), BATCH).groupBy("step").agg(F.count(F.lit(1)).alias("n"))


@add("SELECT s AS step FROM range(1, 98) r(s) WHERE s % 20 = 0 OR s = 97 OR s = 1")
def checkpoint_steps(spark, sf):
    """T12."""
    return loaders.saves(spark.range(1, 98).withColumnRenamed("id", "step"), "step", 20, 97, True)


STREAM_SQL = f"""
WITH d AS (SELECT doc_id % 4 AS shard, doc_id, list_concat(list_concat(['<s>'], {W}), ['</s>']) AS t FROM documents),
o AS (SELECT shard, t, coalesce(sum(len(t)) OVER (PARTITION BY shard ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS base FROM d),
k AS (SELECT shard, (base + i - 1) // 257 AS window_id, (base + i - 1) % 257 AS slot, t[i] AS tok FROM (SELECT *, unnest(range(1, len(t) + 1)) AS i FROM o))
SELECT shard, window_id, md5(string_agg(tok, ' ' ORDER BY slot)) AS tokens_md5 FROM k GROUP BY ALL HAVING count(*) = 257"""


@add(STREAM_SQL)
def stream_packing(spark, sf):
    """G1, T4 as a stream with carried state; tested against the batch packer and over a restart too."""
    provider = "spark.sql.streaming.stateStore.providerClass"
    docs = table(spark, sf, "documents").select("doc_id", "text")
    feed = scratch.new_path(spark, "feed")
    packer.feed(docs, "doc_id", "text", feed)
    fed = packer.fed(spark, feed, docs.schema).select((F.col("doc_id") % 4).alias("shard"), F.col("doc_id").alias("order_key"), T.encode(F.col("text")).alias("tokens"))
    out, partitions = scratch.new_path(spark, "packed"), "spark.sql.shuffle.partitions"
    before = {k: spark.conf.get(k) for k in (provider, partitions)}
    try:
        spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        # Each trigger opens a state store per partition, and there are four shards.
        spark.conf.set(partitions, "8")
        q = packer.packed(fed, 256).writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    rows = spark.read.schema(packer.OUTPUT).parquet(f"{out}/rows")
    return rows.select("shard", "window_id", F.md5(F.array_join("tokens", " ")).alias("tokens_md5"))


@add("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, sf):
    """An extension: windows of event time."""
    return events.windowed(table(spark, sf, "events")).select("start", "event_type", "n", F.round("total", 4).alias("total"))


@add("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*)::BIGINT AS n FROM s GROUP BY user_id, k""")
def event_sessions(spark, sf):
    """An extension: sessions by gap."""
    return events.sessions(table(spark, sf, "events")).select("user_id", "start", "n")
