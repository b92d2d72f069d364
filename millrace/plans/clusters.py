"""Clusters: sizes and weights, draws with cursors, window reads, sketches and re-weighting."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions import arrays as A
from millrace.functions import text as T
from millrace.functions.hashing import uniform
from millrace.operators import packing, sampling, weighting
from millrace.plans.book import WORDS_SQL, Book, digest_sql, table, uniform_sql

BOOK = Book()
add = BOOK.add
W = WORDS_SQL
#: A document's cluster: its source's number.
CLUSTER_SQL = "substr(source, 4)::BIGINT"
DRAWS, BATCH, WORLD = 3000, 16, 4


def _docs(spark, sf):
    return table(spark, sf, "documents").withColumn("cluster_id", F.substring("source", 4, 9).cast("bigint"))


@add(f"SELECT k AS cluster_id, count(doc_id)::BIGINT AS n FROM range(0, (SELECT max({CLUSTER_SQL}) + 1 FROM documents)) r(k) LEFT JOIN (SELECT doc_id, {CLUSTER_SQL} AS c FROM documents WHERE doc_id % 7 <> 3 AND {CLUSTER_SQL} <> 4) ON c = k GROUP BY k")
def cluster_sizes(spark, sf):
    """A1, K2, DEC2: a dense domain in which empty clusters count 0."""
    d = _docs(spark, sf)
    return weighting.dense_counts(spark, d.where("doc_id % 7 <> 3 AND cluster_id <> 4"), "cluster_id", k=d.agg(F.max("cluster_id")).first()[0] + 1)


@add(f"SELECT {CLUSTER_SQL} AS cluster_id, sum(len({W}))::BIGINT AS n, (sum(len({W})) * 4 // 4)::BIGINT AS from_bytes FROM documents GROUP BY 1")
def cluster_token_counts(spark, sf):
    """A2, A3: token counts, and the same from the size of 4-byte ids."""
    n = weighting.dense_counts(spark, _docs(spark, sf), "cluster_id", T.token_count(F.col("text")))
    return n.select("cluster_id", "n", F.floor(F.col("n") * 4 / 4).alias("from_bytes"))


@add(f"SELECT {CLUSTER_SQL} AS cluster_id, round(count(*) / sum(count(*)) OVER (), 6) AS weight FROM documents GROUP BY 1")
def cluster_weights_size(spark, sf):
    """A4, C13."""
    return sampling.proportional(weighting.dense_counts(spark, _docs(spark, sf), "cluster_id")).select("cluster_id", F.round("weight", 6).alias("weight"))


@add(f"SELECT {CLUSTER_SQL} AS cluster_id, round(sum(len({W})) / sum(sum(len({W}))) OVER (), 6) AS weight FROM documents GROUP BY 1")
def cluster_weights_token(spark, sf):
    """A5."""
    n = weighting.dense_counts(spark, _docs(spark, sf), "cluster_id", T.token_count(F.col("text")))
    return sampling.proportional(n).select("cluster_id", F.round("weight", 6).alias("weight"))


@add("SELECT k AS cluster_id, round(CASE WHEN k < 10 THEN k / 45.0 ELSE 0.0 END, 6)::DOUBLE AS weight, 0.05::DOUBLE AS even FROM range(0, 20) r(k)")
def weights_renormalised(spark, sf):
    """A vector without weight becomes even over all."""
    w = spark.range(20).select(F.col("id").alias("cluster_id"), F.when(F.col("id") < 10, F.col("id") * 1.0).otherwise(0.0).alias("weight"))
    zero = sampling.renormalised(w.withColumn("weight", F.lit(0.0))).select("cluster_id", F.col("weight").alias("even"))
    return sampling.renormalised(w).join(zero, "cluster_id").select("cluster_id", F.round("weight", 6).alias("weight"), "even")


@add(f"SELECT doc_id, (row_number() OVER (ORDER BY {digest_sql(42, 'doc_id')}, doc_id) - 1) % 7 AS cluster_id FROM documents")
def random_balanced_assign(spark, sf):
    """R7, C5."""
    return sampling.balanced(table(spark, sf, "documents").select("doc_id"), 7, 42, "doc_id")


@add(f"SELECT doc_id, floor({uniform_sql(42, 'doc_id')} * 7)::BIGINT AS cluster_id FROM documents")
def random_iid_assign(spark, sf):
    """R8."""
    return sampling.independent(table(spark, sf, "documents").select("doc_id"), 7, 42, "doc_id")


@add(f"SELECT doc_id, source, floor({uniform_sql(9, 'doc_id')} * n_chars)::BIGINT AS line, {uniform_sql(1, 'doc_id')} < 0.447 AS drop_a, {uniform_sql(2, 'doc_id')} < 0.447 AS drop_b, floor({uniform_sql(3, 'doc_id')} * (n_chars % 300 + 1))::BIGINT AS crop FROM documents")
def uniform_draws(spark, sf):
    """A line, two independent drop-outs, a crop's offset."""
    k = F.col("doc_id")
    return table(spark, sf, "documents").select("doc_id", "source", F.floor(uniform(9, k) * F.col("n_chars")).alias("line"), (uniform(1, k) < 0.447).alias("drop_a"), (uniform(2, k) < 0.447).alias("drop_b"), F.floor(uniform(3, k) * (F.col("n_chars") % 300 + 1)).alias("crop"))


DRAW_SQL = f"""
WITH s AS (SELECT {CLUSTER_SQL} AS cluster_id, count(*) AS n FROM documents GROUP BY 1),
e AS (SELECT cluster_id, sum(n::DOUBLE / (SELECT sum(n) FROM s)) OVER (ORDER BY cluster_id) AS hi FROM s),
i AS (SELECT cluster_id, coalesce(lag(hi) OVER (ORDER BY cluster_id), 0) AS lo, CASE WHEN lead(hi) OVER (ORDER BY cluster_id) IS NULL THEN 2 ELSE hi END AS hi FROM e),
u AS (SELECT d AS draw, d // {BATCH} AS step, d % {BATCH} AS i, {uniform_sql(11, 'd')} AS u FROM range(0, {DRAWS}) r(d)),
c AS (SELECT draw, step, u.i, cluster_id, row_number() OVER (PARTITION BY cluster_id ORDER BY draw) - 1 AS cursor, row_number() OVER (PARTITION BY step, cluster_id ORDER BY draw) - 1 AS off_step FROM u JOIN i ON u.u >= i.lo AND u.u < i.hi)
"""


def _weights(spark, sf):
    return sampling.proportional(weighting.dense_counts(spark, _docs(spark, sf), "cluster_id"))


def _draws(spark, sf):
    return sampling.with_cursors(sampling.draw(spark, _weights(spark, sf), DRAWS, 11, BATCH))


@add(DRAW_SQL + "SELECT draw, step, i, cluster_id FROM c")
def weighted_draw(spark, sf):
    """R1."""
    return sampling.draw(spark, _weights(spark, sf), DRAWS, 11, BATCH)


@add(DRAW_SQL + "SELECT step, cluster_id, count(*)::BIGINT AS n FROM c GROUP BY step, cluster_id")
def draw_histogram(spark, sf):
    """A7."""
    return sampling.draw(spark, _weights(spark, sf), DRAWS, 11, BATCH).groupBy("step", "cluster_id").agg(F.count(F.lit(1)).alias("n"))


@add(DRAW_SQL + "SELECT draw, step, cluster_id, cursor, off_step AS offset_in_step, draw % 4 AS rank FROM c")
def draw_cursors(spark, sf):
    """W4, W5, H2, H3."""
    return _draws(spark, sf).select("draw", "step", "cluster_id", "cursor", F.col("offset").alias("offset_in_step"), (F.col("draw") % WORLD).alias("rank"))


@add(DRAW_SQL + f"""
, l AS (SELECT {CLUSTER_SQL} AS cluster_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS line_no, doc_id, text FROM documents)
SELECT c.draw, c.cluster_id, l.line_no, l.doc_id, len({W.replace('text', 'l.text')})::BIGINT AS n_tokens FROM c JOIN s USING (cluster_id) LEFT JOIN l ON l.cluster_id = c.cluster_id AND l.line_no = c.cursor % s.n""")
def assigned_lines(spark, sf):
    """Lines by cursor modulo the cluster's size; no line is drawn twice before its cluster wraps."""
    lines = sampling.numbered_lines(_docs(spark, sf), "cluster_id", "doc_id").select("cluster_id", "line_no", "doc_id", T.token_count(F.col("text")).alias("n_tokens"))
    out = sampling.with_lines(_draws(spark, sf), lines, weighting.dense_counts(spark, _docs(spark, sf), "cluster_id"))
    return out.select("draw", "cluster_id", "line_no", "doc_id", "n_tokens")


@add(DRAW_SQL + f"""
, l AS (SELECT {CLUSTER_SQL} AS cluster_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS line_no, list_concat(list_concat(['<s>'], {W}), ['</s>']) AS t FROM documents),
b AS (SELECT c.step, c.draw % 4 AS rank, c.i // 4 AS row, list_concat(t[1:17], ['</s>' FOR x IN range(0, greatest(17 - len(t), 0))]) AS w FROM c JOIN s USING (cluster_id) JOIN l ON l.cluster_id = c.cluster_id AND l.line_no = c.cursor % s.n)
SELECT step, rank, row, array_to_string(w[1:16], ' ') AS inputs, array_to_string(w[2:17], ' ') AS labels FROM b""")
def rank_batches(spark, sf):
    """One document per window, clipped or filled up with EOS (unmasked), dealt to ranks by draw."""
    lines = sampling.numbered_lines(_docs(spark, sf), "cluster_id", "doc_id").select("cluster_id", "line_no", T.encode(F.col("text")).alias("t"))
    read = sampling.with_lines(_draws(spark, sf), lines, weighting.dense_counts(spark, _docs(spark, sf), "cluster_id"))
    w = F.when(F.size("t") >= 2, A.fitted(F.col("t"), 17, F.lit(T.EOS))).otherwise(F.array_repeat(F.lit("0"), 17))
    inputs, labels = A.shifted(F.col("w"))
    return read.withColumn("w", w).select("step", (F.col("draw") % WORLD).alias("rank"), F.floor(F.col("i") / WORLD).alias("row"), F.array_join(inputs, " ").alias("inputs"), F.array_join(labels, " ").alias("labels"))


@add(DRAW_SQL + f"""
, l AS (SELECT {CLUSTER_SQL} AS cluster_id, doc_id, list_concat(list_concat(['<s>'], {W}), ['</s>']) AS t FROM documents),
k AS (SELECT c.draw, l.doc_id, l.t FROM c JOIN s USING (cluster_id) JOIN (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY doc_id) - 1 AS line_no FROM l) l ON l.cluster_id = c.cluster_id AND l.line_no = c.cursor % s.n),
o AS (SELECT draw, t, coalesce(sum(len(t)) OVER (ORDER BY draw ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS base FROM k),
p AS (SELECT (base + i - 1) // 129 AS window_id, (base + i - 1) % 129 AS slot, t[i] AS tok FROM (SELECT base, t, unnest(range(1, len(t) + 1)) AS i FROM o))
SELECT window_id, md5(string_agg(tok, ' ' ORDER BY slot)) AS tokens_md5 FROM p GROUP BY window_id HAVING count(*) = 129""")
def pack_weighted_stream(spark, sf):
    """Drawn lines, in the order of draws, packed end to end."""
    lines = sampling.numbered_lines(_docs(spark, sf), "cluster_id", "doc_id").select("cluster_id", "line_no", T.encode(F.col("text")).alias("t"))
    read = sampling.with_lines(_draws(spark, sf), lines, weighting.dense_counts(spark, _docs(spark, sf), "cluster_id"))
    return packing.concat_and_chunk(read.where(F.col("t").isNotNull()), "t", "draw", 128).select("window_id", F.md5(F.array_join("tokens", " ")).alias("tokens_md5"))


BIN_SQL = f"WITH b AS (SELECT {CLUSTER_SQL} AS cluster_id, flatten(list({W} ORDER BY doc_id)) AS t FROM documents GROUP BY 1)"


def _bin_docs(spark, sf):
    """Documents whose words make each cluster's stream."""
    return _docs(spark, sf).select("cluster_id", "doc_id", T.words(F.col("text")).alias("w"))


@add(BIN_SQL + """
, r AS (SELECT cluster_id, t, len(t) AS n, unnest(range(0, (len(t) + 64) // 65)) AS c FROM b WHERE len(t) > 0)
SELECT cluster_id, c AS cursor, array_to_string([t[(CASE WHEN n < 65 THEN x ELSE c * 65 + x END) % n + 1] FOR x IN range(0, 65)], ' ') AS tokens FROM r""")
def bin_window_read(spark, sf):
    """Each cluster's whole stream, the last read around the end; a short cluster is tiled from its start."""
    d = _bin_docs(spark, sf)
    n = d.groupBy("cluster_id").agg(F.sum(F.size("w")).alias("n")).where("n > 0")
    cursors = F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col("n") / 65) - 1))
    draws = n.select("cluster_id", cursors.alias("cursor")).withColumn("offset", F.col("cursor") * 65)
    return packing.window_reads(d, "doc_id", "w", draws, 64, F.lit("0")).select("cluster_id", "cursor", F.array_join("window", " ").alias("tokens"))


@add(BIN_SQL + """
, r AS (SELECT cluster_id, c AS sample, t, len(t) AS n, (7 + c * 65) % len(t) AS at_token FROM b, range(0, 3) q(c) WHERE len(t) >= 65)
SELECT cluster_id, sample, array_to_string([t[(at_token + x) % n + 1] FOR x IN range(0, 64)], ' ') AS inputs, t[(at_token + 64) % n + 1] AS last_label, 64::BIGINT AS n_mask FROM r""")
def bin_scoring_sample(spark, sf):
    """Consecutive windows from an offset; clusters shorter than a window give none; the mask is all ones."""
    d = _bin_docs(spark, sf)
    long_enough = d.groupBy("cluster_id").agg(F.sum(F.size("w")).alias("n")).where("n >= 65").select("cluster_id")
    samples = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(2).cast("bigint")))
    draws = long_enough.withColumn("sample", samples).withColumn("offset", F.col("sample") * 65 + 7)
    inputs, labels = A.shifted(F.col("window"))
    return packing.window_reads(d, "doc_id", "w", draws, 64, F.lit("0")).select("cluster_id", "sample", F.array_join(inputs, " ").alias("inputs"), F.element_at(labels, -1).alias("last_label"), F.size(inputs).cast("bigint").alias("n_mask"))


@add(f"""
WITH r AS (SELECT {CLUSTER_SQL} AS cluster_id, doc_id, list_concat(list_concat(['<s>'], {W}), ['</s>'])[1:33] AS t, row_number() OVER (PARTITION BY source ORDER BY {digest_sql(5, 'doc_id')}, doc_id) AS rn FROM documents),
m AS (SELECT *, max(len(t)) OVER (PARTITION BY cluster_id) AS longest FROM r WHERE rn <= 4 AND len(t) >= 2)
SELECT cluster_id, doc_id, array_to_string(list_concat(t, ['</s>' FOR x IN range(0, longest - len(t))]), ' ') AS tokens, len(t)::BIGINT AS mask_ones, longest::BIGINT AS width FROM m""")
def cluster_scoring_sample(spark, sf):
    """N documents of each cluster without replacement, clipped, and padded to the longest of the cluster."""
    s = sampling.without_replacement(_docs(spark, sf), ["cluster_id"], 4, 5, "doc_id").select("cluster_id", "doc_id", F.slice(T.encode(F.col("text")), 1, 33).alias("t")).where(F.size("t") >= 2)
    s = s.withColumn("width", F.max(F.size("t")).over(Window.partitionBy("cluster_id")))
    return s.select("cluster_id", "doc_id", F.array_join(A.fitted(F.col("t"), F.col("width"), F.lit(T.EOS)), " ").alias("tokens"), F.size("t").cast("bigint").alias("mask_ones"), F.col("width").cast("bigint").alias("width"))


CELLS = "(SELECT label, vec_id, unnest(range(0, 64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings)"
DIG = "md5('7:g:' || i)"
SKETCH = f"SELECT label::BIGINT AS cluster_id, ('0x' || substr({DIG}, 1, 13))::BIGINT % 16 AS bucket, sum(x * CASE WHEN ('0x' || substr({DIG}, 14, 1))::INT % 2 = 0 THEN 1.0 ELSE -1.0 END) AS v FROM {CELLS} GROUP BY ALL"


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("label").cast("bigint").alias("cluster_id"), "vec_id", "embedding", F.lit("g").alias("name"))


def _rounded(c: str):
    return F.round(c, 5).alias(c)


@add(f"SELECT cluster_id, bucket, round(v, 5) AS v FROM ({SKETCH})")
def count_sketch(spark, sf):
    """A18, C8, J7, U9."""
    return weighting.sketch(_vectors(spark, sf), ["cluster_id"], "name", "embedding", 16, 7).select("cluster_id", "bucket", _rounded("v"))


@add(f"SELECT bucket, round(sum(v), 4) AS whole, true AS same FROM ({SKETCH}) GROUP BY bucket")
def sketch_linearity(spark, sf):
    """The sketch of a sum is the sum of sketches."""
    v = _vectors(spark, sf)
    parts = weighting.sketch(v, ["cluster_id"], "name", "embedding", 16, 7).groupBy("bucket").agg(F.sum("v").alias("parts"))
    whole = weighting.sketch(v, [], "name", "embedding", 16, 7)
    return whole.join(parts, "bucket").select("bucket", F.round("v", 4).alias("whole"), (F.abs(F.col("v") - F.col("parts")) < 1e-6).alias("same"))


CONTRIBUTION = f"s AS ({SKETCH}), q AS (SELECT bucket, sum(v) / 3 AS q FROM s WHERE cluster_id < 3 GROUP BY bucket)"


@add(f"WITH {CONTRIBUTION}, d AS (SELECT cluster_id, sum(v * q) AS dot FROM s JOIN q USING (bucket) WHERE cluster_id <> 9 GROUP BY cluster_id) SELECT k AS cluster_id, round(coalesce(dot, 0) * 0.5, 4)::DOUBLE AS delta FROM range(0, 10) r(k) LEFT JOIN d ON d.cluster_id = k")
def cluster_contribution(spark, sf):
    """Dev batches are the first three clusters; one cluster has no sample."""
    s = weighting.sketch(_vectors(spark, sf), ["cluster_id"], "name", "embedding", 16, 7)
    out = weighting.contributions(s.where("cluster_id <> 9"), weighting.mean_sketch(s.where("cluster_id < 3"), 3), spark.range(10).withColumnRenamed("id", "cluster_id"), 0.5)
    return out.select("cluster_id", F.round("delta", 4).alias("delta"))


@add(f"WITH {CONTRIBUTION} SELECT cluster_id, round(sqrt(sum(v * v)), 5) AS norm, round(sum(v * q) / sqrt(sum(v * v)) / sqrt(sum(q * q)), 5) AS cosine FROM s JOIN q USING (bucket) GROUP BY cluster_id")
def sketch_dot(spark, sf):
    """A19."""
    s = weighting.sketch(_vectors(spark, sf), ["cluster_id"], "name", "embedding", 16, 7)
    j = s.join(weighting.mean_sketch(s.where("cluster_id < 3"), 3), "bucket")
    n = F.sqrt(F.sum(F.col("v") * F.col("v")))
    return j.groupBy("cluster_id").agg(F.round(n, 5).alias("norm"), F.round(F.sum(F.col("v") * F.col("q")) / n / F.sqrt(F.sum(F.col("q") * F.col("q"))), 5).alias("cosine"))


DELTAS = """d AS (SELECT dayofyear(ts)::BIGINT AS update_id, user_id % 12 AS cluster_id, CASE WHEN count(*) % 5 = 0 THEN 0.0::DOUBLE ELSE sum(CASE WHEN event_id % 2 = 0 THEN value ELSE -value END) / 100 END AS delta FROM events GROUP BY 1, 2)"""


def _deltas(spark, sf):
    e = table(spark, sf, "events")
    signed = F.sum(F.when(F.col("event_id") % 2 == 0, F.col("value")).otherwise(-F.col("value"))) / 100
    return e.groupBy(F.dayofyear("ts").cast("bigint").alias("update_id"), (F.col("user_id") % 12).alias("cluster_id")).agg(F.when(F.count(F.lit(1)) % 5 == 0, 0.0).otherwise(signed).alias("delta"))


STREAK = f"""
WITH RECURSIVE {DELTAS}, o AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY update_id) AS rn FROM d),
f AS (SELECT cluster_id, rn, CASE WHEN delta < 0 THEN 1 ELSE 0 END AS streak, false AS dead FROM o WHERE rn = 1
 UNION ALL SELECT o.cluster_id, o.rn, CASE WHEN f.dead THEN f.streak WHEN o.delta < 0 THEN f.streak + 1 WHEN o.delta > 0 THEN 0 ELSE f.streak END,
  f.dead OR (CASE WHEN o.delta < 0 THEN f.streak + 1 WHEN o.delta > 0 THEN 0 ELSE f.streak END) >= 4 FROM f JOIN o ON o.cluster_id = f.cluster_id AND o.rn = f.rn + 1),
z AS (SELECT cluster_id, streak::BIGINT AS streak, dead FROM f QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY rn DESC) = 1)
"""


@add(STREAK + "SELECT * FROM z")
def dead_cluster_streak(spark, sf):
    """W10."""
    return weighting.streaks(_deltas(spark, sf), 4)


@add(STREAK + """
, g AS (SELECT cluster_id, sum(delta) AS gamma FROM d GROUP BY cluster_id),
e AS (SELECT *, CASE WHEN dead THEN 0.0::DOUBLE ELSE greatest(exp(-gamma / 2.0 - max(-gamma / 2.0) OVER ()), 1e-3) END AS w FROM g JOIN z USING (cluster_id))
SELECT cluster_id, round(gamma, 5) AS gamma, streak, dead, round(CASE WHEN sum(w) OVER () > 0 THEN w / sum(w) OVER () WHEN count_if(NOT dead) OVER () > 0 THEN CASE WHEN dead THEN 0 ELSE 1.0 / count_if(NOT dead) OVER () END ELSE 1.0 / count(*) OVER () END, 6)::DOUBLE AS weight FROM e""")
def weight_update(spark, sf):
    """Accumulated gammas, dead clusters, a softmax with a floor."""
    return weighting.updated_weights(_deltas(spark, sf), 2.0, 1e-3, 4).select("cluster_id", F.round("gamma", 5).alias("gamma"), "streak", "dead", F.round("weight", 6).alias("weight"))


@add(f"""WITH {DELTAS}, g AS (SELECT cluster_id, arg_max(delta, update_id) AS gamma FROM d GROUP BY cluster_id),
e AS (SELECT *, greatest(exp(-gamma / 0.5 - max(-gamma / 0.5) OVER ()), 0.01) AS w FROM g)
SELECT cluster_id, round(gamma, 5) AS gamma, round(w / sum(w) OVER (), 6) AS weight FROM e""")
def softmax_floor(spark, sf):
    """Gammas that replace each other; the floor is a ratio to the best."""
    return weighting.updated_weights(_deltas(spark, sf), 0.5, 0.01, 10**6, accumulate=False).select("cluster_id", F.round("gamma", 5).alias("gamma"), F.round("weight", 6).alias("weight"))


@add("""
WITH v AS (SELECT u * 10 AS update_step, c AS cluster_id, ((u + c) % 5) * 1.0 AS weight FROM range(0, 4) a(u), range(0, 3) b(c))
SELECT s AS step, cluster_id, max(update_step) AS update_step, arg_max(weight, update_step)::DOUBLE AS weight FROM range(1, 41) r(s) JOIN v ON s > update_step GROUP BY s, cluster_id""")
def weight_versions(spark, sf):
    """New weights hold from the step after their update."""
    v = spark.range(4).select(F.col("id").alias("u")).select((F.col("u") * 10).alias("update_step"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(2).cast("bigint"))).alias("cluster_id"), "u")
    v = v.select("update_step", "cluster_id", ((F.col("u") + F.col("cluster_id")) % 5 * F.lit(1.0)).alias("weight"))
    return weighting.weights_at(v, spark.range(1, 41).withColumnRenamed("id", "step")).select("step", "cluster_id", "update_step", "weight")


@add("SELECT greatest(1, count(*) // 500)::BIGINT AS k_default, greatest(1, count(*) // 1000000)::BIGINT AS k_least FROM documents")
def cluster_count_rule(spark, sf):
    """C1."""
    return table(spark, sf, "documents").agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) / 500)).alias("k_default"), F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) / 1000000)).alias("k_least"))


@add("""
WITH c AS (SELECT vec_id % 1000 AS cluster_id, [x::DOUBLE FOR x IN embedding] AS c FROM embeddings WHERE vec_id < 8),
d AS (SELECT e.vec_id, c.cluster_id, list_sum([(e.embedding[i]::DOUBLE - c.c[i]) * (e.embedding[i]::DOUBLE - c.c[i]) FOR i IN range(1, 65)]) AS d FROM embeddings e, c)
SELECT vec_id, arg_min(cluster_id, round(d, 9) * 1000 + cluster_id * 1e-9) AS cluster_id FROM d GROUP BY vec_id""")
def nearest_centroid(spark, sf):
    """C4: assignment to the nearest of eight given centroids."""
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return weighting.nearest(e, "v", e.where("vec_id < 8").select(F.col("vec_id").alias("cluster_id"), F.col("v").alias("centroid"))).select("vec_id", "cluster_id")


@add()
def kmeans_fit(spark, sf):
    """KMeans on the embeddings; clusters are checked for size and agreement with labels in tests."""
    return weighting.cluster(table(spark, sf, "embeddings").select("vec_id", "embedding", "label"), "embedding", 10, restarts=2).select("vec_id", F.col("cluster_id").cast("bigint").alias("cluster_id"), "label")


@add(f"SELECT label::BIGINT AS label, i::BIGINT AS dim, round(sum(x * m) / greatest(sum(m), 1), 5) AS mean FROM (SELECT *, CASE WHEN vec_id % 3 = 0 THEN 0 ELSE 1 END AS m FROM {CELLS}) GROUP BY 1, 2")
def mean_pool(spark, sf):
    """Masked mean over the vectors of a label."""
    e = table(spark, sf, "embeddings").select(F.col("label").cast("bigint").alias("label"), F.when(F.col("vec_id") % 3 == 0, 0).otherwise(1).alias("m"), F.posexplode("embedding").alias("dim", "x"))
    return e.groupBy("label", F.col("dim").cast("bigint").alias("dim")).agg(F.round(F.sum(F.col("x").cast("double") * F.col("m")) / F.greatest(F.sum("m"), F.lit(1)), 5).alias("mean"))
