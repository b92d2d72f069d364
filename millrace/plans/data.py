"""Readers' record handling, pictures as arrays, names and files, and generic scans of every table."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import arrays as A
from millrace.functions import text as T
from millrace.operators import filters, masks, ordering, vision
from millrace.plans.book import Book, table
from millrace.sources import readers, sinks

BOOK = Book()
add = BOOK.add

FORMS_SQL = """CASE k WHEN 0 THEN '{"text":"a' || i || '"}' WHEN 1 THEN '{"data":[{"text":"b' || i || '"},{"text":""},{"no":1}]}' WHEN 2 THEN '[{"text":"c' || i || '"},{"text":"d' || i || '"}]' WHEN 3 THEN '{broken' WHEN 4 THEN '{"samples":[{"text":"e' || i || '"}]}' ELSE '{"other":1}' END"""


def _forms(spark):
    i = F.col("id").cast("string")
    k = F.col("id") % 6
    c = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])
    form = (
        F.when(k == 0, c('{"text":"a', i, '"}')).when(k == 1, c('{"data":[{"text":"b', i, '"},{"text":""},{"no":1}]}')).when(k == 2, c('[{"text":"c', i, '"},{"text":"d', i, '"}]'))
        .when(k == 3, c("{broken")).when(k == 4, c('{"samples":[{"text":"e', i, '"}]}')).otherwise(c('{"other":1}'))
    )
    return spark.range(300).select("id", form.alias("content"))


@add("""SELECT i AS id, t AS text FROM (SELECT i, unnest(CASE i % 6 WHEN 0 THEN ['a' || i] WHEN 1 THEN ['b' || i] WHEN 2 THEN ['c' || i, 'd' || i] WHEN 4 THEN ['e' || i] ELSE [] END) AS t FROM range(0, 300) r(i))""")
def embedded_records(spark, sf):
    """One record, a list, a list under a known key; broken ones and those without text give nothing."""
    return _forms(spark).select("id", F.explode(readers.embedded_records(F.col("content"))).alias("text"))


@add("SELECT DISTINCT source AS path FROM documents")
def distinct_paths(spark, sf):
    """O1, X1."""
    return table(spark, sf, "documents").select(F.col("source").alias("path")).distinct()


@add("WITH n AS (SELECT 'hub/' || CASE doc_id % 4 WHEN 0 THEN 'tokenizer' || doc_id || '.json' WHEN 1 THEN 'model-' || doc_id || '.bin' WHEN 2 THEN 'README.md' ELSE 'config.json' END AS path, doc_id FROM documents) SELECT doc_id, path FROM n WHERE regexp_matches(split_part(path, '/', 2), '^tokenizer.*\\.json$') OR split_part(path, '/', 2) = 'config.json'")
def glob_assets(spark, sf):
    """Names with a capital never match, as patterns are lower-cased."""
    k, i = F.col("doc_id") % 4, F.col("doc_id").cast("string")
    name = F.when(k == 0, F.concat(F.lit("tokenizer"), i, F.lit(".json"))).when(k == 1, F.concat(F.lit("model-"), i, F.lit(".bin"))).when(k == 2, "README.md").otherwise("config.json")
    n = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("hub/"), name).alias("path"))
    return readers.listed(n, ["tokenizer*.json", "config.json", "README.md"]).select("doc_id", "path")


@add("SELECT doc_id, CASE WHEN regexp_matches(source, '1') THEN 'ones' WHEN regexp_matches(source, 'src[0-4]$') THEN 'low' ELSE 'rest' END AS label FROM documents")
def regex_groups(spark, sf):
    """F16: the first pattern that matches."""
    return table(spark, sf, "documents").select("doc_id", T.first_pattern(F.col("source"), [("1", "ones"), ("src[0-4]$", "low")], "rest").alias("label"))


STEPS_SQL = "s AS (SELECT doc_id, doc_id * 50 AS step, CASE doc_id % 5 WHEN 4 THEN 'other_' || doc_id ELSE 'run/global_step' || doc_id * 50 || '_x' END AS name, doc_id % 7 <> 0 AS usable FROM documents)"


def _steps(spark, sf):
    n = F.col("doc_id") * 50
    name = F.when(F.col("doc_id") % 5 == 4, F.concat(F.lit("other_"), F.col("doc_id").cast("string"))).otherwise(F.concat(F.lit("run/global_step"), n.cast("string"), F.lit("_x")))
    return table(spark, sf, "documents").select("doc_id", name.alias("name"), (F.col("doc_id") % 7 != 0).alias("usable")).withColumn("step", T.step_of(F.col("name")))


@add(f"WITH {STEPS_SQL} SELECT coalesce(max(step) FILTER (WHERE usable AND name LIKE '%global_step%'), -1)::BIGINT AS latest FROM s")
def latest_checkpoint(spark, sf):
    """The last step whose metadata are there."""
    return ordering.latest_step(_steps(spark, sf), F.col("step"), F.col("usable"))


@add(f"WITH {STEPS_SQL} SELECT step FROM s WHERE name LIKE '%global_step%' QUALIFY row_number() OVER (ORDER BY step DESC) > 10")
def retention(spark, sf):
    """O8, K11, K16, T12."""
    return ordering.purgeable(_steps(spark, sf).where("step IS NOT NULL").select("step"), "step", 10)


@add("SELECT 'dclm_g0' || (i % 10) || '_l' || (i // 10) || '_s' || lpad(i::VARCHAR, 8, '0') || '.jsonl' AS name, i AS id FROM range(0, 100) r(i)")
def shard_names(spark, sf):
    """F14, S12, F17."""
    i = F.col("id")
    path = F.concat(F.lit("global-shard_"), T.padded(i % 10, 2), F.lit("_of_10/local-shard_"), F.floor(i / 10).cast("string"), F.lit("_of_10/shard_"), T.padded(i, 8), F.lit("_processed.jsonl.zst"))
    return spark.range(100).select(T.shard_name(path).alias("name"), "id")


@add("SELECT i AS id, 'layers.{}.w{}.weight' AS pattern, i || ',' || i % 3 AS numbers, 'model.blocks.' || i || '.ffn.' || i % 3 AS mapped FROM range(0, 64) r(i)")
def parameter_names(spark, sf):
    """numbers taken out of a name, and put into its counterpart."""
    name = F.concat(F.lit("layers."), F.col("id").cast("string"), F.lit(".w"), (F.col("id") % 3).cast("string"), F.lit(".weight"))
    pattern, numbers = T.abstracted(name)
    return spark.range(64).select("id", pattern.alias("pattern"), F.array_join(numbers, ",").alias("numbers"), T.restored(F.lit("model.blocks.{}.ffn.{}"), numbers).alias("mapped"))


@add("SELECT doc_id, doc_id % 3 = 0 AS kept, ',' || source AS texts, 'img' || ',' AS images FROM documents")
def interleaved_pairs(spark, sf):
    """Pairs in interleaved form; a sample whose picture failed is not kept."""
    texts, images = filters.interleaved(F.col("source"), F.lit("img"))
    d = table(spark, sf, "documents").select("doc_id", texts.alias("t"), images.alias("i"))
    broken = F.when(F.col("doc_id") % 3 == 0, F.col("i")).otherwise(F.array(F.lit(None).cast("string"), F.lit(None).cast("string")))
    s = lambda c: F.array_join(c, ",", "").alias
    return d.select("doc_id", filters.decoded(F.col("t"), broken).alias("kept"), s("t")("texts"), s("i")("images"))


@add("SELECT CASE WHEN doc_id % 2 = 0 THEN source ELSE lang END AS caption, doc_id FROM documents")
def caption_first(spark, sf):
    """Of a list, the first."""
    d = table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.array("source", "lang")).otherwise(F.array("lang")).alias("caption"))
    return d.select(readers.caption(d).alias("caption"), "doc_id")


@add("""WITH p AS (SELECT vec_id, [x::DOUBLE FOR x IN embedding] AS v FROM embeddings),
k AS (SELECT vec_id, v, q.p AS patch, r.i AS i FROM p, range(0, 4) q(p), range(0, 16) r(i))
SELECT vec_id, patch, round(sum(v[((patch // 2) * 4 + (i // 4)) * 8 + (patch % 2) * 4 + i % 4 + 1] * (i + 1)), 4) AS checksum FROM k GROUP BY vec_id, patch""")
def patchify_blocks(spark, sf):
    """M17, G13 on 8 x 8 pictures of one channel and frame, patches of 4, no merging: block order is then raster order."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    e = table(spark, sf, "embeddings").select("vec_id", F.posexplode(vision.patchify(v, 1, 8, 8, 1, 4, 1, 1)).alias("patch", "x"))
    total = F.aggregate(F.transform("x", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return e.select("vec_id", F.col("patch").cast("bigint").alias("patch"), F.round(total, 4).alias("checksum"))


@add("""SELECT vec_id, r.p // 4 AS row, r.p % 4 AS col, round(sum(embedding[((r.p // 4) * 2 + i // 2) * 8 + (r.p % 4) * 2 + i % 2 + 1]::DOUBLE * (i + 1)), 4) AS checksum FROM embeddings, range(0, 16) r(p), range(0, 4) q(i) GROUP BY ALL""")
def patchify_raster(spark, sf):
    """Patches of 2 in raster order with their coordinates."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    e = table(spark, sf, "embeddings").select("vec_id", F.explode(vision.patchify_raster(v, 8, 8, 1, 2)).alias("x"))
    total = F.aggregate(F.transform(F.col("x.patch"), lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return e.select("vec_id", F.col("x.row").cast("bigint").alias("row"), F.col("x.column").cast("bigint").alias("col"), F.round(total, 4).alias("checksum"))


@add("""WITH k AS (SELECT vec_id, embedding AS v, i // 16 AS patch, i % 16 AS j, i FROM embeddings, range(0, 64) r(i))
SELECT vec_id, round(sum(v[(j // 4) * 16 + ((patch // 2) * 2 + (j // 2) % 2) * 4 + (patch % 2) * 2 + j % 2 + 1]::DOUBLE * (i + 1)), 3) AS packed, true AS same, '0:0:0,0:0:1,0:1:0,0:1:1' AS positions FROM k GROUP BY vec_id""")
def latent_packing(spark, sf):
    """(4, 4, 4) latents to four 2 x 2 packs and back."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    d = table(spark, sf, "embeddings").select("vec_id", v.alias("v"), vision.pack_latents(v, 4, 4, 4).alias("p"))
    total = F.aggregate(F.transform("p", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    at = F.array_join(F.transform(vision.latent_positions(4, 4), lambda x: F.array_join(F.transform(x, lambda y: y.cast("string")), ":")), ",")
    return d.select("vec_id", F.round(total, 3).alias("packed"), (vision.unpack_latents(F.col("p"), 4, 4, 4) == F.col("v")).alias("same"), at.alias("positions"))


@add("SELECT doc_id, CASE WHEN doc_id % 6 <= 4 THEN 4::BIGINT END AS n, CASE WHEN doc_id % 6 <= 4 THEN 4 - doc_id % 6 END AS n_blank FROM documents")
def padded_patches(spark, sf):
    """Up to a fixed number; more are null."""
    c = F.transform(A.upto(F.col("doc_id") % 6), lambda i: F.array(i, i))
    p = vision.padded_coordinates(c, 4)
    d = table(spark, sf, "documents").select("doc_id", p.alias("p"))
    return d.select("doc_id", F.when(F.col("p").isNotNull(), F.size("p").cast("bigint")).alias("n"), F.when(F.col("p").isNotNull(), F.size(F.filter("p", lambda x: x[0] == -1)).cast("bigint")).alias("n_blank"))


@add("SELECT doc_id, array_to_string([CASE WHEN i < doc_id % 5 THEN (i % 2)::VARCHAR ELSE '7' END FOR i IN range(0, 6)], ',') AS ids, array_to_string([CASE WHEN i >= doc_id % 5 THEN '1' WHEN i % 2 = 7 THEN '-100' ELSE (i % 2)::VARCHAR END FOR i IN range(0, 6)], ',') AS labels FROM documents")
def legacy_padding(spark, sf):
    """Labels are filled with 1, which is not masked unless it is the padding id."""
    x = F.transform(A.upto(F.col("doc_id") % 5), lambda i: (i % 2).cast("int"))
    ids, labels = A.legacy_padded(x, x, 6, 7)
    s = lambda c: F.array_join(F.transform(c, lambda y: y.cast("string")), ",")
    return table(spark, sf, "documents").select("doc_id", s(ids).alias("ids"), s(labels).alias("labels"))


@add("SELECT doc_id, CASE doc_id % 2 WHEN 0 THEN '0:0:0 1:1:1 2:2:2 2:2:3 2:3:2 2:3:3 4:4:4 0:0:0 1:1:1' ELSE '0:0:0 0:0:1 2:2:2 3:3:3 3:3:4 3:3:5 3:4:3 3:4:4 3:4:5' END AS positions FROM documents")
def vision_positions(spark, sf):
    """Text, a 2 x 2 picture, text, and a new document; or two pictures with text between."""
    even = F.col("doc_id") % 2 == 0
    lit = lambda *x: F.array(*map(F.lit, x))
    kinds = F.when(even, lit(0, 0, 1, 1, 1, 1, 0, 0, 0)).otherwise(lit(1, 1, 0, 1, 1, 1, 1, 1, 1))
    grid = lambda h, w: F.struct(F.lit(h).alias("h"), F.lit(w).alias("w"))
    grids = F.when(even, F.array(grid(2, 2), grid(1, 1))).otherwise(F.array(grid(1, 2), grid(2, 3)))
    where = F.when(even, lit(0, 1, 2, 3, 4, 5, 6, 0, 1)).otherwise(lit(0, 1, 2, 3, 4, 5, 6, 7, 8))
    p = masks.rope_positions(kinds, grids, where)
    return table(spark, sf, "documents").select("doc_id", F.array_join(F.transform(p, lambda x: F.concat_ws(":", x["t"].cast("string"), x["h"].cast("string"), x["w"].cast("string"))), " ").alias("positions"))


@add("SELECT doc_id - 40 AS left_over FROM documents WHERE doc_id >= 40")
def resume_by_offset(spark, sf):
    """What is left after 40 rows."""
    d = ordering.ordinal(table(spark, sf, "documents").select("doc_id"), "doc_id", "o")
    return ordering.resumed(d, "o", 40).select((F.col("o") - 40).alias("left_over"))


@add("SELECT count(*)::BIGINT AS n, sum(length(text))::BIGINT AS n_chars, (sum(length(text)) * 4 // 2)::BIGINT AS rate FROM benchmark")
def generation_report(spark, sf):
    """A report with responses and a rate, through JSON."""
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.lit("q").alias("input"), F.col("text").alias("output"))
    r = sinks.generation_report(b, 4, 10, 20.0).select(F.from_json("report", "metadata struct<batch_size:int,tokens_per_sec:double>, responses array<struct<id:bigint,input:string,output:string>>").alias("r"))
    n = F.aggregate("r.responses", F.lit(0).cast("bigint"), lambda s, x: s + F.length(x["output"]))
    return r.select(F.size("r.responses").cast("bigint").alias("n"), n.alias("n_chars"), (n * F.col("r.metadata.tokens_per_sec")).cast("bigint").alias("rate"))


@add("SELECT doc_id::VARCHAR AS request_id, doc_id FROM documents")
def order_by_request(spark, sf):
    """Requests by number, not by text."""
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("request_id"), "doc_id")
    return d.orderBy(F.col("request_id").cast("bigint"))


@add("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*)::BIGINT AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def pricing_summary(spark, sf):
    """A smoke check of scans, filters and aggregates on the star schema; an extension."""
    li = table(spark, sf, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count(F.lit(1)).alias("n"))


@add("""SELECT n_name, count(DISTINCT o_custkey)::BIGINT AS customers, count(*)::BIGINT AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name""")
def orders_by_nation(spark, sf):
    """A smoke check of joins on the star schema; an extension."""
    o, c, n, r = (table(spark, sf, t) for t in ("orders", "customer", "nation", "region"))
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return j.groupBy("n_name").agg(F.countDistinct("o_custkey").alias("customers"), F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
