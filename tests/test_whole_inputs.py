"""Queries over all words and rows of the tables, against SQL without the cuts of the catalogue's."""

import __spark_entry__ as entry
import pytest
from oracle import connect, difference
from pyspark.sql import functions as F

from millrace.operators import packing
from millrace.plans import corpus
from millrace.plans.book import WORDS_SQL as W

SF = entry.SMALL


@pytest.fixture(scope="module")
def db():
    return connect(SF)


def check(spark, db, name, sql):
    assert difference(spark, db, entry.queries()[name], sql, SF) == ""


# All windows of 24 tokens of each text; w.row is the window's number in the order of documents.
CELLS = f"""t AS (SELECT doc_id, {W} AS t FROM documents),
v AS (SELECT doc_id, t, unnest(range(0, greatest((len(t) + 23) // 24, 1))) AS win FROM t),
r AS (SELECT *, row_number() OVER (ORDER BY doc_id, win) - 1 AS row FROM v),
w AS (SELECT doc_id, win, row, pos, coalesce(t[win * 24 + pos + 1], 'x') AS tok FROM r, range(0, 24) q(pos)),
e AS (SELECT *, CASE WHEN tok LIKE '%.' THEN 1 ELSE 0 END AS eos FROM w),
d AS (SELECT *, coalesce(sum(eos) OVER (PARTITION BY doc_id, win ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS doc_no FROM e)"""
PAIRS = "FROM d a JOIN d b ON a.doc_id = b.doc_id AND a.win = b.win AND a.pos >= b.pos"
OVER = "(PARTITION BY doc_id, win ORDER BY pos)"
MASKS = {
    "doc_index": "SELECT doc_id, win AS window, pos, doc_no FROM d",
    "cu_seqlens": ", o AS (SELECT doc_id, win, row, 0 AS s FROM d WHERE pos = 0 UNION SELECT doc_id, win, row, pos + 1 FROM d WHERE eos = 1 AND pos < 23) SELECT doc_id, win AS window, string_agg((row * 24 + s)::VARCHAR, ',' ORDER BY s) AS offsets FROM o GROUP BY ALL",
    "causal_mask_count": f"SELECT a.doc_id, a.win AS window, count(*)::BIGINT AS pairs {PAIRS} GROUP BY ALL",
    "sliding_window_pairs": f"SELECT a.doc_id, a.win AS window, a.pos AS q, min(b.pos) AS first_kv, count(*)::BIGINT AS n {PAIRS} AND a.pos - b.pos < 5 GROUP BY ALL",
    "document_mask_pairs": f"SELECT a.doc_id, a.win AS window, a.pos AS q, count(*)::BIGINT AS n, sum(b.pos)::BIGINT AS kv_sum {PAIRS} AND a.doc_no = b.doc_no GROUP BY ALL",
    "fixed_block_pairs": f"SELECT a.doc_id, a.win AS window, a.pos AS q, count(*)::BIGINT AS n {PAIRS} AND a.pos // 7 = b.pos // 7 GROUP BY ALL",
    "reset_and_run_detection": f", p AS (SELECT *, pos - min(pos) OVER (PARTITION BY doc_id, win, doc_no) AS rel, eos = 1 AS m FROM d), l AS (SELECT *, rel < lag(rel) OVER {OVER} AS fresh, m AND NOT coalesce(lag(m) OVER {OVER}, false) AS starts, eos IS DISTINCT FROM lag(eos) OVER {OVER} AS kept FROM p) SELECT doc_id, win AS window, count_if(fresh)::BIGINT AS n_resets, count_if(starts)::BIGINT AS n_runs, count_if(kept)::BIGINT AS n_collapsed FROM l GROUP BY ALL",
}


@pytest.mark.parametrize("name", MASKS)
def test_masks_see_every_window(spark, db, name):
    check(spark, db, name, f"WITH {CELLS} {MASKS[name]}")


BIN = f"WITH b AS (SELECT substr(source, 4)::BIGINT AS cluster_id, flatten(list({W} ORDER BY doc_id)) AS t FROM documents GROUP BY 1)"
BINS = {
    "bin_window_read": "SELECT cluster_id, c AS cursor, array_to_string([t[(c * 65 + x) % len(t) + 1] FOR x IN range(0, 65)], ' ') AS tokens FROM (SELECT cluster_id, t, unnest(range(0, (len(t) + 64) // 65)) AS c FROM b WHERE len(t) >= 65)",
    "bin_scoring_sample": "SELECT cluster_id, c AS sample, array_to_string([t[(7 + c * 65 + x) % len(t) + 1] FOR x IN range(0, 64)], ' ') AS inputs, t[(7 + c * 65 + 64) % len(t) + 1] AS last_label, 64::BIGINT AS n_mask FROM b, range(0, 3) q(c) WHERE len(t) >= 65",
}


@pytest.mark.parametrize("name", BINS)
def test_clusters_are_read_to_their_ends(spark, db, name):
    check(spark, db, name, f"{BIN} {BINS[name]}")


def test_short_clusters_are_tiled(spark):
    docs = spark.createDataFrame([(3, 0, [str(i) for i in range(25)]), (3, 1, [str(i) for i in range(25, 40)]), (5, 2, ["a"])], "cluster_id bigint, doc_id bigint, w array<string>")
    draws = spark.createDataFrame([(3, 0), (3, 65), (5, 0)], "cluster_id bigint, offset bigint")
    got = {(r["cluster_id"], r["offset"]): r["window"] for r in packing.window_reads(docs, "doc_id", "w", draws, 64, F.lit("0")).collect()}
    tiled = [str(i % 40) for i in range(65)]
    assert got == {(3, 0): tiled, (3, 65): tiled, (5, 0): ["a"] * 65}


def test_packing_takes_true_lengths(spark, db):
    n = dict(db.execute(f"SELECT doc_id, len({W}) FROM documents").fetchall())
    want = []
    for shard in {k // corpus.SHARD for k in n}:
        held = []
        for k in sorted(k for k in n if k // corpus.SHARD == shard and 0 < n[k] <= 512):
            if sum(n[x] for x in held) + n[k] > 512:
                want.append((shard, held))
                held = []
            held = [*held, k]
        want.append((shard, held))
    got = [(r["shard"], [int(x) for x in r["keys"].split(",")], r["n_samples"], r["used"]) for r in entry.queries()["pack_greedy"](spark, SF).collect()]
    assert sorted(got) == sorted((s, keys, len(keys), sum(n[k] for k in keys)) for s, keys in want)


SPECIAL = "('the', 'of', 'la', 'der')"
WHOLE_TEXTS = {
    "vocab_ids": f"""WITH t AS (SELECT doc_id, {W} AS w FROM documents), u AS (SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS i FROM t),
v AS (SELECT word, row_number() OVER (ORDER BY word) - 1 AS id FROM (SELECT DISTINCT word FROM u)), m AS (SELECT doc_id, string_agg(id::VARCHAR, ',' ORDER BY i) AS ids FROM u JOIN v USING (word) GROUP BY doc_id)
SELECT (SELECT count(*) FROM v)::BIGINT AS vocab_size, doc_id, coalesce(ids, '') AS ids FROM t LEFT JOIN m USING (doc_id)""",
    "special_mask": f"""WITH t AS (SELECT doc_id, {W} AS h FROM documents)
SELECT doc_id, array_to_string([CASE WHEN x IN {SPECIAL} THEN '-100' ELSE x END FOR x IN h], ' ') AS masked,
  array_to_string([CASE WHEN i < least(greatest(doc_id % 5 - 1, 0), len(h)) THEN '-100' ELSE h[i + 1] END FOR i IN range(0, len(h))], ' ') AS prompt_masked,
  array_to_string(list_concat(h, ['<pad>' FOR i IN range(0, 16)])[1:16], ' ') AS padded, array_to_string(list_concat(h, ['<pad>', '<pad>', '<pad>', '<pad>'])[1:4], ' ') AS clipped,
  len([x FOR x IN h IF x IN {SPECIAL}])::BIGINT AS n_special FROM t""",
    "pad_batch": f"""WITH t AS (SELECT doc_id // 3 AS batch, doc_id % 3 AS r, {W} AS h FROM documents), g AS (SELECT DISTINCT batch, q.r AS r FROM t, range(0, 4) q(r)), f AS (SELECT batch, r, coalesce(h, []) AS h FROM g LEFT JOIN t USING (batch, r))
SELECT batch, r AS row, array_to_string(list_concat(h, ['</s>' FOR i IN range(0, 9)])[1:8], ' ') AS inputs, array_to_string(list_concat(h, ['-100' FOR i IN range(0, 9)])[2:9], ' ') AS labels FROM f""",
    "multimodal_samples": f"""WITH t AS (SELECT doc_id, {W} AS w, doc_id % 3 + 3 AS n FROM documents)
SELECT doc_id, '<v>' || repeat('<i>', (doc_id % 3 + 1)::INT) || '</v>' || coalesce(array_to_string(w, ' '), '') || '</s>' AS sample, n + len(w) + 1 AS n_tokens, n + 1 AS n_masked FROM t""",
    "episode_collation": f"""WITH s AS (SELECT turn, conv_id % 3 AS shard, conv_id, {W} AS w FROM conversations)
SELECT turn, shard, md5(array_to_string(flatten(list(w ORDER BY conv_id)), ' ')) AS tokens_md5, string_agg(least(len(w), 6)::VARCHAR, ',' ORDER BY conv_id) AS prompt_lengths, string_agg(greatest(len(w) - 6, 0)::VARCHAR, ',' ORDER BY conv_id) AS response_lengths FROM s GROUP BY ALL""",
}


@pytest.mark.parametrize("name", WHOLE_TEXTS)
def test_whole_texts_of_all_rows(spark, db, name):
    check(spark, db, name, WHOLE_TEXTS[name])


WHOLE_ROWS = {
    "patchify_blocks": """WITH p AS (SELECT vec_id, [x::DOUBLE FOR x IN embedding] AS v FROM embeddings), k AS (SELECT vec_id, v, q.p AS patch, r.i AS i FROM p, range(0, 4) q(p), range(0, 16) r(i))
SELECT vec_id, patch, round(sum(v[((patch // 2) * 4 + (i // 4)) * 8 + (patch % 2) * 4 + i % 4 + 1] * (i + 1)), 4) AS checksum FROM k GROUP BY vec_id, patch""",
    "interleaved_pairs": "SELECT doc_id, doc_id % 3 = 0 AS kept, ',' || source AS texts, 'img' || ',' AS images FROM documents",
    "order_by_request": "SELECT doc_id::VARCHAR AS request_id, doc_id FROM documents",
}


@pytest.mark.parametrize("name", WHOLE_ROWS)
def test_whole_rows(spark, name):
    """On sf0.1, where ids go past 1000."""
    sf = "/root/testdata/sf0.1"
    assert difference(spark, connect(sf), entry.queries()[name], WHOLE_ROWS[name], sf) == ""


def test_requests_are_in_the_order_of_numbers(spark):
    ids = [r["doc_id"] for r in entry.queries()["order_by_request"](spark, SF).collect()]
    assert ids == sorted(ids) and len(ids) == spark.read.parquet(f"{SF}/documents.parquet").count()
