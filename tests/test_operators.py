"""Operators against plain Python, and rules that must raise or drop."""

from __future__ import annotations

import random
import re
from functools import reduce

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions import arrays as A
from millrace.functions import numbers as N
from millrace.functions import text as T
from millrace.operators import filters, masks, ordering, packing, routing, sampling, vision, weighting
from millrace.sources import readers


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


# --- packers


def greedy_plain(lengths, size):
    bins, held, used = [], [], 0
    for k, n in enumerate(lengths):
        if n > size - used and held:
            bins.append(held)
            held, used = [], 0
        held.append(k)
        used += n
        if used == size:
            bins.append(held)
            held, used = [], 0
    return bins + ([held] if held else [])


def scan_plain(lengths, size, buffer):
    """The state after each arrival, by definition: what one look takes, and what leaves."""

    def look(held):
        return reduce(lambda p, k: [*p, k] if sum(lengths[x] for x in [*p, k]) <= size else p, held, [])

    def settle(held, least):
        took = look(held)
        if not took:
            return [], []
        if sum(lengths[k] for k in took) < least:
            return [], held
        bins, rest = settle([k for k in held if k not in took], least)
        return [took, *bins], rest

    bins, held = [], []
    for k in range(len(lengths)):
        out, held = settle([*held, k], size) if len(held) + 1 >= buffer else ([], [*held, k])
        bins += out
    return bins + settle(held, 0)[0]


def next_fit_plain(lengths, size, buffer):
    bins = []
    for at in range(0, len(lengths), buffer):
        held, used = [], 0
        for k in sorted(range(at, min(at + buffer, len(lengths))), key=lambda k: (-lengths[k], k)):
            if lengths[k] > size:
                continue
            if held and used + lengths[k] > size:
                bins.append(held)
                held, used = [], 0
            held.append(k)
            used += lengths[k]
        if held:
            bins.append(held)
    return bins


CASES = [
    [5, 5, 10, 3, 7, 1],
    [10, 10, 1],
    [4, 4, 4, 6, 2, 12, 3, 3, 3, 1, 9, 10],
    [11, 12],
    [random.Random(3).randint(1, 11) for _ in range(120)],
]


@pytest.mark.parametrize("pack, plain", [("greedy", lambda n: greedy_plain(n, 10)), ("scan", lambda n: scan_plain(n, 10, 4)), ("next_fit", lambda n: next_fit_plain(n, 10, 4))])
def test_packers_match_plain_folds(spark, pack, plain):
    rows = [(s, k, n) for s, lengths in enumerate(CASES) for k, n in enumerate(lengths) if pack != "greedy" or n <= 10]
    df = spark.createDataFrame(rows, "shard long, key long, n long").repartition(3)
    n = F.col("n")
    out = {"greedy": lambda: packing.greedy(df, "shard", "key", n, 10), "scan": lambda: packing.scan_and_pick(df, "shard", "key", n, 10, 4), "next_fit": lambda: packing.sorted_next_fit(df, "shard", "key", n, 10, 4)}[pack]()
    got: dict = {}
    for r in sorted(out.collect()):
        got.setdefault(r["shard"], {}).setdefault(r["bin"], []).append((r["place"], r["key"]))
    for s, lengths in enumerate(CASES):
        kept = [k for k, m in enumerate(lengths) if pack != "greedy" or m <= 10]
        want = [[kept[i] for i in b] for b in plain([lengths[k] for k in kept])]
        assert [[k for _, k in sorted(b)] for _, b in sorted(got.get(s, {}).items())] == want


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 40), min_size=1, max_size=25), st.integers(1, 16))
def test_windows_are_the_stream(spark, lengths, length):
    """Windows joined are the beginning of the token stream; each run of positions starts at 0 and goes up by 1."""
    docs = [(k, [f"{k}.{i}" for i in range(n)]) for k, n in enumerate(lengths)]
    out = packing.concat_and_chunk(spark.createDataFrame(docs, "id long, t array<string>"), "t", "id", length).orderBy("window_id").collect()
    stream = [t for _, d in docs for t in d]
    assert [t for r in out for t in r["tokens"]] == stream[: len(stream) // (length + 1) * (length + 1)]
    for r in out:
        for i, (t, p) in enumerate(zip(r["tokens"], r["positions"], strict=True)):
            same = i > 0 and r["tokens"][i - 1].split(".")[0] == t.split(".")[0]
            assert p == (r["positions"][i - 1] + 1 if same else 0)


def test_prefix_sums_over_many_buckets(spark):
    rng = random.Random(1)
    rows = [(rng.randint(0, 5000), rng.randint(0, 9), i) for i in range(800)]
    df = spark.createDataFrame(rows, "k long, v long, i long").repartition(5)
    got = {r["i"]: r["s"] for r in ordering.prefix_sum(df, "k", F.col("v"), "s", span=64, ties=["i"]).collect()}
    total = 0
    for _, v, i in sorted(rows, key=lambda x: (x[0], x[2])):
        assert got[i] == total
        total += v


def test_prefix_sums_of_null_and_sparse_keys(spark):
    """Null keys come first; keys over all 64 bits, of which two differ where a double would not."""
    rng = random.Random(2)
    keys = [None, None, 1, None, 3, -1, (1 << 62) + 1, (1 << 62), (1 << 63) - 1, -(1 << 63)] + [rng.getrandbits(64) - (1 << 63) for _ in range(300)]
    rows = [(k, b, i) for i, (k, b) in enumerate((k, rng.choice(["x", "y", None])) for k in keys)]
    df = spark.createDataFrame(rows, "k long, b string, i long").repartition(3)
    order = lambda r: (r[0] is not None, r[0] or 0, r[2])
    for span in (1, 64, 1 << 16, 1 << 40):
        got = {r["i"]: r["o"] for r in ordering.ordinal(df, "k", "o", ties=["i"], span=span).collect()}
        assert [got[i] for _, _, i in sorted(rows, key=order)] == list(range(len(rows)))
    got = {r["i"]: r["o"] for r in ordering.ordinal(df, "k", "o", by=["b"], ties=["i"]).collect()}
    for b in ("x", "y", None):
        assert [got[r[2]] for r in sorted((r for r in rows if r[1] == b), key=order)] == list(range(sum(r[1] == b for r in rows)))
    with pytest.raises(ValueError, match="power of 2"):
        ordering.ordinal(df, "k", "o", span=100)


def test_retention_keeps_the_last_steps(spark):
    df = spark.range(50).select((F.col("id") * 7 % 50).alias("step"))
    assert sorted(r["step"] for r in ordering.purgeable(df, "step", 10).collect()) == list(range(40))
    assert ordering.purgeable(df, "step", 50).collect() == ordering.purgeable(df, "step", 60).collect() == ordering.purgeable(df, "step", 0).collect() == []


def test_prefix_within_a_budget(spark):
    rows = [(g, k, v) for g in ("a", None) for k, v in enumerate([3, 0, 4, 5, 0, 1])]
    got = ordering.prefix_within(spark.createDataFrame(rows, "g string, k long, v int"), ["g"], ["k"], F.col("v"), 7).collect()
    assert sorted((r["g"] or "", r["k"]) for r in got) == [(g, k) for g in ("", "a") for k in range(3)]


def test_order_needs_no_task_with_all_rows(spark):
    """Windows are parted by bucket or group of buckets; one more of the permutation's sees a row per expert."""
    rows = spark.range(1000).select(F.col("id"), (F.col("id") % 3).alias("expert"))
    for df, more in ((routing.permutation(rows, "expert", ["id"]), 1), (ordering.prefix_within(rows, ["expert"], ["id"], F.lit(1), 5), 0), (ordering.purgeable(rows, "id", 3), 0)):
        specs = re.findall(r"windowspecdefinition\((.*?)specifiedwindowframe", df._jdf.queryExecution().optimizedPlan().toString())
        assert sum("_bucket" not in s and "_group" not in s for s in specs) == more


@pytest.mark.parametrize("block", [4, 64])
def test_window_reads_from_documents(spark, block):
    """Around the end, over many documents and blocks; short streams are tiled, empty ones read as given."""
    docs = [(c, k, [f"{c}.{k}.{i}" for i in range(n)]) for c, lengths in ((0, [3, 0, 11, 7, 2]), (1, [2, 1]), (2, [0])) for k, n in enumerate(lengths)]
    draws = [(c, o) for c in range(4) for o in (0, 1, 7, 20, 22, 23, 50)]
    out = packing.window_reads(spark.createDataFrame(docs, "cluster_id long, k long, t array<string>"), "k", "t", spark.createDataFrame(draws, "cluster_id long, offset long"), 7, F.lit("-"), block)
    got = {(r["cluster_id"], r["offset"]): r["window"] for r in out.collect()}
    for c, o in draws:
        stream = [t for d in docs if d[0] == c for t in d[2]]
        want = ["-"] * 8 if not stream else [stream[((o if len(stream) >= 8 else 0) + i) % len(stream)] for i in range(8)]
        assert got[c, o] == want


# --- sampling


def test_no_line_is_drawn_twice_before_its_cluster_wraps(spark):
    w = spark.createDataFrame([(0, 0.7), (1, 0.3), (2, 0.0)], "cluster_id long, weight double")
    draws = sampling.with_cursors(sampling.draw(spark, w, 500, 3, 10))
    rows = draws.collect()
    assert sorted(r["draw"] for r in rows) == list(range(500)) and {r["cluster_id"] for r in rows} == {0, 1}
    for c in (0, 1):
        assert sorted(r["cursor"] for r in rows if r["cluster_id"] == c) == list(range(sum(r["cluster_id"] == c for r in rows)))
    assert sum(r["cluster_id"] == 0 for r in rows) == pytest.approx(350, abs=45)


def test_draws_without_lines_are_empty(spark):
    w = spark.createDataFrame([(0, 1.0)], "cluster_id long, weight double")
    lines = spark.createDataFrame([(0, 0, "a")], "cluster_id long, line_no long, text string")
    sizes = spark.createDataFrame([(0, 3)], "cluster_id long, n long")
    out = sampling.with_lines(sampling.with_cursors(sampling.draw(spark, w, 6, 1, 2)), lines, sizes).collect()
    assert [r["text"] for r in sorted(out, key=lambda r: r["draw"])] == ["a", None, None] * 2


def test_kmeans_finds_separate_groups(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(i % 3 * 10 + rng.normal()), float(i % 3 * -10 + rng.normal())]) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    out = weighting.cluster(df, "v", 3, restarts=2).collect()
    assert len({(r["id"] % 3, r["cluster_id"]) for r in out}) == 3
    with pytest.raises(ValueError, match="unknown method"):
        weighting.cluster(df, "v", 3, "other")
    assert weighting.cluster(df, "v", 3, "random", key="id").where("cluster_id BETWEEN 0 AND 2").count() == 90


def test_sketches_add_up_and_skip_nulls(spark):
    a = spark.createDataFrame([("w", [1.0, 2.0, 3.0] * 50), ("b", [0.5] * 40), ("n", None)], "name string, v array<double>")
    whole = {r["bucket"]: r["v"] for r in weighting.sketch(a, [], "name", "v", 8).collect()}
    parts: dict = {}
    for name in ("w", "b"):
        for r in weighting.sketch(a.where(F.col("name") == name), [], "name", "v", 8).collect():
            parts[r["bucket"]] = parts.get(r["bucket"], 0) + r["v"]
    assert whole == pytest.approx(parts)
    with pytest.raises(ValueError, match="positive"):
        weighting.sketch(a, [], "name", "v", 0)


@pytest.mark.parametrize("deltas, streak, dead", [([-1, 0, -1, -1], 3, True), ([-1, -1, 1, -1], 1, False), ([-1, -1, -1, 5, 5], 3, True), ([0, 0], 0, False)])
def test_streaks(spark, deltas, streak, dead):
    df = spark.createDataFrame([(i, 7, float(d)) for i, d in enumerate(deltas)], "update_id long, cluster_id long, delta double")
    r = weighting.streaks(df, 3).first()
    assert (r["streak"], r["dead"]) == (streak, dead)


def test_weights_when_all_are_dead_or_far_apart(spark):
    df = spark.createDataFrame([(i, c, -1.0) for i in range(3) for c in range(4)], "update_id long, cluster_id long, delta double")
    assert [r["weight"] for r in weighting.updated_weights(df, patience=2).collect()] == [0.25] * 4
    far = spark.createDataFrame([(0, 0, -1000.0), (0, 1, 1000.0)], "update_id long, cluster_id long, delta double")
    w = {r["cluster_id"]: r["weight"] for r in weighting.updated_weights(far, 1.0, 1e-3, 9).collect()}
    assert w[1] == pytest.approx(1e-3 / 1.001) and sum(w.values()) == pytest.approx(1)


# --- text


@pytest.mark.parametrize("text, want", [("[ANSWER] 4", 4), ("[ANSWER] 4 no [ANSWER] -7 x", -7), ("the answer is 7 or so 9", 7), ("so = 9.", 9), ("x = 9. The answer", 9), ("1 and 22", 22), ("none", None), ("", None)])
def test_answers(spark, text, want):
    assert one(spark, T.extract_answer(F.lit(text))) == want


@pytest.mark.parametrize("text, expected, want", [("[ANSWER] 4", "4", 1.2), ("[ANSWER] 4 [ANSWER] 4", "4", 1.0), ("[ANSWER] 4 x", "4", 1.0), ("4", "4", 1.0), ("[ANSWER] 5", "4", -1.0), ("", "4", -1.0), ("[ANSWER] 0", "", 1.2)])
def test_rewards(spark, text, expected, want):
    assert one(spark, T.reward(F.lit(text), F.lit(expected))) == want


def test_reasoning_is_split_at_the_last_mark(spark):
    r, a = T.split_reasoning(F.lit(" one #### two #### 3 "))
    assert (one(spark, r), one(spark, a)) == ("one #### two", "3")
    with pytest.raises(Exception, match="no mark"):
        one(spark, T.split_reasoning(F.lit("nothing"))[1])


def test_messages_are_checked(spark):
    bad = F.array(F.struct(F.lit("user").alias("role"), F.lit("a").alias("content")), F.struct(F.lit("user").alias("role"), F.lit("b").alias("content")))
    assert one(spark, T.valid_messages(bad)) is False
    with pytest.raises(Exception, match="not user, assistant"):
        one(spark, T.checked_messages(bad))


def test_placeholders_beyond_the_counts_are_null(spark):
    parts = F.array(F.lit("a"), F.lit(None).cast("string"), F.lit(None).cast("string"))
    assert one(spark, T.placeholders(parts, F.array(F.lit(2)), "<", "i", ">")) is None
    assert one(spark, T.placeholders(parts, F.array(F.lit(2), F.lit(0)), "<", "i", ">", "E")) == "a<ii><>E"


@pytest.mark.parametrize("glob, name, want", [("*.json", "a.json", True), ("a?c", "abc", True), ("a.c", "abc", False), ("README.md", "README.md", False)])
def test_globs(spark, glob, name, want):
    assert one(spark, F.lit(name).rlike(T.glob_pattern(glob))) is want


@pytest.mark.parametrize("text, probs, quality, want", [
    (None, None, None, False), (" \n ", None, None, False), ("w " * 32, {"en": 0.9}, None, True), ("w " * 31, {"en": 0.9}, None, False), ("w " * 32, {"de": 0.9}, None, False), ("w " * 32, None, None, True),
    ("w " * 32, {"en": 0.5}, 0.2, False), ("w " * 32, {"en": 0.5}, 0.3, True), ("w " * 99, {"en": 0.5}, 0.3, False),
])
def test_corpus_filter(spark, text, probs, quality, want):
    df = spark.createDataFrame([(text, probs, quality)], "t string, p map<string,double>, q double")
    ok = filters.passes(F.col("t"), max_tokens=64, lang_probs=F.col("p"), quality=F.col("q"), min_quality=0.3)
    assert df.select(ok.alias("x")).first()["x"] is want


# --- arrays and numbers


def test_window_reads(spark):
    lit = lambda x: F.array(*map(F.lit, x))
    assert one(spark, A.window_at(lit([1, 2, 3, 4, 5]), F.lit(3), 4)) == [4, 5, 1, 2]
    assert one(spark, A.window_at(lit([1, 2, 3, 4, 5]), F.lit(12), 4)) == [3, 4, 5, 1]
    assert one(spark, A.window_at(lit([1, 2]), F.lit(1), 5)) == [1, 2, 1, 2, 1]
    assert one(spark, A.window_at(F.array().cast("array<int>"), F.lit(0), 5)) is None
    assert one(spark, A.lengths_to_positions(lit([3, 0, 2]))) == [0, 1, 2, 0, 1]


def test_legacy_padding_masks_tokens_that_equal_padding(spark):
    ids, labels = A.legacy_padded(F.array(F.lit(1), F.lit(2)), F.array(F.lit(1), F.lit(2)), 4, 2)
    assert (one(spark, ids), one(spark, labels)) == ([1, 2, 2, 2], [1, -100, 1, 1])
    assert one(spark, A.legacy_padded(F.array(F.lit(1)), F.array(F.lit(1)), 3, 2, legacy=False)[1]) == [1, -100, -100]


def test_aspect_over_200_raises(spark):
    assert one(spark, F.array(*N.smart_resize(F.lit(1), F.lit(1), 28, 784, 200000))) == [28, 28]
    with pytest.raises(Exception, match="aspect"):
        one(spark, N.smart_resize(F.lit(1), F.lit(201), 28, 784, 200000)[0])


@pytest.mark.parametrize("total, warmup, ratio, want", [(10, 2, None, [0.5, 1, 1, 7 / 8, 6 / 8, 5 / 8, 4 / 8, 3 / 8, 2 / 8, 1 / 8]), (10, 2, 0.5, [0.5, 1, 1, 1, 1, 1, 0.8, 0.6, 0.4, 0.2])])
def test_learning_rates(spark, total, warmup, ratio, want):
    got = [r[0] for r in spark.range(total).orderBy("id").select(N.lr_factor(F.col("id"), total, warmup, ratio)).collect()]
    assert got == pytest.approx(want)
    with pytest.raises(ValueError, match="unknown decay"):
        N.lr_factor(F.lit(1), 10, 2, None, "cubic")


def test_batches_must_divide(spark):
    with pytest.raises(Exception, match="multiple"):
        one(spark, N.batch_plan(F.lit(4), F.lit(2), F.lit(9))[0])
    with pytest.raises(Exception, match="world"):
        one(spark, N.inferred_degree(F.lit(3), F.lit(8), F.lit(2)))


# --- routing, masks, pictures


def test_routing_ties_go_to_the_least_expert(spark):
    got = one(spark, routing.top_k(F.array(*map(F.lit, [0.5, 0.9, 0.9, 0.5])), 3))
    assert [r["expert"] for r in got] == [1, 2, 0]
    assert [x for x in one(spark, routing.top_logits(F.array(*map(F.lit, [3.0, 1.0, 2.0, 2.0])), 2)) if x is not None] == [3.0, 2.0, 2.0]
    assert sum(one(spark, routing.probabilities(F.array(*map(F.lit, [1.0, 2.0, 3.0]))))) == pytest.approx(1)
    with pytest.raises(ValueError, match="groups"):
        routing.group_limited(F.array(), 8, 8, 1)


def test_sliding_window_needs_a_position():
    with pytest.raises(ValueError, match="one position"):
        masks.first_seen(F.lit(3), width=0)


def test_document_masks(spark):
    rows = [(0, ["a", "E", "b", "E"]), (1, ["E", "E", "c", "d"]), (2, ["a", "b", "c", "d"]), (3, ["E"]), (4, [])]
    df = spark.createDataFrame(rows, "k long, t array<string>").orderBy("k")
    is_end = lambda x: x == "E"
    assert [r[0] for r in df.select(masks.document_numbers(F.col("t"), is_end)).collect()] == [[0, 0, 1, 1], [0, 1, 2, 2], [0, 0, 0, 0], [0], []]
    o = [r[0] for r in df.where("k < 3").select(masks.offsets(F.col("t"), is_end, F.col("k"), 4)).collect()]
    assert o == [[0, 2], [4, 5, 6], [8]]


def test_masks_match_all_pairs(spark):
    rng = random.Random(12)
    rows = [(k, [rng.choice("ab.E") for _ in range(n)]) for k, n in enumerate([1, 2, 24, 300])]
    df = spark.createDataFrame(rows, "k long, t array<string>")
    numbers = masks.document_numbers(F.col("t"), lambda x: x == "E")
    n = F.size("t")
    cases = {
        "causal": (masks.first_seen(n), lambda d, q, v: True),
        "document": (masks.first_seen(n, numbers), lambda d, q, v: d[q] == d[v]),
        "sliding": (masks.first_seen(n, width=5), lambda d, q, v: q - v < 5),
        "blocks": (masks.first_seen(n, F.transform("t", lambda _, i: F.floor(i / 7)), width=4), lambda d, q, v: q // 7 == v // 7 and q - v < 4),
    }
    docs = {k: [t[:i].count("E") for i in range(len(t))] for k, t in rows}
    for name, (first, sees) in cases.items():
        got = {tuple(r) for r in masks.causal_pairs(df, first, "k").collect()}
        assert got == {(k, q, v) for k, t in rows for q in range(len(t)) for v in range(q + 1) if sees(docs[k], q, v)}, name
    for r in df.select("k", masks.relative(numbers).alias("rel"), masks.run_starts(F.transform("t", lambda x: x == "E")).alias("s"), masks.collapsed(F.col("t")).alias("c")).collect():
        d, t = docs[r["k"]], rows[r["k"]][1]
        assert r["rel"] == [i - d.index(d[i]) for i in range(len(t))]
        assert r["s"] == sum(t[i] == "E" and (i == 0 or t[i - 1] != "E") for i in range(len(t)))
        assert r["c"] == [x for i, x in enumerate(t) if i == 0 or t[i - 1] != x]


@pytest.mark.parametrize("t, h, w, c, ps, ts, m", [(1, 4, 4, 1, 2, 1, 1), (3, 8, 8, 3, 2, 2, 2), (2, 4, 8, 2, 2, 2, 2)])
def test_patches_match_numpy(spark, t, h, w, c, ps, ts, m):
    img = np.arange(t * h * w * c).reshape(t, h, w, c)
    full = np.concatenate([img] + [img[-1:]] * (-t % ts))
    a = full.reshape(-1, ts, h // ps // m, m, ps, w // ps // m, m, ps, c)
    want = a.transpose(0, 2, 5, 3, 6, 8, 1, 4, 7).reshape(-1, c * ts * ps * ps)
    df = spark.createDataFrame([(img.ravel().tolist(),)], "p array<int>")
    assert df.select(vision.patchify(F.col("p"), t, h, w, c, ps, ts, m)).first()[0] == want.tolist()
    raster = df.select(vision.patchify_raster(F.slice("p", 1, h * w * c), h, w, c, ps)).first()[0]
    plain = img[0].reshape(h // ps, ps, w // ps, ps, c).transpose(0, 2, 1, 3, 4).reshape(-1, ps * ps * c)
    assert [r["patch"] for r in raster] == plain.tolist() and [(r["row"], r["column"]) for r in raster] == [(i, j) for i in range(h // ps) for j in range(w // ps)]
    with pytest.raises(ValueError, match="multiples"):
        vision.patchify_raster(F.col("p"), 5, 4, 1, 2)


# --- readers of records


@pytest.mark.parametrize("content, want", [
    ('{"text":"a"}\n\n{bad\n{"text":""}\n{"text":5}\n{"text":"b"}', ["a", "b"]), ('[\n {"text":"a"},\n {"text":"b"}\n]', ["b"]), ('[\n {\n "text": "a"\n },\n {\n "text": "b"\n }\n]', ["a", "b"]), ('[{"text":"a"}]', []), ('{\n"data":[{"text":"a"}]\n}', ["a"]), ('{\n"items": 3,\n"records":[{"text":"a"}]\n}', ["a"]),
    ('{\n"text":"solo"\n}', ["solo"]), ("not json", []), ("", []),
])
def test_json_files_of_any_layout(spark, tmp_path, content, want):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "x.json").write_text(content)
    (tmp_path / "y.txt").write_text('{"text":"no"}')
    got = readers.json_texts(spark, f"file://{tmp_path}").orderBy("ordinal").collect()
    assert [r["text"] for r in got] == want
