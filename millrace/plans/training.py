"""Chat samples, rollouts, routing, masks, metrics, schedules, geometry and shards."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import arrays as A
from millrace.functions import numbers as N
from millrace.functions import text as T
from millrace.functions.hashing import uniform
from millrace.operators import filters, masks, metrics, ordering, packing, rollouts, routing, sharding
from millrace.plans.book import WORDS_SQL, Book, table, uniform_sql

BOOK = Book()
add = BOOK.add
W = WORDS_SQL

# --- chat

PAIR_SQL = """p AS (SELECT conv_id, turn, text AS q, lead(text) OVER w AS a, role, lead(role) OVER w AS next_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))"""


def _pairs(spark, sf):
    """Adjacent user and assistant turns as samples."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf, "conversations").withColumns({"a": F.lead("text").over(w), "next_role": F.lead("role").over(w)})
    return c.where((F.col("role") == "user") & (F.col("next_role") == "assistant")).select("conv_id", "turn", T.qa_messages(F.col("text"), F.col("a")).alias("messages"))


@add(f"WITH {PAIR_SQL} SELECT conv_id, turn, md5(q) AS user_md5, md5(a) AS assistant_md5 FROM p WHERE role = 'user' AND next_role = 'assistant'")
def chat_pairs(spark, sf):
    """P2, P20, P21."""
    m = _pairs(spark, sf).where(T.valid_messages(F.col("messages"))).select("conv_id", "turn", T.checked_messages(F.col("messages")).alias("m"))
    return m.select("conv_id", "turn", F.md5(F.col("m")[0]["content"]).alias("user_md5"), F.md5(F.col("m")[1]["content"]).alias("assistant_md5"))


@add("SELECT conv_id FROM (SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS r FROM conversations GROUP BY conv_id) WHERE r = 'user,assistant'")
def chat_strict(spark, sf):
    """P20: conversations that are exactly a user's and an assistant's turn."""
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    return c.where(T.valid_messages(F.col("m"))).select("conv_id")


@add(f"WITH {PAIR_SQL} SELECT conv_id, turn, 'user' || chr(10) || q || 'assistant' || chr(10) || a AS rendered, 'user' || chr(10) || q || 'assistant' || chr(10) AS prompt FROM p WHERE role = 'user' AND next_role = 'assistant'")
def chat_template(spark, sf):
    """The marks are not defined in the template's setting, so they are empty."""
    m = F.col("messages")
    return _pairs(spark, sf).select("conv_id", "turn", T.render_chat(m).alias("rendered"), T.render_chat(F.slice(m, 1, 1), True).alias("prompt"))


def _chat_samples(spark, sf, length):
    m = F.col("messages")
    d = _pairs(spark, sf).select("conv_id", "turn", T.ensure_eos(T.encode(T.strip_newlines(T.render_chat(m)), eos=False)).alias("t"), F.size(T.encode(T.render_chat(F.slice(m, 1, 1), True), eos=False)).alias("prompt"))
    inputs, labels = A.shifted(F.col("t"))
    return d.where(filters.chat_fits(F.col("t"), length)).select("conv_id", "turn", inputs.alias("inputs"), A.prompt_mask(labels, F.col("prompt"), F.lit("-100")).alias("labels"))


CHAT_SQL = f"""
WITH RECURSIVE {PAIR_SQL},
r AS (SELECT conv_id, turn, list_concat(['<s>'], regexp_extract_all(rtrim('user' || chr(10) || q || 'assistant' || chr(10) || a, chr(10)), '\\S+')) AS t, len(regexp_extract_all('user' || chr(10) || q || 'assistant' || chr(10), '\\S+')) + 1 AS prompt FROM p WHERE role = 'user' AND next_role = 'assistant'),
e AS (SELECT conv_id, turn, prompt, CASE WHEN t[-1] <> '</s>' THEN list_concat(t, ['</s>']) ELSE t END AS t FROM r),
c AS (SELECT conv_id, turn, t[1:len(t) - 1] AS inputs, [CASE WHEN i < least(greatest(prompt - 1, 0), len(t) - 1) THEN '-100' ELSE t[i + 2] END FOR i IN range(0, len(t) - 1)] AS labels FROM e WHERE len(t) - 1 <= 256)
"""


@add(CHAT_SQL + "SELECT conv_id, turn, array_to_string(inputs, ' ') AS inputs, array_to_string(labels, ' ') AS labels FROM c")
def chat_mask(spark, sf):
    """G3, F9, P16, Y1, Y2."""
    return _chat_samples(spark, sf, 256).select("conv_id", "turn", F.array_join("inputs", " ").alias("inputs"), F.array_join("labels", " ").alias("labels"))


@add(CHAT_SQL + """,
s AS (SELECT conv_id % 4 AS shard, conv_id * 1000 + turn AS key, inputs, labels, len(inputs) AS n, row_number() OVER (PARTITION BY conv_id % 4 ORDER BY conv_id, turn) AS rn FROM c),
f AS (SELECT shard, rn, key, n, 0 AS bin, n AS used FROM s WHERE rn = 1
 UNION ALL SELECT s.shard, s.rn, s.key, s.n, CASE WHEN f.used + s.n > 256 OR f.used = 256 THEN f.bin + 1 ELSE f.bin END, CASE WHEN f.used + s.n > 256 OR f.used = 256 THEN s.n ELSE f.used + s.n END FROM f JOIN s ON s.shard = f.shard AND s.rn = f.rn + 1),
g AS (SELECT shard, bin, list(inputs ORDER BY key) AS i, list(labels ORDER BY key) AS l FROM f JOIN s USING (shard, key) GROUP BY shard, bin)
SELECT shard, bin::BIGINT AS bin, len(i)::BIGINT AS n_samples, array_to_string(list_concat(flatten(i), ['</s>' FOR x IN range(0, 256 - len(flatten(i)))]), ' ') AS inputs, array_to_string(list_concat(flatten(l), ['-100' FOR x IN range(0, 256 - len(flatten(l)))]), ' ') AS labels,
 array_to_string(list_concat(flatten([range(0, len(x)) FOR x IN i]), range(0, 256 - len(flatten(i)))), ',') AS positions FROM g""")
def chat_pack(spark, sf):
    """Samples are never split; the rest of a window is filled up with EOS, masked, with positions from 0."""
    s = _chat_samples(spark, sf, 256).withColumns({"shard": F.col("conv_id") % 4, "key": F.col("conv_id") * 1000 + F.col("turn")})
    bins = packing.greedy(s, "shard", "key", F.size("inputs"), 256)
    out = packing.filled(s, bins, 256, F.lit(T.EOS), F.lit("-100"))
    return out.select("shard", "bin", F.col("n_samples").cast("bigint").alias("n_samples"), F.array_join("inputs", " ").alias("inputs"), F.array_join("labels", " ").alias("labels"), F.array_join(F.transform("positions", lambda x: x.cast("string")), ",").alias("positions"))


# --- rollouts

SAID_SQL = """s AS (SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'So [ANSWER] 3 no [ANSWER] ' || doc_id WHEN 1 THEN 'x [ANSWER] -' || doc_id || ' ' WHEN 2 THEN 'The Answer is ' || doc_id || ' or answer: 9 then' WHEN 3 THEN '1 + 2 = ' || doc_id || '. The answer' WHEN 4 THEN 'only 5 and ' || doc_id || ' here' WHEN 5 THEN 'no number' WHEN 6 THEN '[ANSWER] ' || doc_id || ' and more' ELSE '1 = ' || doc_id || '.' END AS c, CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 8 = 1 THEN '-' || doc_id ELSE doc_id::VARCHAR END AS expected FROM documents)"""


def _said(spark, sf):
    d, n = table(spark, sf, "documents"), F.col("doc_id").cast("string")
    k = F.col("doc_id") % 8
    c = (
        F.when(k == 0, F.concat(F.lit("So [ANSWER] 3 no [ANSWER] "), n)).when(k == 1, F.concat(F.lit("x [ANSWER] -"), n, F.lit(" "))).when(k == 2, F.concat(F.lit("The Answer is "), n, F.lit(" or answer: 9 then")))
        .when(k == 3, F.concat(F.lit("1 + 2 = "), n, F.lit(". The answer"))).when(k == 4, F.concat(F.lit("only 5 and "), n, F.lit(" here"))).when(k == 5, F.lit("no number"))
        .when(k == 6, F.concat(F.lit("[ANSWER] "), n, F.lit(" and more"))).otherwise(F.concat(F.lit("1 = "), n, F.lit(".")))
    )
    expected = F.when(F.col("doc_id") % 3 == 0, "").when(k == 1, F.concat(F.lit("-"), n)).otherwise(n)
    return d.select("doc_id", c.alias("c"), expected.alias("expected"))


ANSWER_SQL = """coalesce(regexp_extract_all(c, '\\[ANSWER\\]\\s*(-?\\d+)', 1)[-1], regexp_extract_all(c, '(?i)(?:the answer is|answer is|answer:)\\s*(-?\\d+)', 1)[-1], regexp_extract_all(c, '(?i)=\\s*(-?\\d+)\\.?\\s*(?:The answer|$)', 1)[-1], regexp_extract_all(c, '(-?\\d+)', 1)[-1])::BIGINT"""


@add(f"WITH {SAID_SQL} SELECT doc_id, {ANSWER_SQL} AS answer FROM s")
def extract_answer(spark, sf):
    """F12."""
    return _said(spark, sf).select("doc_id", T.extract_answer(F.col("c")).alias("answer"))


REWARD_SQL = f"""{SAID_SQL}, a AS (SELECT doc_id, c, {ANSWER_SQL} AS answer, coalesce(nullif(expected, '')::BIGINT, 0) AS want FROM s),
r AS (SELECT doc_id, c, answer, CASE WHEN coalesce(answer = want, false) AND len(regexp_extract_all(c, '\\[ANSWER\\]')) = 1 AND regexp_matches(c, '\\[ANSWER\\]\\s*-?\\d+\\s*$') THEN 1.2::DOUBLE WHEN coalesce(answer = want, false) THEN 1.0 ELSE -1.0 END AS reward FROM a)"""


def _rewarded(spark, sf):
    return _said(spark, sf).select("doc_id", "c", T.reward(F.col("c"), F.col("expected")).alias("reward"))


@add(f"WITH {REWARD_SQL} SELECT doc_id, reward FROM r")
def reward_rules(spark, sf):
    """F13, U7, J5."""
    return _rewarded(spark, sf).select("doc_id", "reward")


@add(f"WITH {REWARD_SQL} SELECT doc_id, doc_id // 8 AS group_id, round(reward - avg(reward) OVER (PARTITION BY doc_id // 8), 6) AS advantage FROM r")
def advantages(spark, sf):
    """A21."""
    d = _rewarded(spark, sf).withColumn("group_id", F.floor(F.col("doc_id") / 8))
    return rollouts.advantages(d, "group_id", "reward").select("doc_id", "group_id", F.round("advantage", 6).alias("advantage"))


@add(f"WITH {REWARD_SQL} SELECT doc_id % 5 AS part, round(avg(reward), 6) AS mean, round(stddev_samp(reward), 6) AS std FROM r GROUP BY 1")
def reward_stats(spark, sf):
    """A22."""
    d = _rewarded(spark, sf).withColumn("part", F.col("doc_id") % 5)
    return rollouts.reward_stats(d, "reward", ["part"]).select("part", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@add(f"WITH {REWARD_SQL} SELECT doc_id // 100 AS step, round(avg(reward), 6) AS mean, count_if(reward > 0)::BIGINT AS right_ones, count(*)::BIGINT AS total, round(avg(length(c)), 6) AS avg_length FROM r GROUP BY 1")
def step_summary(spark, sf):
    """A23."""
    return _rewarded(spark, sf).groupBy(F.floor(F.col("doc_id") / 100).alias("step")).agg(F.round(F.avg("reward"), 6).alias("mean"), F.count_if(F.col("reward") > 0).alias("right_ones"), F.count(F.lit(1)).alias("total"), F.round(F.avg(F.length("c")), 6).alias("avg_length"))


@add(f"WITH {REWARD_SQL}, f AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY doc_id // 8 ORDER BY doc_id) = 1) SELECT count(*)::BIGINT AS prompts, round(avg(CASE WHEN reward > 0 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS accuracy, round(avg(CASE WHEN c LIKE '%[ANSWER]%' THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS format_rate FROM f")
def first_per_group(spark, sf):
    """The first completion of each prompt."""
    d = _rewarded(spark, sf).withColumn("g", F.floor(F.col("doc_id") / 8))
    f = ordering.first_per_group(d, ["g"], ["doc_id"])
    return f.agg(F.count(F.lit(1)).alias("prompts"), F.round(F.avg(F.when(F.col("reward") > 0, 1.0).otherwise(0.0)), 6).alias("accuracy"), F.round(F.avg(F.when(F.col("c").contains("[ANSWER]"), 1.0).otherwise(0.0)), 6).alias("format_rate"))


@add("SELECT doc_id, 'steps ' || (doc_id % 9) || ' #### x' AS reasoning, doc_id::VARCHAR AS answer FROM documents")
def qa_reasoning_split(spark, sf):
    """At the last mark."""
    a = F.concat(F.lit(" steps "), (F.col("doc_id") % 9).cast("string"), F.lit(" #### x  #### "), F.col("doc_id").cast("string"), F.lit(" "))
    r, x = T.split_reasoning(a)
    return table(spark, sf, "documents").select("doc_id", r.alias("reasoning"), x.alias("answer"))


SUM_SQL = f"""q AS (SELECT i, [10 + floor({uniform_sql(3, "(i || ':' || j)")} * 90)::BIGINT FOR j IN range(0, 2 + floor({uniform_sql(2, 'i')} * 3)::BIGINT)] AS n FROM range(0, 500) r(i))"""


@add(f"WITH {SUM_SQL} SELECT i AS id, 'What is the total digit sum of [' || array_to_string(n, ', ') || ']?' AS question, list_sum([x // 10 + x % 10 FOR x IN n])::BIGINT AS answer FROM q")
def sum_digits(spark, sf):
    """Two to four numbers from 10 to 99 by seeded draws."""
    from millrace.sources.readers import sum_digit_questions

    return sum_digit_questions(spark, 500).select("id", "question", "answer")


@add("""
WITH l AS (SELECT vec_id, -list_aggregate([abs(x::DOUBLE) FOR x IN embedding], 'avg') AS m, (vec_id % 5) - 2.0 AS a FROM embeddings), r AS (SELECT exp(m) AS r, greatest(least(exp(m), 1.1), 0.9) AS c, a FROM l)
SELECT round(-avg(least(r * a, c * a)), 6) AS pg_loss, round(avg(r), 6) AS ratio_mean, round(avg(CASE WHEN abs(r - c) > 1e-6 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS ratio_clipped_frac FROM r""")
def grpo_surrogate(spark, sf):
    """Embeddings stand for token log-probabilities."""
    e = table(spark, sf, "embeddings").select(F.transform("embedding", lambda x: -F.abs(x.cast("double"))).alias("lp"), ((F.col("vec_id") % 5) - 2.0).alias("a"))
    out = rollouts.surrogate(e, "lp", "a", 0.1)
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@add("""
WITH c AS (SELECT vec_id, unnest(embedding)::DOUBLE AS g, unnest(range(0, 64)) AS i FROM embeddings), t AS (SELECT vec_id, g, g + CASE WHEN vec_id % 4 = 0 AND i % 2 = 0 THEN 0.25 ELSE 0 END AS t, vec_id % 4 = 0 AS d FROM c)
SELECT NOT bool_or(g <> t) AS identical, count(*)::BIGINT AS tokens, count_if(g <> t)::BIGINT AS different, round(max(abs(g - t)) FILTER (WHERE d), 6) AS max_delta, round(avg(abs(g - t)) FILTER (WHERE d), 6) AS avg_delta, round(avg(t - g), 6) AS ratio_mean, round(max(abs(t - g)), 6) AS ratio_max FROM t""")
def logprob_parity(spark, sf):
    """A26."""
    g = F.transform("embedding", lambda x: x.cast("double"))
    t = F.transform(g, lambda x, i: x + F.when((F.col("vec_id") % 4 == 0) & (i % 2 == 0), 0.25).otherwise(0.0))
    out = rollouts.parity(table(spark, sf, "embeddings").select("vec_id", g.alias("g"), t.alias("t")), "g", "t")
    return out.select("identical", "tokens", "different", *[F.round(c, 6).alias(c) for c in ("max_delta", "avg_delta", "ratio_mean", "ratio_max")])


@add(f"""
WITH s AS (SELECT turn, conv_id % 3 AS shard, conv_id, {W} AS w FROM conversations)
SELECT turn, shard, md5(array_to_string(flatten(list(w ORDER BY conv_id)), ' ')) AS tokens_md5, string_agg(least(len(w), 6)::VARCHAR, ',' ORDER BY conv_id) AS prompt_lengths, string_agg(greatest(len(w) - 6, 0)::VARCHAR, ',' ORDER BY conv_id) AS response_lengths FROM s GROUP BY ALL""")
def episode_collation(spark, sf):
    """Each turn is a step; a row's first six words are the prompt, and all others the response."""
    d = table(spark, sf, "conversations").select("conv_id", "turn", T.words(F.col("text")).alias("w"))
    d = d.select("conv_id", "turn", F.slice("w", 1, 6).alias("p"), F.slice("w", F.lit(7), F.greatest(F.size("w") - 6, F.lit(0))).alias("r"))
    out = rollouts.episodes(d, F.struct("turn", (F.col("conv_id") % 3).alias("shard")), "conv_id", "p", "r")
    s = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return out.select("shard.*", F.md5(F.array_join("tokens", " ")).alias("tokens_md5"), s("prompt_lengths"), s("response_lengths"))


@add("""
WITH e AS (SELECT vec_id, [x::DOUBLE FOR x IN embedding] AS v, vec_id % 7 AS start, 3 + vec_id % 4 AS p, 5 AS r FROM embeddings)
SELECT vec_id, round(list_sum(v[start + p:start + p + r - 1]), 5) AS response_sum, len(v[start + p:start + p + r - 1])::BIGINT AS n FROM e""")
def response_slice(spark, sf):
    """What predicts the response begins one before it."""
    e = table(spark, sf, "embeddings").select("vec_id", A.response_slice(F.transform("embedding", lambda x: x.cast("double")), F.col("vec_id") % 7, F.col("vec_id") % 4 + 3, F.lit(5)).alias("v"))
    return e.select("vec_id", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 5).alias("response_sum"), F.size("v").cast("bigint").alias("n"))


# --- routing

E64 = "SELECT vec_id, unnest(range(0, 64)) AS i, unnest(embedding)::DOUBLE AS s FROM embeddings"


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", "embedding")


@add(f"WITH c AS ({E64}), k AS (SELECT vec_id, i, s, row_number() OVER (PARTITION BY vec_id ORDER BY s + (i % 5) * 0.125 DESC, i) AS rn FROM c) SELECT vec_id, rn AS rank, i AS expert, round(s, 6) AS gate FROM k WHERE rn <= 4")
def topk_experts(spark, sf):
    """O3: chosen with a bias, gated without."""
    bias = F.array(*[F.lit((i % 5) * 0.125) for i in range(64)])
    e = _vectors(spark, sf).select("vec_id", F.posexplode(routing.top_k(F.col("embedding"), 4, bias)).alias("r", "x"))
    return e.select("vec_id", (F.col("r") + 1).cast("bigint").alias("rank"), F.col("x.expert").cast("bigint").alias("expert"), F.round("x.gate", 6).alias("gate"))


GROUPED = f"""c AS ({E64}), g AS (SELECT vec_id, i // 8 AS g, sum(s) AS gs FROM (SELECT *, row_number() OVER (PARTITION BY vec_id, i // 8 ORDER BY s DESC) AS rn FROM c) WHERE rn <= 2 GROUP BY vec_id, i // 8),
h AS (SELECT vec_id, g FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY gs DESC, g) AS rn FROM g) WHERE rn <= 3),
k AS (SELECT vec_id, i, s, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, i) AS rn FROM c JOIN h USING (vec_id) WHERE i // 8 = g)"""


@add(f"WITH {GROUPED} SELECT vec_id, string_agg(i::VARCHAR, ',' ORDER BY rn) AS experts FROM k WHERE rn <= 4 GROUP BY vec_id")
def group_limited_topk(spark, sf):
    """Groups by the sum of their two best."""
    s = routing.group_limited(F.col("embedding"), 64, 8, 3)
    return _vectors(spark, sf).select("vec_id", F.array_join(F.transform(routing.top_k(s, 4), lambda x: x["expert"].cast("string")), ",").alias("experts"))


CHOSEN = f"k AS (SELECT vec_id, i AS expert, s AS gate, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, i) AS rn FROM ({E64})), t AS (SELECT * FROM k WHERE rn <= 4)"


def _chosen(spark, sf):
    e = _vectors(spark, sf).select("vec_id", F.explode(routing.top_k(F.col("embedding"), 4)).alias("x"))
    return e.select("vec_id", F.col("x.expert").cast("bigint").alias("expert"), F.col("x.gate").alias("gate"))


def _experts(spark):
    return spark.range(64).withColumnRenamed("id", "expert")


@add(f"WITH {CHOSEN} SELECT e AS expert, count(t.vec_id)::BIGINT AS n FROM range(0, 64) r(e) LEFT JOIN t ON t.expert = e GROUP BY e")
def expert_histogram(spark, sf):
    """A27, M21."""
    return routing.histogram(_chosen(spark, sf), "expert", _experts(spark)).select("expert", "n")


@add(f"WITH {CHOSEN}, n AS (SELECT e AS expert, count(t.vec_id) AS n FROM range(0, 64) r(e) LEFT JOIN t ON t.expert = e GROUP BY e), b AS (SELECT expert, 0.001 * sign(avg(n) OVER () - n) AS d FROM n) SELECT expert, round(d - avg(d) OVER (), 9) AS delta FROM b")
def expert_bias(spark, sf):
    """Steps towards the mean load, centred."""
    return routing.bias_step(routing.histogram(_chosen(spark, sf), "expert", _experts(spark)), 0.001).select("expert", F.round("delta", 9).alias("delta"))


@add(f"WITH {CHOSEN} SELECT vec_id, expert, row_number() OVER (ORDER BY expert, vec_id) - 1 AS place FROM t")
def expert_permutation(spark, sf):
    """Stable order by expert, without a single-task sort."""
    return routing.permutation(_chosen(spark, sf), "expert", ["vec_id"]).select("vec_id", "expert", "place")


@add(f"WITH {CHOSEN} SELECT vec_id, round(sum(gate * (expert + 1)), 5) AS value FROM t GROUP BY vec_id")
def expert_combine(spark, sf):
    """Gathered by expert, processed, and summed back by token."""
    done = _chosen(spark, sf).withColumn("out", F.col("expert") + 1.0)
    return routing.combined(done, "vec_id", "gate", "out").select("vec_id", F.round("value", 5).alias("value"))


@add("SELECT t AS token, j, (t * 4 + j) % 64 AS expert FROM range(0, 200) a(t), range(0, 4) b(j)")
def forced_routing(spark, sf):
    """R13."""
    d = spark.range(200).select(F.col("id").alias("token"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(3).cast("bigint"))).alias("j"))
    return d.select("token", "j", routing.forced(F.col("token"), F.col("j"), 4, 64).alias("expert"))


LOGITS = "l AS (SELECT vec_id, unnest(range(0, 64)) AS i, round(unnest(embedding)::DOUBLE * 4, 0) AS x FROM embeddings), k AS (SELECT *, rank() OVER (PARTITION BY vec_id ORDER BY x DESC) AS r FROM l)"


def _logits():
    return F.transform("embedding", lambda x: F.round(x.cast("double") * 4, 0))


@add(f"WITH {LOGITS}, e AS (SELECT vec_id, i, exp(x / 0.7 - max(x / 0.7) OVER (PARTITION BY vec_id)) AS e FROM k WHERE r <= 5) SELECT vec_id, count(*)::BIGINT AS survivors, round(max(p), 6) AS top_p FROM (SELECT vec_id, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM e) GROUP BY vec_id")
def topk_logits(spark, sf):
    """Ties at the pivot all survive."""
    e = _vectors(spark, sf).select("vec_id", routing.top_logits(_logits(), 5).alias("l"))
    return e.select("vec_id", F.size(F.filter("l", lambda x: x.isNotNull())).cast("bigint").alias("survivors"), F.round(F.array_max(routing.probabilities(F.col("l"), 0.7)), 6).alias("top_p"))


@add(f"WITH l AS (SELECT vec_id, unnest(range(0, 64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), e AS (SELECT vec_id, i, exp(x) / sum(exp(x)) OVER (PARTITION BY vec_id) / -ln({uniform_sql(4, '(vec_id || chr(58) || i)')}) AS s FROM l) SELECT vec_id, arg_max(i, s) AS token FROM e GROUP BY vec_id")
def sampled_token(spark, sf):
    """A race of exponentials."""
    u = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: uniform(4, F.col("vec_id"), i))
    return _vectors(spark, sf).select("vec_id", routing.raced(routing.probabilities(F.col("embedding")), u).cast("bigint").alias("token"))


@add("WITH l AS (SELECT vec_id, unnest(range(0, 64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) SELECT vec_id, round(max(x) FILTER (WHERE i = vec_id % 64) - ln(sum(exp(x))), 5) AS logprob FROM l GROUP BY vec_id")
def gathered_logprob(spark, sf):
    """The log-probability of a given next token."""
    return _vectors(spark, sf).select("vec_id", F.round(F.element_at(routing.log_probabilities(F.col("embedding")), (F.col("vec_id") % 64 + 1).cast("int")), 5).alias("logprob"))


# --- masks

WINDOW = 24

#: Every token of every window of 24 of each text; row is the window's number in the order of documents.
CELL_SQL = f"""t AS (SELECT doc_id, {W} AS t FROM documents),
v AS (SELECT doc_id, t, unnest(range(0, greatest((len(t) + 23) // 24, 1))) AS win FROM t),
r AS (SELECT *, row_number() OVER (ORDER BY doc_id, win) - 1 AS row FROM v),
w AS (SELECT doc_id, win, row, pos, coalesce(t[win * 24 + pos + 1], 'x') AS tok FROM r, range(0, 24) q(pos)),
e AS (SELECT *, CASE WHEN tok LIKE '%.' THEN 1 ELSE 0 END AS eos FROM w),
d AS (SELECT *, coalesce(sum(eos) OVER (PARTITION BY doc_id, win ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS doc_no FROM e)"""
PAIR_SQL = "FROM d a JOIN d b ON a.doc_id = b.doc_id AND a.win = b.win AND a.pos >= b.pos"
IN_ORDER = "(PARTITION BY doc_id, win ORDER BY pos)"


def _token_windows(spark, sf):
    """(doc_id, window, t): each whole text in consecutive windows of WINDOW tokens, of which the last is filled up; an empty text is one window of
    filler."""
    d = table(spark, sf, "documents").select("doc_id", T.words(F.col("text")).alias("w"))
    starts = A.upto(F.greatest(F.ceil(F.size("w") / WINDOW), F.lit(1)))
    cut = F.transform(starts, lambda i: A.fitted(F.slice("w", i * WINDOW + 1, F.lit(WINDOW)), WINDOW, F.lit("x")))
    d = d.select("doc_id", F.posexplode(cut).alias("window", "t"))
    return d.select("doc_id", F.col("window").cast("bigint").alias("window"), "t")


def _ends(token):
    return token.endswith(".")


def _numbers():
    return masks.document_numbers(F.col("t"), _ends)


def _seen(spark, sf, first):
    """(doc_id, window, q, low): a row per query position, with the first position that it sees."""
    return _token_windows(spark, sf).select("doc_id", "window", F.posexplode(first).alias("q", "low")).select("doc_id", "window", F.col("q").cast("bigint").alias("q"), F.col("low").cast("bigint").alias("low"))


@add(f"WITH {CELL_SQL} SELECT doc_id, win AS window, pos, doc_no FROM d")
def doc_index(spark, sf):
    """Sentences stand for documents."""
    d = _token_windows(spark, sf).select("doc_id", "window", F.posexplode(_numbers()).alias("pos", "doc_no"))
    return d.select("doc_id", "window", F.col("pos").cast("bigint").alias("pos"), "doc_no")


@add(f"WITH {CELL_SQL}, o AS (SELECT doc_id, win, row, 0 AS s FROM d WHERE pos = 0 UNION SELECT doc_id, win, row, pos + 1 FROM d WHERE eos = 1 AND pos < 23) SELECT doc_id, win AS window, string_agg((row * 24 + s)::VARCHAR, ',' ORDER BY s) AS offsets FROM o GROUP BY ALL")
def cu_seqlens(spark, sf):
    """The rows of the flat batch are all windows in the order of documents."""
    n = table(spark, sf, "documents").select("doc_id", F.greatest(F.ceil(T.token_count(F.col("text")) / WINDOW), F.lit(1)).alias("n"))
    first = ordering.prefix_sum(n, "doc_id", F.col("n"), "first").select("doc_id", "first")
    d = _token_windows(spark, sf).join(first, "doc_id")
    o = masks.offsets(F.col("t"), _ends, F.col("first") + F.col("window"), WINDOW)
    return d.select("doc_id", "window", F.array_join(F.transform(o, lambda x: x.cast("string")), ",").alias("offsets"))


@add(f"WITH {CELL_SQL} SELECT a.doc_id, a.win AS window, count(*)::BIGINT AS pairs {PAIR_SQL} GROUP BY ALL")
def causal_mask_count(spark, sf):
    """J8."""
    seen = F.transform(masks.first_seen(F.size("t")), lambda low, q: (q - low + 1).cast("bigint"))
    return _token_windows(spark, sf).select("doc_id", "window", F.aggregate(seen, F.lit(0).cast("bigint"), lambda s, x: s + x).alias("pairs"))


@add(f"WITH {CELL_SQL} SELECT a.doc_id, a.win AS window, a.pos AS q, min(b.pos) AS first_kv, count(*)::BIGINT AS n {PAIR_SQL} AND a.pos - b.pos < 5 GROUP BY ALL")
def sliding_window_pairs(spark, sf):
    """J9."""
    d = _seen(spark, sf, masks.first_seen(F.size("t"), width=5))
    return d.select("doc_id", "window", "q", F.col("low").alias("first_kv"), (F.col("q") - F.col("low") + 1).alias("n"))


@add(f"WITH {CELL_SQL} SELECT a.doc_id, a.win AS window, a.pos AS q, count(*)::BIGINT AS n, sum(b.pos)::BIGINT AS kv_sum {PAIR_SQL} AND a.doc_no = b.doc_no GROUP BY ALL")
def document_mask_pairs(spark, sf):
    """Causal and within a document. What a query sees is a range, so its number and sum follow from the ends."""
    d = _seen(spark, sf, masks.first_seen(F.size("t"), _numbers()))
    n = F.col("q") - F.col("low") + 1
    return d.select("doc_id", "window", "q", n.alias("n"), F.shiftright((F.col("q") + F.col("low")) * n, 1).alias("kv_sum"))


@add(f"WITH {CELL_SQL} SELECT a.doc_id, a.win AS window, a.pos AS q, count(*)::BIGINT AS n {PAIR_SQL} AND a.pos // 7 = b.pos // 7 GROUP BY ALL")
def fixed_block_pairs(spark, sf):
    """Causal and within blocks of seven."""
    blocks = F.transform("t", lambda _, i: F.floor(i / 7))
    return _seen(spark, sf, masks.first_seen(F.size("t"), blocks)).select("doc_id", "window", "q", (F.col("q") - F.col("low") + 1).alias("n"))


@add(f"WITH {CELL_SQL}, p AS (SELECT *, pos - min(pos) OVER (PARTITION BY doc_id, win, doc_no) AS rel, eos = 1 AS m FROM d), l AS (SELECT *, rel < lag(rel) OVER {IN_ORDER} AS fresh, m AND NOT coalesce(lag(m) OVER {IN_ORDER}, false) AS starts, eos IS DISTINCT FROM lag(eos) OVER {IN_ORDER} AS kept FROM p) SELECT doc_id, win AS window, count_if(fresh)::BIGINT AS n_resets, count_if(starts)::BIGINT AS n_runs, count_if(kept)::BIGINT AS n_collapsed FROM l GROUP BY ALL")
def reset_and_run_detection(spark, sf):
    """Positions that restart, runs that begin, repeats collapsed."""
    d = _token_windows(spark, sf).select("doc_id", "window", masks.relative(_numbers()).alias("rel"), F.transform("t", _ends).alias("m"))
    n = {"n_resets": masks.resets(F.col("rel")), "n_runs": masks.run_starts(F.col("m")), "n_collapsed": F.size(masks.collapsed(F.col("m")))}
    return d.select("doc_id", "window", *[c.cast("bigint").alias(k) for k, c in n.items()])


# --- metrics

EV = "e AS (SELECT dayofyear(ts)::BIGINT AS step, user_id % 4 AS rank, value AS loss, CASE WHEN event_type = 'click' THEN 0 ELSE 1 END AS mask, (event_id % 9 + 1) AS valid, event_id, value FROM events)"


def _events(spark, sf):
    e = table(spark, sf, "events")
    return e.select(F.dayofyear("ts").cast("bigint").alias("step"), (F.col("user_id") % 4).alias("rank"), F.col("value").alias("loss"), F.when(F.col("event_type") == "click", 0).otherwise(1).alias("mask"), (F.col("event_id") % 9 + 1).alias("valid"), "event_id", "value")


@add(f"WITH {EV} SELECT step, round(sum(loss) / sum(valid), 6) AS avg_loss, round(max(r), 6) AS max_loss, round(avg(r), 6) AS mean_of_means FROM (SELECT step, rank, sum(loss) AS loss, sum(valid) AS valid, sum(loss) / sum(valid) AS r FROM e GROUP BY step, rank) GROUP BY step")
def global_vs_mean_loss(spark, sf):
    """Weighted by tokens, the largest rank's, and the mean of batch means."""
    out = metrics.losses(_events(spark, sf), ["step"], "rank", "loss", "valid")
    return out.select("step", *[F.round(c, 6).alias(c) for c in ("avg_loss", "max_loss", "mean_of_means")])


@add(f"WITH {EV} SELECT rank, round(sum(loss * mask) / greatest(sum(mask), 1), 6) AS masked_mean, round(sum((loss - valid) * (loss - valid)), 4) AS squared, round(sum(CASE WHEN mask = 1 THEN loss END), 4) AS masked_sum FROM e GROUP BY rank")
def masked_ce(spark, sf):
    """A9, A15, A16."""
    d = F.col("loss") - F.col("valid")
    return _events(spark, sf).groupBy("rank").agg(F.round(metrics.masked_mean(F.col("loss"), F.col("mask")), 6).alias("masked_mean"), F.round(F.sum(d * d), 4).alias("squared"), F.round(F.sum(F.when(F.col("mask") == 1, F.col("loss"))), 4).alias("masked_sum"))


@add(f"SELECT source, sum(len({W}) - len([x FOR x IN {W} IF x IN ('the', 'la')]))::BIGINT AS valid, sum(len({W}))::BIGINT AS seen FROM documents GROUP BY source")
def masked_token_count(spark, sf):
    """Valid labels, and all tokens seen."""
    d = table(spark, sf, "documents").select("source", F.transform(T.words(F.col("text")), lambda x: F.when(x.isin("the", "la"), A.IGNORE).otherwise(1)).alias("l"))
    return d.groupBy("source").agg(F.sum(A.count_valid(F.col("l"))).alias("valid"), F.sum(F.size("l")).alias("seen"))


@add(f"WITH {EV}, t AS (SELECT step, sum(valid * 1000) AS tokens, max(value) AS seconds, avg(loss) / 100 AS loading, sum(loss) / 100 AS loaded FROM e GROUP BY step) SELECT step, round(tokens / (seconds * 2), 5) AS tps, round(6.0e9 * (tokens / (seconds * 2)) / 1e12, 8) AS tflops, round(6.0e11 * (tokens / (seconds * 2)) / 989e12, 8) AS mfu, round(seconds / 10, 6) AS end_to_end, round(loading, 6) AS data_loading, round(100 * loaded / seconds, 5) AS data_loading_pct FROM t")
def throughput_metrics(spark, sf):
    """A29, A33, M9."""
    t = _events(spark, sf).groupBy("step").agg(F.sum(F.col("valid") * 1000).alias("tokens"), F.max("value").alias("seconds"), (F.avg("loss") / 100).alias("loading"), (F.sum("loss") / 100).alias("loaded"))
    m = N.throughput(F.col("tokens"), F.col("seconds"), 2, 6.0e9, 989e12)
    return t.select("step", F.round(m["tps"], 5).alias("tps"), F.round(m["tflops"], 8).alias("tflops"), F.round(m["mfu"], 8).alias("mfu"), F.round(F.col("seconds") / 10, 6).alias("end_to_end"), F.round("loading", 6).alias("data_loading"), F.round(100 * F.col("loaded") / F.col("seconds"), 5).alias("data_loading_pct"))


@add("SELECT s AS step FROM range(1, 101) r(s) WHERE s = 1 OR s % 10 = 0")
def log_step_gate(spark, sf):
    """P26, P30."""
    return spark.range(1, 101).withColumnRenamed("id", "step").where(filters.log_step(F.col("step"), 10))


@add(f"WITH {EV}, m AS (SELECT step, avg(loss) AS loss, sum(valid)::DOUBLE AS valid FROM e GROUP BY step) SELECT step, 'train/loss' AS name, round(loss, 6) AS value FROM m UNION ALL SELECT step, 'train/valid', valid FROM m")
def metric_rows(spark, sf):
    """Long metric rows under a tag."""
    m = _events(spark, sf).groupBy("step").agg(F.avg("loss").alias("loss"), F.sum("valid").alias("valid"))
    return metrics.long_format(m, ["step"], ["loss", "valid"], "train").select("step", "name", F.round("value", 6).alias("value"))


RUNS = f"{EV}, a AS (SELECT step, avg(loss) AS loss FROM e WHERE rank < 2 AND step <> 7 GROUP BY step), b AS (SELECT step, avg(loss) AS loss FROM e WHERE rank >= 2 AND step <> 11 GROUP BY step)"


def _runs(spark, sf):
    e = _events(spark, sf)
    return tuple(e.where(c).groupBy("step").agg(F.avg("loss").alias("loss")) for c in ("rank < 2 AND step <> 7", "rank >= 2 AND step <> 11"))


@add(f"WITH {RUNS} SELECT step, round(a.loss, 6) AS baseline, round(b.loss, 6) AS test, round(b.loss - a.loss, 6) AS diff FROM a JOIN b USING (step)")
def loss_compare(spark, sf):
    """J3, X2."""
    out = metrics.compared(*_runs(spark, sf))
    return out.select("step", *[F.round(c, 6).alias(c) for c in ("baseline", "test", "diff")])


@add(f"WITH {RUNS} SELECT coalesce(a.step, b.step) AS step, CASE WHEN b.step IS NULL THEN 'baseline' ELSE 'test' END AS only_in FROM a FULL JOIN b ON a.step = b.step WHERE a.step IS NULL OR b.step IS NULL")
def step_set_diff(spark, sf):
    """J4, X3."""
    return metrics.only_one(*_runs(spark, sf))


@add(f"WITH {RUNS} SELECT round((SELECT avg(loss) FROM a), 6) AS baseline, (SELECT count(*) FROM a)::BIGINT AS n_baseline, round((SELECT avg(loss) FROM b), 6) AS test, (SELECT count(*) FROM b)::BIGINT AS n_test, round((SELECT avg(loss) FROM b) - (SELECT avg(loss) FROM a), 6) AS diff")
def run_averages(spark, sf):
    """Each over its own steps."""
    out = metrics.run_averages(*_runs(spark, sf))
    return out.select("n_baseline", "n_test", *[F.round(c, 6).alias(c) for c in ("baseline", "test", "diff")])


# --- schedules and geometry


@add("""
SELECT s AS step, round(CASE WHEN s < 10 THEN (s + 1) / 10.0 WHEN s < 61 THEN 1.0 ELSE 0.1 + 0.9 * (1 - (s + 1 - 61) / 40.0) END, 9)::DOUBLE AS linear,
 round(CASE WHEN s < 10 THEN (s + 1) / 10.0 WHEN s < 61 THEN 1.0 ELSE 1 - sqrt((s + 1 - 61) / 40.0) END, 9)::DOUBLE AS root, round(CASE WHEN s < 10 THEN (s + 1) / 10.0 WHEN s < 61 THEN 1.0 ELSE 0.5 * (1 + cos(pi() * (s + 1 - 61) / 40.0)) END, 9)::DOUBLE AS cosine,
 round(CASE WHEN s < 10 THEN (s + 1) / 10.0 WHEN s < 11 THEN 1.0 ELSE 1 - (s + 1 - 11) / 90.0 END, 9)::DOUBLE AS no_stable FROM range(0, 100) r(s)""")
def lr_schedule(spark, sf):
    """M6."""
    s = F.col("step")
    d = spark.range(100).withColumnRenamed("id", "step")
    return d.select("step", F.round(N.lr_factor(s, 100, 10, 0.4, "linear", 0.1), 9).alias("linear"), F.round(N.lr_factor(s, 100, 10, 0.4, "sqrt"), 9).alias("root"), F.round(N.lr_factor(s, 100, 10, 0.4, "cosine"), 9).alias("cosine"), F.round(N.lr_factor(s, 100, 10), 9).alias("no_stable"))


@add("SELECT doc_id, ((row_number() OVER (ORDER BY doc_id) - 1) % 8 + 0.5)::DOUBLE / 8 AS t FROM documents")
def timestep_cycle(spark, sf):
    """Round-robin over eight timesteps."""
    d = ordering.ordinal(table(spark, sf, "documents").select("doc_id"), "doc_id", "o")
    return d.select("doc_id", ((F.col("o") % 8 + 0.5) / 8).alias("t"))


@add("WITH g AS (SELECT l, i, 1 - i / 20.0::DOUBLE AS t, exp(0.65 / 3840 * l + 0.5 - 0.65 / 3840 * 256) AS m FROM (SELECT unnest([256, 1024, 4096]) AS l), range(0, 21) r(i)) SELECT l::BIGINT AS length, i AS point, round(CASE WHEN t > 0 THEN m / (m + (1 / t - 1)) ELSE 0 END, 8)::DOUBLE AS t FROM g")
def time_shift(spark, sf):
    """M13."""
    d = spark.range(21).select(F.col("id").alias("point"), F.explode(F.array(*[F.lit(x).cast("bigint") for x in (256, 1024, 4096)])).alias("length"))
    return d.select("length", "point", F.round(N.time_shift(1 - F.col("point") / 20, N.shift_mu(F.col("length"))), 8).alias("t"))


GRID = "g AS (SELECT (10 + h * 37)::BIGINT AS h, (10 + w * 53)::BIGINT AS w FROM range(0, 40) a(h), range(0, 40) b(w))"


def _grid(spark):
    d = spark.range(40).select((F.col("id") * 37 + 10).alias("h"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(39).cast("bigint"))).alias("k"))
    return d.select("h", (F.col("k") * 53 + 10).alias("w"))


@add(f"""WITH {GRID}, b AS (SELECT h, w, greatest(round_even(h / 32.0::DOUBLE, 0) * 32, 32) AS hb, greatest(round_even(w / 32.0::DOUBLE, 0) * 32, 32) AS wb FROM g WHERE greatest(h, w) <= 200 * least(h, w))
SELECT h, w, (CASE WHEN hb * wb > 600000 THEN greatest(floor(h / sqrt(h * w / 600000.0::DOUBLE) / 32) * 32, 32) WHEN hb * wb < 20000 THEN ceil(h * sqrt(20000.0::DOUBLE / (h * w)) / 32) * 32 ELSE hb END)::BIGINT AS new_h,
 (CASE WHEN hb * wb > 600000 THEN greatest(floor(w / sqrt(h * w / 600000.0::DOUBLE) / 32) * 32, 32) WHEN hb * wb < 20000 THEN ceil(w * sqrt(20000.0::DOUBLE / (h * w)) / 32) * 32 ELSE wb END)::BIGINT AS new_w FROM b""")
def smart_resize(spark, sf):
    """M1."""
    g = _grid(spark).where(F.greatest("h", "w") <= 200 * F.least("h", "w"))
    h, w = N.smart_resize(F.col("h"), F.col("w"), 32, 20000, 600000)
    return g.select("h", "w", h.alias("new_h"), w.alias("new_w"))


@add(f"WITH {GRID}, s AS (SELECT h, w, greatest(28.0::DOUBLE / h, 28.0::DOUBLE / w) AS k FROM g) SELECT h, w, CASE WHEN h < 28 OR w < 28 THEN floor(h * k) ELSE h END::BIGINT AS new_h, CASE WHEN h < 28 OR w < 28 THEN floor(w * k) ELSE w END::BIGINT AS new_w FROM s")
def tiny_prescale(spark, sf):
    """M2."""
    h, w = N.prescaled(F.col("h"), F.col("w"), 28)
    return _grid(spark).select("h", "w", h.alias("new_h"), w.alias("new_w"))


@add(f"""WITH {GRID}, a AS (SELECT h, w, h * w // 1024 AS n FROM g), s AS (SELECT h, w, CASE WHEN n = 0 THEN greatest(32.0::DOUBLE / w, 32.0::DOUBLE / h) WHEN n < 1 THEN sqrt(1.0::DOUBLE / n) WHEN n <= 300 THEN 1.0 ELSE sqrt(300.0::DOUBLE / n) END AS k FROM a),
x AS (SELECT h, w, floor(h * k) AS h1, floor(w * k) AS w1 FROM s), r AS (SELECT *, round_even(h1 / 32, 0) * 32 AS hb, round_even(w1 / 32, 0) * 32 AS wb FROM x), p AS (SELECT *, floor(hb * wb / 1024) AS n2, sqrt(hb * wb / 307200.0::DOUBLE) AS beta FROM r)
SELECT h, w, CASE WHEN n2 > 300 THEN floor(h1 / beta / 32) * 32 WHEN n2 < 1 THEN ceil(h1 / 32) * 32 ELSE hb END::BIGINT AS new_h, CASE WHEN n2 > 300 THEN floor(w1 / beta / 32) * 32 WHEN n2 < 1 THEN ceil(w1 / 32) * 32 ELSE wb END::BIGINT AS new_w FROM p""")
def legacy_resize(spark, sf):
    """M4, M24."""
    h, w = N.legacy_resize(F.col("h"), F.col("w"), 32, 300)
    return _grid(spark).select("h", "w", h.alias("new_h"), w.alias("new_w"))


@add(f"WITH {GRID} SELECT h, w, (ceil((h % 9 + 1) / 2.0) * (w // 28) * (h // 28))::BIGINT AS tokens, (w // 28)::BIGINT AS per_row, (h // 28)::BIGINT AS n_rows FROM g")
def vision_tokens(spark, sf):
    """M3."""
    t, r, n = N.vision_tokens(F.col("h") % 9 + 1, F.col("h"), F.col("w"), 14, 2, 2)
    return _grid(spark).select("h", "w", t.alias("tokens"), r.alias("per_row"), n.alias("n_rows"))


@add("""WITH v AS (SELECT t AS total, f AS fps, least(greatest(least(floor(t / f * 2.0), 64), 4), t)::BIGINT AS n FROM (SELECT unnest(range(1, 400, 7)) AS t), (SELECT unnest([24.0::DOUBLE, 30.0, 12.5]) AS f)),
i AS (SELECT total, fps, n, CASE WHEN n = 1 THEN 0 WHEN k = n - 1 THEN total - 1 ELSE floor(k * ((total - 1)::DOUBLE / (n - 1))) END::BIGINT AS x FROM (SELECT *, unnest(range(0, n)) AS k FROM v))
SELECT total, fps, string_agg(DISTINCT x::VARCHAR, ',' ORDER BY x::VARCHAR) AS frames FROM i GROUP BY total, fps""")
def frame_indices(spark, sf):
    """M5, S20."""
    d = spark.range(1, 400, 7).select(F.col("id").alias("total"), F.explode(F.array(*map(F.lit, (24.0, 30.0, 12.5)))).alias("fps"))
    x = N.frame_indices(F.col("total"), F.col("fps"), 2.0, 4, 64)
    return d.select("total", "fps", F.array_join(F.array_sort(F.transform(x, lambda y: y.cast("string"))), ",").alias("frames"))


@add(f"WITH {GRID} SELECT h, w, CASE WHEN w >= h THEN 256 ELSE ceil(256.0::DOUBLE / w * h) END::BIGINT AS new_h, CASE WHEN w >= h THEN ceil(256.0::DOUBLE / h * w) ELSE 256 END::BIGINT AS new_w FROM g WHERE h >= 256 AND w >= 256")
def crop_extents(spark, sf):
    """M16, P19."""
    h, w, _ = N.crop_extents(F.col("h"), F.col("w"), 256)
    return _grid(spark).select("h", "w", h.alias("new_h"), w.alias("new_w")).where("new_h IS NOT NULL")


@add("SELECT l AS local, d AS degree, l * d AS default_global, l * d * 3 AS whole, 3::BIGINT AS steps, 16 // d AS inferred FROM (SELECT unnest([1, 2, 8])::BIGINT AS l), (SELECT unnest([1, 2, 4])::BIGINT AS d)")
def batch_arithmetic(spark, sf):
    """M7, M8."""
    d = spark.createDataFrame([(a, b) for a in (1, 2, 8) for b in (1, 2, 4)], "local long, degree long")
    lo, de = F.col("local"), F.col("degree")
    return d.select("local", "degree", N.batch_plan(lo, de, F.lit(None).cast("bigint"))[0].alias("default_global"), N.batch_plan(lo, de, lo * de * 3)[0].alias("whole"), N.batch_plan(lo, de, lo * de * 3)[1].alias("steps"), N.inferred_degree(F.lit(-1), F.lit(16), de).alias("inferred"))


@add("SELECT vec_id, round(list_sum([(x::DOUBLE / 255 - 0.5) / 0.25 FOR x IN embedding]), 5) AS normalised, round(list_sum([0.75 * x::DOUBLE + 0.25 * 0.5 FOR x IN embedding]), 5) AS mixed, round(list_sum([1.0 + 3.0 * (x::DOUBLE - 1.0) FOR x IN embedding]), 5) AS guided FROM embeddings")
def pixel_scalars(spark, sf):
    """M14, M15, M23."""
    total = lambda f: F.round(F.aggregate(F.transform("embedding", f), F.lit(0.0), lambda s, x: s + x), 5)
    x = lambda v: v.cast("double")
    return table(spark, sf, "embeddings").select("vec_id", total(lambda v: (x(v) / 255 - 0.5) / 0.25).alias("normalised"), total(lambda v: x(v) * 0.75 + 0.125).alias("mixed"), total(lambda v: (x(v) - 1.0) * 3.0 + 1.0).alias("guided"))


# --- shards


@add("WITH n AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS o, count(*) OVER () AS n FROM documents) SELECT doc_id, o // ceil(n / 7.0)::BIGINT AS shard FROM n")
def shard_contiguous(spark, sf):
    """H1, H4, H9."""
    return sharding.contiguous(table(spark, sf, "documents").select("doc_id"), "doc_id", 7).select("doc_id", "shard")


@add("SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) % 7 AS shard FROM documents")
def shard_strided(spark, sf):
    """H1, H3."""
    return sharding.strided(table(spark, sf, "documents").select("doc_id"), "doc_id", 7).select("doc_id", "shard")


@add("SELECT d AS replica, r AS rank, 4 * d + r AS global_rank, 12::BIGINT AS world FROM range(0, 3) a(d), range(0, 4) b(r)")
def ft_rank_map(spark, sf):
    """H5."""
    d = spark.range(12).select(F.floor(F.col("id") / 4).alias("replica"), (F.col("id") % 4).alias("rank"))
    g, w = sharding.nested_rank(F.col("rank"), 4, F.col("replica"), 3)
    return d.select("replica", "rank", g.alias("global_rank"), w.cast("bigint").alias("world"))


@add("""SELECT vec_id, r AS rank, round(list_sum([x::DOUBLE FOR x IN list_concat(embedding[r * 8 + 1:r * 8 + 8], embedding[(7 - r) * 8 + 1:(7 - r) * 8 + 8])]), 5) AS head_tail, round(list_sum([x::DOUBLE FOR x IN embedding[r * 16 + 1:r * 16 + 16]]), 5) AS plain FROM embeddings, range(0, 4) q(r)""")
def sequence_shards(spark, sf):
    """Contiguous slices, and head-and-tail pairs that even out causal work."""
    e = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(3).cast("bigint"))).alias("rank"))
    total = lambda v: F.round(F.aggregate(v, F.lit(0.0), lambda s, x: s + x), 5)
    return e.select("vec_id", "rank", total(sharding.head_tail(F.col("v"), F.col("rank"), 4)).alias("head_tail"), total(sharding.slice_of(F.col("v"), F.col("rank"), 4)).alias("plain"))
