"""Mixing sources to target weights: a classifier's domain posteriors, and document rates by projected-gradient least squares.

A classifier trained on a labelled table (at most MOST_LABELLED of its rows, those first by digest) gives each document soft membership of the
domains. A document's rate r >= 0 says how often it is read. With t tokens and posteriors p, domain d is expected to give S_d = sum of
r * t * p_d tokens. The rates minimise the sum over domains of (S_d - T_d)^2 / N_d, where T_d is the domain's target and N_d what it has
at rate 1. Each step is a gradient step of size 1 (in these units the curvature is at most 1) and a projection to r >= 0; only the domains'
sums come to the driver. Steps are taken from rates moved on by momentum, whose sums follow from those of the rates, so a round is one
aggregate. It folds the steps since rates were last written, STEPS at most; then rates are written anew, so that a round's work does not
grow with the rounds before it. Rounds end when all targets are met, or when the loss has settled (targets that no rates meet: then the residual is
close to the least there is); a fit that does neither within `rounds` raises.

Domains and their target weights are given by the caller. A domain of weight 0 is aimed at 0, where the projection holds its documents' rates.

Cases: a null or empty text has no tokens and the model's posteriors of an empty text; its rate does not matter and is fitted like any other. A
domain without target weight is aimed at 0; a target without documents is left out of the fit. Without labelled rows there is one
domain, "all". Repeated rows each get their rate; a null doc_id is returned as null. An empty table gives an empty result. Extra columns are
ignored by rates() and kept by mixed(). Texts are read whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import shared

DIMENSIONS, MOST_LABELLED = 2048, 2000
#: Target shares of tokens by domain, as the queries use them. What is of low quality in any language is a domain to be CUT to one token in 200: about
#: what soft membership gives all texts, so that rates of texts that are surely of it go to 0.
WEIGHTS = {"en": 0.55, "fr": 0.16, "de": 0.16, "es": 0.125, "low": 0.005}
CUT = ("low",)
#: Steps that a round folds at most, and rounds within which a settled loss falls by less than SETTLED of what it was at first.
STEPS, PATIENCE, SETTLED = 8, 5, 1e-4


def vector(text: bytes) -> np.ndarray:
    """Hashed counts of byte pairs, square-rooted, of length 1; zeros without any."""
    b = np.frombuffer(text, np.uint8)
    out = np.zeros(DIMENSIONS)
    for at in range(0, len(b) - 1, 1 << 20):
        x = b[at : at + (1 << 20) + 1].astype(np.int32)
        out += np.bincount((x[:-1] * 61 + x[1:] * 7919) % DIMENSIONS, minlength=DIMENSIONS)
    out = np.sqrt(out)
    return out / max(float(np.linalg.norm(out)), 1e-12)


def train(labelled: DataFrame, most: int = MOST_LABELLED, rounds: int = 80, rate: float = 4.0, momentum: float = 0.9, decay: float = 1e-4) -> tuple[list[str], np.ndarray]:
    """(domains, weights of DIMENSIONS + 1 by domain) by gradient descent with momentum on softmax regression. labelled: (text, domain)."""
    rows = labelled.where(F.col("domain").isNotNull() & F.col("text").isNotNull()).select("text", "domain")
    keys = rows.select(F.xxhash64("text").alias("h"), "domain")
    vectors = shared.per_text(lambda t: vector(t).astype("<f4").tobytes(), "binary", pa.binary())
    taken = sorted(shared.bounded_sample(rows.select("text"), keys, most).select("h", "domain", vectors.alias("v")).collect())
    domains = sorted({r["domain"] for r in taken}) or ["all"]
    w = np.zeros((DIMENSIONS + 1, len(domains)), np.float32)
    if len(domains) == 1:
        return domains, w
    x = np.ones((len(taken), DIMENSIONS + 1), np.float32)
    for i, r in enumerate(taken):
        x[i, :-1] = np.frombuffer(r["v"], "<f4")
    y, v = np.zeros((len(taken), len(domains)), np.float32), np.zeros_like(w)
    y[np.arange(len(taken)), [domains.index(r["domain"]) for r in taken]] = 1
    for _ in range(rounds):
        z = x @ w
        z = np.exp(z - z.max(axis=1, keepdims=True))
        v = momentum * v - rate * (x.T @ (z / z.sum(axis=1, keepdims=True) - y) / len(x) + decay * w)
        w += v
    return domains, w


def members(domains: list[str], w: np.ndarray, text: str | Column = "text") -> Column:
    """struct<n_tokens, p>: the words of a text, and its domain posteriors."""
    weights = w.astype(np.float32)

    def one(t: bytes) -> dict:
        z = (np.r_[vector(t), 1.0].astype(np.float32) @ weights).astype(np.float64)
        z = np.exp(z - z.max())
        return {"n_tokens": len(t.split()), "p": z / z.sum()}

    return shared.per_text(one, "struct<n_tokens:bigint,p:array<double>>", pa.struct([("n_tokens", pa.int64()), ("p", pa.list_(pa.float64()))]), text)


def moved(state: Column, p: Column, steps: list[list[float]]) -> Column:
    """struct<rate, before> after these steps, each of which is (momentum, residual by domain): rates move on by the momentum, and the
    posterior-weighted residual is taken off and the result projected to 0 or more."""
    if not steps:
        return state
    table = F.array(*[F.array(*map(F.lit, s)) for s in steps])

    def step(s: Column, e: Column) -> Column:
        off = F.aggregate(F.zip_with(p, F.slice(e, 2, F.size(p)), lambda a, b: a * b), F.lit(0.0), lambda total, x: total + x)
        return F.struct(F.greatest(F.lit(0.0), s["rate"] + e[0] * (s["rate"] - s["before"]) - off).alias("rate"), s["rate"].alias("before"))

    return F.aggregate(table, state, step)


def first_state() -> Column:
    return F.struct(F.lit(1.0).alias("rate"), F.lit(1.0).alias("before"))


def folded(p: Column, steps: list[list[float]]) -> Column:
    """The rate after all steps."""
    return moved(first_state(), p, steps)["rate"]


def fit(member: DataFrame, domains: list[str], weights: dict[str, float], total: float | None = None, rounds: int = 1000, tolerance: float = 1e-4, unlisted: bool = False, cut: tuple[str, ...] = CUT, settled: float = SETTLED) -> tuple[list[list[float]], dict[str, tuple[float, float]]]:
    """The steps, from (n_tokens, p), which fold to the rates; and of each domain what it gets and what it is to get. total: tokens aimed at; None: as
    few as let no domain with weight that is not to be cut be read less than once, and one in a hundred more, for the fit's tolerance. unlisted: domains that weights lacks
    are aimed at their share of the tokens at hand, and the weights divide the rest."""
    sums = lambda r: [F.coalesce(F.sum(r * F.col("n_tokens") * F.element_at("p", d + 1)), F.lit(0.0)).alias(f"s{d}") for d in range(len(domains))]
    have = np.array(list(member.agg(*sums(F.lit(1.0))).first()), float)
    share = np.array([weights.get(d, 0.0) for d in domains])
    share = share / share.sum() if share.sum() > 0 else np.full(len(domains), 1 / len(domains))
    rest = np.array([unlisted and d not in weights for d in domains])
    if rest.any() and have.sum() > 0:
        share = np.where(rest, have / have.sum(), share * (1 - have[rest].sum() / have.sum()) if not rest.all() else 0.0)
    if total is None:
        total = 1.01 * float(max((n / s for n, s, d in zip(have, share, domains, strict=True) if s > 0 and d not in cut), default=0.0))
    target, scale = share * total, np.where(have > 0, have, 1.0)
    now, before, losses, steps, done, pace = have, have, [], [], 0, 1.0
    held = member.select("n_tokens", "p", first_state().alias("state"))
    for _ in range(rounds):
        off = np.where(have > 0, now - target, 0.0)
        losses.append(float((off**2 / scale).sum()))
        still = len(losses) > PATIENCE and min(losses[:-PATIENCE]) - min(losses) <= settled * losses[0]
        if np.abs(off).max(initial=0) <= tolerance * max(total, 1e-12) or still:
            return steps, dict(zip(domains, zip(now.tolist(), target.tolist(), strict=True), strict=True))
        if len(steps) - done == STEPS:
            new = shared.written(held.withColumn("state", moved(F.col("state"), F.col("p"), steps[done:])), "rates")
            if done:
                shared.dropped(held)
            held, done = new, len(steps)
        # Momentum grows with the rounds, and starts anew where the loss has risen.
        if len(losses) > 1 and losses[-1] > losses[-2]:
            pace = 1.0
        faster = (1 + (1 + 4 * pace**2) ** 0.5) / 2
        push, pace = (pace - 1) / faster, faster
        ahead = np.where(have > 0, now + push * (now - before) - target, 0.0)
        steps.append([push, *(ahead / scale).tolist()])
        rate = moved(F.col("state"), F.col("p"), steps[done:])["rate"]
        now, before = np.array(list(held.agg(*sums(rate)).first()), float), now
    raise RuntimeError(f"rates not settled after {rounds} rounds; off by {dict(zip(domains, (now - target).tolist(), strict=True))}")


def copies(rate: Column, seed: int, *key: Column) -> Column:
    """Whole copies whose mean is the rate: the part after the point is drawn by a digest of the row."""
    u = F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return (F.floor(rate) + F.when(u < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def rates(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], total: float | None = None) -> DataFrame:
    """doc_id, n_tokens, domain (the likeliest), p (posterior by domain), rate, copies of every row."""
    domains, w = train(labelled)
    member = shared.written(docs.select("doc_id", members(domains, w).alias("m")).select("doc_id", "m.n_tokens", "m.p"), "members")
    steps, _ = fit(member, domains, weights, total)
    names = F.array(*map(F.lit, domains))
    out = member.withColumn("rate", folded(F.col("p"), steps))
    best = F.element_at(names, F.array_position("p", F.array_max("p")).cast("int"))
    return out.select("doc_id", "n_tokens", best.alias("domain"), F.map_from_arrays(names, "p").alias("p"), "rate", copies(F.col("rate"), 5, F.col("doc_id"), F.col("n_tokens")).alias("copies"))


def mixed(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], total: float | None = None, unlisted: bool = True) -> DataFrame:
    """docs, all columns, with n_tokens, domain, rate and copies added (under names that docs lacks). No row goes: one that is not
    to be read has 0 copies. unlisted: labelled domains that weights lacks keep their share of the tokens. Without a total,
    rates are scaled until a text with words whose likeliest domain has weight is read at least once; a rate of 0 stays."""
    domains, w = train(labelled)
    m = shared.unused(docs, "__m")
    held = shared.written(docs.withColumn(m, members(domains, w)), "mixed")
    steps, _ = fit(held.select(f"{m}.n_tokens", f"{m}.p"), domains, weights, total, unlisted=unlisted)
    p, n = F.col(f"{m}.p"), F.col(f"{m}.n_tokens")
    best = F.element_at(F.array(*map(F.lit, domains)), F.array_position(p, F.array_max(p)).cast("int"))
    rate = shared.unused(docs, "rate")
    fitted = folded(p, steps)
    if total is None:
        # Posteriors are soft: a text of the scarcest domain that is partly another's has a rate under that domain's.
        aimed = [d for d in domains if weights.get(d, 1.0 if unlisted else 0.0) > 0 and d not in CUT]
        least = held.select(n.alias("n"), best.alias("d"), fitted.alias("r")).where((F.col("n") > 0) & F.col("d").isin(aimed) & (F.col("r") > 0)).agg(F.min("r")).first()[0]
        if least is not None and least < 1:
            fitted = fitted * (1.000001 / least)
    out = held.withColumn(rate, fitted)
    added = {shared.unused(docs, "n_tokens"): n, shared.unused(docs, "domain"): best, shared.unused(docs, "copies"): copies(F.col(rate), 5, F.xxhash64("text"), n)}
    return out.withColumns(added).select(*docs.columns, rate, *added)


def labelled_table(docs: DataFrame, labels: DataFrame, domain: Column, most: int = MOST_LABELLED) -> DataFrame:
    """(text, domain) of at most `most` documents in labels, those first by a digest of their doc_id. domain: over the columns of docs and labels;
    of several labels of one document, the least."""
    named = docs.select("doc_id", "text", *[c for c in docs.columns if c not in ("doc_id", "text") and c not in labels.columns])
    ids = labels.where(F.col("doc_id").isNotNull()).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    told = labels.join(F.broadcast(ids), "doc_id", "left_semi").dropDuplicates()
    rows = named.join(F.broadcast(told.groupBy("doc_id").agg(F.min(F.struct(*[c for c in labels.columns if c != "doc_id"])).alias("__l"))), "doc_id")
    return shared.written(rows.select("text", *[c for c in named.columns if c not in ("doc_id", "text")], "__l.*").select("text", domain.alias("domain")), "labelled")


def language_or_low() -> Column:
    """The domain of the queries' labelled table: the language, and `low` for what is labelled as of low quality."""
    return F.when(F.col("quality") == 0, "low").otherwise(F.col("lang"))
