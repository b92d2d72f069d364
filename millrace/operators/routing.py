"""Tokens to experts: choice by score, group limits, load, bias, dispatch and return."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.arrays import let
from millrace.operators.ordering import ordinal


def top_k(scores: Column, k: int, bias: Column | None = None) -> Column:
    """array of (expert, gate), best first: chosen by biased score (ties: least expert), gated by the plain score."""
    ranked = F.transform(scores, lambda s, i: F.struct((-(s.cast("double") + (F.element_at(bias, i + 1) if bias is not None else F.lit(0.0)))).alias("o"), i.alias("expert"), s.cast("double").alias("gate")))
    return F.transform(F.slice(F.array_sort(ranked), 1, k), lambda x: F.struct(x["expert"].alias("expert"), x["gate"].alias("gate")))


def group_limited(scores: Column, experts: int, groups: int, keep: int) -> Column:
    """scores with those outside the best groups put to -infinity; a group's score is the sum of its two best (ties: least group)."""
    per = experts // groups
    if experts % groups or per < 2:
        raise ValueError("experts must divide into groups of two at least")
    best_two = lambda g: F.aggregate(F.slice(F.sort_array(F.slice(scores, g * per + 1, per), False), 1, 2), F.lit(0.0), lambda s, x: s + x.cast("double"))
    ranked = F.array_sort(F.array(*[F.struct((-best_two(g)).alias("o"), F.lit(g).alias("g")) for g in range(groups)]))
    kept = F.transform(F.slice(ranked, 1, keep), lambda x: x["g"])
    return let(kept, lambda held: F.transform(scores, lambda s, i: F.when(F.array_contains(held, F.floor(i / per).cast("int")), s.cast("double")).otherwise(F.lit(float("-inf")))))


def forced(token: Column, j: Column, k: int, experts: int) -> Column:
    """Balanced routing for tests: expert (token * k + j) mod experts."""
    return F.pmod(token * k + j, F.lit(experts))


def histogram(chosen: DataFrame, expert: str, experts: DataFrame) -> DataFrame:
    """(expert, n) over all experts."""
    n = chosen.groupBy(expert).agg(F.count(F.lit(1)).alias("n"))
    return experts.join(n, expert, "left").select(expert, F.coalesce("n", F.lit(0)).alias("n"))


def bias_step(load: DataFrame, rate: float) -> DataFrame:
    """load with delta: rate * sign(mean - n), centred. One row per expert, so one task."""
    w = Window.partitionBy()
    raw = load.withColumn("raw", F.signum(F.avg("n").over(w) - F.col("n")) * rate)
    return raw.withColumn("delta", F.col("raw") - F.avg("raw").over(w)).drop("raw")


def permutation(chosen: DataFrame, expert: str, order: list[str]) -> DataFrame:
    """chosen with the row's place in the order of experts, and of `order` (a whole-number column, then ties) within an expert: load before the expert plus
    the place in it. An expert's rows are numbered bucket by bucket, so a hot expert is spread over tasks."""
    load = chosen.groupBy(expert).agg(F.count(F.lit(1)).alias("__n"))
    # One row per expert.
    before = F.coalesce(F.sum("__n").over(Window.orderBy(expert).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = ordinal(chosen, order[0], "__within", by=[expert], ties=order[1:])
    return numbered.join(load.select(expert, before.alias("__before")), expert).withColumn("place", F.col("__before") + F.col("__within")).drop("__before", "__within")


def combined(processed: DataFrame, token: str, gate: str, value: str) -> DataFrame:
    """Experts' outputs summed back by token, weighted by their gates."""
    return processed.groupBy(token).agg(F.sum(F.col(gate) * F.col(value)).alias("value"))


def top_logits(logits: Column, k: int) -> Column:
    """Logits under the k-th largest put to null; all that tie with it stay."""
    return let(F.element_at(F.sort_array(logits, False), k), lambda pivot: F.transform(logits, lambda x: F.when(x >= pivot, x)))


def probabilities(logits: Column, temperature: float = 1.0) -> Column:
    """Softmax of logits over temperature; nulls have 0."""
    z = F.transform(logits, lambda x: x.cast("double") / max(temperature, 1e-5))
    total = lambda e: F.aggregate(e, F.lit(0.0), lambda s, x: s + x)
    powers = let(z, lambda z: let(F.array_max(z), lambda top: F.transform(z, lambda x: F.coalesce(F.exp(x - top), F.lit(0.0)))))
    return let(powers, lambda e: let(total(e), lambda t: F.transform(e, lambda x: x / t)))


def log_probabilities(logits: Column) -> Column:
    def log_sum(top: Column) -> Column:
        return top + F.ln(F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x.cast("double") - top)))

    return let(let(F.array_max(logits).cast("double"), log_sum), lambda z: F.transform(logits, lambda x: x.cast("double") - z))


def raced(probs: Column, u: Column) -> Column:
    """A categorical draw as a race: the index of the largest p / -ln(u)."""
    return F.array_max(F.zip_with(F.transform(probs, lambda p, i: F.struct(p.alias("p"), i.alias("i"))), u, lambda p, x: F.struct((p["p"] / -F.ln(x)).alias("s"), p["i"].alias("i"))))["i"]
