"""Scalars: image geometry, frame choice, schedules, throughput, mesh arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def smart_resize(h: Column, w: Column, factor: int, least: int, most: int) -> tuple[Column, Column]:
    """(height, width) as multiples of factor with least to most pixels in all; halves round to even; raises over an aspect of 200."""
    ok = F.when(F.greatest(h, w) / F.least(h, w) > 200, F.raise_error(F.lit("aspect ratio over 200"))).otherwise(F.lit(1))
    near = lambda x: F.greatest(F.bround(x / factor) * factor * ok, F.lit(factor))
    hb, wb = near(h), near(w)
    shrink, grow = F.sqrt(h * w / F.lit(float(most))), F.sqrt(F.lit(float(least)) / (h * w))
    down = lambda x: F.greatest(F.floor(x / shrink / factor) * factor, F.lit(factor))
    up = lambda x: F.ceil(x * grow / factor) * factor
    pick = lambda x, b: F.when(hb * wb > most, down(x)).when(hb * wb < least, up(x)).otherwise(b).cast("bigint")
    return pick(h, hb), pick(w, wb)


def prescaled(h: Column, w: Column, factor: int) -> tuple[Column, Column]:
    """A picture with a side under factor is scaled up so that no side is, and cut to whole pixels."""
    scale = F.greatest(F.lit(float(factor)) / h, F.lit(float(factor)) / w)
    small = (h < factor) | (w < factor)
    return F.when(small, F.floor(h * scale)).otherwise(h).cast("bigint"), F.when(small, F.floor(w * scale)).otherwise(w).cast("bigint")


def legacy_resize(h: Column, w: Column, factor: int, most: int, least: int = 1) -> tuple[Column, Column]:
    """The older form by number of patches: scaled up or down to the budget, then rounded to multiples of factor, and shrunk if still over."""
    now = F.floor(h * w / (factor * factor))
    scale = F.when((now < least) & (now == 0), F.greatest(F.lit(float(factor)) / w, F.lit(float(factor)) / h)).when(now < least, F.sqrt(F.lit(float(least)) / now)).when(now <= most, F.lit(1.0)).otherwise(F.sqrt(F.lit(float(most)) / now))
    h1, w1 = F.floor(h * scale), F.floor(w * scale)
    hb, wb = F.bround(h1 / factor) * factor, F.bround(w1 / factor) * factor
    patches = F.floor(hb * wb / (factor * factor))
    beta = F.sqrt(hb * wb / F.lit(float(most * factor * factor)))
    down = lambda x: F.floor(x / beta / factor) * factor
    fewer = F.sqrt(F.lit(1.0) / F.greatest(patches, F.lit(1)))
    up = lambda x: F.ceil(x * fewer / factor) * factor
    pick = lambda x, b: F.when(patches > most, down(x)).when(patches < 1, up(x)).otherwise(b).cast("bigint")
    return pick(h1, hb), pick(w1, wb)


def vision_tokens(frames: Column, h: Column, w: Column, patch: int, merge: int, temporal: int) -> tuple[Column, Column, Column]:
    """(tokens in all, tokens per row, rows)."""
    row, rows = F.floor(w / (patch * merge)), F.floor(h / (patch * merge))
    return (F.ceil(frames / temporal) * row * rows).cast("bigint"), row.cast("bigint"), rows.cast("bigint")


def frame_indices(total: Column, video_fps: Column, fps: float = 2.0, least: int = 4, most: int = 768) -> Column:
    """Distinct frames, evenly spread from the first to the last."""
    n = F.least(F.greatest(F.least(F.floor(total / video_fps * fps), F.lit(most)), F.lit(least)), total).cast("int")
    spread = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(n == 1, F.lit(0)).otherwise(F.floor(i * ((total - 1) / (n - 1)))).cast("bigint"))
    # The last point is the last frame exactly, whatever the step's rounding.
    return F.array_distinct(F.transform(spread, lambda x, i: F.when((i == n - 1) & (n > 1), (total - 1).cast("bigint")).otherwise(x)))


def crop_extents(h: Column, w: Column, size: int) -> tuple[Column, Column, Column]:
    """(height, width, offsets to choose from) once the shorter side is scaled to size; null for a picture with a side under size."""
    ok = (h >= size) & (w >= size)
    wide = w >= h
    nh = F.when(wide, F.lit(size)).otherwise(F.ceil(F.lit(size) / w * h)).cast("bigint")
    nw = F.when(wide, F.ceil(F.lit(size) / h * w)).otherwise(F.lit(size)).cast("bigint")
    return F.when(ok, nh), F.when(ok, nw), F.when(ok, F.greatest(nh, nw) - size + 1)


def lr_factor(step: Column, total: int, warmup: int, decay_ratio: float | None = None, kind: str = "linear", least: float = 0.0) -> Column:
    """Linear warm-up, a stable part, and decay (linear, sqrt or cosine) to `least`; parts that do not fit are shortened."""
    warmup = min(warmup, total)
    decay = total - warmup if decay_ratio is None else min(round(total * decay_ratio), total - warmup)
    flat = warmup + total + 1 - warmup - decay
    p = (step + 1 - flat) / F.lit(float(max(decay, 1)))
    shapes = {"linear": 1 - p, "sqrt": 1 - F.sqrt(F.greatest(p, F.lit(0.0))), "cosine": 0.5 * (1 + F.cos(F.lit(math.pi) * p))}
    if kind not in shapes:
        raise ValueError(f"unknown decay: {kind}")
    return F.when(step < warmup, (step + 1) / F.lit(float(max(warmup, 1)))).when(step < flat, F.lit(1.0)).otherwise(F.lit(least) + F.lit(1 - least) * shapes[kind])


def throughput(tokens: Column, seconds: Column, degree: int, flops_per_token: float, peak_flops: float, quantised: bool = False) -> dict[str, Column]:
    tps = tokens / (seconds * degree)
    return {"tps": tps, "tflops": F.lit(flops_per_token) * tps / F.lit(1e12), "mfu": F.lit(None).cast("double") if quantised else F.lit(100 * flops_per_token) * tps / F.lit(peak_flops)}


def time_shift(t: Column, mu: Column, sigma: float = 1.0) -> Column:
    """e^mu / (e^mu + (1/t - 1)^sigma), and its limit 0 at t = 0."""
    return F.when(t > 0, F.exp(mu) / (F.exp(mu) + F.pow(1 / F.greatest(t, F.lit(1e-300)) - 1, F.lit(sigma)))).otherwise(F.lit(0.0))


def shift_mu(length: Column, x1: float = 256, y1: float = 0.5, x2: float = 4096, y2: float = 1.15) -> Column:
    """The line through (x1, y1) and (x2, y2)."""
    slope = (y2 - y1) / (x2 - x1)
    return F.lit(slope) * length + F.lit(y1 - slope * x1)


def softmax_weights(gamma: Column, dead: Column, over, temperature: float, least: float) -> Column:
    """exp(-gamma / T) against the best, floored, dead ones 0, normalised over the window; all 0: even over the living, or else over all."""
    z = -gamma / max(temperature, 1e-6)
    w = F.when(dead, 0.0).otherwise(F.greatest(F.exp(z - F.max(z).over(over)), F.lit(least)))
    total, alive, n = F.sum(w).over(over), F.sum(F.when(dead, 0).otherwise(1)).over(over), F.count(F.lit(1)).over(over)
    even = F.when(alive > 0, F.when(dead, 0.0).otherwise(1.0 / alive)).otherwise(1.0 / n)
    return F.when(total > 0, w / total).otherwise(even)


def batch_plan(local: Column, degree: Column, global_batch: Column) -> tuple[Column, Column]:
    """(global batch, accumulation steps): the default global batch is local * degree; it must divide."""
    whole = F.coalesce(global_batch, local * degree)
    fits = F.when(whole % (local * degree) != 0, F.raise_error(F.lit("global batch must be a multiple of local batch times degree"))).otherwise(whole)
    return fits, F.floor(fits / (local * degree)).cast("bigint")


def inferred_degree(shard: Column, world: Column, others: Column) -> Column:
    """-1 stands for what is left of the world; the product must be the world."""
    d = F.when(shard == -1, F.floor(world / others)).otherwise(shard)
    return F.when(d * others != world, F.raise_error(F.lit("degrees do not multiply to the world size"))).otherwise(d).cast("bigint")


def digit_sum(text: Column) -> Column:
    """Sum of all digits in a text."""
    return F.aggregate(F.regexp_extract_all(text, F.lit(r"(\d)"), F.lit(1)), F.lit(0).cast("bigint"), lambda s, d: s + d.cast("bigint"))
