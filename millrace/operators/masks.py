"""Attention structure of token windows as index arithmetic over each row's arrays: documents in a window, offsets, and who sees whom."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.arrays import let, upto


def document_numbers(tokens: Column, is_end: Callable[[Column], Column]) -> Column:
    """Of each position, the number of ends before it; what follows an end begins a document. Made run by run, so its cost grows with the window."""
    n = F.size(tokens)
    after = F.filter(F.transform(tokens, lambda t, i: F.when(is_end(t), i + 1)), lambda x: x.isNotNull() & (x < n))

    def runs(cuts: Column) -> Column:
        stops = F.concat(F.slice(cuts, 2, F.size(cuts)), F.array(n))
        return F.flatten(F.transform(F.zip_with(cuts, stops, lambda a, b: b - a), lambda length, k: F.array_repeat(k.cast("bigint"), length)))

    return F.when(n > 0, let(F.concat(F.array(F.lit(0)), after), runs)).otherwise(F.array().cast("array<bigint>"))


def offsets(tokens: Column, is_end, row: Column, length: int) -> Column:
    """Starts of documents in a flat batch: 0, after each end, without repeats, from row * length."""
    at = F.filter(F.transform(tokens, lambda t, i: F.when(is_end(t), i + 1)), lambda x: x.isNotNull())
    ends = F.array_distinct(F.concat(F.array(F.lit(0)), at, F.array(F.lit(length))))
    return F.transform(F.filter(ends, lambda x: x < length), lambda x: x.cast("bigint") + row * length)


def run_begins(blocks: Column) -> Column:
    """Of each position, where its run of equal values begins."""

    def of(b: Column) -> Column:
        cuts = F.filter(F.transform(b, lambda x, i: F.when((i == 0) | (F.try_element_at(b, F.greatest(i, F.lit(1))) != x), i)), lambda x: x.isNotNull())
        stops = lambda c: F.concat(F.slice(c, 2, F.size(c)), F.array(F.size(b)))
        return let(cuts, lambda c: F.flatten(F.zip_with(c, stops(c), lambda a, z: F.array_repeat(a, z - a))))

    return F.when(F.size(blocks) > 0, let(blocks, of)).otherwise(F.array().cast("array<int>"))


def first_seen(length: Column, blocks: Column | None = None, width: int | None = None) -> Column:
    """Of each query position, the first key position that it sees in a causal mask: within its run of equal `blocks` (documents' numbers, or fixed
    blocks), and less than `width` away. A query sees all positions from there to its own, so this array is the whole mask."""
    if width is not None and width < 1:
        raise ValueError("a sliding window has one position at least")
    low = F.transform(upto(length), lambda _: F.lit(0)) if blocks is None else run_begins(blocks)
    return low if width is None else F.transform(low, lambda x, i: F.greatest(x, i - width + 1))


def causal_pairs(windows: DataFrame, first: Column, *key: str) -> DataFrame:
    """(key, q, kv): the pairs of the mask that first_seen() gives, one row each."""
    each = windows.select(*key, F.posexplode(first).alias("q", "__low"))
    return each.select(*key, "q", F.explode(F.sequence("__low", "q")).alias("kv"))


def relative(blocks: Column) -> Column:
    """Positions from 0 in each run of equal values."""
    return F.transform(run_begins(blocks), lambda x, i: i - x)


def resets(positions: Column) -> Column:
    """How many positions are smaller than the one before, each of which begins a document."""
    return F.size(F.filter(F.transform(positions, lambda x, i: (i > 0) & (F.try_element_at(positions, F.greatest(i, F.lit(1))) > x)), lambda x: x))


def run_starts(members: Column) -> Column:
    """How many positions are members of which the one before is none."""
    return F.size(F.filter(F.transform(members, lambda x, i: x & ((i == 0) | ~F.try_element_at(members, F.greatest(i, F.lit(1))))), lambda x: x))


def collapsed(values: Column) -> Column:
    """Without repeats of the value right before."""
    return F.transform(F.filter(F.transform(values, lambda x, i: F.struct(x.alias("x"), ((i > 0) & (F.try_element_at(values, F.greatest(i, F.lit(1))) == x)).alias("again"))), lambda s: ~s["again"]), lambda s: s["x"])


def rope_positions(kinds: Column, grids: Column, positions: Column) -> Column:
    """array of (t, h, w): text runs are equal on all axes; a vision run takes its grid's indices from the offset; the offset is the largest so
    far plus 1, and 0 again where positions restart. kinds: 0 text, 1 vision, by token; grids: array of (h, w) of each vision run (a video's frame counts as a
    picture)."""
    n = F.size(kinds)
    zero = F.struct(F.lit(0).alias("next"), F.lit(0).alias("base"), F.lit(0).alias("g"), F.lit(0).alias("k"), F.lit(False).alias("in_run"), F.array().cast("array<struct<t:int,h:int,w:int>>").alias("out"))

    def step(acc: Column, i: Column) -> Column:
        vision = F.element_at(kinds, i + 1) == 1
        fresh = (i > 0) & (F.element_at(positions, i + 1) < F.element_at(positions, F.greatest(i, F.lit(1))))
        start = vision & (fresh | ~acc["in_run"])
        nxt = F.when(fresh, F.lit(0)).otherwise(acc["next"])
        g = acc["g"] + F.when(start, 1).otherwise(0)
        k = F.when(start, F.lit(0)).otherwise(acc["k"])
        base = F.when(start, nxt).otherwise(acc["base"])
        wide = F.coalesce(F.try_element_at(grids, g)["w"], F.lit(1))
        h, w = F.floor(k / wide).cast("int"), (k % wide).cast("int")
        here = F.when(vision, F.struct(base.alias("t"), (base + h).alias("h"), (base + w).alias("w"))).otherwise(F.struct(nxt.alias("t"), nxt.alias("h"), nxt.alias("w")))
        return F.struct(F.greatest(nxt, here["t"] + 1, here["h"] + 1, here["w"] + 1).alias("next"), base.alias("base"), g.alias("g"), (k + 1).alias("k"), vision.alias("in_run"), F.concat(acc["out"], F.array(here)).alias("out"))

    return F.aggregate(F.sequence(F.lit(0), n - 1), zero, step, lambda acc: acc["out"])
