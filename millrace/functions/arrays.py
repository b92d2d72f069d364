"""Array functions of the data path: label shift, masks, padding, windows of token arrays, positions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

IGNORE = -100


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, also where f uses it within a lambda over many elements."""
    return F.transform(F.array(value), f)[0]


def upto(n: Column) -> Column:
    """0 .. n - 1; empty for n = 0."""
    return F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))


def shifted(tokens: Column) -> tuple[Column, Column]:
    """(inputs, labels): all but the last token, and all but the first."""
    n = F.greatest(F.size(tokens) - 1, F.lit(0))
    return F.slice(tokens, 1, n), F.slice(tokens, 2, n)


def prompt_mask(labels: Column, prompt: Column, ignore: Column | None = None) -> Column:
    """The first min(max(prompt - 1, 0), n) labels replaced by `ignore`."""
    blank = F.lit(IGNORE) if ignore is None else ignore
    return F.transform(labels, lambda x, i: F.when(i < F.greatest(prompt - 1, F.lit(0)), blank).otherwise(x))


def member_mask(labels: Column, special: list, ignore: Column | None = None) -> Column:
    """Labels that are special replaced by `ignore`."""
    blank = F.lit(IGNORE) if ignore is None else ignore
    return F.transform(labels, lambda x: F.when(x.isin(special), blank).otherwise(x))


def fitted(values: Column, n: int | Column, pad: Column) -> Column:
    """Padded at the end, or clipped, to length n."""
    size = F.lit(n) if isinstance(n, int) else n
    return F.slice(F.concat(values, F.array_repeat(pad, F.greatest(size - F.size(values), F.lit(0)).cast("int"))), F.lit(1), size.cast("int"))


def tiled(values: Column, n: int) -> Column:
    """Repeated until long enough, clipped to n; empty stays empty."""
    times = F.when(F.size(values) > 0, F.floor(F.lit(n) / F.size(values)) + 1).otherwise(F.lit(0))
    return F.slice(F.flatten(F.array_repeat(values, times.cast("int"))), 1, n)


def window_at(values: Column, offset: Column, n: int) -> Column:
    """n values from offset, around the end; fewer values than n are tiled from the start whatever the offset; empty gives null."""
    size = F.size(values)
    start = F.pmod(offset, F.greatest(size, F.lit(1))).cast("int")
    ring = F.slice(F.concat(values, F.slice(values, 1, n)), start + 1, F.lit(n))
    return F.when(size == 0, F.lit(None)).when(size < n, tiled(values, n)).otherwise(ring)


def count_valid(labels: Column) -> Column:
    return F.size(F.filter(labels, lambda x: x != IGNORE)).cast("bigint")


def lengths_to_positions(lengths: Column) -> Column:
    """0 .. n - 1 for each length n, one after another."""
    return F.flatten(F.transform(lengths, upto))


def map_value(m: Column, key: str, default: float = 0.0) -> Column:
    return F.coalesce(F.try_element_at(m, F.lit(key)), F.lit(default))


def response_slice(values: Column, start: Column, prompt: Column, response: Column) -> Column:
    """Of packed values, those that predict the response: from start + prompt - 1."""
    return F.slice(values, (start + prompt).cast("int"), response.cast("int"))


def legacy_padded(tokens: Column, labels: Column, n: int, pad: int, legacy: bool = True) -> tuple[Column, Column]:
    """Tokens and labels fitted to n. The older form fills labels with 1 and then masks real tokens that equal pad; legacy=False masks padding only."""
    ids = fitted(tokens, n, F.lit(pad))
    if not legacy:
        return ids, fitted(labels, n, F.lit(IGNORE))
    return ids, F.transform(fitted(labels, n, F.lit(1)), lambda x: F.when(x == pad, IGNORE).otherwise(x))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))
