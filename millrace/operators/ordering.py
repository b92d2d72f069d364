"""Global order without a single-task window: prefix sums and ordinals in three phases."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Keys per bucket, and buckets per group of buckets (a power of 2): 64-bit keys have at most 1 << 24 groups, however sparse they are.
SPAN, GROUP_BITS = 1 << 16, 24


def prefix_sum(df: DataFrame, key: str, value: Column, out: str, span: int = SPAN, by: list[str] | None = None, ties: list[str] | None = None) -> DataFrame:
    """df with the sum of `value` over all rows before it in the order of the whole-number column `key` (then `ties`), within each group of
    `by`. Buckets of `span` keys (a power of 2) are summed first, and then groups of buckets. Running sums go from groups to buckets to
    rows, so no task holds more than one bucket's rows, one group's buckets (16 million at most) or a `by`'s groups (as many), whether keys are dense or
    spread over 64 bits. Rows whose key is null are one bucket and come first; nulls in `by` are a group of their own."""
    if span < 1 or span & (span - 1):
        raise ValueError("a span is a power of 2")
    by = by or []
    bucket, group, base, val = (f"__{out}_{x}" for x in ("bucket", "group", "base", "value"))
    rows = df.withColumn(bucket, F.shiftright(F.col(key).cast("bigint"), span.bit_length() - 1)).withColumn(val, value)
    sums = rows.groupBy(*by, bucket).agg(F.sum(val).alias(base)).withColumn(group, F.shiftright(bucket, GROUP_BITS))
    tops = _running(sums.groupBy(*by, group).agg(F.sum(base).alias(base)), by, group, base)
    bases = _same(_running(sums, [*by, group], bucket, base), tops.withColumnRenamed(base, f"{base}_top"), [*by, group])
    bases = bases.select(*by, bucket, (F.col(base) + F.col(f"{base}_top")).alias(base))
    inner = Window.partitionBy(*by, bucket).orderBy(key, *(ties or [])).rowsBetween(Window.unboundedPreceding, -1)
    return _same(rows, bases, [*by, bucket]).withColumn(out, F.col(base) + F.coalesce(F.sum(val).over(inner), F.lit(0))).drop(bucket, base, val)


def prefix_sum_wide(df: DataFrame, key: str, value: Column, out: str, n: str) -> DataFrame:
    """df with `value` as the column n, and as `out` what prefix_sum() gives, for wide rows: only keys and values go through the sums and their
    buckets, and a row is sent once, to its key's sum. Rows of one key follow each other in the order of value."""
    id_ = f"__{out}_key"
    keys = df.select(key, value.alias(n)).groupBy(key).agg(F.sum(n).alias(n))
    # As a struct, null keys are equal too.
    sums = prefix_sum(keys, key, F.col(n), out).select(F.struct(key).alias(id_), out)
    rows = df.withColumn(n, value).withColumn(id_, F.struct(key)).join(sums.hint("shuffle_hash"), id_)
    inner = Window.partitionBy(id_).orderBy(n).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(out, F.col(out) + F.coalesce(F.sum(n).over(inner), F.lit(0))).drop(id_)


def _running(df: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """df with the sum of `value` before each row."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(value, F.coalesce(F.sum(value).over(w), F.lit(0)))


def _same(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """An inner join by columns in which nulls are equal."""
    other = right.withColumnsRenamed({c: f"{c}__r" for c in on})
    met = left.join(other, reduce(lambda a, b: a & b, [left[c].eqNullSafe(other[f"{c}__r"]) for c in on]))
    return met.drop(*[f"{c}__r" for c in on])


def ordinal(df: DataFrame, key: str, out: str, by: list[str] | None = None, ties: list[str] | None = None, span: int = SPAN) -> DataFrame:
    """df with each row's number from 0 in the order of the whole-number column key, within each group of `by`."""
    return prefix_sum(df, key, F.lit(1).cast("bigint"), out, span, by, ties)


def shuffled_ordinal(df: DataFrame, digest: Column, out: str, by: list[str] | None = None, ties: list[str] | None = None) -> DataFrame:
    """Each row's number from 0 in the order of a hexadecimal digest: buckets are the digest's first 6 digits."""
    h = f"__{out}_h"
    n = f"__{out}_n"
    rows = df.withColumn(h, digest).withColumn(n, F.conv(F.substring(h, 1, 12), 16, 10).cast("bigint"))
    return ordinal(rows, n, out, by, [h, *(ties or [])], span=1 << 24).drop(h, n)


def first_per_group(df: DataFrame, by: list[str], order: list[Column | str], n: int = 1) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")


def prefix_within(df: DataFrame, by: list[str], order: list[str], value: Column, budget: int) -> DataFrame:
    """Per group, the longest run of first rows whose summed value (nothing below 0) keeps to the budget. order: a whole-number column, then ties."""
    return prefix_sum(df, order[0], value, "__sum", by=by, ties=order[1:]).where(F.col("__sum") + value <= budget).drop("__sum")


def latest_step(df: DataFrame, step: Column, usable: Column) -> DataFrame:
    """The largest step that is usable; -1 without any."""
    return df.agg(F.coalesce(F.max(F.when(usable, step)), F.lit(-1).cast("bigint")).alias("latest"))


def purgeable(df: DataFrame, step: str, keep: int) -> DataFrame:
    """All but the last `keep` steps, which are distinct; keep = 0 purges nothing. The last that stays is found by a top-k, not by a sort of all."""
    if keep == 0:
        return df.limit(0)
    last = df.select(F.col(step).alias("__s")).orderBy(F.desc("__s")).limit(keep).agg(F.when(F.count(F.lit(1)) == keep, F.min("__s")).alias("__last"))
    return df.withColumn("__one", F.lit(1)).join(F.broadcast(last.withColumn("__one", F.lit(1))), "__one").where(F.col(step) < F.col("__last")).drop("__one", "__last")


def resumed(df: DataFrame, ordinal_column: str, skip: int) -> DataFrame:
    """What is left after `skip` rows."""
    return df.where(F.col(ordinal_column) >= skip)
