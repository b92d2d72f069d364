"""Stateless randomness: draws are digests of a seed and a key, so they do not depend on how rows are dealt to tasks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(seed: int | str, *keys: Column) -> Column:
    """MD5 of the seed and the keys, colon-joined; the order by it is a seeded shuffle."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def uniform(seed: int | str, *keys: Column) -> Column:
    """A number from 0 to under 1 with 52 bits."""
    return F.conv(F.substring(digest(seed, *keys), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def draw_int(seed: int | str, n: int | Column, *keys: Column) -> Column:
    """A whole number from 0 to n - 1."""
    return F.floor(uniform(seed, *keys) * n).cast("bigint")
