"""Pixels as arrays: patches in block and raster order, latents in 2 x 2 packs, padding. Index arithmetic on one row's array."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def gathered(values: Column, n: int, place) -> Column:
    """n values: the i-th is that at place(i), counted from 0."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.element_at(values, (place(i) + 1).cast("int")))


def _div(a: Column, b: int) -> Column:
    return F.floor(a / b)


def patchify(pixels: Column, t: int, h: int, w: int, c: int, ps: int, ts: int, m: int) -> Column:
    """array of patches of a (t, h, w, c) picture: merge groups together, order (t, block row, block column, row, column), each patch as
    (c, frame, y, x). The last frame is repeated to fill."""
    frames = -(-t // ts)
    hp, wp, size = h // ps, w // ps, c * ts * ps * ps

    def place(patch: Column, i: Column) -> Column:
        x, y = i % ps, _div(i, ps) % ps
        frame, channel = _div(i, ps * ps) % ts, _div(i, ps * ps * ts)
        col, row = patch % m, _div(patch, m) % m
        bw, bh = _div(patch, m * m) % (wp // m), _div(patch, m * m * (wp // m)) % (hp // m)
        tt = _div(patch, hp * wp)
        f = F.least(tt * ts + frame, F.lit(t - 1))
        return ((f * h + (bh * m + row) * ps + y) * w + (bw * m + col) * ps + x) * c + channel

    return F.transform(F.sequence(F.lit(0), F.lit(frames * hp * wp - 1)), lambda p: gathered(pixels, size, lambda i: place(p, i)))


def patchify_raster(pixels: Column, h: int, w: int, c: int, ps: int) -> Column:
    """array of (row, column, patch) in raster order, each patch as (y, x, c); raises if sides do not divide."""
    if h % ps or w % ps:
        raise ValueError("sides must be multiples of the patch")
    wp = w // ps

    def one(p: Column) -> Column:
        r, q = _div(p, wp), p % wp
        return F.struct(r.cast("int").alias("row"), q.cast("int").alias("column"), gathered(pixels, ps * ps * c, lambda i: ((r * ps + _div(i, c * ps)) * w + q * ps + _div(i, c) % ps) * c + i % c).alias("patch"))

    return F.transform(F.sequence(F.lit(0), F.lit((h // ps) * wp - 1)), one)


def pack_latents(x: Column, c: int, h: int, w: int, p: int = 2) -> Column:
    """(c, h, w) to (h/p * w/p) rows of (c, p, p), as one flat array."""
    wp = w // p

    def place(i: Column) -> Column:
        patch, k = _div(i, c * p * p), i % (c * p * p)
        return (_div(k, p * p) * h + _div(patch, wp) * p + _div(k, p) % p) * w + patch % wp * p + k % p

    return gathered(x, c * h * w, place)


def unpack_latents(x: Column, c: int, h: int, w: int, p: int = 2) -> Column:
    """The inverse of pack_latents."""
    wp = w // p

    def place(i: Column) -> Column:
        ch, y, z = _div(i, h * w), _div(i, w) % h, i % w
        return (_div(y, p) * wp + _div(z, p)) * c * p * p + ch * p * p + y % p * p + z % p

    return gathered(x, c * h * w, place)


def latent_positions(h: int, w: int, p: int = 2) -> Column:
    """array of (0, row, column) of the packed latents."""
    return F.transform(F.sequence(F.lit(0), F.lit((h // p) * (w // p) - 1)), lambda i: F.array(F.lit(0), _div(i, w // p).cast("int"), (i % (w // p)).cast("int")))


def padded_patches(patches: Column, size: int, n: int) -> Column:
    """Patches with zero ones up to n; more than n are an error and give null."""
    return F.when(F.size(patches) <= n, F.concat(patches, F.array_repeat(F.array_repeat(F.lit(0.0), size), F.greatest(F.lit(n) - F.size(patches), F.lit(0)))))


def padded_coordinates(coords: Column, n: int) -> Column:
    """Coordinates with (-1, -1) up to n; more are null."""
    return F.when(F.size(coords) <= n, F.concat(coords, F.array_repeat(F.array(F.lit(-1), F.lit(-1)), F.greatest(F.lit(n) - F.size(coords), F.lit(0)))))
