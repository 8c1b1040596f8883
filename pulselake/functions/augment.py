"""Augmentations of an array of samples (survey K10) as columns; what is random is a parameter or comes from a hash of a key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def chance(key: Column, salt: str) -> Column:
    """A number in 0..1 (below 1) from md5(salt, key): the same on every run and engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(salt), key.cast("string"))), 1, 8), 16, 10).cast("double") / 2.0**32


def cropped(x: Column, share: Column, at: Column) -> Column:
    """A part of floor(share * n) samples (one at least); at (0..1) says where among the possible starts."""
    n = F.size(x)
    length = F.greatest(F.lit(1), F.floor(n * share)).cast("int")
    return F.slice(x, F.floor(at * (n - length + 1)).cast("int") + 1, length)


def noisy(x: Column, key: Column, sigma: float) -> Column:
    """Normal noise by the Box-Muller transform of two hashes for each sample."""
    of = lambda i, salt: chance(F.concat_ws("/", key.cast("string"), i.cast("string")), salt)
    return F.transform(x, lambda v, i: v + sigma * F.sqrt(-2 * F.log(1 - of(i, "radius"))) * F.cos(6.283185307179586 * of(i, "angle")))


def dropped(x: Column, key: Column, share: float) -> Column:
    """About a share of the samples set to 0."""
    return F.transform(x, lambda v, i: F.when(chance(F.concat_ws("/", key.cast("string"), i.cast("string")), "drop") < share, 0.0).otherwise(v))


def shifted(x: Column, steps: int) -> Column:
    """Later by `steps` (earlier if negative), repeating the sample at the edge; the length stays (mended from the reference)."""
    n = F.size(x)
    return F.transform(x, lambda v, i: F.get(x, F.greatest(F.lit(0), F.least(n - 1, i - steps))))


def scaled(x: Column, by: Column | float) -> Column:
    return F.transform(x, lambda v: v * by)


def masked(x: Column, start: Column | int, width: Column | int) -> Column:
    """Samples start..start + width - 1 set to 0."""
    return F.transform(x, lambda v, i: F.when((i >= start) & (i < start + width), 0.0).otherwise(v))


def composed(x: Column, steps: list[Callable[[Column], Column]]) -> Column:
    for step in steps:
        x = step(x)
    return x


def views(x: Column, key: Column, n: int, length: int, step: Callable[[Column, Column], Column]) -> Column:
    """n views of x: step(x, key of the view), then a part of `length` samples at a place of its own."""
    out = []
    for i in range(n):
        own = F.concat_ws("/", key.cast("string"), F.lit(str(i)))
        y = step(x, own)
        out.append(F.slice(y, F.floor(chance(own, "view") * F.greatest(F.lit(1), F.size(y) - length + 1)).cast("int") + 1, length))
    return F.array(*out)
