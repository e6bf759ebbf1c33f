"""Reproducible draws: uniform numbers hashed from keys, alike in any engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(*keys: Column) -> Column:
    """In [0, 1): the first 8 hex digits of an MD5 of the keys, over 2 ** 32."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[k.cast("string") for k in keys])), 1, 8), 16, 10).cast("double") / 4294967296.0


def exponential(u: Column, mean: float = 5.0) -> Column:
    return -mean * F.log(1 - u)


def draw_index(n: Column, *keys: Column) -> Column:
    """One of 0 .. n - 1."""
    return F.floor(uniform(*keys) * n).cast("long")
