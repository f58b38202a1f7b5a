"""Reproducible pseudo-random draws: a hash of (seed, key), never of the partitioning."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .missing import as_col

SPAN = 4294967296.0  # 2**32


def hash32(key: Column | str, seed: int | str = 42) -> Column:
    """First eight hex digits of md5(seed ':' key) as a number in [0, 2**32)."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), as_col(key).cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def uniform01(key: Column | str, seed: int | str = 42) -> Column:
    return hash32(key, seed) / F.lit(SPAN)
