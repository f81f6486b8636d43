"""Repeatable randomness: everything random is an MD5 of a seed and a row id.

The same row gets the same draw on any cluster, in any order, after any retry.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def hash_key(seed: int | str, *ids: Column | str) -> Column:
    """32 hex digits; rows ordered by it are in a seeded random order."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[_col(c).cast("string") for c in ids]).cast("binary"))


def hash_int(seed: int | str, *ids: Column | str) -> Column:
    """Non-negative 32-bit integer as BIGINT."""
    return F.conv(F.substring(hash_key(seed, *ids), 1, 8), 16, 10).cast("bigint")


def hash_uniform(seed: int | str, *ids: Column | str) -> Column:
    """Double in [0, 1)."""
    return hash_int(seed, *ids) / F.lit(4294967296.0)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c
