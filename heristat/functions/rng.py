"""Randomness by hashing: a draw depends on its seed and key alone, never on partitions or order."""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, functions as F


def _key(seed: int, *parts: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(p.cast("string") for p in parts)))


def _unit(digest: Column, first: int) -> Column:
    return (F.conv(F.substring(digest, first, 8), 16, 10).cast("bigint") + 0.5) / F.lit(4294967296.0)


def uniform(seed: int, *parts: Column) -> Column:
    """In (0, 1), from the first 8 hex digits of md5('seed:part:...')."""
    return _unit(_key(seed, *parts), 1)


def gaussian(seed: int, *parts: Column) -> Column:
    """Standard normal by the Box-Muller rule on digits 1 to 8 and 9 to 16."""
    digest = _key(seed, *parts)
    return F.sqrt(-2.0 * F.log(_unit(digest, 1))) * F.cos(F.lit(2 * math.pi) * _unit(digest, 9))


def gaussian_value(seed: int, *parts: object) -> float:
    """gaussian() of one key, in Python."""
    digest = hashlib.md5(":".join(map(str, (seed, *parts))).encode()).hexdigest()
    u, v = ((int(digest[o : o + 8], 16) + 0.5) / 4294967296.0 for o in (0, 8))
    return math.sqrt(-2.0 * math.log(u)) * math.cos(2 * math.pi * v)


def hwe_draw(u: Column, p: Column) -> Column:
    """Inverse of the Hardy-Weinberg distribution function: 0, 1 or 2 for a uniform u and an allele frequency p."""
    q = 1 - p
    return F.when(u < q * q, 0).when(u < q * q + 2 * p * q, 1).otherwise(2)
