"""Random numbers that depend only on a seed and a row's key.

A draw is a hash of its key, so it is the same after a retry, on another
executor and under any partitioning.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridpanel.functions.scalars import as_col


def uniform(seed: int | str, *key: Column | str) -> Column:
    """Uniform in (0, 1) from the first 32 bits of the key's md5."""
    text = F.concat_ws("|", F.lit(str(seed)), *[as_col(k).cast("string") for k in key])
    bits = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")
    return (bits + F.lit(0.5)) / F.lit(4294967296.0)


def normal(seed: int | str, *key: Column | str) -> Column:
    """Standard normal from two keyed uniforms (Box-Muller)."""
    u1 = uniform(seed, *key, F.lit("radius"))
    u2 = uniform(seed, *key, F.lit("angle"))
    return F.sqrt(-2.0 * F.log(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)


def choice(u: Column, options: list) -> Column:
    """Equally likely element of a list, from a uniform."""
    position = F.least(F.floor(u * len(options)), F.lit(len(options) - 1)) + 1
    return F.element_at(F.array(*[F.lit(o) for o in options]), position.cast("int"))


def integer_between(u: Column, low: int, high: int) -> Column:
    """Equally likely integer in [low, high], from a uniform."""
    return (F.floor(u * (high - low + 1)) + low).cast("int")
