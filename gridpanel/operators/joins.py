"""Joins to a side with few rows, by keys that a few of the others' rows may crowd on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpanel.functions import sizes
from gridpanel.sources.scratch import landed

MAX_BYTES = 64 << 20
SALTS = 32
KINDS = ("inner", "left", "left_semi", "left_anti")


def join_few(
    rows: DataFrame, few: DataFrame, on: list[str], how: str = "inner", max_bytes: int = MAX_BYTES, salts: int = SALTS
) -> DataFrame:
    """``rows`` joined to ``few``, which has a row for a key (a series, a period) and not for a step.

    The few rows are stored and measured. Up to ``max_bytes`` they are broadcast, so the others
    stay where they are and no key meets in a task. Beyond that they are copied ``salts`` times and the
    others dealt over the copies, so a key that holds a third of all rows goes to as many tasks.
    Null keys match nothing.
    """
    if how not in KINDS:
        raise ValueError(f"unknown join {how!r}")
    stored = landed(few, "few")
    small = sizes.broadcast_if_small(stored, max_bytes)
    if small is not None:
        return rows.join(small, on, how)
    copies = stored.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]), F.lit(salts)).cast("int"))
    return dealt.join(copies, [*on, "_salt"], how).drop("_salt")
