"""Broadcast hints that hold to a stated bound."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def at_most(df: DataFrame, max_rows: int) -> DataFrame:
    """The table, or an error when it is read if it has more than ``max_rows`` rows. No more
    than one row beyond that is ever looked at."""
    # in one partition ids count from 0
    numbered = df.limit(max_rows + 1).repartition(1).withColumn("_nth", F.monotonically_increasing_id())
    fits = F.assert_true(F.col("_nth") < max_rows, f"a table promised to have up to {max_rows} rows has more")
    return numbered.where(fits.isNull()).drop("_nth")


def broadcast_within(df: DataFrame, max_rows: int | None) -> DataFrame:
    """Hint a broadcast where the caller states how many rows there can be.

    The promise is tested when the table is read, before anything is sent out. Without
    one the plan is left to adaptive execution, which broadcasts by measured size.
    """
    return df if max_rows is None else F.broadcast(at_most(df, max_rows))


WIDTHS = {"double": 8, "bigint": 8, "int": 4, "timestamp": 8, "timestamp_ntz": 8, "date": 4, "boolean": 1, "float": 4}


def measured_bytes(df: DataFrame) -> int:
    """What a table of numbers, dates, flags and texts takes as a broadcast relation, where each
    column has at least a word of its own. Reads the texts' lengths and counts the rows, so this is
    for stored tables; columns of other types are refused."""
    texts = [c for c, kind in df.dtypes if kind == "string"]
    if odd := [c for c, kind in df.dtypes if kind not in WIDTHS and kind != "string"]:
        raise ValueError(f"columns whose size can't be told: {odd}")
    length = [F.coalesce(F.sum(F.octet_length(f"`{c}`")), F.lit(0)) for c in texts]
    n, *more = df.agg(F.count(F.lit(1)), *length).first()
    return n * (16 + 8 * len(df.columns)) + sum(more)


def broadcast_if_small(df: DataFrame, max_bytes: int) -> DataFrame | None:
    """The hinted table if it measures up to ``max_bytes``, else None."""
    return F.broadcast(df) if measured_bytes(df) <= max_bytes else None
