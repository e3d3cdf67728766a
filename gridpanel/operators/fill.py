"""Gap filling of complete panels: one row per series and calendar hour."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridpanel.functions.calendars import hour_number, hour_start
from gridpanel.operators.blocks import BLOCK_HOURS, spread, with_halo, with_neighbours

DAY = 24
LOOKBACK_DAYS = 3


def short_and_seasonal_fill(
    panel: DataFrame, seasonal_exempt: list[str] | None = None, block_hours: int = BLOCK_HOURS
) -> DataFrame:
    """Fill the first hour of each gap from the hour before, then what is left
    from the same hour up to three days back.

    Series in ``seasonal_exempt`` (prices) skip the second step. Three rounds of
    a one-day shift, each on the result of the round before, reach exactly the
    first known value 24, 48 or 72 hours back, so they are one ``coalesce``.
    """
    reach = DAY * LOOKBACK_DAYS + 1
    hours = panel.select("series", hour_number("ts").alias("position"), "value")
    cut = with_halo(hours, ["series"], "position", block_hours, reach)
    w = Window.partitionBy("series", "block").orderBy("position")
    short = F.coalesce(F.col("value"), F.lag("value", 1).over(w))
    seasonal = F.coalesce(
        F.col("short"),
        *[F.lag("short", DAY * d).over(w) for d in range(1, LOOKBACK_DAYS + 1)],
    )
    if seasonal_exempt:
        seasonal = F.when(F.col("series").isin(seasonal_exempt), F.col("short")).otherwise(seasonal)
    return (
        cut.withColumn("short", short)
        .withColumn("value", seasonal)
        .where(~F.col("in_halo"))
        .drop("short", "in_halo")
    )


def interpolate(panel: DataFrame) -> DataFrame:
    """Straight line between known neighbours; the nearest known value at either
    end; an all-null series stays null. Needs ``position`` and ``block``."""
    near = with_neighbours(panel, ["series"], "position", "block", "value")
    b, a = F.col("before"), F.col("after")
    line = b["value"] + (a["value"] - b["value"]) * (F.col("position") - b["at"]) / F.nullif(
        a["at"] - b["at"], F.lit(0)
    )
    filled = F.coalesce(F.col("value"), line, b["value"], a["value"])
    return near.withColumn("value", filled).drop("before", "after")


def impute(
    panel: DataFrame, seasonal_exempt: list[str] | None = None, block_hours: int = BLOCK_HOURS
) -> DataFrame:
    """All fills in order: one hour, same hour of earlier days, line, back fill."""
    started = short_and_seasonal_fill(panel, seasonal_exempt, block_hours)
    return interpolate(started).select("series", hour_start("position").alias("ts"), "value")


def ffill_bfill(
    df: DataFrame, keys: list[str], order: str, block: str, value: str
) -> DataFrame:
    """Last known value, or the next known one before the first."""
    near = with_neighbours(spread(df, keys, block), keys, order, block, value)
    return near.withColumn(
        value, F.coalesce(F.col("before")["value"], F.col("after")["value"])
    ).drop("before", "after")


def null_audit(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Rows and empty cells per key."""
    empty = [F.count_if(F.col(c).isNull()).alias(f"{c}_nulls") for c in columns]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), *empty)
