"""Sampled windows of history, rescaled to a projected year."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpanel import fixed_values as fv
from gridpanel.functions import calendars, scalars, sizes

SALTS = 32
BROADCAST_BYTES = 256 << 20


def expand(
    panel: DataFrame, draws: DataFrame, strategy: str = "measured",
    window_days: int | None = fv.WINDOW_DAYS, salts: int = SALTS, max_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Each iteration's hours: its base year, and in every month the days from
    ``day_start`` on (``window_days=None``: the whole year).

    Days are listed on the draw, which makes it a plain equi join. ``"measured"`` counts the
    panel's rows: up to ``max_bytes`` of numbers it is broadcast, which leaves iterations where they are;
    beyond that, and with ``"salted"``, it is
    copied ``salts`` times with iterations dealt over the copies, since a handful of
    (year, day) keys would otherwise hold all rows. ``"broadcast"`` refuses a larger panel. The
    panel should be a stored table with the columns that are used.
    """
    if strategy not in ("measured", "broadcast", "salted"):
        raise ValueError(f"unknown strategy {strategy!r}")
    keyed = draws
    on = ["year"]
    if window_days is not None:
        last = F.col("day_start") + window_days - 1
        keyed = keyed.withColumn("day", F.explode(F.sequence(F.col("day_start"), last)))
        on = ["year", "day"]
    keyed = keyed.withColumn("year", F.col("base_year"))
    small = None if strategy == "salted" else sizes.broadcast_if_small(panel, max_bytes)
    if small is not None:
        return keyed.join(small, on)
    if strategy == "broadcast":
        raise ValueError(f"the panel takes more than {max_bytes} bytes")
    copies = panel.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = keyed.withColumn(
        "salt", F.pmod(F.xxhash64("scenario", "iteration"), F.lit(salts)).cast("int")
    )
    return dealt.join(copies, [*on, "salt"]).drop("salt")


def apply_deltas(hours: DataFrame, variables: list[str]) -> DataFrame:
    """Grow each variable by its ``d_`` factor, carried on the row."""
    return hours.withColumns(
        {v: F.col(v) * (1.0 + F.coalesce(F.col(f"d_{v}"), F.lit(0.0))) for v in variables}
    ).drop(*[f"d_{v}" for v in variables])


def climate_scale(hours: DataFrame) -> DataFrame:
    """Monthly demand multiplier in climate scenarios; industry is not affected."""
    factor = F.when(
        F.col("climate_demand"), calendars.by_month(fv.CLIMATE_MULTIPLIER, "month")
    ).otherwise(1.0)
    return hours.withColumns(
        {f"{s}_demand_gwh": F.col(f"{s}_demand_gwh") * factor for s in ("residential", "commercial")}
    )


def floor_price(hours: DataFrame) -> DataFrame:
    return hours.withColumn("spot_price_eur_mwh", scalars.price_floor("spot_price_eur_mwh"))


def project(hours: DataFrame, variables: list[str]) -> DataFrame:
    """All steps from sampled history to a projected hour."""
    return floor_price(climate_scale(apply_deltas(hours, variables)))
