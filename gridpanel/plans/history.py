"""From landed feeds to the wide hourly panel."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpanel import fixed_values as fv
from gridpanel import schemas
from gridpanel.functions import calendars, scalars
from gridpanel.functions.sizes import broadcast_within
from gridpanel.operators import clean, fill
from gridpanel.operators.blocks import hour_block

PRICE_SERIES = ["spot_price_eur_mwh"]
DAILY_COSTS = [
    "cost_gas_eur_mwh", "cost_coal_eur_mwh", "cost_diesel_eur_mwh", "cost_uranium_eur_mwh",
    "eu_ets_price_eur_tco2",
]
HOURS_OF_YEAR = 8784


def series_names() -> list[str]:
    """Every series of the panel before unit conversion."""
    names = [*fv.INDICATOR_NAMES.values(), *fv.MONTHLY_CAPACITY_NAMES.values()]
    return names + [c for c in fv.HYDRO_FEED_COLUMNS if c not in names]


def complete_series(
    hourly: DataFrame, capacity: DataFrame, hydro: DataFrame | None, start: datetime, end: datetime
) -> DataFrame:
    """All series on the full calendar, gaps open: hourly feeds, hydro columns
    from their own feed, monthly capacities repeated over their month."""
    spark = hourly.sparkSession
    if hydro is not None:
        found = [c for c in fv.HYDRO_FEED_COLUMNS if c in hydro.columns]
        better = hydro.unpivot(["datetime"], found, "series", "value").withColumnRenamed("datetime", "ts")
        hourly = hourly.where(~F.col("series").isin(found)).unionByName(better)
    monthly = list(fv.MONTHLY_CAPACITY_NAMES.values())

    def spine(names):
        listed = spark.createDataFrame([(n,) for n in names], "series string")
        return clean.hourly_spine(listed, start, end)

    others = [n for n in series_names() if n not in monthly]
    fine = clean.on_spine(hourly, spine(others))
    months = (end.year - start.year + 1) * 12 * len(monthly)
    coarse = spine(monthly).withColumn("year_month", calendars.year_month("ts")).join(
        broadcast_within(capacity, months), ["series", "year_month"], "left"
    )
    return fine.unionByName(coarse.select("series", "ts", "value"))


def split_demand(panel: DataFrame, hours: int | None = HOURS_OF_YEAR) -> DataFrame:
    """National demand by sector.

    A voltage level's share is its mean over the years at the same month, day
    and hour; an hour without any share takes that of the hour before.
    """
    panel = clean.rescale_if_mean_exceeds(panel, "total_national_demand_mwh")
    levels = {lv: f"`demand_{lv}_mwh`" for lv in fv.VOLTAGE_LEVELS}
    total = scalars.add_up([F.coalesce(F.col(c), F.lit(0.0)) for c in levels.values()])
    keyed = panel.withColumns({"mdh": calendars.month_day_hour("ts"), "_total": total})
    means = keyed.groupBy("mdh").agg(
        *[F.avg(scalars.ratio(F.col(c), F.col("_total"))).alias(f"share_{i}") for i, c in enumerate(levels.values())]
    )
    names = [f"share_{i}" for i in range(len(levels))]
    shares = means.select(
        "mdh", F.when(F.col(names[0]).isNotNull(), F.struct(*names)).alias("shares")
    )
    joined = keyed.select("ts", "mdh").join(broadcast_within(shares, hours), "mdh", "left")
    placed = joined.withColumns({"_key": F.lit("all"), "block": hour_block("ts")})
    carried = fill.ffill_bfill(placed, ["_key"], "ts", "block", "shares").select("ts", "shares")
    out = keyed.join(carried, "ts").drop("mdh", "_total")
    sectors: dict[str, list] = {s: [] for s in fv.SECTORS}
    for i, lv in enumerate(levels):
        sectors[fv.SECTOR_OF_LEVEL[lv]].append(F.col("shares")[f"share_{i}"])
    return out.withColumns(
        {
            f"{s}_demand_mwh": scalars.add_up(parts) * F.col("total_national_demand_mwh")
            for s, parts in sectors.items()
        }
    ).drop("shares", *[f"demand_{lv}_mwh" for lv in fv.VOLTAGE_LEVELS])


def fill_daily_costs(costs: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Every calendar day with the last known cost, or the next before the first.

    ``costs`` is long: ``series, date, price``.
    """
    names = costs.select("series").distinct()
    days = names.withColumn(
        "date", F.explode(F.sequence(F.lit(start.date()), F.lit(end.date())))
    ).join(costs, ["series", "date"], "left")
    filled = fill.ffill_bfill(
        days.withColumn("block", F.year("date")), ["series"], "date", "block", "price"
    )
    return filled.groupBy("date").pivot("series", DAILY_COSTS).agg(F.first("price"))


def build_history(
    hourly: DataFrame, capacity: DataFrame, costs: DataFrame, start: datetime, end: datetime,
    hydro: DataFrame | None = None,
) -> DataFrame:
    """The hourly panel in its published order and units.

    ``hourly`` is ``series, ts, value``; ``capacity`` is ``series, year_month,
    value``; ``costs`` is ``series, date, price``; ``hydro`` has a ``datetime``
    and hydro columns. A series without any value is 0.
    """
    filled = fill.impute(complete_series(hourly, capacity, hydro, start, end), PRICE_SERIES)
    wide = filled.groupBy("ts").pivot("series", series_names()).agg(F.first("value"))
    wide = wide.fillna(0.0)
    wide = clean.constant_columns(wide)
    wide = clean.year_mapped_column(wide, F.year("ts"), "batteries_cap_mw")
    wide = wide.withColumn("batteries_gen_mwh", F.lit(0.0))
    wide = split_demand(wide)
    for b in fv.BORDERS:
        wide = clean.signed_split(wide, f"net_raw_{b}_mwh", b)
    wide = clean.clip_negative(clean.capacity_factors(wide))
    days = (end - start).days + 1
    daily = fill_daily_costs(costs, start, end)
    wide = clean.coarse_join(wide, daily, F.to_date("ts"), "date", days).drop("date")
    named = clean.convert_units(clean.calendar_parts(wide))
    order = [f.name for f in schemas.HOURLY_PANEL.fields]
    return clean.ordered_projection(named, order)
