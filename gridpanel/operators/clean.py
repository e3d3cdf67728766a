"""Panel building and column clean-up."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridpanel import fixed_values as fv
from gridpanel.functions import calendars, scalars
from gridpanel.functions.sizes import broadcast_within
from gridpanel.operators.joins import join_few
from gridpanel.operators import fill

# --- rows ----------------------------------------------------------------------------


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the first along ``order``; ties fall to the other columns.

    An aggregate rather than a ranking window, so that copies of a hot key are
    reduced before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = df.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("_row"))
    return best.select(*keys, *[F.col("_row")[c].alias(c) for c in [*order, *rest]]).select(
        *df.columns
    )


def hourly_mean(panel: DataFrame) -> DataFrame:
    """Mean per series and clock hour."""
    hour = F.date_trunc("hour", F.col("ts").cast("timestamp"))
    return panel.groupBy("series", hour.alias("ts")).agg(F.avg("value").alias("value"))


def monthly_sum(panel: DataFrame) -> DataFrame:
    return panel.groupBy("series", calendars.year_month("ts").alias("year_month")).agg(
        F.sum("value").alias("value")
    )


# --- spine and joins -------------------------------------------------------------------


def hourly_spine(series: DataFrame, start: Column | datetime, end: Column | datetime) -> DataFrame:
    """Every hour from start to end for each series.

    The calendar is unrolled by day and then by hour so that a long span never
    sits in one array.
    """
    lo = start if isinstance(start, Column) else F.lit(start)
    hi = end if isinstance(end, Column) else F.lit(end)
    days = series.select(
        "series",
        lo.alias("_lo"),
        hi.alias("_hi"),
        F.explode(F.sequence(F.to_date(lo), F.to_date(hi))).alias("_day"),
    )
    hours = days.select(
        "series",
        "_lo",
        "_hi",
        F.explode(
            F.transform(
                F.sequence(F.lit(0), F.lit(23)),
                lambda h: F.col("_day").cast("timestamp") + F.make_dt_interval(hours=h),
            )
        ).alias("ts"),
    )
    return hours.where(F.col("ts").between(F.col("_lo"), F.col("_hi"))).select("series", "ts")


def on_spine(panel: DataFrame, spine: DataFrame) -> DataFrame:
    """Left join of an hourly panel to its calendar: missing hours become null."""
    return spine.join(panel, ["series", "ts"], "left").select("series", "ts", "value")


def coarse_join(
    fine: DataFrame, coarse: DataFrame, key: Column, name: str, max_periods: int | None = None
) -> DataFrame:
    """Attach monthly, daily or yearly columns to finer rows.

    ``coarse`` has one row per calendar period under ``name``. ``max_periods``
    is the number of periods in the calendar span, if it is known.
    """
    return fine.withColumn(name, key).join(broadcast_within(coarse, max_periods), name, "left")


def override_series(panel: DataFrame, better: DataFrame) -> DataFrame:
    """Replace whole series by those of another source, matched by name; the panel's rows are
    not moved to their names, of which there are few."""
    names = better.select("series").distinct()
    return join_few(panel, names, ["series"], "left_anti").unionByName(better.select(*panel.columns))


def override_columns(df: DataFrame, better: DataFrame, key: str) -> DataFrame:
    """Wide form of the same: overlapping columns come from ``better``."""
    overlap = [c for c in better.columns if c != key and c in df.columns]
    return df.drop(*overlap).join(better, key, "left")


# --- columns -----------------------------------------------------------------------------


def backfill_columns(df: DataFrame, expected: list[str], value: float = 0.0) -> DataFrame:
    """Add expected columns that are missing."""
    return df.withColumns({c: F.lit(value) for c in expected if c not in df.columns})


def constant_columns(df: DataFrame, values: dict[str, float] | None = None) -> DataFrame:
    values = fv.FIXED_CAPACITY_MW if values is None else values
    return df.withColumns({c: F.lit(v) for c, v in values.items()})


def year_mapped_column(
    df: DataFrame, year: Column | str, out: str,
    by_year: dict[int, float] | None = None, default: float = fv.BATTERY_MW_DEFAULT,
) -> DataFrame:
    """A value per year, with a default for other years."""
    by_year = fv.BATTERY_MW_BY_YEAR if by_year is None else by_year
    pairs = [F.lit(x) for y, v in by_year.items() for x in (y, float(v))]
    year_int = scalars.as_col(year).cast("int")
    table = F.create_map(*pairs)
    return df.withColumn(out, F.coalesce(F.try_element_at(table, year_int), F.lit(float(default))))


def rescale_if_mean_exceeds(
    df: DataFrame, column: str, threshold: float = fv.RESCALE_MEAN_THRESHOLD, divisor: float = 10.0
) -> DataFrame:
    """Divide a column reported in a wrong scale. The mean is a one-value subquery."""
    mean = df.agg(F.avg(column)).scalar()
    return df.withColumn(
        column, F.when(mean > threshold, F.col(column) / divisor).otherwise(F.col(column))
    )


def signed_split(df: DataFrame, raw: str, name: str, unit: str = "mwh") -> DataFrame:
    """A signed flow to its import and export parts; the net is kept."""
    return df.withColumns(
        {
            f"net_flows_{name}_{unit}": F.col(raw),
            f"imports_{name}_{unit}": scalars.import_part(raw),
            f"exports_{name}_{unit}": scalars.export_part(raw),
        }
    )


def capacity_factors(df: DataFrame) -> DataFrame:
    """Availability of nuclear (self reported), solar and wind."""
    sources = {
        "nuclear": ("nuclear_self_reported_cap_mw", "nuclear_cap_mw"),
        "solar_pv": ("solar_pv_gen_mwh", "solar_pv_cap_mw"),
        "solar_thermal": ("solar_thermal_gen_mwh", "solar_thermal_cap_mw"),
        "wind": ("wind_gen_mwh", "wind_cap_mw"),
    }
    return df.withColumns(
        {f"{t}_cap_factor": scalars.capacity_factor(g, c) for t, (g, c) in sources.items()}
    )


def clip_negative(df: DataFrame, marks: tuple[str, ...] = ("_gen_", "_cap_factor")) -> DataFrame:
    """No negative output: every column whose name carries one of the marks."""
    return df.withColumns(
        {c: scalars.clip(c, low=0.0) for c in df.columns if any(m in c for m in marks)}
    )


def calendar_parts(df: DataFrame, ts: str = "ts") -> DataFrame:
    c = F.col(ts)
    return df.withColumns(
        {
            "time_long": F.date_format(c, "yyyy-MM-dd HH:mm:ss"),
            "year": F.year(c),
            "month": F.month(c),
            "day": F.dayofmonth(c),
            "hour": F.hour(c),
        }
    )


def convert_units(df: DataFrame) -> DataFrame:
    """Suffix-driven: MW and MWh columns to GW and GWh, fuel costs to EUR/GWh.

    Prices per MWh (spot) and per tonne (allowances) keep their unit.
    """
    out = []
    for c in df.columns:
        volume = c.endswith(("_mw", "_mwh")) and not c.startswith(("spot_", "cost_", "eu_ets"))
        if volume:
            new = c.replace("_mwh", "_gwh").replace("_mw", "_gw")
            out.append((F.col(f"`{c}`") / 1000.0).alias(new))
        elif c.startswith("cost_"):
            out.append((F.col(f"`{c}`") * 1000.0).alias(c.replace("_mwh", "_gwh")))
        else:
            out.append(F.col(f"`{c}`"))
    return df.select(*out)


def ordered_projection(df: DataFrame, order: list[str], on_missing: str = "raise") -> DataFrame:
    """Columns in a fixed order. A missing name is an error unless told to skip it."""
    missing = [c for c in order if c not in df.columns]
    if missing and on_missing != "skip":
        raise ValueError(f"columns missing from the panel: {missing}")
    return df.select(*[F.col(f"`{c}`") for c in order if c in df.columns])


# --- demand by voltage level -----------------------------------------------------------------


def level_shares(levels: DataFrame, keys: list[str], level: str, value: str, position: str) -> DataFrame:
    """Mean share of each level per calendar position.

    ``levels`` is long: one row per ``keys`` (time), ``position`` (a function of
    the keys, such as month-day-hour) and level. A time whose levels add up to 0
    has no share and does not enter the mean.
    """
    totals = levels.groupBy(*keys, position).agg(F.sum(value).alias("_total"))
    return (
        levels.join(totals, [*keys, position])
        .groupBy(position, level)
        .agg(F.avg(scalars.ratio(F.col(value), F.col("_total"))).alias("share"))
    )


def split_by_share(
    totals: DataFrame, time: str, position_of: Column, shares: DataFrame, position: str, level: str
) -> DataFrame:
    """Every time and level with the level's ``share`` at that calendar position; a
    position without one takes the last share before it, or the next one after.

    The levels are a handful of names; they travel as one array on one row.
    """
    names = shares.agg(F.collect_set(level).alias("_levels")).withColumn("_one", F.lit(1))
    listed = totals.withColumn("_one", F.lit(1)).join(F.broadcast(names), "_one")
    wanted = listed.select(*totals.columns, position_of.alias(position), F.explode("_levels").alias(level))
    joined = wanted.join(shares, [position, level], "left").withColumn("_block", F.year(time))
    return fill.ffill_bfill(joined, [level], time, "_block", "share").drop("_block")
