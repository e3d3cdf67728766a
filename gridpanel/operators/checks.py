"""What couples hours: bundles, ramps, storage stocks, weekly budgets."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridpanel import fixed_values as fv
from gridpanel.functions.calendars import hour_number
from gridpanel.operators import blocks


def with_bundle(
    df: DataFrame, keys: list[str], order: str, block: str | None = None,
    size: int = fv.BUNDLE_HOURS, out: str = "bundle",
) -> DataFrame:
    """Number runs of ``size`` rows; what is left over joins the last full run.

    A group of fewer rows is one bundle. Without ``block`` a group is taken to
    be one sampled iteration, of at most a year of hours; with it, groups of any
    length are numbered block by block.
    """
    if block is None:
        w = Window.partitionBy(*keys)
        numbered = df.withColumn("_n", F.row_number().over(w.orderBy(order))).withColumn(
            "_all", F.count(F.lit(1)).over(w)
        )
    else:
        placed = blocks.spread(df, keys, block)
        sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_all"))
        numbered = blocks.with_row_number(placed, keys, [order], block, "_n").join(sizes, keys)
    full = F.greatest(F.floor(F.col("_all") / size) - 1, F.lit(0))
    return numbered.withColumn(out, F.least(F.floor((F.col("_n") - 1) / size), full)).drop("_n", "_all")


def with_calendar_bundle(
    df: DataFrame, ts: str, first: Column | int, last: Column | int, size: int = fv.BUNDLE_HOURS, out: str = "bundle"
) -> DataFrame:
    """``with_bundle`` where every hour is there once from hour number ``first`` to ``last``: a row's
    position follows from its time, so nothing is numbered, sorted or shuffled."""
    begin, end = (x if isinstance(x, Column) else F.lit(x) for x in (first, last))
    full = F.greatest(F.floor((end - begin + 1) / size) - 1, F.lit(0))
    return df.withColumn(out, F.least(F.floor((hour_number(ts) - begin) / size), full).cast("bigint"))


def bundle_bounds(
    df: DataFrame, keys: list[str], value: str, bundle: str = "bundle", prefix: str = "hydro"
) -> DataFrame:
    """Minimum, maximum and total of each bundle, on every row of it."""
    w = Window.partitionBy(*keys, bundle)
    return df.withColumns(
        {
            f"{prefix}_min": F.min(value).over(w),
            f"{prefix}_max": F.max(value).over(w),
            f"{prefix}_total": F.sum(value).over(w),
        }
    )


def weekly_budget(
    df: DataFrame, keys: list[str], used: str, budget: str, factor: Column | float = 1.0,
    bundle: str = "bundle", tol: float = 1e-9,
) -> DataFrame:
    """Use and budget per bundle with a flag where use is larger."""
    scale = factor if isinstance(factor, Column) else F.lit(factor)
    sums = df.groupBy(*keys, bundle).agg(
        F.sum(used).alias("used"), F.sum(F.col(budget) * scale).alias("budget")
    )
    return sums.withColumn("violated", F.col("used") > F.col("budget") + tol)


def ramp_changes(
    df: DataFrame, keys: list[str], order: str, block: str, q: str, limit: Column, tol: float = 1e-9
) -> DataFrame:
    """Change against the previous row, its limit, and whether it is exceeded."""
    placed = blocks.spread(df.withColumn("limit", limit), keys, block)
    before = blocks.with_previous(placed, keys, [order], block, [q], "_before")
    change = F.col(q) - F.col("_before")[q]
    return (
        before.withColumn("change", change)
        .withColumn("violated", F.coalesce(F.abs(F.col("change")) > F.col("limit") + tol, F.lit(False)))
        .drop("_before")
    )


def ramp_violations(dispatched: DataFrame, params: dict[str, float], keys: list[str], order: str, block: str) -> DataFrame:
    """Rows of a wide dispatch whose output moved faster than allowed, long."""
    rows = F.array(
        *[
            F.struct(
                F.lit(t).alias("technology"), F.col(f"q_{t}").alias("q"),
                (F.col(fv.CAPACITY_COLUMN[t]) * params[p]).alias("limit"),
            )
            for t, p in fv.RAMP_FACTOR.items()
        ]
    )
    long = dispatched.select(*keys, order, block, F.explode(rows).alias("r")).select(
        *keys, order, block, "r.*"
    )
    checked = ramp_changes(long, [*keys, "technology"], order, block, "q", F.col("limit"))
    return checked.where("violated").drop("violated", block)


def soc_rollforward(
    df: DataFrame, keys: list[str], order: str, block: str, charge: str, discharge: str,
    efficiency: float, start: Column, out: str = "stock",
) -> DataFrame:
    """Stock before each row: the start plus what earlier rows put in and took out."""
    root = math.sqrt(efficiency)
    flow = F.col(charge) * root - F.col(discharge) / root
    placed = blocks.spread(df, keys, block)
    rolled = blocks.with_running_sum(placed, keys, [order], block, flow, out, inclusive=False)
    return rolled.withColumn(out, start + F.col(out))


def soc_violations(
    df: DataFrame, keys: list[str], order: str, stock: str, cap: Column, least_end: float = 0.2,
    tol: float = 1e-9,
) -> DataFrame:
    """Per key: rows below 0 and above capacity, and whether the last stock is too low."""
    level = F.col(stock)
    low_end = F.max_by(level, F.col(order)) < least_end * F.max_by(cap, F.col(order)) - tol
    return df.groupBy(*keys).agg(
        F.count_if(level < -tol).alias("below_zero"),
        F.count_if(level > cap + tol).alias("above_cap"),
        low_end.alias("low_end"),
    )


def stock_columns(hours: DataFrame, params: dict[str, float], keys: list[str], order: str, start_share: Column) -> DataFrame:
    """Pumped-hydro and battery stocks of each iteration from its flows.

    One iteration is at most a year of hours, so its window is short.
    ``start_share`` is the initial filling, for example a keyed uniform.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)

    def rolled(charge, discharge, efficiency, start):
        root = math.sqrt(efficiency)
        flow = F.sum(charge * root - discharge / root).over(before)
        return start + F.coalesce(flow, F.lit(0.0))

    hydro = rolled(
        F.col("charge"), F.col("q_pumped_hydro"), params["ph_roundtrip_eff"],
        start_share * params["ph_storage_cap_gwh"],
    )
    battery = rolled(
        F.col("battery_charge"), F.col("q_battery"), params["batt_roundtrip_eff"],
        start_share * params["batt_duration"] * F.first("batteries_cap_gw").over(w),
    )
    return hours.withColumns({"pumped_hydro_storage": hydro, "battery_storage": battery})


# --- storage limits over series of any length --------------------------------------------------


def stores(params: dict[str, float], battery_charge: str = "battery_charge") -> Column:
    """The two stores of a row: flows, the power that limits them, the stock that limits the
    store, and the size its first and last stock are measured by."""

    def store(name, charge, discharge, efficiency, charge_power, discharge_power, limit, size):
        root = math.sqrt(params[efficiency])
        return F.struct(
            F.lit(name).alias("store"),
            (F.col(charge) * root - F.col(discharge) / root).alias("flow"),
            (F.col(charge) - F.col(charge_power)).alias("charge_over"),
            (F.col(discharge) - F.col(discharge_power)).alias("discharge_over"),
            limit.cast("double").alias("limit"),
            size.cast("double").alias("size"),
        )

    hydro, battery = F.lit(params["ph_storage_cap_gwh"]), params["batt_duration"] * F.col("batteries_cap_gw")
    return F.array(
        store(
            "pumped_hydro", "charge", "q_pumped_hydro", "ph_roundtrip_eff", "pumped_hydro_pump_cap_gw",
            "pumped_hydro_turb_cap_gw", hydro, hydro,
        ),
        store(
            "battery", battery_charge, "q_battery", "batt_roundtrip_eff", "batteries_cap_gw", "batteries_cap_gw",
            battery / math.sqrt(params["batt_roundtrip_eff"]), battery,
        ),
    )


def storage_checks(
    hours: DataFrame, params: dict[str, float], keys: list[str], order: str, block: str, start_share: Column,
    least_end: float = 0.2, tol: float = 1e-9,
) -> DataFrame:
    """Per key and store: its first and last stock, steps below 0, above the limit (the first one
    is given, so it is not tested) and with flows beyond power, and whether it ends below ``least_end`` of its size.

    A block of a series hands on its flow, its lowest running stock and its highest one against
    the limit, all from a start of 0; these add up along the blocks. Rows are counted only in
    blocks whose summary shows that a limit is passed, so a series of any length passes in pieces.
    ``start_share`` is the first stock by size, of the key's columns.
    """
    group = [*keys, "store"]
    long = hours.select(*keys, order, block, start_share.alias("share"), F.explode(stores(params)).alias("s"))
    placed = blocks.spread(long.select(*keys, order, block, "share", "s.*"), group, block)
    so_far = Window.partitionBy(*group, block).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    local = placed.withColumn("rolled", F.coalesce(F.sum("flow").over(so_far), F.lit(0.0)))
    ends = local.groupBy(*group, block).agg(
        F.sum("flow").alias("flow"), F.min("rolled").alias("lowest"),
        F.max(F.col("rolled") - F.col("limit")).alias("highest"), F.min_by(F.struct("size", "share"), order).alias("opening"),
        F.min(order).alias("begins"), F.max_by("rolled", order).alias("closing"),
        F.count_if(F.col("charge_over") > tol).alias("charge_over"), F.count_if(F.col("discharge_over") > tol).alias("discharge_over"),
    )
    along = Window.partitionBy(*group).orderBy(block)
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    first = F.first("opening").over(along)
    carried = ends.withColumns(
        {
            "size": first["size"], "start": first["size"] * first["share"],
            "carry": first["size"] * first["share"] + F.coalesce(F.sum("flow").over(earlier), F.lit(0.0)),
            "opens": F.first("begins").over(along),
        }
    )
    broken = (F.col("carry") + F.col("lowest") < -tol) | (F.col("carry") + F.col("highest") > tol)
    passed = carried.where(broken).select(*group, block, "carry", "opens")
    stock = F.col("carry") + F.col("rolled")
    counted = (
        local.join(passed, [*group, block])
        .groupBy(*group)
        .agg(
            F.count_if(stock < -tol).alias("below_zero"),
            F.count_if((stock > F.col("limit") + tol) & (F.col(order) > F.col("opens"))).alias("above_limit"),
        )
    )
    whole = carried.groupBy(*group).agg(
        F.first("start").alias("first_stock"), F.max_by(F.col("carry") + F.col("closing"), block).alias("last_stock"),
        F.sum("charge_over").alias("charge_over"), F.sum("discharge_over").alias("discharge_over"),
        (F.max_by(F.col("carry") + F.col("closing"), block) < least_end * F.first("size") - tol).alias("low_end"),
    )
    return whole.join(counted, group, "left").fillna(0, ["below_zero", "above_limit"])
