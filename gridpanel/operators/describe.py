"""Descriptive statistics of the hourly panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridpanel import fixed_values as fv
from gridpanel.functions import calendars, scalars
from gridpanel.functions.sizes import broadcast_within
from gridpanel.operators.joins import join_few
from gridpanel.operators.quantiles import exact_quantiles

# --- totals of a row -------------------------------------------------------------------


def derived_totals(panel: DataFrame) -> DataFrame:
    """Demand, renewable, non-renewable and total generation, trade totals."""
    gen = fv.GENERATION_COLUMN
    return panel.withColumns(
        {
            "total_demand_gwh": scalars.add_up([f"{s}_demand_gwh" for s in fv.SECTORS]),
            "renewable_generation_gwh": scalars.add_up([gen[t] for t in fv.RENEWABLE]),
            "nonrenewable_generation_gwh": scalars.add_up([gen[t] for t in fv.NON_RENEWABLE]),
            "total_imports_gwh": scalars.add_up([f"imports_{b}_gwh" for b in fv.BORDERS]),
            "total_exports_gwh": scalars.add_up([f"exports_{b}_gwh" for b in fv.BORDERS]),
        }
    ).withColumn(
        "total_generation_gwh",
        F.col("renewable_generation_gwh") + F.col("nonrenewable_generation_gwh"),
    )


TRADE = [f"{kind}_{b}_gwh" for kind in ("imports", "exports") for b in fv.BORDERS]
TOTALLED = [
    "total_demand_gwh", *[f"{s}_demand_gwh" for s in fv.SECTORS], "total_generation_gwh",
    "total_imports_gwh", "total_exports_gwh", "renewable_generation_gwh",
    "nonrenewable_generation_gwh", *TRADE,
]
SHARED = (
    ["renewable_generation_gwh", "nonrenewable_generation_gwh"]
    + [fv.GENERATION_COLUMN[t] for t in fv.NON_RENEWABLE + fv.RENEWABLE]
    + ["pumped_hydro_gen_gwh"]
    + TRADE[: len(fv.BORDERS)]
)
YEARLY_ONLY = ["pumped_hydro_consumption_gwh"]


def period_summary(panel: DataFrame, keys: list[str], means: list[str]) -> DataFrame:
    """Means, totals and shares of total generation per period.

    A share is a ratio of sums, not a mean of hourly ratios. The yearly table
    also totals pumping.
    """
    extra = YEARLY_ONLY if keys == ["year"] else []
    whole = F.sum("total_generation_gwh")
    return panel.groupBy(*keys).agg(
        *[F.avg(c).alias(f"mean_{c}") for c in means],
        *[F.sum(c).alias(f"total_{c}") for c in TOTALLED + extra],
        *[scalars.ratio(F.sum(c), whole).alias(f"share_{c}") for c in SHARED + extra],
    )


# --- technology groups -------------------------------------------------------------------


def to_long(df: DataFrame, ids: list[str], columns: dict[str, str], name: str, value: str) -> DataFrame:
    """Wide to long with new names: ``columns`` maps column to label."""
    picked = df.select(*ids, *[F.col(c).cast("double").alias(label) for c, label in columns.items()])
    return picked.unpivot(ids, list(columns.values()), name, value)


def group_columns(columns: dict[str, str]) -> dict[str, Column]:
    """One summed column per reporting group, from technology -> column."""
    groups: dict[str, list[str]] = {}
    for technology, column in columns.items():
        groups.setdefault(fv.GENERATION_GROUP[technology], []).append(column)
    return {g: scalars.add_up(cs) for g, cs in groups.items()}


def grouped_share(panel: DataFrame, keys: list[str]) -> DataFrame:
    """Share of total generation per reporting group; storage is not in the total."""
    sums = {g: F.sum(c) for g, c in group_columns(fv.GENERATION_COLUMN).items()}
    sums["Total"] = F.sum("total_generation_gwh")
    return panel.groupBy(*keys).agg(
        *[scalars.ratio(s, sums["Total"]).alias(g) for g, s in sums.items()]
    )


def grouped_monthly_generation(panel: DataFrame) -> DataFrame:
    """Generation per month start and reporting group, long."""
    groups = group_columns(fv.GENERATION_COLUMN)
    monthly = panel.groupBy("year", "month").agg(*[F.sum(c).alias(g) for g, c in groups.items()])
    dated = monthly.withColumn("date", calendars.month_start("year", "month"))
    return to_long(dated, ["date"], {g: g for g in groups}, "technology", "generation")


def grouped_monthly_capacity(panel: DataFrame) -> DataFrame:
    """Mean capacity per month start and reporting group plus its total, wide."""
    groups = group_columns(fv.CAPACITY_COLUMN)
    monthly = panel.groupBy("year", "month").agg(*[F.avg(c).alias(g) for g, c in groups.items()])
    return monthly.select(
        calendars.month_start("year", "month").alias("date"),
        *[F.col(g) for g in groups],
        scalars.add_up([F.col(g) for g in groups]).alias("Total"),
    )


# --- emissions, demand ----------------------------------------------------------------------


def yearly_emissions(long_generation: DataFrame, technology: DataFrame, totals: DataFrame) -> DataFrame:
    """Direct emissions per year and per unit of total generation.

    ``long_generation`` is ``year, technology, generation`` and ``totals`` is
    ``year, total_generation_gwh``; the intensity is per thousand.
    """
    factors = technology.select("technology", "direct_e_tco2_gwh").where(
        (F.col("direct_e_tco2_gwh") > 0) & F.col("technology").isin(fv.TECHNOLOGIES)
    )
    emitted = (
        long_generation.groupBy("year", "technology")
        .agg(F.sum("generation").alias("generation"))
        .join(broadcast_within(factors, len(fv.TECHNOLOGIES)), "technology")
        .groupBy("year")
        .agg(F.sum(F.col("generation") * F.col("direct_e_tco2_gwh")).alias("total_emissions_tco2"))
    )
    return emitted.join(totals, "year").withColumn(
        "emissions_intensity_tco2_gwh",
        scalars.ratio("total_emissions_tco2", "total_generation_gwh") / 1e3,
    )


def profile_with_band(df: DataFrame, key: str, columns: dict[str, Column | str]) -> DataFrame:
    """Mean per key value with a normal 95% band, for each named column."""
    out = []
    for name, c in columns.items():
        x = scalars.as_col(c)
        se = F.stddev_samp(x) / F.sqrt(F.count(F.lit(1)))
        out += [
            F.avg(x).alias(f"{name}_dem"),
            se.alias(f"{name}_se"),
            (F.avg(x) - fv.CONFIDENCE_Z * se).alias(f"{name}_ci_lower"),
            (F.avg(x) + fv.CONFIDENCE_Z * se).alias(f"{name}_ci_upper"),
        ]
    return df.groupBy(key).agg(*out)


def demand_profile(panel: DataFrame, key: str) -> DataFrame:
    sectors = [f"{s}_demand_gwh" for s in fv.SECTORS]
    names = dict(zip(["res", "com", "ind"], sectors))
    return profile_with_band(panel, key, names | {"total": scalars.add_up(sectors)})


def demand_by_sector(panel: DataFrame) -> DataFrame:
    """Yearly demand in TWh by sector with the total."""
    names = dict(zip(["total_res_demand", "total_com_demand", "total_ind_demand"], fv.SECTORS))
    sums = panel.groupBy("year").agg(
        *[(F.sum(f"{s}_demand_gwh") / 1e3).alias(n) for n, s in names.items()]
    )
    return sums.withColumn("total_demand", scalars.add_up(list(names)))


def sector_shares(demand: DataFrame) -> DataFrame:
    """Long form of the yearly sector demand with each sector's share."""
    labels = {
        "total_res_demand": "Residential",
        "total_com_demand": "Commercial",
        "total_ind_demand": "Industrial",
    }
    long = to_long(demand, ["year", "total_demand"], labels, "sector", "demand")
    return long.withColumn("demand_share", scalars.ratio("demand", "total_demand"))


def with_history_and_projections(observed: DataFrame, history: DataFrame, projected: DataFrame) -> DataFrame:
    """Older totals, observed years by sector and projections in one table."""
    return history.unionByName(observed, allowMissingColumns=True).unionByName(
        projected, allowMissingColumns=True
    )


def rank_labels(
    df: DataFrame, keys: list[str], value: str, prefix: str = "S", low: float = 2026.0, high: float = 2030.0
) -> DataFrame:
    """Rank rows by value, label them S1, S2, ... and place them evenly in [low, high].

    ``keys`` bound the ranking: one key holds one set of alternatives.
    """
    w = Window.partitionBy(*keys)
    rank = F.row_number().over(w.orderBy(value))
    step = scalars.ratio(F.lit(high - low), (F.count(F.lit(1)).over(w) - 1).cast("double"))
    return df.select(
        "*",
        F.concat(F.lit(prefix), rank).alias("label"),
        (low + (rank - 1) * F.coalesce(step, F.lit(0.0))).alias("position"),
    )


def accepted(value: Column | str, below: float = fv.ACCEPTED_BELOW_TWH) -> Column:
    return F.when(scalars.as_col(value) < below, "Accepted projections").otherwise(
        "Rejected projections"
    )


# --- distribution, trend, extremes --------------------------------------------------------------


def boxplot_stats(
    df: DataFrame, keys: list[str], value: str, max_groups: int | None = None
) -> DataFrame:
    """Quartiles and the most distant values within 1.5 quartile ranges.

    ``max_groups`` is the number of groups if fixed lists bound it.
    """
    points = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    quartiles = exact_quantiles(df, keys, value, points, max_groups=max_groups)
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    x = F.col(value)
    within = x.between(F.col("q1") - reach, F.col("q3") + reach)
    known = df.where(x.isNotNull())
    return (
        (join_few(known, quartiles, keys) if max_groups is None else known.join(broadcast_within(quartiles, max_groups), keys))
        .groupBy(*keys, "q1", "median", "q3")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min(F.when(within, x)).alias("whisker_low"),
            F.max(F.when(within, x)).alias("whisker_high"),
        )
    )


def trend(df: DataFrame, keys: list[str], y: str, x: str, until=None) -> DataFrame:
    """Least-squares line of y on x per key, over the points with x up to ``until``."""
    fitted = df if until is None else df.where(F.col(x) <= until)
    return fitted.groupBy(*keys).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept")
    )


def extrapolate(line: DataFrame, keys: list[str], points: DataFrame, x: str, out: str) -> DataFrame:
    """Fitted value at the x of each point."""
    joined = points.join(line, keys)
    return joined.withColumn(out, F.col("intercept") + F.col("slope") * F.col(x))


def significant_extremes(monthly: DataFrame, year: str, month: str, value: str) -> DataFrame:
    """Months that top (or bottom) their 7-month neighbourhood by a margin.

    Neighbourhoods stay within a year, so only months with three months on
    either side qualify.
    """
    w = Window.partitionBy(year).orderBy(month)
    around = w.rowsBetween(-3, 3)
    full = F.count(F.lit(1)).over(around) == 7
    v = F.col(value)
    lag3, lead3 = F.lag(value, 3).over(w), F.lead(value, 3).over(w)
    flags = monthly.select(
        "*",
        F.when(full, F.max(value).over(around)).alias("roll_max"),
        F.when(full, F.min(value).over(around)).alias("roll_min"),
        lag3.alias("lag_3"),
        lead3.alias("lead_3"),
    )
    peak = (v == F.col("roll_max")) & (v > F.greatest("lag_3", "lead_3") + fv.PEAK_MARGIN)
    trough = (v == F.col("roll_min")) & (v < F.least("lag_3", "lead_3") - fv.PEAK_MARGIN)
    false = F.lit(False)
    return flags.withColumn("peak", F.coalesce(peak, false)).withColumn(
        "trough", F.coalesce(trough, false)
    )


def last_per_group(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row with the greatest order per key."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.col(order)).alias("_row")
    ).select(*keys, *[F.col("_row")[c].alias(c) for c in rest])
