"""Indicators of each iteration and statistics over iterations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridpanel import fixed_values as fv
from gridpanel import schemas
from gridpanel.functions import calendars, scalars
from gridpanel.functions.sizes import broadcast_within
from gridpanel.operators.blocks import with_row_number
from gridpanel.operators.describe import to_long
from gridpanel.operators.quantiles import exact_quantiles

RUN = ["scenario", "iteration"]
PRODUCERS = fv.NON_RENEWABLE + fv.RENEWABLE


# --- one row per iteration ----------------------------------------------------------------


def valid_hours(hours: DataFrame) -> DataFrame:
    """Hours with a price; the others are marked by status, not by a sentinel."""
    return hours.where(F.col("status") != "undefined")


def status_counts(hours: DataFrame, keys: list[str]) -> DataFrame:
    """Hours of each status, the undefined ones included, which no other table counts."""
    return hours.groupBy(*keys).agg(
        *[F.count_if(F.col("status") == s).alias(f"{s}_hours") for s in ("cleared", "shortage", "oversupply", "undefined")]
    )


def price_stats(hours: DataFrame, keys: list[str], price: str = "price") -> DataFrame:
    return hours.groupBy(*keys).agg(
        F.avg(price).alias("avg_price"),
        F.max(price).alias("max_price"),
        F.min(price).alias("min_price"),
        F.stddev_samp(price).alias("std_price"),
    )


def curtailed_share(produced: Column, curtailed: Column) -> Column:
    """1 - produced / available; null where nothing was available."""
    return 1.0 - scalars.ratio(produced, produced + curtailed)


class OverHours:
    """Aggregates as they are taken from the cleared hours themselves."""

    def count(self) -> Column:
        return F.count(F.lit(1))

    def count_if(self, condition: str) -> Column:
        return F.count_if(F.expr(CONDITIONS[condition]))

    def first(self, c: str) -> Column:
        return F.min_by(c, "ts")

    def __getattr__(self, kind: str):
        return {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "std": F.stddev_samp}[kind]


CONDITIONS = {
    "shortage": "status = 'shortage'",
    "oversupply": "status = 'oversupply'",
    "shed": f"shed > {fv.SHED_HOUR_THRESHOLD!r}D",
}


def kpi_columns(over=None) -> dict[str, Column]:
    """Aggregates of an iteration's cleared hours, in reporting order.

    Flows are scaled from the sampled hours to a year. Emissions are given both
    for the sample and for a year. ``over`` says how aggregates are taken: from hours or
    from their ``parts``.
    """
    over = over or OverHours()
    yearly = F.lit(fv.HOURS_PER_YEAR) / over.count()

    def annual(c):
        return over.sum(c) * yearly

    def share(c):
        return scalars.ratio(over.sum(c), over.sum("total_generation"))

    out = {
        "n_hours": over.count(),
        "shortage_hours": over.count_if("shortage"),
        "oversupply_hours": over.count_if("oversupply"),
        "baseline_year": over.min("base_year"),
        "day_start": over.min("day_start"),
        "avg_price": over.avg("price"),
        "max_price": over.max("price"),
        "min_price": over.min("price"),
        "std_price": over.std("price"),
    }
    out |= {f"{s}_demand": annual(f"{s}_demand") for s in fv.SECTORS}
    surplus = over.sum("producer_revenue") - over.sum("total_costs")
    out |= {
        "total_demand": annual("total_demand"),
        "consumer_surplus": annual("consumer_surplus"),
        "producer_surplus": surplus * yearly,
        "total_cost": annual("total_costs"),
        "net_welfare": (over.sum("consumer_surplus") + surplus) * yearly,
    }
    out |= {f"{t}_gen": annual(f"q_{t}") for t in PRODUCERS}
    out |= {
        "pumped_hydro_pumping": annual("charge"),
        "pumped_hydro_out": annual("q_pumped_hydro"),
        "battery_charge": annual("battery_charge"),
        "battery_out": annual("q_battery"),
    }
    for short, stock in (("ph", "pumped_hydro_storage"), ("batt", "battery_storage")):
        out |= {
            f"initial_{short}_stock": over.first(stock),
            f"mean_{short}_stock": over.avg(stock),
            f"max_{short}_stock": over.max(stock),
        }
    out |= {
        c: annual(c)
        for c in ("total_generation", "renewable_gen", "low_carbon_gen", "non_renewable_gen", "storage_out")
    }
    out |= {
        "share_renewable_gen": share("renewable_gen"),
        "share_low_carbon_gen": share("low_carbon_gen"),
        "share_storage_out": share("storage_out"),
        "share_min_non_ren": share("min_non_renewable_gen"),
        "min_share_ren": over.min("share_renewable_gen"),
        "max_share_ren": over.max("share_renewable_gen"),
    }
    out |= {
        f"curt_{t}": curtailed_share(over.sum(f"q_{t}"), over.sum(f"curtailment_{t}"))
        for t in fv.FACTOR_LIMITED
    }
    out |= {
        "load_shedding": annual("shed"),
        "total_ens": annual("shed"),
        "lole_hours": over.count_if("shed") * yearly,
    }
    out |= {f"{kind}_{b}": annual(f"{kind}_{b}_gwh") for kind in ("imports", "exports") for b in fv.BORDERS}
    out |= {
        "direct_emissions": over.sum("direct_emissions"),
        "direct_emissions_annual": annual("direct_emissions"),
    }
    return out


def iteration_kpis(hours: DataFrame, names: list[str] | None = None) -> DataFrame:
    """One row per iteration with all indicators, or with the named ones."""
    columns = kpi_columns()
    picked = columns if names is None else {n: columns[n] for n in names}
    return hours.groupBy(*RUN).agg(*[c.alias(n) for n, c in picked.items()])


PROFILED = {
    "price": "price",
    "solar_pv": "q_solar_pv",
    "wind": "q_wind",
    "nuclear": "q_nuclear",
    "conv_hydro": "q_conventional_hydro",
    "ccgt": "q_combined_cycle",
    "cogen": "q_cogeneration",
    "total_gen": "total_generation",
    "ren_gen": "renewable_gen",
    "non_ren_gen": "non_renewable_gen",
    "batt_in": "battery_charge",
    "batt_out": "q_battery",
    "ph_in": "charge",
    "ph_out": "q_pumped_hydro",
    "ren_share": "share_renewable_gen",
    "lc_share": "share_low_carbon_gen",
    "emissions": "direct_emissions",
}
PERIODS = {"hour": (0, 23), "month": (1, 12)}


def period_profile(
    hours: DataFrame, period: str, columns: dict[str, str] | None = None, complete: bool = True
) -> DataFrame:
    """Mean per iteration and hour of day (0-23) or month (1-12).

    ``complete`` adds periods without hours, with null means. The few periods of
    an iteration are laid out in place; the hours are read once and not joined.
    """
    columns = PROFILED if columns is None else columns
    means = hours.groupBy(*RUN, period).agg(*[F.avg(c).alias(n) for n, c in columns.items()])
    return _every_period(means, period, list(columns)) if complete else means


def _every_period(means: DataFrame, period: str, columns: list[str]) -> DataFrame:
    first, last = PERIODS[period]
    entry = F.struct(F.col(period), F.struct(*columns).alias("m"))
    laid = means.groupBy(*RUN).agg(F.map_from_entries(F.collect_list(entry)).alias("by_period"))
    every = laid.withColumn(period, F.explode(F.sequence(F.lit(first), F.lit(last))))
    found = F.try_element_at("by_period", F.col(period))
    return every.select(*RUN, period, found.alias("m")).select(
        *RUN, period, *[F.col("m")[n].alias(n) for n in columns]
    )


INPUTS = schemas.PANEL_DEMAND + schemas.PANEL_CAPACITIES + fv.COST_COLUMNS


def realised_inputs(hours: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Mean demand, capacity and cost of each iteration's projected hours."""
    return hours.groupBy(*RUN).agg(*[F.avg(c).alias(c) for c in (columns or INPUTS)])


# --- all tables of an iteration from one pass over its hours ---------------------------------------


class _Wanted:
    """Notes which aggregates are asked for."""

    def __init__(self):
        self.asked: set[tuple[str, str]] = set()

    def count(self) -> Column:
        return F.lit(1)

    def __getattr__(self, kind: str):
        def ask(c: str) -> Column:
            self.asked.add((kind, c))
            return F.lit(1)

        return ask


def _wanted() -> list[tuple[str, str]]:
    """The aggregates that the tables of an iteration are made of."""
    wanted = _Wanted()
    kpi_columns(wanted)
    return sorted(wanted.asked | {("avg", c) for c in [*PROFILED.values(), *INPUTS]})


def _summed() -> list[str]:
    return sorted({c for kind, c in _wanted() if kind in ("sum", "avg", "std")})


GAP_BITS = 62


def _gaps() -> dict[str, Column]:
    """Flags that tell which of the summed columns a row lacks: a bit each, in as many numbers as
    it takes."""
    names = _summed()
    out = {}
    for k in range(0, len(names), GAP_BITS):
        flags = [F.when(F.col(c).isNull(), F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint") for i, c in enumerate(names[k : k + GAP_BITS])]
        out[f"gaps_{k // GAP_BITS}"] = scalars.add_up(flags)
    return out


class OverParts:
    """The same aggregates from ``parts``: counts and sums are added up, means weighted by the
    known values, the deviations of the parts and of their means added."""

    def __init__(self):
        self.place = {c: divmod(i, GAP_BITS) for i, c in enumerate(_summed())}

    def known(self, c: str) -> Column:
        """Whether the part's rows have the column: all of them or none."""
        number, bit = self.place[c]
        return F.col(f"gaps_{number}").bitwiseAND(F.lit(1 << bit).cast("bigint")) == 0

    def n(self, c: str) -> Column:
        return F.when(self.known(c), F.col("n")).otherwise(F.lit(0))

    def total(self, c: str) -> Column:
        return F.when(self.known(c), F.col(f"sum_{c}"))

    def count(self) -> Column:
        return F.sum("n")

    def count_if(self, condition: str) -> Column:
        return F.sum(f"if_{condition}")

    def sum(self, c: str) -> Column:
        return F.sum(self.total(c))

    def avg(self, c: str) -> Column:
        return scalars.ratio(F.sum(self.total(c)), F.sum(self.n(c)))

    def min(self, c: str) -> Column:
        return F.min(f"min_{c}")

    def max(self, c: str) -> Column:
        return F.max(f"max_{c}")

    def std(self, c: str) -> Column:
        n, total = self.n(c), self.total(c)
        between = F.sum(scalars.ratio(total * total, n)) - scalars.ratio(F.sum(total) * F.sum(total), F.sum(n))
        squares = F.sum(f"dev_{c}") + F.greatest(between, F.lit(0.0))
        return F.when(F.sum(n) > 1, F.sqrt(squares / (F.sum(n) - 1)))

    def first(self, c: str) -> Column:
        return F.min_by(f"first_{c}", "first_ts")


def parts(hours: DataFrame) -> DataFrame:
    """One row per iteration, month, hour of day, whether the hours are ``valid`` and which columns
    they lack, with what the indicators, both profiles and the realised inputs are made of. The only
    pass over the hours.

    Hours of a part have a column all or not at all, so one count serves all columns and sums
    needn't look out for nulls: of so many aggregates, those that tell known values would be most of
    the work.
    """
    out = {"n": F.count(F.lit(1)), "first_ts": F.min("ts")}
    for c in _summed():
        out[f"sum_{c}"] = F.sum(F.coalesce(F.col(c).cast("double"), F.lit(0.0)))
    for kind, c in _wanted():
        if kind == "std":
            out[f"dev_{c}"] = F.var_pop(c) * F.count(c)
        if kind in ("min", "max"):
            out[f"{kind}_{c}"] = getattr(F, kind)(c)
        if kind == "first":
            out[f"first_{c}"] = F.min_by(c, "ts")
        if kind == "count_if":
            out[f"if_{c}"] = F.count_if(F.expr(CONDITIONS[c]))
    valid = (F.col("status") != "undefined").alias("valid")
    gaps = [e.alias(n) for n, e in _gaps().items()]
    return hours.groupBy(*RUN, "month", "hour", valid, *gaps).agg(*[e.alias(n) for n, e in out.items()])


def kpis_of_parts(parts: DataFrame) -> DataFrame:
    """``iteration_kpis`` of the valid hours."""
    return parts.where("valid").groupBy(*RUN).agg(*[c.alias(n) for n, c in kpi_columns(OverParts()).items()])


def profile_of_parts(parts: DataFrame, period: str) -> DataFrame:
    """``period_profile`` of the valid hours."""
    over = OverParts()
    means = parts.where("valid").groupBy(*RUN, period).agg(*[over.avg(c).alias(n) for n, c in PROFILED.items()])
    return _every_period(means, period, list(PROFILED))


def inputs_of_parts(parts: DataFrame) -> DataFrame:
    """``realised_inputs`` of all hours."""
    over = OverParts()
    return parts.groupBy(*RUN).agg(*[over.avg(c).alias(c) for c in INPUTS])


def mean_capacity(hours: DataFrame, keys: list[str]) -> DataFrame:
    """Mean capacity per technology, long."""
    wide = hours.groupBy(*keys).agg(*[F.avg(c).alias(t) for t, c in fv.CAPACITY_COLUMN.items()])
    return to_long(wide, keys, {t: t for t in fv.TECHNOLOGIES}, "technology", "capacity")


def default_hour(df: DataFrame, keys: list[str], order: list[str], block: str, levels: int = 2) -> DataFrame:
    """Hour of day from the row's position when a table has no hour column. Block sums are
    added up in a tree of ``levels``, as such a table may have any number of rows a key."""
    numbered = with_row_number(df, keys, order, block, "_n", levels)
    hour = F.pmod(F.pmod(F.col("_n") - 1, F.lit(8760)), F.lit(24))
    return numbered.withColumn("hour", hour).drop("_n")


# --- over iterations -----------------------------------------------------------------------


def percent(c: Column | str) -> Column:
    return scalars.as_col(c) * 100.0


def metric_columns() -> dict[str, Column]:
    """Reported mean of each metric, in its reporting unit."""
    mean = F.avg
    total = "total_generation"
    return {
        "ren_share_mean_pct": mean(percent("share_renewable_gen")),
        "ren_share_sd_pct": F.stddev_samp(percent("share_renewable_gen")),
        "prob_target_pct": mean(
            (percent("share_renewable_gen") >= fv.TARGET_SHARE).cast("double")
        ) * 100.0,
        "low_carbon_share_pct": mean(percent("share_low_carbon_gen")),
        "min_non_ren_share_pct": mean(percent("share_min_non_ren")),
        "cc_gas_share_pct": mean(percent(scalars.ratio("combined_cycle_gen", total))),
        "battery_out_gwh": mean("battery_out"),
        "pumped_hydro_out_gwh": mean("pumped_hydro_out"),
        "storage_share_pct": mean(percent(scalars.ratio("storage_out", total))),
        "avg_price_eur_mwh": mean("avg_price"),
        "demand_twh": mean(F.col("total_demand") / 1e3),
        "consumer_surplus_beur": mean(F.col("consumer_surplus") / 1e9),
        "producer_surplus_beur": mean(F.col("producer_surplus") / 1e9),
        "total_cost_beur": mean(F.col("total_cost") / 1e9),
        "net_welfare_beur": mean(F.col("net_welfare") / 1e9),
        "emissions_mt": mean(F.col("direct_emissions") / 1e6),
        "solar_curtailment_pct": mean(percent("curt_solar_pv")),
        "wind_curtailment_pct": mean(percent("curt_wind")),
        "lole_hours": mean("lole_hours"),
        "eens_gwh": mean("total_ens"),
    }


def scenario_statistics(
    results: DataFrame, digits: int | None = 2, max_scenarios: int | None = None
) -> DataFrame:
    """Mean, spread, 5th and 95th percentile, target probability and mean metrics
    per scenario."""
    means = results.groupBy("scenario").agg(*[c.alias(n) for n, c in metric_columns().items()])
    shares = results.select("scenario", percent("share_renewable_gen").alias("share"))
    tails = exact_quantiles(
        shares, ["scenario"], "share", {"ren_share_p5_pct": 0.05, "ren_share_p95_pct": 0.95},
        max_groups=max_scenarios,
    )
    table = means.join(tails, "scenario")
    if digits is None:
        return table
    return table.select("scenario", *[F.round(c, digits).alias(c) for c in table.columns[1:]])


def metric_matrix(statistics: DataFrame, scenarios: list[str], missing: str = "-") -> DataFrame:
    """Metrics as rows, scenarios as columns, two decimals as text."""
    metrics = [c for c in statistics.columns if c != "scenario"]
    long = to_long(statistics, ["scenario"], {m: m for m in metrics}, "metric", "value")
    wide = long.groupBy("metric").pivot("scenario", scenarios).agg(F.first("value"))
    return wide.select(
        "metric",
        *[
            F.when(F.col(f"`{s}`").isNotNull(), F.format_string("%.2f", F.col(f"`{s}`")))
            .otherwise(missing).alias(s)
            for s in scenarios
        ],
    )


def mean_profiles_wide(
    profiles: DataFrame, period: str, value: Column | str, scenarios: list[str]
) -> DataFrame:
    """Mean over iterations per period, one column per scenario."""
    values = profiles.select("scenario", period, scalars.as_col(value).alias("_v"))
    return values.groupBy(period).pivot("scenario", scenarios).agg(F.avg("_v"))


def mix_with_residual(profiles: DataFrame, period: str) -> DataFrame:
    """Mean generation mix per scenario and period; what the named technologies
    leave of their class is an other-technology column, not below 0."""
    named = [
        "solar_pv", "wind", "conv_hydro", "ccgt", "cogen", "nuclear", "batt_out", "ph_out",
        "ren_gen", "non_ren_gen",
    ]
    means = profiles.groupBy("scenario", period).agg(*[F.avg(c).alias(c) for c in named])
    rest = F.col("ren_gen") - F.col("solar_pv") - F.col("wind") - F.col("conv_hydro")
    rest_non = F.col("non_ren_gen") - F.col("ccgt") - F.col("nuclear") - F.col("cogen")
    out = means.withColumns(
        {
            "other_renewable": scalars.clip(rest, low=0.0),
            "other_non_renewable": scalars.clip(rest_non, low=0.0),
        }
    ).drop("ren_gen", "non_ren_gen")
    return out.withColumn("label", calendars.month_label(period)) if period == "month" else out


def storage_profile(profiles: DataFrame, scenarios: list[str], signed: bool = False) -> DataFrame:
    """Mean storage flows per hour, columns ``<scenario>_<flow>``; charging is
    negative in the signed view."""
    flows = ["batt_in", "batt_out", "ph_in", "ph_out"]
    values = profiles.select(
        "scenario", "hour",
        *[(-F.col(f) if signed and f.endswith("_in") else F.col(f)).alias(f) for f in flows],
    )
    return values.groupBy("hour").pivot("scenario", scenarios).agg(*[F.avg(f).alias(f) for f in flows])


def capacity_means(inputs: DataFrame, digits: int = 2) -> DataFrame:
    """Mean realised capacity per scenario for every capacity column."""
    names = [c for c in inputs.columns if "cap_" in c.lower()]
    return inputs.groupBy("scenario").agg(*[F.round(F.avg(c), digits).alias(c) for c in names])


LABEL_SHARE = 3.0


def mix_percent(results: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Mean per technology and its percentage of the scenario's total.

    ``columns`` maps technology to column; a missing column counts as 0, and a
    technology that is 0 in all scenarios is left out.
    """
    present = {t: c for t, c in columns.items() if c in results.columns}
    means = results.groupBy("scenario").agg(
        *[F.coalesce(F.avg(c), F.lit(0.0)).alias(t) for t, c in present.items()]
    )
    long = to_long(means, ["scenario"], {t: t for t in present}, "technology", "value")
    total = F.sum("value").over(Window.partitionBy("scenario"))
    anywhere = F.sum("value").over(Window.partitionBy("technology"))
    shared = long.select(
        "scenario", "technology", "value", total.alias("total"), anywhere.alias("_any"),
        F.when(total > 0, F.col("value") / total * 100.0).alias("pct"),
    )
    return shared.where(F.col("_any") != 0).drop("_any").withColumn(
        "labelled", F.coalesce(F.col("pct") >= LABEL_SHARE, F.lit(False))
    )


def histogram(
    df: DataFrame, key: str, value: str, bins: int = 50, max_keys: int | None = None
) -> DataFrame:
    """Counts in equal bins between each key's own minimum and maximum.

    The last bin includes the maximum. A key with one distinct value gets a range
    of half a unit on both sides of it. ``max_keys`` is the number of keys, if a
    fixed list bounds it: the rows then need not be shuffled to their key's ends.
    """
    x = F.col(value)
    flat = F.when(F.min(x) == F.max(x), 0.5).otherwise(0.0)
    ends = df.groupBy(key).agg((F.min(x) - flat).alias("low"), (F.max(x) + flat).alias("high"))
    at = F.floor((x - F.col("low")) * bins / (F.col("high") - F.col("low")))
    placed = df.where(x.isNotNull()).join(broadcast_within(ends, max_keys), key).withColumn(
        "bin", F.least(at, F.lit(bins - 1)).cast("int")
    )
    width = (F.col("high") - F.col("low")) / bins
    return (
        placed.groupBy(key, "bin", "low", "high").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("bin_start", F.col("low") + F.col("bin") * width)
    )


def axis_range(df: DataFrame, value: str, margin: float = 0.05) -> DataFrame:
    """Common range of all keys, widened by a share of its length on both sides."""
    ends = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    pad = (F.col("hi") - F.col("lo")) * margin
    return ends.select((F.col("lo") - pad).alias("axis_low"), (F.col("hi") + pad).alias("axis_high"))


def position_in(column: str, order: list[str]) -> Column:
    """Place of a name in a fixed order, from 1; unknown names come last."""
    position = F.array_position(F.array(*[F.lit(o) for o in order]), F.col(column))
    return F.when(position == 0, len(order) + 1).otherwise(position)


def ordered(df: DataFrame, column: str, order: list[str]) -> DataFrame:
    """Rows in a fixed order of names, unknown names last."""
    return df.orderBy(position_in(column, order), column)
