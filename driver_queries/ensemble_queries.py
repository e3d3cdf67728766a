"""Iteration indicators, profiles and scenario statistics on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from driver_queries.bases import CAP, LINES_SQL, lines
from driver_queries.draw_queries import REGIONS, SEED, projected_hours, PROJECTED_SQL, uniform_sql
from driver_queries.example_market import EMISSIONS
from driver_queries.market_queries import DISPATCH_SQL, PARAMS, d, dispatched
from driver_queries.registry import query, table
from gridpanel import fixed_values as fv
from gridpanel.functions import keyed_random as rnd
from gridpanel.functions import scalars
from gridpanel.operators import checks, ensemble
from gridpanel.sources import scratch

RUN = ["scenario", "iteration"]

# --- indicators of cleared iterations ---------------------------------------------------------------


def with_stocks(spark, sf_dir):
    """Cleared hours with stocks; each iteration starts 20 to 60% full."""
    start = 0.2 + 0.4 * rnd.uniform(SEED, "scenario", "iteration", F.lit("stock"))
    return checks.stock_columns(dispatched(spark, sf_dir), PARAMS, RUN, "ts", start)


def _stock_sql(charge, discharge, efficiency):
    return (
        f"coalesce(sum({charge} * sqrt({d(efficiency)}) - {discharge} / sqrt({d(efficiency)})) OVER earlier, 0.0)"
    )


STOCKS_SQL = f"""
{DISPATCH_SQL.strip()},
filled AS (
  SELECT *, 0.2 + 0.4 * {uniform_sql("scenario", "iteration", "'stock'")} AS start_share,
         first_value(batteries_cap_gw) OVER (PARTITION BY scenario, iteration ORDER BY ts) AS first_batt
  FROM accounts),
stocked AS (
  SELECT *,
    start_share * {d(PARAMS["ph_storage_cap_gwh"])} + {_stock_sql("charge", "q_pumped_hydro", PARAMS["ph_roundtrip_eff"])}
      AS pumped_hydro_storage,
    start_share * {d(PARAMS["batt_duration"])} * first_batt + {_stock_sql("battery_charge", "q_battery", PARAMS["batt_roundtrip_eff"])}
      AS battery_storage
  FROM filled
  WINDOW earlier AS (PARTITION BY scenario, iteration ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
"""


def _kpi_sql() -> dict[str, tuple[str, int | str]]:
    """Column -> (SQL aggregate, digits)."""
    y = f"({d(fv.HOURS_PER_YEAR)} / count(*))"

    def annual(c):
        return f"sum({c}) * {y}"

    def share(c):
        return f"sum({c}) / nullif(sum(total_generation), 0)"

    out = {
        "n_hours": ("count(*)", "i"),
        "shortage_hours": ("sum(CASE WHEN status = 'shortage' THEN 1 ELSE 0 END)", "i"),
        "oversupply_hours": ("sum(CASE WHEN status = 'oversupply' THEN 1 ELSE 0 END)", "i"),
        "baseline_year": ("min(base_year)", "i"),
        "day_start": ("min(day_start)", "i"),
        "avg_price": ("avg(price)", 4), "max_price": ("max(price)", 4), "min_price": ("min(price)", 4),
        "std_price": ("stddev_samp(price)", 4),
    }
    out |= {f"{s}_demand": (annual(f"{s}_demand"), 1) for s in fv.SECTORS}
    ps = "(sum(producer_revenue) - sum(total_costs))"
    out |= {
        "total_demand": (annual("total_demand"), 1),
        "consumer_surplus": (annual("consumer_surplus"), 0),
        "producer_surplus": (f"{ps} * {y}", 0),
        "total_cost": (annual("total_costs"), 0),
        "net_welfare": (f"(sum(consumer_surplus) + {ps}) * {y}", 0),
    }
    out |= {f"{t}_gen": (annual(f"q_{t}"), 1) for t in ensemble.PRODUCERS}
    out |= {
        "pumped_hydro_pumping": (annual("charge"), 1), "pumped_hydro_out": (annual("q_pumped_hydro"), 1),
        "battery_charge": (annual("battery_charge"), 1), "battery_out": (annual("q_battery"), 1),
    }
    for short, stock in (("ph", "pumped_hydro_storage"), ("batt", "battery_storage")):
        out |= {
            f"initial_{short}_stock": (f"arg_min({stock}, ts)", 4),
            f"mean_{short}_stock": (f"avg({stock})", 4), f"max_{short}_stock": (f"max({stock})", 4),
        }
    out |= {
        c: (annual(c), 1)
        for c in ("total_generation", "renewable_gen", "low_carbon_gen", "non_renewable_gen", "storage_out")
    }
    out |= {
        "share_renewable_gen": (share("renewable_gen"), 6), "share_low_carbon_gen": (share("low_carbon_gen"), 6),
        "share_storage_out": (share("storage_out"), 6), "share_min_non_ren": (share("min_non_renewable_gen"), 6),
        "min_share_ren": ("min(share_renewable_gen)", 6), "max_share_ren": ("max(share_renewable_gen)", 6),
    }
    out |= {
        f"curt_{t}": (f"1.0 - sum(q_{t}) / nullif(sum(q_{t}) + sum(curtailment_{t}), 0)", 6) for t in fv.FACTOR_LIMITED
    }
    out |= {
        "load_shedding": (annual("shed"), 2), "total_ens": (annual("shed"), 2),
        "lole_hours": (f"sum(CASE WHEN shed > 0.001 THEN 1 ELSE 0 END) * {y}", 4),
    }
    out |= {f"{k}_{b}": (annual(f"{k}_{b}_gwh"), 1) for k in ("imports", "exports") for b in fv.BORDERS}
    out |= {
        "direct_emissions": ("sum(direct_emissions)", 0),
        "direct_emissions_annual": (annual("direct_emissions"), 0),
    }
    return out


KPI = _kpi_sql()


def _kpi_query(names, source, ctes):
    picked = ", ".join(f"{KPI[n][0]} AS {n}" for n in names)
    return f"WITH {ctes} SELECT scenario, iteration, {picked} FROM {source} GROUP BY 1, 2"


def _kpi_spec(names):
    return "scenario iteration:i " + " ".join(f"{n}:{KPI[n][1]}" for n in names)


@query("iteration_kpis", _kpi_spec(KPI), _kpi_query(KPI, "stocked", STOCKS_SQL))
def iteration_kpis(spark, sf_dir):
    return ensemble.iteration_kpis(ensemble.valid_hours(with_stocks(spark, sf_dir)))


CURTAILMENT = [f"curt_{t}" for t in fv.FACTOR_LIMITED]


@query("curtailment", _kpi_spec(CURTAILMENT), _kpi_query(CURTAILMENT, "accounts", DISPATCH_SQL))
def curtailment(spark, sf_dir):
    return ensemble.iteration_kpis(dispatched(spark, sf_dir), CURTAILMENT)


ADEQUACY = ["shortage_hours", "load_shedding", "total_ens", "lole_hours"]


@query("adequacy", _kpi_spec(ADEQUACY), _kpi_query(ADEQUACY, "accounts", DISPATCH_SQL))
def adequacy(spark, sf_dir):
    return ensemble.iteration_kpis(dispatched(spark, sf_dir), ADEQUACY)


@query(
    "price_stats", "scenario avg_price:4 max_price:4 min_price:4 std_price:4",
    f"""WITH {DISPATCH_SQL} SELECT scenario, avg(price) AS avg_price, max(price) AS max_price,
    min(price) AS min_price, stddev_samp(price) AS std_price FROM accounts GROUP BY 1""",
)
def price_stats(spark, sf_dir):
    return ensemble.price_stats(dispatched(spark, sf_dir), ["scenario"])


PROFILE_DIGITS = {"emissions": 1}


def _profile_spec(period):
    return f"scenario iteration:i {period}:i " + " ".join(
        f"{n}:{PROFILE_DIGITS.get(n, 4)}" for n in ensemble.PROFILED
    )


def _profile_sql(period, first, last):
    means = ", ".join(f"avg({c}) AS {n}" for n, c in ensemble.PROFILED.items())
    return f"""WITH {DISPATCH_SQL},
    means AS (SELECT scenario, iteration, {period}, {means} FROM accounts GROUP BY 1, 2, 3),
    periods AS (SELECT scenario, iteration, unnest(generate_series({first}, {last})) AS {period}
                FROM (SELECT DISTINCT scenario, iteration FROM accounts) r)
    SELECT p.*, m.* EXCLUDE (scenario, iteration, {period}) FROM periods p LEFT JOIN means m
      ON m.scenario = p.scenario AND m.iteration = p.iteration AND m.{period} = p.{period}"""


@query("period_profile", _profile_spec("hour"), _profile_sql("hour", 0, 23))
def period_profile(spark, sf_dir):
    """Hours of day without a step stay in the table, with null means."""
    return ensemble.period_profile(dispatched(spark, sf_dir), "hour")


@query("period_profile_monthly", _profile_spec("month"), _profile_sql("month", 1, 12))
def period_profile_monthly(spark, sf_dir):
    return ensemble.period_profile(dispatched(spark, sf_dir), "month")


@query(
    "realised_inputs", "scenario iteration:i " + " ".join(f"{c}:4" for c in ensemble.INPUTS),
    f"WITH {PROJECTED_SQL} SELECT scenario, iteration, "
    + ", ".join(f"avg({c}) AS {c}" for c in ensemble.INPUTS) + " FROM hours GROUP BY 1, 2",
)
def realised_inputs(spark, sf_dir):
    return ensemble.realised_inputs(projected_hours(spark, sf_dir))


# --- the same tables from one pass over stored hours --------------------------------------------------


def stored_parts(spark, sf_dir):
    return scratch.landed(ensemble.parts(with_stocks(spark, sf_dir)), "parts")


@query("one_pass_kpis", _kpi_spec(KPI), _kpi_query(KPI, "stocked", STOCKS_SQL))
def one_pass_kpis(spark, sf_dir):
    return ensemble.kpis_of_parts(stored_parts(spark, sf_dir))


@query("one_pass_hourly", _profile_spec("hour"), _profile_sql("hour", 0, 23))
def one_pass_hourly(spark, sf_dir):
    return ensemble.profile_of_parts(stored_parts(spark, sf_dir), "hour")


@query("one_pass_monthly", _profile_spec("month"), _profile_sql("month", 1, 12))
def one_pass_monthly(spark, sf_dir):
    return ensemble.profile_of_parts(stored_parts(spark, sf_dir), "month")


@query(
    "one_pass_inputs", "scenario iteration:i " + " ".join(f"{c}:4" for c in ensemble.INPUTS),
    f"WITH {PROJECTED_SQL} SELECT scenario, iteration, "
    + ", ".join(f"avg({c}) AS {c}" for c in ensemble.INPUTS) + " FROM hours GROUP BY 1, 2",
)
def one_pass_inputs(spark, sf_dir):
    return ensemble.inputs_of_parts(stored_parts(spark, sf_dir))


@query(
    "period_key_default", "o_orderkey:i hour:i",
    """SELECT o_orderkey, ((row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1) % 8760) % 24
    AS hour FROM orders""",
)
def period_key_default(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("block", F.floor(F.col("o_orderkey") / 1000))
    return ensemble.default_hour(orders, ["o_orderpriority"], ["o_orderkey"], "block")


# --- results and profiles read off the line items: suppliers as iterations of their region ----------------

EMITTED = EMISSIONS


def owned_lines(spark, sf_dir):
    supplier = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("n_nationkey")
    )
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").alias("r_regionkey"))
    region = table(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("scenario"))
    place = supplier.join(nation, "n_nationkey").join(region, "r_regionkey").select("l_suppkey", "scenario")
    return lines(spark, sf_dir).join(place, "l_suppkey").withColumnRenamed("l_suppkey", "iteration")


OWNED_SQL = f"""
{LINES_SQL.strip()},
owned AS (
  SELECT l.*, r_name AS scenario, l_suppkey AS iteration FROM lines l
  JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey
  JOIN region ON r_regionkey = n_regionkey)
"""


def _qty(names):
    return F.sum(F.when(F.col("technology").isin(names), F.col("l_quantity")).otherwise(0.0))


def _qty_sql(names):
    return f"sum(CASE WHEN technology IN ({', '.join(repr(n) for n in names)}) THEN l_quantity ELSE 0.0 END)"


def results(spark, sf_dir):
    """Indicators per supplier; shares are shifted to lie around the target."""
    whole = _qty(ensemble.PRODUCERS)
    emitted = F.lit(0.0)
    for t, e in EMITTED.items():
        emitted = emitted + _qty([t]) * e
    columns = {
        "share_renewable_gen": 0.345 + scalars.ratio(_qty(fv.RENEWABLE), whole),
        "share_low_carbon_gen": scalars.ratio(_qty(fv.LOW_CARBON), whole),
        "share_min_non_ren": 0.2 * scalars.ratio(_qty(fv.FLOOR_TECHNOLOGIES), whole),
        "battery_out": _qty(["battery"]),
        "pumped_hydro_out": _qty(["pumped_hydro"]),
        "storage_out": _qty(fv.STORAGE),
        "total_generation": whole,
        "avg_price": F.avg(F.col("l_extendedprice") / F.col("l_quantity")) / 20.0,
        "total_demand": F.sum("l_quantity") * 2.0,
        "consumer_surplus": F.sum("l_extendedprice") * 1e5,
        "producer_surplus": F.sum(F.col("l_extendedprice") * F.col("l_discount")) * 1e5,
        "total_cost": F.sum(F.col("l_extendedprice") * F.col("l_tax")) * 1e5,
        "net_welfare": F.sum(F.col("l_extendedprice") * (1 + F.col("l_discount"))) * 1e5,
        "direct_emissions": emitted,
        "curt_solar_pv": F.avg("l_discount"),
        "curt_wind": F.avg("l_tax"),
        "lole_hours": F.count_if(F.col("l_quantity") == 50).cast("double"),
        "total_ens": F.sum("l_tax"),
    } | {f"{t}_gen": _qty([t]) for t in ensemble.PRODUCERS}
    return owned_lines(spark, sf_dir).groupBy(*RUN).agg(*[c.alias(n) for n, c in columns.items()])


def main_results(spark, sf_dir):
    """The indicators as a stored table: several statistics read it, the line
    items are read once."""
    return scratch.landed(results(spark, sf_dir), "main_results")


_WHOLE = _qty_sql(ensemble.PRODUCERS)
RESULTS_SQL = f"""
{OWNED_SQL.strip()},
results AS (
  SELECT scenario, iteration,
    0.345 + {_qty_sql(fv.RENEWABLE)} / nullif({_WHOLE}, 0) AS share_renewable_gen,
    {_qty_sql(fv.LOW_CARBON)} / nullif({_WHOLE}, 0) AS share_low_carbon_gen,
    0.2 * {_qty_sql(fv.FLOOR_TECHNOLOGIES)} / nullif({_WHOLE}, 0) AS share_min_non_ren,
    {_qty_sql(["battery"])} AS battery_out, {_qty_sql(["pumped_hydro"])} AS pumped_hydro_out,
    {_qty_sql(fv.STORAGE)} AS storage_out, {_WHOLE} AS total_generation,
    avg(l_extendedprice / l_quantity) / 20.0 AS avg_price, sum(l_quantity) * 2.0 AS total_demand,
    sum(l_extendedprice) * 1e5 AS consumer_surplus, sum(l_extendedprice * l_discount) * 1e5 AS producer_surplus,
    sum(l_extendedprice * l_tax) * 1e5 AS total_cost, sum(l_extendedprice * (1 + l_discount)) * 1e5 AS net_welfare,
    {" + ".join(f"{_qty_sql([t])} * {e}" for t, e in EMITTED.items())} AS direct_emissions,
    avg(l_discount) AS curt_solar_pv, avg(l_tax) AS curt_wind,
    sum(CASE WHEN l_quantity = 50 THEN 1.0 ELSE 0.0 END) AS lole_hours, sum(l_tax) AS total_ens,
    {", ".join(f"{_qty_sql([t])} AS {t}_gen" for t in ensemble.PRODUCERS)}
  FROM owned GROUP BY 1, 2),
statistics AS (
  SELECT scenario, avg(share_renewable_gen * 100) AS ren_share_mean_pct,
    stddev_samp(share_renewable_gen * 100) AS ren_share_sd_pct,
    avg(CASE WHEN share_renewable_gen * 100 >= 81 THEN 1.0 ELSE 0.0 END) * 100 AS prob_target_pct,
    avg(share_low_carbon_gen * 100) AS low_carbon_share_pct, avg(share_min_non_ren * 100) AS min_non_ren_share_pct,
    avg(combined_cycle_gen / nullif(total_generation, 0) * 100) AS cc_gas_share_pct,
    avg(battery_out) AS battery_out_gwh, avg(pumped_hydro_out) AS pumped_hydro_out_gwh,
    avg(storage_out / nullif(total_generation, 0) * 100) AS storage_share_pct, avg(avg_price) AS avg_price_eur_mwh,
    avg(total_demand / 1e3) AS demand_twh, avg(consumer_surplus / 1e9) AS consumer_surplus_beur,
    avg(producer_surplus / 1e9) AS producer_surplus_beur, avg(total_cost / 1e9) AS total_cost_beur,
    avg(net_welfare / 1e9) AS net_welfare_beur, avg(direct_emissions / 1e6) AS emissions_mt,
    avg(curt_solar_pv * 100) AS solar_curtailment_pct, avg(curt_wind * 100) AS wind_curtailment_pct,
    avg(lole_hours) AS lole_hours, avg(total_ens) AS eens_gwh,
    quantile_cont(share_renewable_gen * 100, 0.05) AS ren_share_p5_pct,
    quantile_cont(share_renewable_gen * 100, 0.95) AS ren_share_p95_pct
  FROM results GROUP BY 1)
"""
METRICS = [
    "ren_share_mean_pct", "ren_share_sd_pct", "ren_share_p5_pct", "ren_share_p95_pct", "prob_target_pct",
    "low_carbon_share_pct", "min_non_ren_share_pct", "cc_gas_share_pct", "battery_out_gwh",
    "pumped_hydro_out_gwh", "storage_share_pct", "avg_price_eur_mwh", "demand_twh",
    "consumer_surplus_beur", "producer_surplus_beur", "total_cost_beur", "net_welfare_beur",
    "emissions_mt", "solar_curtailment_pct", "wind_curtailment_pct", "lole_hours", "eens_gwh",
]


@query(
    "scenario_stats", "scenario " + " ".join(f"{m}:4" for m in METRICS),
    f"WITH {RESULTS_SQL} SELECT * FROM statistics",
)
def scenario_stats(spark, sf_dir):
    return ensemble.scenario_statistics(main_results(spark, sf_dir), digits=None, max_scenarios=len(REGIONS))


REGION_COLUMNS = [r.replace(" ", "_") for r in REGIONS]


def underscored(df):
    """Region names with blanks make awkward column names."""
    return df.select(*[F.col(f"`{c}`").alias(c.replace(" ", "_")) for c in df.columns])


@query(
    "metric_gaps", "metric absent known unknown",
    f"""WITH {RESULTS_SQL}, long AS ({" UNION ALL ".join(f"SELECT scenario, '{m}' AS metric, {m} AS value FROM statistics" for m in METRICS)})
    SELECT metric, '-' AS absent, CASE WHEN count(value) FILTER (scenario = 'AFRICA') = 0 THEN '-' ELSE 'number' END AS known,
      CASE WHEN metric = 'eens_gwh' OR count(value) FILTER (scenario = 'ASIA') = 0 THEN '-' ELSE 'number' END AS unknown
    FROM long GROUP BY metric""",
)
def metric_gaps(spark, sf_dir):
    """Cells without a value, of a scenario that was not run and of one that lacks a metric, are dashes."""
    statistics = ensemble.scenario_statistics(main_results(spark, sf_dir), digits=None, max_scenarios=len(REGIONS))
    lacking = statistics.withColumn("eens_gwh", F.when(F.col("scenario") != "ASIA", F.col("eens_gwh")))
    matrix = ensemble.metric_matrix(lacking, ["AFRICA", "ASIA", "ATLANTIS"])
    dash = {c: F.when(F.col(c) == "-", "-").otherwise("number") for c in ("AFRICA", "ASIA")}
    return matrix.select("metric", F.col("ATLANTIS").alias("absent"), dash["AFRICA"].alias("known"), dash["ASIA"].alias("unknown"))


@query(
    "metric_matrix", "metric " + " ".join(f"{r}:2" for r in REGION_COLUMNS),
    f"WITH {RESULTS_SQL}, long AS ("
    + " UNION ALL ".join(f"SELECT scenario, '{m}' AS metric, {m} AS value FROM statistics" for m in METRICS)
    + ") SELECT metric, "
    + ", ".join(f"max(CASE WHEN scenario = '{r}' THEN value END) AS {c}" for r, c in zip(REGIONS, REGION_COLUMNS))
    + " FROM long GROUP BY metric",
)
def metric_matrix(spark, sf_dir):
    """Two-decimal text per cell, compared as numbers rounded the shared way."""
    statistics = ensemble.scenario_statistics(main_results(spark, sf_dir), digits=None, max_scenarios=len(REGIONS))
    shifted = statistics.select(
        "scenario", *[(F.col(m) + 0.001234567).alias(m) for m in METRICS]
    )
    wide = underscored(ensemble.metric_matrix(shifted, REGIONS))
    return wide.select("metric", *[F.col(c).try_cast("double").alias(c) for c in REGION_COLUMNS])


# --- profiles -----------------------------------------------------------------------------------------------


def _linestatus(names, status):
    return F.sum(
        F.when(F.col("technology").isin(names) & (F.col("l_linestatus") == status), F.col("l_quantity")).otherwise(0.0)
    )


def _linestatus_sql(names, status):
    inside = ", ".join(repr(n) for n in names)
    return (
        f"sum(CASE WHEN technology IN ({inside}) AND l_linestatus = '{status}' THEN l_quantity ELSE 0.0 END)"
    )


NAMED = {
    "solar_pv": ["solar_pv"], "wind": ["wind"], "conv_hydro": ["conventional_hydro"],
    "ccgt": ["combined_cycle"], "cogen": ["cogeneration"], "nuclear": ["nuclear"],
    "ren_gen": fv.RENEWABLE, "non_ren_gen": fv.NON_RENEWABLE,
}
FLOWS = {
    "batt_in": (["battery"], "O"), "batt_out": (["battery"], "F"),
    "ph_in": (["pumped_hydro"], "O"), "ph_out": (["pumped_hydro"], "F"),
}


def profiles(spark, sf_dir, period):
    key = {"hour": F.hour("ts"), "month": F.month("ts")}[period]
    return owned_lines(spark, sf_dir).groupBy(*RUN, key.alias(period)).agg(
        (F.avg(F.col("l_extendedprice") / F.col("l_quantity")) / 20.0).alias("price"),
        *[_qty(ts).alias(n) for n, ts in NAMED.items()],
        *[_linestatus(ts, s).alias(n) for n, (ts, s) in FLOWS.items()],
        scalars.add_up([_qty([t]) * e for t, e in EMITTED.items()]).alias("emissions"),
        scalars.ratio(_qty(fv.RENEWABLE), _qty(ensemble.PRODUCERS)).alias("ren_share"),
    )


def profiles_sql(period):
    return f"""
{OWNED_SQL.strip()},
profiles AS (
  SELECT scenario, iteration, {period}(ts) AS {period}, avg(l_extendedprice / l_quantity) / 20.0 AS price,
    {", ".join(f"{_qty_sql(ts)} AS {n}" for n, ts in NAMED.items())},
    {", ".join(f"{_linestatus_sql(ts, s)} AS {n}" for n, (ts, s) in FLOWS.items())},
    {" + ".join(f"{_qty_sql([t])} * {e}" for t, e in EMITTED.items())} AS emissions,
    {_qty_sql(fv.RENEWABLE)} / nullif({_WHOLE}, 0) AS ren_share
  FROM owned GROUP BY 1, 2, 3)
"""


def _by_region(expression):
    return ", ".join(
        f"avg(CASE WHEN scenario = '{r}' THEN {expression} END) AS {c}" for r, c in zip(REGIONS, REGION_COLUMNS)
    )


@query(
    "mean_profiles_wide", "hour:i " + " ".join(f"{c}:4" for c in REGION_COLUMNS),
    f"WITH {profiles_sql('hour')} SELECT hour, {_by_region('price')} FROM profiles GROUP BY 1",
)
def mean_profiles_wide(spark, sf_dir):
    return underscored(ensemble.mean_profiles_wide(profiles(spark, sf_dir, "hour"), "hour", "price", REGIONS))


@query(
    "renewable_share_monthly", "month:i " + " ".join(f"{c}:4" for c in REGION_COLUMNS),
    f"WITH {profiles_sql('month')} SELECT month, {_by_region('ren_share * 100')} FROM profiles GROUP BY 1",
)
def renewable_share_monthly(spark, sf_dir):
    """A mean of iteration shares, in percent."""
    monthly = profiles(spark, sf_dir, "month")
    return underscored(
        ensemble.mean_profiles_wide(monthly, "month", ensemble.percent("ren_share"), REGIONS)
    )


@query(
    "emission_profiles", "hour:i " + " ".join(f"{c}:2" for c in REGION_COLUMNS),
    f"WITH {profiles_sql('hour')} SELECT hour, {_by_region('emissions')} FROM profiles GROUP BY 1",
)
def emission_profiles(spark, sf_dir):
    hourly = profiles(spark, sf_dir, "hour")
    return underscored(ensemble.mean_profiles_wide(hourly, "hour", "emissions", REGIONS))


SHOWN = ["EUROPE", "ASIA", "AFRICA"]


@query(
    "scenario_order", "scenario place:i n:i",
    f"""WITH {RESULTS_SQL}, counted AS (SELECT scenario, count(*) AS n FROM results GROUP BY 1)
    SELECT scenario, n, row_number() OVER (ORDER BY CASE scenario
      {" ".join(f"WHEN '{r}' THEN {i}" for i, r in enumerate(SHOWN, 1))} ELSE {len(SHOWN) + 1} END, scenario) AS place
    FROM counted""",
)
def scenario_order(spark, sf_dir):
    """A report's rows: some scenarios in a fixed order, the others behind them by name."""
    counted = results(spark, sf_dir).groupBy("scenario").agg(F.count("*").alias("n"))
    of_few_rows = Window.partitionBy().orderBy(ensemble.position_in("scenario", SHOWN), "scenario")
    return ensemble.ordered(counted, "scenario", SHOWN).withColumn("place", F.row_number().over(of_few_rows))


EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


@query(
    "event_profiles_wide", "hour:i " + " ".join(f"{e}:4" for e in EVENT_TYPES),
    "SELECT hour(ts) AS hour, "
    + ", ".join(f"avg(CASE WHEN event_type = '{e}' THEN value END) AS {e}" for e in EVENT_TYPES)
    + " FROM events GROUP BY 1",
)
def event_profiles_wide(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("scenario"), F.hour("ts").alias("hour"), "value"
    )
    return ensemble.mean_profiles_wide(events, "hour", "value", EVENT_TYPES)


MIX = ["solar_pv", "wind", "conv_hydro", "ccgt", "cogen", "nuclear", "batt_out", "ph_out"]


@query(
    "mix_with_residual",
    "scenario month:i label " + " ".join(f"{c}:4" for c in [*MIX, "other_renewable", "other_non_renewable"]),
    f"""WITH {profiles_sql("month")}, m AS (
      SELECT scenario, month, {", ".join(f"avg({c}) AS {c}" for c in [*MIX, "ren_gen", "non_ren_gen"])}
      FROM profiles GROUP BY 1, 2)
    SELECT *, strftime(make_date(2000, CAST(month AS INTEGER), 1), '%b') AS label,
      greatest(ren_gen - solar_pv - wind - conv_hydro, 0.0) AS other_renewable,
      greatest(non_ren_gen - ccgt - nuclear - cogen, 0.0) AS other_non_renewable FROM m""",
)
def mix_with_residual(spark, sf_dir):
    return ensemble.mix_with_residual(profiles(spark, sf_dir, "month"), "month")


@query(
    "mix_hourly", "scenario hour:i " + " ".join(f"{c}:4" for c in [*MIX, "other_renewable", "other_non_renewable"]),
    f"""WITH {profiles_sql("hour")}, m AS (
      SELECT scenario, hour, {", ".join(f"avg({c}) AS {c}" for c in [*MIX, "ren_gen", "non_ren_gen"])}
      FROM profiles GROUP BY 1, 2)
    SELECT *, greatest(ren_gen - solar_pv - wind - conv_hydro, 0.0) AS other_renewable,
      greatest(non_ren_gen - ccgt - nuclear - cogen, 0.0) AS other_non_renewable FROM m""",
)
def mix_hourly(spark, sf_dir):
    return ensemble.mix_with_residual(profiles(spark, sf_dir, "hour"), "hour")


@query(
    "storage_profile", "hour:i " + " ".join(f"{c}_{f}:4" for c in REGION_COLUMNS for f in FLOWS),
    f"WITH {profiles_sql('hour')} SELECT hour, "
    + ", ".join(
        f"avg(CASE WHEN scenario = '{r}' THEN {'-' if f.endswith('_in') else ''}{f} END) AS {c}_{f}"
        for r, c in zip(REGIONS, REGION_COLUMNS) for f in FLOWS
    )
    + " FROM profiles GROUP BY 1",
)
def storage_profile(spark, sf_dir):
    return underscored(ensemble.storage_profile(profiles(spark, sf_dir, "hour"), REGIONS, signed=True))


@query(
    "storage_profile_unsigned", "hour:i " + " ".join(f"{c}_{f}:4" for c in REGION_COLUMNS for f in FLOWS),
    f"WITH {profiles_sql('hour')} SELECT hour, "
    + ", ".join(
        f"avg(CASE WHEN scenario = '{r}' THEN {f} END) AS {c}_{f}" for r, c in zip(REGIONS, REGION_COLUMNS) for f in FLOWS
    )
    + " FROM profiles GROUP BY 1",
)
def storage_profile_unsigned(spark, sf_dir):
    return underscored(ensemble.storage_profile(profiles(spark, sf_dir, "hour"), REGIONS))


# wind is asked for under a name the results lack, so it counts as 0 and drops out
MIX_COLUMNS = {t: f"{t}_gen" for t in ensemble.PRODUCERS} | {"wind": "wind_generation"}


@query(
    "mix_percent", "scenario technology value:2 total:2 pct:4 labelled",
    f"WITH {RESULTS_SQL}, long AS ("
    + " UNION ALL ".join(
        f"SELECT scenario, '{t}' AS technology, avg({c}) AS value FROM results GROUP BY scenario"
        for t, c in MIX_COLUMNS.items() if t != "wind"
    )
    + """), whole AS (SELECT *, sum(value) OVER (PARTITION BY scenario) AS total,
                           sum(value) OVER (PARTITION BY technology) AS anywhere FROM long)
    SELECT scenario, technology, value, total, value / nullif(total, 0) * 100 AS pct,
           coalesce(value / nullif(total, 0) * 100 >= 3, false) AS labelled
    FROM whole WHERE anywhere <> 0""",
)
def mix_percent(spark, sf_dir):
    return ensemble.mix_percent(results(spark, sf_dir), MIX_COLUMNS)


@query(
    "capacity_means", "scenario " + " ".join(f"{CAP[t]}:2" for t in fv.TECHNOLOGIES),
    f"""WITH {OWNED_SQL}, inputs AS (SELECT scenario, iteration,
      {", ".join(f"max(CASE WHEN technology = '{t}' THEN l_extendedprice ELSE 0.0 END) AS {CAP[t]}" for t in fv.TECHNOLOGIES)}
      FROM owned GROUP BY 1, 2)
    SELECT scenario, {", ".join(f"avg({CAP[t]}) AS {CAP[t]}" for t in fv.TECHNOLOGIES)} FROM inputs GROUP BY 1""",
)
def capacity_means(spark, sf_dir):
    inputs = owned_lines(spark, sf_dir).groupBy(*RUN).agg(
        *[
            F.max(F.when(F.col("technology") == t, F.col("l_extendedprice")).otherwise(0.0)).alias(CAP[t])
            for t in fv.TECHNOLOGIES
        ]
    )
    return ensemble.capacity_means(inputs, digits=9)


# --- distributions -------------------------------------------------------------------------------------------


@query(
    "histogram50", "o_orderpriority bin:i n:i low:2 high:2 bin_start:4",
    """WITH ends AS (SELECT o_orderpriority,
      min(o_totalprice) - CASE WHEN min(o_totalprice) = max(o_totalprice) THEN 0.5 ELSE 0.0 END AS low,
      max(o_totalprice) + CASE WHEN min(o_totalprice) = max(o_totalprice) THEN 0.5 ELSE 0.0 END AS high
      FROM orders GROUP BY 1)
    SELECT e.o_orderpriority, bin, low, high, count(*) AS n, low + bin * ((high - low) / 50) AS bin_start FROM (
      SELECT o.o_orderpriority,
        least(floor((o_totalprice - low) * 50 / (high - low)), 49) AS bin
      FROM orders o JOIN ends e ON e.o_orderpriority = o.o_orderpriority) b
    JOIN ends e ON e.o_orderpriority = b.o_orderpriority GROUP BY 1, 2, 3, 4""",
)
def histogram50(spark, sf_dir):
    return ensemble.histogram(table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice", max_keys=5)


@query(
    "axis_range", "axis_low:4 axis_high:4",
    """SELECT min(o_totalprice) - 0.05 * (max(o_totalprice) - min(o_totalprice)) AS axis_low,
    max(o_totalprice) + 0.05 * (max(o_totalprice) - min(o_totalprice)) AS axis_high FROM orders""",
)
def axis_range(spark, sf_dir):
    return ensemble.axis_range(table(spark, sf_dir, "orders"), "o_totalprice")
