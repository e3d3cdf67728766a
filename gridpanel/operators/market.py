"""Hourly market: demand curves, supply blocks, merit-order clearing, accounts.

Hours are cleared on their own; what couples them (ramps, stocks, weekly hydro
budgets) is checked afterwards in ``checks``.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridpanel import fixed_values as fv
from gridpanel.functions import calendars, scalars
from gridpanel.functions.sizes import broadcast_within
from gridpanel.operators import merit_order

# --- constants ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Constants:
    """Technology rows by name and technical parameters by name."""

    technology: dict[str, dict]
    params: dict[str, float]

    @classmethod
    def load(cls, technology: DataFrame, params: DataFrame) -> Constants:
        """From the two small tables: one row per technology, one row of parameters."""
        rows = technology.limit(len(fv.TECHNOLOGIES) + 1).collect()
        by_name = {r["technology"]: r.asDict() for r in rows}
        missing = set(fv.TECHNOLOGIES) - set(by_name)
        if missing or len(rows) != len(fv.TECHNOLOGIES):
            raise ValueError(f"technology table: {len(rows)} rows, missing {sorted(missing)}")
        given = params.limit(2).collect()
        if len(given) != 1:
            raise ValueError("the parameter table must have exactly one row")
        return cls(by_name, given[0].asDict())

    @property
    def loss(self) -> float:
        return self.params["grid_loss_factor"]

    @property
    def voll(self) -> float:
        """Value of lost load in EUR per GWh."""
        return self.params["voll_eur_mwh"] * 1000.0


# --- demand --------------------------------------------------------------------------------


def calibrate_demand(hours: DataFrame, params: dict[str, float]) -> DataFrame:
    """Linear demand ``a - b * price`` per sector through the observed point.

    Prices inside the market are EUR/GWh.
    """
    price = F.col("spot_price_eur_mwh") * 1000.0
    slopes = {
        f"b_{s}": params[f"elas_{s}"] * F.col("elas_anomaly") * F.col(f"{s}_demand_gwh") / price
        for s in fv.SECTORS
    }
    return hours.withColumns(slopes).withColumns(
        {f"a_{s}": F.col(f"{s}_demand_gwh") + F.col(f"b_{s}") * price for s in fv.SECTORS}
    )


SECTOR_CURVES = [(f"a_{s}", f"b_{s}") for s in fv.SECTORS]


def demand_at(price: str, curves=SECTOR_CURVES) -> Column:
    """Total demand of all sectors at a price in EUR/GWh, given as an SQL
    expression; no sector goes below 0."""
    return F.expr(" + ".join(f"greatest({a} - {b} * ({price}), 0D)" for a, b in curves))


def price_at(demand: Column, curves=SECTOR_CURVES) -> Column:
    """Price at which total demand is the given positive amount.

    Total demand is the largest of the sums over subsets of sectors, so its
    inverse is the largest of their inverses.
    """
    options = []
    for size in range(1, len(curves) + 1):
        for subset in combinations(curves, size):
            a = scalars.add_up([F.col(x) for x, _ in subset])
            b = scalars.add_up([F.col(x) for _, x in subset])
            options.append(scalars.ratio(a - demand, b))
    return options[0] if len(options) == 1 else F.greatest(*options)


# --- supply ----------------------------------------------------------------------------------


def marginal_cost(technology: str, constants: Constants) -> Column:
    """Variable cost, fuel and allowances of one more GWh."""
    row = constants.technology[technology]
    cost = F.lit(float(row["var_om_eur_gwh"]))
    fuel = fv.FUEL_COLUMN.get(technology)
    if fuel is not None:
        cost = cost + F.col(fuel) / float(row["efficiency"])
    if row["fossil_fuel"]:
        cost = cost + F.col("eu_ets_price_eur_tco2") * float(row["direct_e_tco2_gwh"])
    return cost


def river_factors(params: dict[str, float]) -> tuple[Column, Column]:
    """Lower and upper output factor of run-of-river in the row's month."""
    low = [params[f"ror_lo_{s}"] for s in fv.RIVER_SEASON]
    high = [params[f"ror_hi_{s}"] for s in fv.RIVER_SEASON]
    return calendars.by_month(low, "month"), calendars.by_month(high, "month")


def output_bounds(technology: str, params: dict[str, float], hydro: str = "profile") -> tuple[Column, Column]:
    """Least and greatest output of a technology in an hour.

    ``hydro="profile"`` makes reservoirs follow their projected hours, which
    keeps the weekly budget; ``"bounds"`` lets them move between the weekly
    extremes in ``hydro_min`` and ``hydro_max``. Storage follows its profile.
    """
    cap = F.col(fv.CAPACITY_COLUMN[technology])
    if technology in fv.OUTPUT_FACTORS:
        low, high = fv.OUTPUT_FACTORS[technology]
        return (
            cap * (params[low] if low else 0.0),
            cap * (params[high] if high else 1.0),
        )
    if technology == "nuclear":
        available = cap * F.col("nuclear_cap_factor")
        return available, available
    if technology in fv.FACTOR_LIMITED:
        return F.lit(0.0), cap * F.col(f"{technology}_cap_factor")
    if technology == "run_of_river_hydro":
        low, high = river_factors(params)
        return cap * F.col("hydro_anomaly") * low, cap * F.col("hydro_anomaly") * high
    profile = F.col(fv.GENERATION_COLUMN[technology])
    if technology == "conventional_hydro":
        if hydro == "bounds":
            return F.col("hydro_min"), F.col("hydro_max")
        fixed = profile * F.col("hydro_anomaly")
        return fixed, fixed
    held = F.least(profile, cap)
    return held, held


def floor_of_non_renewables(params: dict[str, float]) -> Column:
    """Output that thermal plants cannot go below."""
    return scalars.add_up([output_bounds(t, params)[0] for t in fv.FLOOR_TECHNOLOGIES])


def pumping() -> Column:
    """Storage charging taken as given, within pump capacity."""
    return F.least(F.col("pumped_hydro_consumption_gwh"), F.col("pumped_hydro_pump_cap_gw"))


def net_exports() -> Column:
    return scalars.add_up([F.col(f"exports_{b}_gwh") - F.col(f"imports_{b}_gwh") for b in fv.BORDERS])


def supply_blocks(hours: DataFrame, constants: Constants, carried: list[str], hydro: str = "profile") -> DataFrame:
    """Long form: one row per hour and technology with bounds, cost and the
    carried columns of the hour."""
    rows = []
    for t in fv.TECHNOLOGIES:
        low, high = output_bounds(t, constants.params, hydro)
        rows.append(
            F.struct(
                F.lit(t).alias("technology"), low.alias("lo"), high.alias("hi"),
                marginal_cost(t, constants).alias("mc"),
            )
        )
    return hours.select(*carried, F.explode(F.array(*rows)).alias("b")).select(*carried, "b.*")


def with_technology(df: DataFrame, technology: DataFrame) -> DataFrame:
    """Technology parameters by name; the table has one row per known technology."""
    known = technology.where(F.col("technology").isin(fv.TECHNOLOGIES))
    return df.join(broadcast_within(known, len(fv.TECHNOLOGIES)), "technology")


def marginal_cost_long(df: DataFrame, technology: DataFrame) -> DataFrame:
    """Adds ``mc`` to long rows that carry ``fuel_cost`` (null for none) and ``ets``."""
    fuel = F.coalesce(scalars.ratio("fuel_cost", "efficiency"), F.lit(0.0))
    allowance = F.col("fossil_fuel") * F.col("ets") * F.col("direct_e_tco2_gwh")
    return with_technology(df, technology).withColumn(
        "mc", F.col("var_om_eur_gwh") + fuel + allowance
    )


# --- clearing ------------------------------------------------------------------------------------


STATUSES = ["cleared", "shortage", "oversupply", "undefined"]


def _status(known: Column, oversupplied: Column, shed: Column) -> Column:
    """``undefined`` hours lack an input: they have no price and no quantities."""
    return (
        F.when(~known, "undefined")
        .when(oversupplied, "oversupply")
        .when(shed > 0, "shortage")
        .otherwise("cleared")
    )


def clear_market(
    blocks: DataFrame, demand: DataFrame | None, keys: list[str], loss: float, voll: float,
    curves=(("a", "b"),),
) -> DataFrame:
    """Merit-order clearing of long supply blocks, one market per key.

    ``blocks`` has ``technology, lo, hi, mc`` per key; ``demand`` one row per key
    with the demand curves and ``net_export``, or None if the blocks carry these
    columns, which saves the join. Output below ``lo`` is must-run.
    The rest is taken in the order of cost until supply meets the demand at that
    cost; where demand falls between two blocks the price lies between them.
    Returns the blocks with ``q``, and the market's ``price`` (EUR/MWh),
    ``shed``, ``spill`` and ``status``. A market with a null among its bounds,
    costs, curves or exports is ``undefined`` and has none of the others.
    """
    gross = 1.0 + loss
    whole = Window.partitionBy(*keys)
    given = ["lo", "hi", "mc", "net_export", *[c for pair in curves for c in pair]]
    stack = whole.orderBy("mc", "technology").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )

    def needed(level: str) -> Column:
        return gross * demand_at(f"{gross}D * {level}", curves) + F.col("net_export")

    def level_for(supply: Column) -> Column:
        return price_at((supply - F.col("net_export")) / gross, curves) / gross

    flex = F.col("hi") - F.col("lo")
    laid = (
        (blocks if demand is None else blocks.join(demand, keys))
        .withColumn("_must", F.sum("lo").over(whole))
        .withColumn("_upto", F.col("_must") + F.sum(flex).over(stack))
        .withColumn("_below", F.col("_upto") - flex)
        .withColumn("_need", needed("mc"))
        .withColumn("_need0", needed("0D"))
        .withColumn("_hit", F.col("_upto") >= F.col("_need"))
        .withColumn("_over", F.col("_must") >= F.col("_need0"))
        .withColumn(
            "_marginal", F.col("_hit") & ~F.col("_over") & (F.count_if("_hit").over(stack) == 1)
        )
    )
    at_margin = F.when(F.col("_below") <= F.col("_need"), F.col("mc")).otherwise(
        level_for(F.col("_below"))
    )
    met = (
        laid.withColumn("_met", F.max(F.when(F.col("_marginal"), at_margin)).over(whole))
        .withColumn("_all", F.max("_upto").over(whole))
        .withColumn("_need_voll", needed(f"{voll}D"))
    )
    short = F.col("_met").isNull() & ~F.col("_over") & (F.col("_need_voll") > F.col("_all"))
    level = (
        F.when(F.col("_over"), 0.0)
        .when(F.col("_met").isNotNull(), F.col("_met"))
        .when(short, voll)
        .otherwise(level_for(F.col("_all")))
    )
    q = (
        F.when(F.col("_over"), F.col("lo"))
        .when(F.col("_marginal"), F.col("lo") + F.greatest(F.col("_need") - F.col("_below"), F.lit(0.0)))
        .when(F.col("_met").isNull() | ~F.col("_hit"), F.col("hi"))
        .otherwise(F.col("lo"))
    )
    shed = F.when(short, F.col("_need_voll") - F.col("_all")).otherwise(0.0)
    spill = F.when(F.col("_over"), F.col("_must") - F.col("_need0")).otherwise(0.0)
    known = ~F.max(scalars.add_up(given).isNull()).over(whole)
    result = {"q": q, "price": gross * level / 1000.0, "shed": shed, "spill": spill}
    return (
        met.withColumn("_known", known)
        .withColumns({name: F.when(F.col("_known"), c) for name, c in result.items()})
        .withColumn("status", _status(F.col("_known"), F.col("spill") > 0, F.col("shed")))
        .drop("_known", "_must", "_upto", "_below", "_need", "_need0", "_hit", "_over", "_marginal", "_met", "_all", "_need_voll")
    )


def clear_hours(hours: DataFrame, constants: Constants, hydro: str = "profile") -> DataFrame:
    """The same clearing on wide hours, each in its own row.

    Bounds, costs and curves are expressions of the row; they alone go, in Arrow batches, to
    ``merit_order.clear``, which clears a batch of hours at once. Nothing is exploded, shuffled or
    sorted across rows. Adds ``q_<technology>``, ``price``, ``shed``, ``spill``, ``status``,
    ``<sector>_demand``, ``charge``, ``battery_charge`` (a supplied profile, 0
    without one) and ``net_export``, which includes both charges. An hour with a
    null among its bounds, costs, curves or exports is ``undefined``.
    """
    loss, voll = constants.loss, constants.voll
    gross = 1.0 + loss
    names = sorted(fv.TECHNOLOGIES)  # ties of cost go by name
    listed = [names.index(t) for t in fv.TECHNOLOGIES]
    supply = {}
    for t in fv.TECHNOLOGIES:
        low, high = output_bounds(t, constants.params, hydro)
        supply |= {f"_lo_{t}": low, f"_hi_{t}": high, f"_mc_{t}": marginal_cost(t, constants)}
    given = F.col("battery_charge_gwh") if "battery_charge_gwh" in hours.columns else F.lit(0.0)
    ready = hours.withColumns(supply | {"charge": pumping(), "battery_charge": given}).withColumn(
        "net_export", net_exports() + F.col("charge") + F.col("battery_charge")
    )
    inputs = [*supply, "net_export", *[c for pair in SECTOR_CURVES for c in pair]]
    ready = ready.withColumn("_known", F.expr(" + ".join(inputs)).isNotNull())
    arguments = [f"_{kind}_{t}" for kind in ("lo", "hi", "mc") for t in names] + ["net_export", *[c for pair in SECTOR_CURVES for c in pair]]
    results = [*[f"q_{t}" for t in fv.TECHNOLOGIES], "level", "shed", "spill"]

    @F.arrow_udf(", ".join(f"{c} double" for c in results))
    def cleared(*columns: pa.Array) -> pa.Array:
        given = [c.to_numpy(zero_copy_only=False) for c in columns]
        k = len(names)
        lo, hi, mc = (np.stack(given[i * k : (i + 1) * k], axis=1) for i in range(3))
        curves = given[3 * k + 1 :]
        done = merit_order.clear(lo, hi, mc, curves[::2], curves[1::2], given[3 * k], loss, voll)
        values = [pa.array(done.q[:, i]) for i in listed]
        values += [pa.array(done.level, mask=np.isnan(done.level)), pa.array(done.shed), pa.array(done.spill)]
        return pa.StructArray.from_arrays(values, results)

    # said to vary, so that a later filter on any result stops above this column, where it would
    # otherwise clear the hours once more
    solved = ready.withColumn("_m", cleared.asNondeterministic()(*arguments))
    # written out and not by each other's names: every level of names is one more copy of a wide row
    known = {c: F.when(F.col("_known"), F.col("_m")[c]) for c in results}
    at = F.lit(gross) * known.pop("level")
    demands = {
        f"{s}_demand": F.when(F.col("_known"), F.greatest(F.col(f"a_{s}") - F.col(f"b_{s}") * at, F.lit(0.0))) for s in fv.SECTORS
    }
    status = _status(F.col("_known"), known["spill"] > 0, known["shed"])
    return solved.withColumns(known | demands | {"price": at / 1000.0, "status": status}).drop("_known", "_m", *supply)


# --- accounts of a cleared hour --------------------------------------------------------------------


def surplus_and_revenue(hours: DataFrame) -> DataFrame:
    """Consumer surplus and producer revenue of the hour, in EUR."""
    surplus, revenue = [], []
    for s in fv.SECTORS:
        d, a, b = F.col(f"{s}_demand"), F.col(f"a_{s}"), F.col(f"b_{s}")
        surplus.append(F.coalesce(scalars.ratio(d * d, 2.0 * b), F.lit(0.0)))
        revenue.append(F.coalesce(scalars.ratio((a - d) * d, b), F.lit(0.0)))
    return hours.withColumns(
        {
            "consumer_surplus": scalars.add_up(surplus),
            "producer_revenue": scalars.add_up(revenue),
            "total_demand": scalars.add_up([f"{s}_demand" for s in fv.SECTORS]),
        }
    )


def costs_and_emissions(hours: DataFrame, constants: Constants) -> DataFrame:
    """Running and fixed cost (EUR) and direct emissions (t) of the hour.

    The fixed cost is that of the hour's capacity, so its sum over the sample is
    the yearly cost of the mean capacity times the sampled part of a year.
    """
    variable, fuel, emitted, fixed = [], [], [], []
    for t in fv.TECHNOLOGIES:
        row, q = constants.technology[t], F.col(f"q_{t}")
        variable.append(float(row["var_om_eur_gwh"]) * q)
        if t in fv.FUEL_COLUMN:
            fuel.append(F.col(fv.FUEL_COLUMN[t]) * q / float(row["efficiency"]))
        if row["fossil_fuel"]:
            emitted.append(q * float(row["direct_e_tco2_gwh"]))
        yearly = float(row["fixed_om_Meur_gwy"]) * 1e6
        fixed.append(F.col(fv.CAPACITY_COLUMN[t]) * (yearly / fv.HOURS_PER_YEAR))
    fuel_costs, direct, fixed_costs = (scalars.add_up(x) for x in (fuel, emitted, fixed))
    # in one step: a level of names more is a copy of a wide row more
    running = scalars.add_up(variable) + constants.voll * F.col("shed") + fuel_costs + F.col("eu_ets_price_eur_tco2") * direct
    return hours.withColumns(
        {
            "fuel_costs": fuel_costs,
            "direct_emissions": direct,
            "fixed_costs": fixed_costs,
            "running_costs": running,
            "total_costs": running + fixed_costs,
        }
    )


def generation_totals(hours: DataFrame, params: dict[str, float]) -> DataFrame:
    """Output by class, shares and curtailment. Storage is outside the total."""

    def q(names):
        return scalars.add_up([F.col(f"q_{t}") for t in names])

    renewable, low_carbon, other = q(fv.RENEWABLE), q(fv.LOW_CARBON), q(fv.NON_RENEWABLE)
    total = renewable + other
    return hours.withColumns(
        {
            "non_renewable_gen": other,
            "renewable_gen": renewable,
            "low_carbon_gen": low_carbon,
            "storage_out": q(fv.STORAGE),
            "min_non_renewable_gen": floor_of_non_renewables(params),
            **{
                f"curtailment_{t}": F.col(fv.CAPACITY_COLUMN[t]) * F.col(f"{t}_cap_factor") - F.col(f"q_{t}")
                for t in fv.FACTOR_LIMITED
            },
            "total_generation": total,
            "share_renewable_gen": scalars.ratio(renewable, total),
            "share_low_carbon_gen": scalars.ratio(low_carbon, total),
        }
    )


def balance_residual(hours: DataFrame, loss: float) -> DataFrame:
    """Supply minus use in each hour; 0 but for rounding. Spilled must-run counts as use."""
    supply = scalars.add_up([F.col(f"q_{t}") for t in fv.TECHNOLOGIES]) + F.col("shed")
    use = (1.0 + loss) * scalars.add_up([f"{s}_demand" for s in fv.SECTORS])
    return hours.withColumn(
        "residual", supply - F.col("net_export") - use - F.col("spill")
    )


def snapped(hours: DataFrame, columns: list[str], tol: float = fv.SMALL_VALUE) -> DataFrame:
    """Small values of the listed columns become 0."""
    return hours.withColumns({c: scalars.snap_small(c, tol) for c in columns})


RESULTS = [
    *[f"q_{t}" for t in fv.TECHNOLOGIES], *[f"{s}_demand" for s in fv.SECTORS], "shed", "spill", "charge", "battery_charge",
]


def dispatch(hours: DataFrame, constants: Constants, hydro: str = "profile") -> DataFrame:
    """From projected hours to cleared hours with all accounts; small results are 0."""
    cleared = clear_hours(calibrate_demand(hours, constants.params), constants, hydro)
    cleared = snapped(cleared, RESULTS)
    accounted = costs_and_emissions(surplus_and_revenue(cleared), constants)
    return generation_totals(accounted, constants.params)
