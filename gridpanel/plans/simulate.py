"""Scenario ensembles: draws, projection, clearing, and the result tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpanel import fixed_values as fv
from gridpanel.functions import keyed_random as rnd
from gridpanel.operators import checks, draws, ensemble, market, project
from gridpanel.sources import commits, scratch

SETTINGS = [
    "scenario", "elas_anomaly", "hydro_anomaly", "coal_phase_out", "nuclear_phase_out",
    "climate_demand", "batt_cap_multiplier", "ren_cap_multiplier",
]
FIRST_STOCK = (0.2, 0.6)


@dataclass(frozen=True)
class Ensemble:
    """The five result tables and the cleared hours they come from."""

    hours: DataFrame
    main_results: DataFrame
    hourly_profiles: DataFrame
    monthly_profiles: DataFrame
    delta_draws: DataFrame
    inputs_realized: DataFrame


def draw_ensemble(
    scenarios: DataFrame, estimates: DataFrame, n: int, seed: int, base_years: list[int],
    rules: list[tuple] | None = None,
) -> DataFrame:
    """One row per scenario and iteration: settings, window and growth factors."""
    runs = draws.iterations(scenarios.select(*SETTINGS), n).drop("iter_block")
    windows = draws.draw_windows(runs, seed, base_years)
    known = draws.distributions(draws.long_estimates(estimates, base_years))
    drawn = draws.draw_deltas(
        windows, known, seed, max_groups=len(base_years) * len(fv.DRAWN_VARIABLES)
    )
    fanned = draws.fan_out(draws.adjust(drawn.drop("rule"), rules))
    keys = [*SETTINGS, "iteration", "base_year", "day_start"]
    return draws.to_wide(fanned, keys, draws.fanned_variables())


def cleared_hours(
    panel: DataFrame, drawn: DataFrame, constants: market.Constants, seed: int,
    base_years: list[int], window_days: int | None = fv.WINDOW_DAYS, hydro: str = "profile",
) -> DataFrame:
    """Every sampled hour of every iteration, projected, cleared and accounted.

    ``panel`` holds one row per hour (``ts``) of the base years, best as a stored table: it is
    measured, and read for every block of iterations.
    """
    variables = draws.fanned_variables()
    past = panel.where(F.col("year").isin(base_years))
    hours = project.project(
        project.expand(past, drawn, window_days=window_days), variables
    )
    if hydro == "bounds":
        hours = checks.with_bundle(hours, ensemble.RUN, "ts")
        hours = checks.bundle_bounds(hours, ensemble.RUN, "conventional_hydro_gen_gwh")
    done = market.dispatch(hours, constants, hydro)
    low, high = FIRST_STOCK
    start = low + (high - low) * rnd.uniform(seed, *ensemble.RUN, F.lit("stock"))
    return checks.stock_columns(done, constants.params, ensemble.RUN, "ts", start)


def result_tables(hours: DataFrame, drawn: DataFrame) -> Ensemble:
    """The hours are read once, for a stored table of parts a seventh their length (and
    narrower); the result tables add these up."""
    parts = scratch.landed(ensemble.parts(hours), "parts")
    return Ensemble(
        hours=hours,
        main_results=ensemble.kpis_of_parts(parts),
        hourly_profiles=ensemble.profile_of_parts(parts, "hour"),
        monthly_profiles=ensemble.profile_of_parts(parts, "month"),
        delta_draws=drawn,
        inputs_realized=ensemble.inputs_of_parts(parts),
    )


def run_digests(scenarios: DataFrame, inputs: list[DataFrame], seed: int, base_years: list[int], window_days: int | None) -> dict[str, str]:
    """By scenario, what its cleared hours follow from: its settings, the seed, the sampled
    years and window, and the rows of the inputs. The scenario table is small by its nature."""
    shared = [seed, base_years, window_days, *[commits.content_hash(df) for df in inputs]]
    rows = scenarios.select(*SETTINGS).collect()
    return {r["scenario"]: commits.digest_of(r.asDict(), shared) for r in rows}


def run_ensemble(
    panel: DataFrame, technology: DataFrame, params: DataFrame, estimates: DataFrame,
    scenarios: DataFrame, n: int, seed: int, base_years: list[int] | None = None,
    window_days: int | None = fv.WINDOW_DAYS, path: str | None = None, block: int = 1000,
) -> Ensemble:
    """Draw, project, clear and summarise ``n`` iterations per scenario.

    The cleared hours are written in blocks of iterations to ``path`` or the session's
    shared folder, and read from there, once, for all tables. A
    run that is started again on the same ``path`` writes what is missing there of the same
    seed, settings and inputs (``run_digests``): after a run that died, for more iterations,
    for scenarios that were added.
    """
    spark = panel.sparkSession
    years = fv.BASE_YEARS if base_years is None else base_years
    constants = market.Constants.load(technology, params)
    drawn = draw_ensemble(scenarios, estimates, n, seed, years)
    target = path or scratch.new_path(spark, "cleared_hours")
    past = scratch.landed(panel.where(F.col("year").isin(years)), "base_years")
    inputs = [past, technology, params, estimates]
    digests = run_digests(scenarios, inputs, seed, years, window_days)

    def hours_of(first: int, last: int, names: list[str]) -> DataFrame:
        some = drawn.where(F.col("iteration").between(first, last) & F.col("scenario").isin(names))
        return cleared_hours(past, some, constants, seed, years, window_days)

    commits.write_blocks(spark, hours_of, target, n, digests, block)
    return result_tables(commits.read_iterations(spark, target, digests, n), drawn)
