"""The analysis tables of an ensemble, one DataFrame per table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from gridpanel import fixed_values as fv
from gridpanel.operators import ensemble
from gridpanel.plans.simulate import Ensemble


def report(run: Ensemble, scenarios: list[str] | None = None) -> dict[str, DataFrame]:
    order = fv.SCENARIO_ORDER if scenarios is None else scenarios
    hourly, monthly, main = run.hourly_profiles, run.monthly_profiles, run.main_results
    statistics = ensemble.scenario_statistics(main, max_scenarios=len(order))
    share = ensemble.percent
    generation = {t: f"{t}_gen" for t in ensemble.PRODUCERS}
    capacity = {t: fv.CAPACITY_COLUMN[t] for t in ensemble.PRODUCERS}
    shares = main.select("scenario", share("share_renewable_gen").alias("share"))
    return {
        "main_statistics": ensemble.ordered(statistics, "scenario", order),
        "metric_matrix": ensemble.metric_matrix(statistics, order),
        "hourly_price": ensemble.mean_profiles_wide(hourly, "hour", "price", order),
        "monthly_price": ensemble.mean_profiles_wide(monthly, "month", "price", order),
        "hourly_emissions": ensemble.mean_profiles_wide(hourly, "hour", "emissions", order),
        "monthly_emissions": ensemble.mean_profiles_wide(monthly, "month", "emissions", order),
        "hourly_renewable_share": ensemble.mean_profiles_wide(hourly, "hour", share("ren_share"), order),
        "monthly_renewable_share": ensemble.mean_profiles_wide(monthly, "month", share("ren_share"), order),
        "hourly_generation_mix": ensemble.mix_with_residual(hourly, "hour"),
        "monthly_generation_mix": ensemble.mix_with_residual(monthly, "month"),
        "hourly_storage": ensemble.storage_profile(hourly, order),
        "capacity_inputs": ensemble.capacity_means(run.inputs_realized),
        "generation_mix": ensemble.mix_percent(main, generation),
        "capacity_mix": ensemble.mix_percent(run.inputs_realized, capacity),
        "share_histogram": ensemble.histogram(shares, "scenario", "share", max_keys=len(order)),
        "share_axis": ensemble.axis_range(shares, "share"),
        "price_histogram": ensemble.histogram(main, "scenario", "avg_price", max_keys=len(order)),
        "price_axis": ensemble.axis_range(main, "avg_price"),
    }
