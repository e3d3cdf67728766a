"""Whole stages on small inputs: history from feeds, an ensemble, its report."""

from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from driver_queries.bases import panel as line_panel
from driver_queries.example_market import PARAMS, TECHNOLOGY_ROWS
from gridpanel import fixed_values as fv
from gridpanel import schemas
from gridpanel.operators import market
from gridpanel.plans import history, report, simulate
from gridpanel.sources import tables
from tests.oracle import sf_path

START, END = datetime(2020, 2, 27), datetime(2020, 3, 3, 23)


@pytest.fixture(scope="module")
def feeds(spark):
    rng = np.random.default_rng(4)
    hours = pd.date_range(START, END, freq="h")
    frames = []
    for name in fv.INDICATOR_NAMES.values():
        v = rng.uniform(10, 1000, len(hours))
        if name.startswith("net_raw"):
            v -= 500
        v[rng.random(len(hours)) < 0.1] = np.nan
        frames.append(pd.DataFrame({"series": name, "ts": hours, "value": v}))
    long = pd.concat([f for f in frames if f["series"].iloc[0] != "diesel_gen_mwh"]).dropna()
    capacity = pd.DataFrame(
        [(n, m, 2000.0 + i) for i, n in enumerate(fv.MONTHLY_CAPACITY_NAMES.values()) for m in ("2020-02", "2020-03")],
        columns=["series", "year_month", "value"],
    )
    costs = pd.DataFrame(
        [(c, d.date(), 20.0 + i) for i, c in enumerate(history.DAILY_COSTS) for d in pd.date_range("2020-02-28", "2020-03-02", freq="2D")],
        columns=["series", "date", "price"],
    )
    return long, capacity, costs


def test_history(spark, feeds):
    long, capacity, costs = feeds
    df = history.build_history(
        spark.createDataFrame(long), spark.createDataFrame(capacity), spark.createDataFrame(costs), START, END
    )
    assert df.columns == [f.name for f in schemas.HOURLY_PANEL.fields] and len(df.columns) == 63
    got = df.toPandas().sort_values("time_long").reset_index(drop=True)
    assert len(got) == 6 * 24 and not got.isna().any().any()
    # flows, factors, costs, a series without data, units
    for b in fv.BORDERS:
        np.testing.assert_allclose(got[f"imports_{b}_gwh"] - got[f"exports_{b}_gwh"], got[f"net_flows_{b}_gwh"], atol=1e-12)
    assert got[fv.CAP_FACTOR_COLUMNS].min().min() >= 0 and got[fv.CAP_FACTOR_COLUMNS].max().max() <= 1
    assert (got["diesel_gen_gwh"] == 0).all()
    assert (got["pumped_hydro_pump_cap_gw"] == 2.278).all() and (got["batteries_cap_gw"] == 0.01).all()
    assert (got["cost_gas_eur_gwh"] == 20000.0).all()
    # sectors add up to national demand where its value was observed
    national = long[long["series"] == "total_national_demand_mwh"].set_index("ts")["value"]
    sectors = got.set_index(pd.to_datetime(got["time_long"]))[[f"{s}_demand_gwh" for s in fv.SECTORS]].sum(axis=1)
    np.testing.assert_allclose(sectors.loc[national.index], national / 1000.0)


def test_history_takes_hydro_from_its_feed(spark, feeds):
    long, capacity, costs = feeds
    hours = pd.DataFrame({"datetime": pd.date_range(START, END, freq="h"), "conventional_hydro_gen_mwh": 123.0})
    series = history.complete_series(
        spark.createDataFrame(long), spark.createDataFrame(capacity), spark.createDataFrame(hours), START, END
    )
    names = {r["series"]: r["n"] for r in series.groupBy("series").agg(F.count("*").alias("n")).collect()}
    assert set(names) == set(history.series_names()) and set(names.values()) == {144}
    hydro = series.where("series = 'conventional_hydro_gen_mwh'").select("value").distinct().collect()
    assert [r[0] for r in hydro] == [123.0]


YEARS = [1996, 1997]


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    panel = line_panel(spark, sf_path("0.001"))
    technology = spark.createDataFrame(TECHNOLOGY_ROWS, schemas.TECHNOLOGY)
    params = spark.createDataFrame(pd.DataFrame([PARAMS]))
    rng = np.random.default_rng(6)
    rows = []
    for v in fv.DRAWN_VARIABLES:
        spread = 0.3 if v in ("wind_cap_gw", "solar_pv_cap_gw", "batteries_cap_gw") else 0.02
        for _ in range(3):
            d = float(rng.normal(0.2, spread))
            rows.append((v, 1.0, d, d + 0.05))
    estimates = spark.createDataFrame(rows, "variable string, weight double, delta_wrt_1996 double, delta_wrt_1997 double")
    scenarios = spark.createDataFrame(fv.SCENARIO_ROWS[:4], schemas.SCENARIOS)
    path = str(tmp_path_factory.mktemp("hours"))
    return simulate.run_ensemble(
        panel, technology, params, estimates, scenarios, 4, seed=9, base_years=YEARS, path=path, block=2
    )


def test_ensemble_tables(spark, run):
    main = run.main_results.toPandas()
    assert len(main) == 16 and set(main["scenario"]) == set(fv.SCENARIO_ORDER[:4])
    np.testing.assert_allclose(main["renewable_gen"] + main["non_renewable_gen"], main["total_generation"])
    np.testing.assert_allclose(main["consumer_surplus"] + main["producer_surplus"], main["net_welfare"])
    assert set(main["baseline_year"]) <= set(YEARS)
    hourly = run.hourly_profiles.toPandas()
    assert len(hourly) == 16 * 24 and set(hourly["hour"]) == set(range(24))
    known = hourly.dropna()
    np.testing.assert_allclose(known["ren_gen"] + known["non_ren_gen"], known["total_gen"])
    draws = run.delta_draws.toPandas().set_index(["scenario", "iteration"])
    assert (draws["d_coal_cap_gw"] == -1.0).all()
    assert (draws.loc["nuclear", "d_nuclear_cap_gw"] == 0.0).all()
    inputs = run.inputs_realized.toPandas()
    assert (inputs["coal_cap_gw"].abs() < 1e-9).all() and len(inputs.columns) == 2 + 26


def test_same_seed_same_ensemble(spark, run):
    again = run.delta_draws.repartition(7).toPandas().sort_values(["scenario", "iteration"]).reset_index(drop=True)
    first = run.delta_draws.repartition(1).toPandas().sort_values(["scenario", "iteration"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(first, again)


def test_report(run):
    out = report.report(run, fv.SCENARIO_ORDER[:4])
    assert len(out) == 18
    matrix = out["metric_matrix"].toPandas()
    assert len(matrix) == 22 and (matrix != "-").all().all()
    stats = out["main_statistics"].toPandas()
    assert stats["scenario"].tolist() == fv.SCENARIO_ORDER[:4]
    assert len(out["hourly_price"].columns) == 5


def test_scenario_files(spark, tmp_path):
    schema = "iteration int, v double"
    for name, text in {"climate change": "iteration,v\n1,NA\n2,2.5\n", "nuclear": "iteration,v\n1,1.0\n"}.items():
        (tmp_path / f"{name}_main_results.csv").write_text(text)
    (tmp_path / "nuclear_other.csv").write_text("x\n1\n")
    from pyspark.sql.types import _parse_datatype_string

    got = tables.read_scenario_files(spark, str(tmp_path), "main_results", _parse_datatype_string(schema))
    assert {(r["scenario"], r["iteration"], r["v"]) for r in got.collect()} == {
        ("climate change", 1, None), ("climate change", 2, 2.5), ("nuclear", 1, 1.0)
    }


def test_a_report_is_one_file(spark, tmp_path):
    path = tmp_path / "report"
    tables.export_csv(spark.createDataFrame([("x", 1.5), ("y", None)], "name string, value double"), str(path))
    files = list(path.glob("*.csv"))
    assert len(files) == 1 and sorted(files[0].read_text().split()) == ["name,value", "x,1.5", "y,NA"]


def test_parameters_are_one_row(spark):
    technology = spark.createDataFrame(TECHNOLOGY_ROWS, schemas.TECHNOLOGY)
    params = spark.createDataFrame(pd.DataFrame([PARAMS, PARAMS]))
    with pytest.raises(ValueError, match="one row"):
        market.Constants.load(technology, params)
