"""Statistics over iterations and reporting tables."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from gridpanel.operators import describe, ensemble


def test_histogram_equals_numpy(spark):
    rng = np.random.default_rng(2)
    groups = {"a": rng.normal(70, 5, 3000), "b": rng.uniform(0, 1, 40), "flat": np.full(9, 2.0)}
    pdf = pd.concat([pd.DataFrame({"k": k, "v": v}) for k, v in groups.items()])
    got = ensemble.histogram(spark.createDataFrame(pdf), "k", "v").toPandas()
    for k in groups:
        counts = np.zeros(50, dtype=int)
        part = got[got["k"] == k]
        counts[part["bin"]] = part["n"]
        assert (counts == np.histogram(groups[k], bins=50)[0]).all()


def test_mean_of_ratios_is_not_ratio_of_means(spark):
    rows = [("a", 1, 1.0, 10.0), ("a", 2, 9.0, 10.0), ("a", 3, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "scenario string, iteration int, ren double, total double")
    row = df.agg(F.avg(F.col("ren") / F.col("total")), F.sum("ren") / F.sum("total")).first()
    assert abs(row[0] - 2.0 / 3) < 1e-12 and abs(row[1] - 11 / 21) < 1e-12


def test_default_hour(spark):
    df = spark.range(9000).select(F.lit("s").alias("k"), F.col("id").alias("t"), F.floor(F.col("id") / 700).alias("b"))
    got = ensemble.default_hour(df, ["k"], ["t"], "b").toPandas()
    assert (got["hour"] == (got["t"] % 8760) % 24).all()


def test_running_sums_over_a_tree_of_blocks(spark, monkeypatch):
    from gridpanel.operators import blocks

    monkeypatch.setattr(blocks, "FAN", 3)
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"k": rng.choice(["a", "b"], 400), "t": np.arange(400), "v": rng.normal(size=400)})
    pdf["b"] = pdf["t"] // 7
    df = spark.createDataFrame(pdf[pdf["b"] % 5 != 2])  # blocks and runs without rows
    want = df.toPandas().sort_values(["k", "t"])
    for levels in (1, 2, 4):
        for inclusive in (True, False):
            got = blocks.with_running_sum(df, ["k"], ["t"], "b", F.col("v"), "s", inclusive, levels).toPandas().sort_values(["k", "t"])
            running = want.groupby("k")["v"].cumsum() - (0 if inclusive else want["v"])
            np.testing.assert_allclose(got["s"], running, atol=1e-9)


def test_mix_percent(spark):
    rows = [("a", 97.0, 2.0, 1.0, 0.0), ("b", 50.0, 47.0, 3.0, 0.0)]
    df = spark.createDataFrame(rows, "scenario string, w double, s double, c double, z double")
    got = ensemble.mix_percent(df, {"wind": "w", "solar": "s", "coal": "c", "none": "z", "absent": "y"}).toPandas()
    assert set(got["technology"]) == {"wind", "solar", "coal"}
    flags = got.set_index(["scenario", "technology"])["labelled"]
    assert not flags["a", "solar"] and flags["b", "coal"] and flags["a", "wind"]


def test_matrix_marks_missing_cells(spark):
    stats = spark.createDataFrame([("x", 1.5, None), ("y", 2.0, 3.0)], "scenario string, m double, n double")
    got = {r["metric"]: (r["x"], r["y"], r["z"]) for r in ensemble.metric_matrix(stats, ["x", "y", "z"]).collect()}
    assert got == {"m": ("1.50", "2.00", "-"), "n": ("-", "3.00", "-")}


def test_fixed_order(spark):
    df = spark.createDataFrame([("c",), ("new",), ("a",), ("b",)], "s string")
    assert [r["s"] for r in ensemble.ordered(df, "s", ["b", "a", "c"]).collect()] == ["b", "a", "c", "new"]


def test_residual_is_not_negative(spark):
    rows = [("a", 1, 5.0, 1.0, 1.0, 3.0, 1.0, 1.0, 0.0, 0.0, 6.0, 9.0)]
    cols = "scenario string, month int, solar_pv double, wind double, conv_hydro double, ccgt double, cogen double, nuclear double, batt_out double, ph_out double, ren_gen double, non_ren_gen double"
    row = ensemble.mix_with_residual(spark.createDataFrame(rows, cols), "month").first()
    assert row["other_renewable"] == 0.0 and row["other_non_renewable"] == 4.0 and row["label"] == "Jan"


def test_boxplot_whiskers(spark):
    v = [1.0, 2.0, 3.0, 4.0, 5.0, 100.0]
    df = spark.createDataFrame([("k", x) for x in v], "k string, v double")
    row = describe.boxplot_stats(df, ["k"], "v").first()
    assert (row["q1"], row["median"], row["q3"]) == (2.25, 3.5, 4.75)
    assert row["whisker_low"] == 1.0 and row["whisker_high"] == 5.0 and row["n"] == 6


def test_rank_labels(spark):
    df = spark.createDataFrame([("k", v) for v in (344.0, 274.0, 295.0)], "k string, v double")
    got = {r["v"]: (r["label"], r["position"]) for r in describe.rank_labels(df, ["k"], "v").collect()}
    assert got == {274.0: ("S1", 2026.0), 295.0: ("S2", 2028.0), 344.0: ("S3", 2030.0)}


def test_tables_from_parts_equal_those_from_hours(spark):
    from driver_queries.ensemble_queries import with_stocks
    from gridpanel.sources import scratch
    from tests.oracle import sf_path

    hours = scratch.landed(with_stocks(spark, sf_path("0.001")), "hours")
    odd = F.when(F.col("iteration") % 3 == 0, F.lit("undefined")).otherwise(F.col("status"))
    gaps = F.when(F.col("hour") != 6, F.col("share_renewable_gen"))
    hours = hours.withColumns({"status": F.when(F.col("hour") == 18, odd).otherwise(F.col("status")), "share_renewable_gen": gaps})
    parts = scratch.landed(ensemble.parts(hours), "parts")
    valid = ensemble.valid_hours(hours)
    for one, other in (
        (ensemble.kpis_of_parts(parts), ensemble.iteration_kpis(valid)),
        (ensemble.profile_of_parts(parts, "hour"), ensemble.period_profile(valid, "hour")),
        (ensemble.profile_of_parts(parts, "month"), ensemble.period_profile(valid, "month")),
        (ensemble.inputs_of_parts(parts), ensemble.realised_inputs(hours)),
    ):
        keys = [c for c in ("scenario", "iteration", "hour", "month") if c in other.columns]
        assert one.columns == other.columns and one.dtypes == other.dtypes
        a, b = (df.toPandas().sort_values(keys).reset_index(drop=True) for df in (one, other))
        pd.testing.assert_frame_equal(a, b, rtol=1e-9, atol=1e-9)
        assert "hours" not in " ".join(one.inputFiles()) and len(a)
    assert parts.count() < hours.count()


def test_parts_take_one_pass(spark):
    from driver_queries.ensemble_queries import with_stocks
    from gridpanel.sources import scratch
    from tests.oracle import sf_path

    hours = scratch.landed(with_stocks(spark, sf_path("0.001")), "hours")
    plan = ensemble.parts(hours)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 1


def test_parts_count_known_values_by_what_hours_lack(spark):
    """Hours of a part lack the same columns, so one count serves all of them; hours that lack others are parts of their own."""
    from driver_queries.ensemble_queries import with_stocks
    from gridpanel.sources import scratch
    from tests.oracle import sf_path

    hours = scratch.landed(with_stocks(spark, sf_path("0.001")), "hours")
    day = F.dayofmonth("ts")
    names = {"coal_cap_gw": day % 2 == 0, "q_wind": day % 3 == 0, "price": day % 5 < 4, "cost_gas_eur_gwh": F.lit(True), "battery_charge": F.col("iteration") % 2 == 0}
    hours = hours.withColumns({c: F.when(~gone, F.col(c)).cast("double") for c, gone in names.items()})
    parts = scratch.landed(ensemble.parts(hours), "parts")
    assert not [c for c in parts.columns if c.startswith("n_")]
    valid = ensemble.valid_hours(hours)
    for one, other in (
        (ensemble.kpis_of_parts(parts), ensemble.iteration_kpis(valid)),
        (ensemble.profile_of_parts(parts, "hour"), ensemble.period_profile(valid, "hour")),
        (ensemble.inputs_of_parts(parts), ensemble.realised_inputs(hours)),
    ):
        keys = [c for c in ("scenario", "iteration", "hour", "month") if c in other.columns]
        a, b = (df.toPandas().sort_values(keys).reset_index(drop=True) for df in (one, other))
        pd.testing.assert_frame_equal(a, b, rtol=1e-9, atol=1e-9)
        assert b.isna().any().any()
