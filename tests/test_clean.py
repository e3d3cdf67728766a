"""Column and row clean-up on small hand-made frames."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from gridpanel.functions import scalars
from gridpanel.operators import clean
from gridpanel.sources import feeds, priority


def test_capacity_factor_guards(spark):
    rows = [(0.0, 0.0), (5.0, 0.0), (5.0, 4.0), (1.0, 4.0), (-1.0, 4.0), (None, 4.0), (1.0, None)]
    df = spark.createDataFrame(rows, "g double, c double")
    got = [r[0] for r in df.select(scalars.capacity_factor("g", "c")).collect()]
    assert got == [0.0, 0.0, 1.0, 0.25, 0.0, 0.0, 0.0]


def test_flow_parts_add_up(spark):
    df = clean.signed_split(spark.createDataFrame([(3.0,), (-2.0,), (0.0,), (None,)], "x double"), "x", "A")
    for r in df.collect():
        if r["x"] is None:
            assert r["imports_A_mwh"] is None and r["exports_A_mwh"] is None
        else:
            assert r["imports_A_mwh"] - r["exports_A_mwh"] == r["net_flows_A_mwh"] == r["x"]


def test_first_wins_ignores_arrival_of_partitions(spark):
    rows = [("a", 2, 20.0), ("a", 1, 10.0), ("b", 5, 1.0), ("b", 5, 0.5)]
    for n in (1, 3):
        df = spark.createDataFrame(rows, "k string, o int, v double").repartition(n)
        got = {r["k"]: (r["o"], r["v"]) for r in clean.first_wins(df, ["k"], ["o"]).collect()}
        assert got == {"a": (1, 10.0), "b": (5, 0.5)}


def test_units_and_order(spark):
    df = spark.createDataFrame(
        [(2278.0, 50.0, 10.0, 60.0, 5000.0)],
        "pumped_hydro_pump_cap_mw double, spot_price_eur_mwh double, cost_gas_eur_mwh double, "
        "eu_ets_price_eur_tco2 double, wind_gen_mwh double",
    )
    out = clean.convert_units(df)
    row = out.first().asDict()
    assert row == {
        "pumped_hydro_pump_cap_gw": 2.278, "spot_price_eur_mwh": 50.0, "cost_gas_eur_gwh": 10000.0,
        "eu_ets_price_eur_tco2": 60.0, "wind_gen_gwh": 5.0,
    }
    assert all(v < 1000 for k, v in row.items() if k.endswith("_gw"))
    with pytest.raises(ValueError, match="missing"):
        clean.ordered_projection(out, ["wind_gen_gwh", "pumped_hydro_turb_cap_gw"])
    assert clean.ordered_projection(out, ["wind_gen_gwh", "no"], "skip").columns == ["wind_gen_gwh"]


def test_spine_covers_each_hour_once(spark):
    names = spark.createDataFrame([("a",), ("b",)], "series string")
    spine = clean.hourly_spine(names, datetime(2024, 2, 28, 5), datetime(2024, 3, 1, 4))
    rows = spine.groupBy("series").agg(
        F.count("*").alias("n"), F.countDistinct("ts").alias("d"), F.min("ts").alias("a"), F.max("ts").alias("b")
    ).collect()
    assert len(rows) == 2
    for r in rows:
        assert r["n"] == r["d"] == 48
        assert r["a"] == datetime(2024, 2, 28, 5) and r["b"] == datetime(2024, 3, 1, 4)


def test_rescale_uses_the_mean(spark):
    df = spark.createDataFrame([(10.0,), (200000.0,)], "x double")
    assert {r[0] for r in clean.rescale_if_mean_exceeds(df, "x").collect()} == {1.0, 20000.0}
    assert {r[0] for r in clean.rescale_if_mean_exceeds(df, "x", 1e9).collect()} == {10.0, 200000.0}


def test_battery_years(spark):
    df = spark.createDataFrame([(2020,), (2022,), (2031,)], "y int")
    got = [r["c"] for r in clean.year_mapped_column(df, "y", "c").collect()]
    assert got == [10.0, 15.0, 25.0]


def test_prioritized_source_boundary(spark):
    def source(name, n):
        return spark.range(n).select(
            F.lit(name).alias("series"), F.col("id").cast("timestamp").alias("ts"), F.lit(1.0).alias("value")
        )

    first = source("few", 100).unionByName(source("enough", 101))
    second = source("few", 3).unionByName(source("enough", 3)).withColumn("value", F.lit(2.0))
    got = priority.prioritized_source([first, second], min_non_null=100)
    means = {r["series"]: (r["m"], r["n"]) for r in got.groupBy("series").agg(
        F.avg("value").alias("m"), F.count("*").alias("n")).collect()}
    assert means == {"few": (2.0, 3), "enough": (1.0, 101)}


def test_hydro_columns_are_found_by_name():
    columns = ["datetime", "Hydro Pumped Storage_Actual Consumption", "Hydro Pumped Storage_Actual Aggregated"]
    assert feeds.matching_column(columns, ["Pumped Storage", "Aggregated"]) == columns[2]
    assert feeds.matching_column(columns, ["Reservoir"]) is None


def test_fuel_units(spark):
    df = spark.createDataFrame([(81.4, 2.0)], "q double, fx double")
    row = df.select(
        scalars.fuel_cost_eur_mwh("coal", "q", "fx").alias("coal"), scalars.fuel_cost_eur_mwh("uranium", "q").alias("u")
    ).first()
    assert abs(row["coal"] - 5.0) < 1e-12 and abs(row["u"] - 81.4 / 30.211) < 1e-12
