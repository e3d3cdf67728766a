"""Bundles, ramps, stocks and extremes."""

import math

import pytest
from pyspark.sql import functions as F

from gridpanel.operators import checks, describe


@pytest.mark.parametrize("n", [100, 168, 200, 336, 720])
@pytest.mark.parametrize("block", [None, "b"])
def test_bundles(spark, n, block):
    df = spark.range(n).select(
        F.lit("s").alias("k"), F.col("id").alias("t"), F.floor(F.col("id") / 50).alias("b")
    )
    sizes = {
        r["bundle"]: r["count"]
        for r in checks.with_bundle(df, ["k"], "t", block).groupBy("bundle").count().collect()
    }
    full = max(n // 168, 1)
    assert sorted(sizes) == list(range(full))
    assert sum(sizes.values()) == n and sizes[full - 1] == n - 168 * (full - 1)


def test_bundle_bounds_and_budget(spark):
    df = spark.range(400).select(
        F.lit("s").alias("k"), F.col("id").alias("t"), F.col("id").cast("double").alias("v")
    )
    out = checks.bundle_bounds(checks.with_bundle(df, ["k"], "t"), ["k"], "v")
    ends = {r["bundle"]: (r["hydro_min"], r["hydro_max"], r["hydro_total"]) for r in out.collect()}
    assert ends == {0: (0.0, 167.0, sum(range(168))), 1: (168.0, 399.0, sum(range(168, 400)))}
    flags = checks.weekly_budget(out.withColumn("q", F.col("v") * 0.9), ["k"], "q", "v", 0.8).collect()
    assert all(r["violated"] for r in flags)
    flags = checks.weekly_budget(out.withColumn("q", F.col("v") * 0.8), ["k"], "q", "v", 0.8).collect()
    assert not any(r["violated"] for r in flags)


def test_ramps_across_blocks(spark):
    rows = [(0, 1.0), (1, 1.5), (2, 1.9), (3, 4.0), (4, 3.7), (5, 1.0)]
    df = spark.createDataFrame(rows, "t int, q double").withColumns(
        {"k": F.lit("a"), "b": F.floor(F.col("t") / 3)}
    )
    out = checks.ramp_changes(df, ["k"], "t", "b", "q", F.lit(0.5)).orderBy("t").collect()
    assert [r["violated"] for r in out] == [False, False, False, True, False, True]
    assert out[0]["change"] is None and abs(out[3]["change"] - 2.1) < 1e-12


def test_stock_rolls_forward_and_is_checked(spark):
    rows = [(0, 4.0, 0.0), (1, 4.0, 0.0), (2, 0.0, 3.0), (3, 0.0, 3.0), (4, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "t int, i double, o double").withColumns(
        {"k": F.lit("a"), "b": F.floor(F.col("t") / 2), "cap": F.lit(7.0)}
    )
    out = checks.soc_rollforward(df, ["k"], "t", "b", "i", "o", 0.81, F.lit(1.0))
    got = [r["stock"] for r in out.orderBy("t").collect()]
    want = [1.0]
    for _, i, o in rows[:-1]:
        want.append(want[-1] + 0.9 * i - o / 0.9)
    assert all(math.isclose(g, w, abs_tol=1e-12) for g, w in zip(got, want))
    row = checks.soc_violations(out, ["k"], "t", "stock", F.col("cap")).first()
    assert row["above_cap"] == 1 and row["below_zero"] == 0
    assert row["low_end"] == (want[-1] < 0.2 * 7.0)


def test_extremes_stay_within_a_year(spark):
    values = [0.5] * 24
    values[1] = 0.9  # February of the first year: no three months before it
    values[17] = 0.9  # June of the second year
    values[3] = 0.1  # April of the first year
    rows = [(2020 + i // 12, i % 12 + 1, v) for i, v in enumerate(values)]
    out = describe.significant_extremes(
        spark.createDataFrame(rows, "year int, month int, v double"), "year", "month", "v"
    )
    peaks = {(r["year"], r["month"]) for r in out.where("peak").collect()}
    troughs = {(r["year"], r["month"]) for r in out.where("trough").collect()}
    assert peaks == {(2021, 6)} and troughs == {(2020, 4)}


def test_bundles_by_the_calendar(spark):
    for n in (100, 168, 200, 336, 720):
        df = spark.range(n).select(F.lit("s").alias("k"), F.timestamp_seconds(F.lit(1_600_000_000 // 3600 * 3600) + F.col("id") * 3600).alias("ts"))
        first = 1_600_000_000 // 3600
        numbered = checks.with_bundle(df, ["k"], "ts").withColumnRenamed("bundle", "numbered")
        both = checks.with_calendar_bundle(numbered, "ts", first, F.lit(first + n - 1))
        assert both.where("bundle <> numbered").count() == 0 and both.count() == n


PLANT = {
    "ph_storage_cap_gwh": 10.0, "ph_roundtrip_eff": 0.81, "batt_roundtrip_eff": 0.9, "batt_duration": 4.0,
}
FLOWS = "k string, t int, charge double, q_pumped_hydro double, battery_charge double, q_battery double, pumped_hydro_pump_cap_gw double, pumped_hydro_turb_cap_gw double, batteries_cap_gw double"


def plain_storage(rows, share):
    """Stocks step by step, as they are defined."""
    out = {}
    for k in sorted({r[0] for r in rows}):
        own = sorted(r for r in rows if r[0] == k)
        for store, eff, charge, discharge, charge_cap, discharge_cap in (("pumped_hydro", 0.81, 2, 3, 6, 7), ("battery", 0.9, 4, 5, 8, 8)):
            size = [10.0 if store == "pumped_hydro" else 4.0 * r[8] for r in own]
            limit = [s if store == "pumped_hydro" else s / math.sqrt(eff) for s in size]
            stock = [share * size[0]]
            for r in own[:-1]:
                stock.append(stock[-1] + math.sqrt(eff) * r[charge] - r[discharge] / math.sqrt(eff))
            out[k, store] = (
                round(stock[0], 9), round(stock[-1], 9),
                sum(r[charge] > r[charge_cap] + 1e-9 for r in own), sum(r[discharge] > r[discharge_cap] + 1e-9 for r in own),
                stock[-1] < 0.2 * size[0] - 1e-9,
                sum(s < -1e-9 for s in stock), sum(s > m + 1e-9 for s, m in list(zip(stock, limit))[1:]),
            )
    return out


@pytest.mark.parametrize("span", [1, 7, 1000])
def test_storage_against_steps(spark, span):
    import random

    rng = random.Random(span)
    rows = []
    for k, pull in (("calm", 0.0), ("drained", 0.4), ("filled", -0.4), ("one", 0.0)):
        for t in range(1 if k == "one" else 60):
            charge, out = max(rng.random() - pull, 0), max(rng.random() + pull - 0.1, 0)
            rows.append((k, t, charge, out, charge / 2, out / 2, 0.9, 0.9, 0.5 + 0.01 * (t % 7)))
    df = spark.createDataFrame(rows, FLOWS).withColumn("b", F.floor(F.col("t") / span))
    found = checks.storage_checks(df, PLANT, ["k"], "t", "b", F.lit(0.4)).collect()
    got = {
        (r["k"], r["store"]): (
            round(r["first_stock"], 9), round(r["last_stock"], 9), r["charge_over"], r["discharge_over"], r["low_end"], r["below_zero"], r["above_limit"],
        )
        for r in found
    }
    want = plain_storage(rows, 0.4)
    assert got == want
    assert any(w[5] for w in want.values()) and any(w[6] for w in want.values()) and any(w[4] for w in want.values())
    assert checks.storage_checks(df.limit(0), PLANT, ["k"], "t", "b", F.lit(0.4)).count() == 0
