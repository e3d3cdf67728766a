"""Merit-order clearing: hand example, welfare optimum, ties, extremes, accounts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from driver_queries.bases import panel
from driver_queries.example_market import PARAMS
from driver_queries.market_queries import CONSTANTS, LOSS, VOLL
from gridpanel import fixed_values as fv
from gridpanel.operators import market
from tests.oracle import sf_path

BLOCKS = "k long, technology string, lo double, hi double, mc double"
DEMAND = "k long, a double, b double, net_export double"


def clear(spark, blocks, demand, loss=0.0, voll=1e6):
    out = market.clear_market(
        spark.createDataFrame(blocks, BLOCKS), spark.createDataFrame(demand, DEMAND), ["k"], loss, voll
    )
    return {(r["k"], r["technology"]): r for r in out.collect()}


def test_hand_example(spark):
    # must-run 2 (one block), then 0-cost wind 3, gas 4 at 50e3, oil 5 at 100e3
    blocks = [
        (1, "waste", 2.0, 2.0, 5000.0), (1, "wind", 0.0, 3.0, 0.0),
        (1, "gas", 0.0, 4.0, 50000.0), (1, "oil", 0.0, 5.0, 100000.0),
    ]
    got = clear(spark, blocks, [(1, 7.0, 0.0, 0.0)])
    assert [got[1, t]["q"] for t in ("waste", "wind", "gas", "oil")] == [2.0, 3.0, 2.0, 0.0]
    assert got[1, "gas"]["price"] == 50.0 and got[1, "gas"]["status"] == "cleared"
    # exports raise the need to 10: oil sets the price
    got = clear(spark, blocks, [(1, 7.0, 0.0, 3.0)])
    assert got[1, "oil"]["q"] == 1.0 and got[1, "oil"]["price"] == 100.0


def test_price_between_blocks(spark):
    # 5 units cost nothing, the next costs 100e3; demand is 10 - p / 10e3
    blocks = [(1, "a", 0.0, 5.0, 0.0), (1, "b", 0.0, 5.0, 100000.0)]
    got = clear(spark, blocks, [(1, 10.0, 1e-4, 0.0)])
    assert got[1, "a"]["q"] == 5.0 and got[1, "b"]["q"] == 0.0
    assert abs(got[1, "a"]["price"] - 50.0) < 1e-9


def test_cost_ties_go_by_name(spark):
    blocks = [(1, "b", 0.0, 5.0, 10.0), (1, "a", 0.0, 5.0, 10.0)]
    got = clear(spark, blocks, [(1, 7.0, 0.0, 0.0)])
    assert got[1, "a"]["q"] == 5.0 and got[1, "b"]["q"] == 2.0


def test_oversupply_and_shortage(spark):
    blocks = [(1, "a", 8.0, 9.0, 10.0), (2, "a", 1.0, 3.0, 10.0)]
    got = clear(spark, blocks, [(1, 5.0, 0.0, 0.0), (2, 5.0, 0.0, 0.0)], voll=2e7)
    assert got[1, "a"]["status"] == "oversupply" and got[1, "a"]["spill"] == 3.0 and got[1, "a"]["price"] == 0.0
    assert got[2, "a"]["status"] == "shortage" and got[2, "a"]["shed"] == 2.0 and got[2, "a"]["price"] == 2e4


def random_case(rng):
    n = rng.integers(2, 7)
    lo = np.where(rng.random(n) < 0.4, rng.uniform(0, 1, n), 0.0)
    hi = lo + rng.uniform(0.1, 3, n)
    mc = np.where(rng.random(n) < 0.3, 0.0, rng.uniform(1e3, 1.5e5, n))
    a, b = rng.uniform(3, 12), rng.uniform(5e-6, 5e-5)
    return lo, hi, mc, a, b, rng.uniform(-1, 1)


def test_price_is_the_welfare_optimum(spark):
    """Surplus of served demand less cost, on a grid of demands, has its maximum
    where the clearing puts it."""
    rng = np.random.default_rng(8)
    cases = [random_case(rng) for _ in range(60)]
    loss, voll = 0.015, 1e7
    blocks, demand = [], []
    for k, (lo, hi, mc, a, b, x) in enumerate(cases):
        blocks += [(k, f"t{i}", float(lo[i]), float(hi[i]), float(mc[i])) for i in range(len(lo))]
        demand.append((k, float(a), float(b), float(x)))
    got = clear(spark, blocks, demand, loss, voll)
    checked = 0
    for k, (lo, hi, mc, a, b, x) in enumerate(cases):
        row = got[k, "t0"]
        if row["status"] != "cleared":
            continue
        grid = np.linspace(0, a, 200001)
        need = (1 + loss) * grid + x
        extra = need - lo.sum()
        order = np.argsort(mc, kind="stable")
        cost = np.zeros_like(grid)
        left = extra.copy()
        for i in order:
            use = np.clip(left, 0, hi[i] - lo[i])
            cost += use * mc[i]
            left = left - use
        welfare = (a * grid - grid**2 / 2) / b - cost
        welfare[(left > 1e-9) | (extra < 0)] = -np.inf
        best = grid[np.argmax(welfare)]
        served = a - b * row["price"] * 1000
        assert abs(served - best) < 3 * a / 200000, (k, served, best)
        q = sum(got[k, f"t{i}"]["q"] for i in range(len(lo)))
        assert abs(q - (1 + loss) * served - x) < 1e-9
        checked += 1
    assert checked > 30


def test_inverse_demand_with_sectors_that_leave(spark):
    rows = [(10.0, 1e-3, 5.0, 1e-2, 1.0, 1e-1)]
    cols = "a_residential double, b_residential double, a_commercial double, b_commercial double, a_industrial double, b_industrial double"
    df = spark.createDataFrame(rows, cols)
    for p in (1.0, 9.0, 50.0, 400.0, 900.0, 5000.0):
        back = df.withColumn("d", market.demand_at(f"{p}D")).select(market.price_at(F.col("d"))).first()[0]
        assert abs(back - p) < 1e-6 * p


@pytest.fixture(scope="module")
def hours(spark):
    base = panel(spark, sf_path("0.001")).withColumns({"elas_anomaly": F.lit(1.0), "hydro_anomaly": F.lit(0.9)})
    return market.calibrate_demand(base, PARAMS)


def test_rows_and_windows_agree(spark, hours):
    wide = market.clear_hours(hours, CONSTANTS)
    supply = market.supply_blocks(hours, CONSTANTS, ["ts"])
    curves = [c for pair in market.SECTOR_CURVES for c in pair]
    demand = hours.select("ts", *curves, (market.net_exports() + market.pumping()).alias("net_export"))
    long = market.clear_market(supply, demand, ["ts"], LOSS, VOLL, market.SECTOR_CURVES)
    a = wide.select("ts", "price", "shed", "spill", *[F.col(f"q_{t}").alias(t) for t in fv.TECHNOLOGIES]).toPandas().set_index("ts").sort_index()
    b = long.select("ts", "technology", "q").toPandas().pivot(index="ts", columns="technology", values="q").sort_index()
    p = long.select("ts", "price", "shed", "spill").distinct().toPandas().groupby("ts").first().sort_index()
    np.testing.assert_allclose(a[fv.TECHNOLOGIES], b[fv.TECHNOLOGIES], atol=1e-8)
    np.testing.assert_allclose(a[["price", "shed", "spill"]], p[["price", "shed", "spill"]], atol=1e-7)
    assert wide.select("status").distinct().count() >= 2


def test_energy_is_conserved(hours):
    out = market.balance_residual(market.clear_hours(hours, CONSTANTS), LOSS)
    assert out.where("abs(residual) > 1e-7").count() == 0
    accounted = market.dispatch(hours, CONSTANTS)
    bad = accounted.where(F.abs(F.col("renewable_gen") + F.col("non_renewable_gen") - F.col("total_generation")) > 1e-9)
    assert bad.count() == 0


def test_price_does_not_fall_when_demand_grows(hours):
    def prices(factor):
        grown = hours.withColumns({f"{s}_demand_gwh": F.col(f"{s}_demand_gwh") * factor for s in fv.SECTORS})
        out = market.clear_hours(market.calibrate_demand(grown, PARAMS), CONSTANTS)
        return out.select("ts", "price").toPandas().set_index("ts")["price"].sort_index()

    assert (prices(1.2) >= prices(1.0) - 1e-9).all()


def test_constants_must_cover_all_technologies(spark):
    short = spark.createDataFrame([("coal", 0.4, 1, 1.0, 1.0, 1.0)], "technology string, efficiency double, fossil_fuel int, direct_e_tco2_gwh double, var_om_eur_gwh double, fixed_om_Meur_gwy double")
    with pytest.raises(ValueError, match="missing"):
        market.Constants.load(short, spark.createDataFrame([(1.0,)], "grid_loss_factor double"))


def test_batches_of_hours_against_one_at_a_time():
    """The vectorised clearing against a plain fold over the blocks of each hour."""
    from gridpanel.operators import merit_order

    rng = np.random.default_rng(3)
    n, k, loss, voll = 400, 6, 0.015, 1e7
    lo = np.where(rng.random((n, k)) < 0.4, rng.uniform(0, 1, (n, k)), 0.0)
    hi = lo + np.where(rng.random((n, k)) < 0.2, 0.0, rng.uniform(0.1, 3, (n, k)))
    mc = rng.choice([0.0, 1e4, 2.5e4, 9e4], (n, k))  # many ties
    a = [rng.uniform(0, 6, n) for _ in range(2)]
    b = [np.where(rng.random(n) < 0.3, 0.0, rng.uniform(5e-6, 5e-5, n)) for _ in range(2)]
    x = rng.uniform(-3, 3, n)
    done = merit_order.clear(lo, hi, mc, a, b, x, loss, voll)
    seen = set()
    for h in range(n):
        def need(level):
            return (1 + loss) * sum(max(a[s][h] - b[s][h] * (1 + loss) * level, 0.0) for s in range(2)) + x[h]

        supply, q, price = lo[h].sum(), lo[h].copy(), None
        if supply >= need(0.0):
            assert done.level[h] == 0 and done.spill[h] == pytest.approx(supply - need(0.0))
            np.testing.assert_array_equal(done.q[h], q)
            seen.add("over")
            continue
        for t in sorted(range(k), key=lambda t: (mc[h, t], t)):
            if supply + hi[h, t] - lo[h, t] >= need(mc[h, t]) - 1e-12:
                extra = max(need(mc[h, t]) - supply, 0.0)
                q[t], price = lo[h, t] + extra, mc[h, t] if supply <= need(mc[h, t]) else "between"
                break
            q[t] = hi[h, t]
            supply += hi[h, t] - lo[h, t]
        np.testing.assert_allclose(done.q[h], q, atol=1e-9)
        if price is None and need(voll) > supply:
            assert done.level[h] == voll and done.shed[h] == pytest.approx(need(voll) - supply)
            seen.add("short")
        elif price is None or price == "between":
            assert need(done.level[h]) == pytest.approx(supply, abs=1e-6)
            seen.add("between")
        else:
            assert done.level[h] == price and done.shed[h] == done.spill[h] == 0
            seen.add("block")
    assert seen == {"over", "short", "between", "block"}


def test_hours_that_lack_an_input(spark, hours):
    gaps = hours.withColumn("wind_cap_gw", F.when(F.col("hour") != 6, F.col("wind_cap_gw")))
    out = market.clear_hours(gaps, CONSTANTS).select("hour", "status", "price", "q_coal", "shed")
    assert out.where("(hour = 6) <> (status = 'undefined')").count() == 0
    assert out.where("status = 'undefined' AND coalesce(price, q_coal, shed) IS NOT NULL").count() == 0
    assert market.clear_hours(hours.limit(0), CONSTANTS).count() == 0


def test_snap(spark):
    df = market.snapped(spark.createDataFrame([(5e-4,), (-5e-4,), (2e-3,)], "x double"), ["x"])
    assert [r[0] for r in df.collect()] == [0.0, 0.0, 2e-3]


def test_accounts_of_an_hour_are_few_copies_of_a_row(spark):
    """Each level of names is one more copy of some hundred columns for every hour."""
    from driver_queries.market_queries import dispatched
    from tests.oracle import sf_path

    hours = dispatched(spark, sf_path("0.001"))
    wide = hours.select(*[c for c in hours.columns if c not in ("ts",)], "ts")
    plan = wide._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("ArrowEvalPython")]
    assert above.count("Project") <= 5 and "Generate" not in above
    filtered = wide.where("price > 50 AND status = 'cleared'")._jdf.queryExecution().optimizedPlan().toString()
    assert filtered.count("cleared(") == 1
