"""Keyed draws, sampling rules and kernel densities."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridpanel import fixed_values as fv
from gridpanel import schemas
from gridpanel.functions import keyed_random as rnd
from gridpanel.operators import draws


def test_uniform_is_the_hash_of_its_key_under_any_partitioning(spark):
    df = spark.range(200).select(F.lit("s").alias("scenario"), F.col("id").alias("iteration"))
    seen = []
    for n in (1, 64):
        rows = df.repartition(n).select("iteration", rnd.uniform(11, "scenario", "iteration").alias("u")).collect()
        seen.append({r["iteration"]: r["u"] for r in rows})
    assert seen[0] == seen[1]
    for i, u in seen[0].items():
        digest = hashlib.md5(f"11|s|{i}".encode()).hexdigest()
        assert u == (int(digest[:8], 16) + 0.5) / 2**32
        assert 0 < u < 1


def test_moments_of_draws(spark):
    row = spark.range(20000).select(
        rnd.uniform(1, "id").alias("u"), rnd.normal(2, "id").alias("z")
    ).agg(F.avg("u"), F.stddev("u"), F.avg("z"), F.stddev("z")).first()
    np.testing.assert_allclose(row, [0.5, 12**-0.5, 0, 1], atol=0.02)


def test_window_draws_cover_their_range(spark):
    runs = spark.range(3000).select(F.lit("a").alias("scenario"), F.col("id").alias("iteration"))
    got = draws.draw_windows(runs, 3).toPandas()
    assert set(got["base_year"]) == set(fv.BASE_YEARS)
    assert set(got["day_start"]) == set(range(1, 22))


def test_iterations_are_complete(spark):
    scenarios = spark.createDataFrame(fv.SCENARIO_ROWS, schemas.SCENARIOS)
    got = draws.iterations(scenarios, 25, block=10).toPandas()
    assert len(got) == 125 and not got.duplicated(["scenario", "iteration"]).any()
    assert (got["iter_block"] == (got["iteration"] - 1) // 10).all()
    assert got["iteration"].min() == 1 and got["iteration"].max() == 25


def points(spark, groups):
    rows = [(2020, name, float(x), float(w)) for name, pts in groups.items() for x, w in pts]
    return spark.createDataFrame(rows, "base_year int, variable string, delta double, weight double")


GROUPS = {
    "jitter": [(0.0, 1.0)],
    "constant": [(-1.0, 1.0)] * 3,
    "single": [(0.3, 1.0)],
    "normal": [(-0.067, 1.0), (-0.048, 1.0), (-0.067, 1.0)],
    "kde": [(0.201, 1.0), (0.921, 0.5), (1.071, 0.2)],
}


def test_sampling_rules(spark):
    rules = {r["variable"]: r["rule"] for r in draws.delta_stats(points(spark, GROUPS)).collect()}
    assert rules == {
        "jitter": "jitter", "constant": "constant", "single": "constant", "normal": "normal", "kde": "kde"
    }


def test_delta_of_estimate(spark):
    df = spark.createDataFrame([(274.0, 251.2), (None, 251.2), (0.0, 8.139)], "e double, h double")
    got = [r[0] for r in df.select(draws.estimate_to_delta("e", "h")).collect()]
    assert got == [0.091, 0.0, -1.0]


def test_density_equals_the_direct_sum(spark):
    pts = points(spark, {"kde": GROUPS["kde"]})
    grid = draws.kde_grid(pts, draws.delta_stats(pts)).orderBy("i").toPandas()
    x, w = np.array(GROUPS["kde"]).T
    bw = 0.75 * x.std(ddof=1) * 3**-0.2
    at = np.linspace(x.min() - 4 * bw, x.max() + 4 * bw, 2048)
    direct = (w * np.exp(-0.5 * ((at[:, None] - x) / bw) ** 2)).sum(axis=1)
    direct /= direct.sum()
    assert len(grid) == 2048
    np.testing.assert_allclose(grid["x"], at, atol=1e-12)
    np.testing.assert_allclose(grid["pdf"], direct, atol=direct.max() * 1e-5)
    np.testing.assert_allclose(grid["cdf"], direct.cumsum(), atol=1e-5)
    assert abs(grid["cdf"].iloc[-1] - 1) < 1e-9


def test_grid_index_is_the_first_level_at_or_above(spark):
    levels = sorted([0.1, 0.1, 0.2, 0.35, 0.35, 0.6, 0.9, 0.99])
    us = [0.0, 0.05, 0.1, 0.15, 0.35, 0.36, 0.95, 0.99, 1.0]
    df = spark.createDataFrame([(u, levels) for u in us], "u double, c array<double>")
    got = [r[0] for r in df.select(draws.grid_index("c", "u", 8)).collect()]
    want = np.minimum(np.searchsorted(levels, us, side="left"), 7)
    assert got == want.tolist()


def test_draws_stay_within_their_clamp(spark):
    table = draws.distributions(points(spark, GROUPS))
    runs = spark.range(400).select(
        F.lit("a").alias("scenario"), F.col("id").alias("iteration"), F.lit(2020).alias("base_year")
    )
    got = draws.draw_deltas(runs, table, 5).toPandas().groupby("variable")["delta"]
    assert (got.get_group("constant") == -1.0).all() and (got.get_group("single") == 0.3).all()
    kde = got.get_group("kde")
    assert kde.min() >= 0.201 * 0.9 - 1e-12 and kde.max() <= 1.071 * 1.1 + 1e-12
    assert kde.nunique() > 200
    assert abs(got.get_group("normal").mean() + 0.0607) < 0.005
    assert 0.03 < got.get_group("jitter").std() < 0.07
    again = draws.draw_deltas(runs.repartition(7), table, 5).toPandas()
    pd.testing.assert_series_equal(
        again.sort_values(["variable", "iteration"])["delta"].reset_index(drop=True),
        draws.draw_deltas(runs, table, 5).toPandas().sort_values(["variable", "iteration"])["delta"].reset_index(drop=True),
    )


def test_scenario_rules_and_fan_out(spark):
    scenarios = spark.createDataFrame(fv.SCENARIO_ROWS, schemas.SCENARIOS)
    names = F.array(*[F.lit(v) for v in fv.DRAWN_VARIABLES])
    base = scenarios.withColumn("iteration", F.lit(1)).withColumn("variable", F.explode(names)).withColumn(
        "delta", F.lit(0.5)
    )
    out = draws.fan_out(draws.adjust(base))
    got = {(r["scenario"], r["variable"]): r["delta"] for r in out.collect()}
    assert len({v for _, v in got}) == 26
    assert got["baseline", "coal_cap_gw"] == -1.0
    assert got["baseline", "nuclear_cap_gw"] == 0.5 and got["nuclear", "nuclear_cap_gw"] == 0.0
    assert got["optimistic", "batteries_cap_gw"] == 0.75 and got["no batteries", "batteries_cap_gw"] == 0.0
    assert got["optimistic", "solar_pv_cap_gw"] == 0.625 and got["nuclear", "wind_cap_gw"] == 0.375
    assert got["baseline", "pumped_hydro_pump_cap_gw"] == 0.35
    assert got["baseline", "industrial_demand_gwh"] == 0.5
    narrow = draws.adjust(base, draws.scenario_rules(["renewable_waste_cap_gw"]))
    only = {r["variable"] for r in narrow.where("scenario = 'optimistic' AND delta = 0.625").collect()}
    assert only == {"renewable_waste_cap_gw"}


@pytest.mark.parametrize("strategy", ["measured", "broadcast", "salted"])
def test_expand_picks_whole_windows(spark, strategy):
    from gridpanel.operators import project

    panel = spark.sql(
        """SELECT year(ts) year, month(ts) month, day(ts) day, ts FROM (SELECT explode(sequence(
        TIMESTAMP'2020-01-01', TIMESTAMP'2021-12-31 18:00:00', INTERVAL 6 HOURS)) ts)"""
    )
    drawn = spark.createDataFrame(
        [("a", 1, 2020, 21), ("a", 2, 2021, 1), ("b", 1, 2020, 5)],
        "scenario string, iteration int, base_year int, day_start int",
    )
    got = project.expand(panel, drawn, strategy, salts=4).toPandas()
    assert len(got) == 3 * 7 * 12 * 4 and not got.duplicated(["scenario", "iteration", "ts"]).any()
    assert (got["year"] == got["base_year"]).all()
    assert ((got["day"] >= got["day_start"]) & (got["day"] < got["day_start"] + 7)).all()
    whole = project.expand(panel, drawn, strategy, window_days=None, salts=4)
    assert whole.count() == (366 * 2 + 365) * 4


def test_expand_refuses_to_broadcast_a_large_panel(spark):
    from gridpanel.operators import project

    panel = spark.range(1000).selectExpr("2020 AS year", "CAST(1 + id % 28 AS INT) AS day", "id AS step", "repeat('x', 40) AS note")
    drawn = spark.createDataFrame([("a", 1, 2020, 3)], "scenario string, iteration int, base_year int, day_start int")
    with pytest.raises(ValueError, match="more than 50000 bytes"):
        project.expand(panel, drawn, "broadcast", max_bytes=50_000)
    counts = [project.expand(panel, drawn, how, max_bytes=n).count() for how, n in (("measured", 50_000), ("salted", 1), ("broadcast", 1 << 20))]
    assert counts == [252] * 3 and len(set(counts)) == 1
    plan = project.expand(panel, drawn, max_bytes=50_000)._jdf.queryExecution().toString()
    assert "ResolvedHint (strategy=broadcast)" not in plan


def test_promised_sizes_are_tested(spark):
    from gridpanel.functions import sizes

    small = spark.range(100).repartition(7)
    big = spark.range(1000)
    assert big.join(sizes.broadcast_within(small, 100), "id").count() == 100
    with pytest.raises(Exception, match="promised to have up to 99"):
        big.join(sizes.broadcast_within(small, 99), "id").count()
    assert sizes.measured_bytes(spark.createDataFrame([("ab", 1), (None, 2)], "a string, b int")) == 2 * 32 + 2
    with pytest.raises(ValueError, match="size"):
        sizes.measured_bytes(spark.createDataFrame([([1],)], "a array<int>"))
