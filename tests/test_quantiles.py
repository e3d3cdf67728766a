"""Exact quantiles against numpy, with a group that holds most rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridpanel.operators import describe, quantiles
from gridpanel.operators.quantiles import exact_quantiles

PROBS = {"p0": 0.0, "p5": 0.05, "q1": 0.25, "mid": 0.5, "q3": 0.75, "p95": 0.95, "p100": 1.0}


@pytest.mark.parametrize("whole", [4096, 700])
def test_exact_quantiles(spark, whole, monkeypatch):
    monkeypatch.setattr(quantiles, "WHOLE", whole)
    rng = np.random.default_rng(1)
    parts = {
        "hot": rng.lognormal(0, 3, 20000),
        "steps": rng.choice([0.0, 1.0, 1.0, 5.0], 9000),
        "signs": rng.normal(0, 1, 5000),
        "ties": rng.integers(0, 4, 500).astype(float),
        "one": np.array([7.5]),
        "two": np.array([1.0, 2.0]),
        "flat": np.full(300, -3.25),
        "gap": np.concatenate([np.full(50, 0.0), np.full(50, 1000.0)]),
    }
    pdf = pd.concat([pd.DataFrame({"k": k, "v": v}) for k, v in parts.items()])
    df = spark.createDataFrame(pdf).unionByName(
        spark.createDataFrame([("two", None)], "k string, v double")
    )
    got = exact_quantiles(df.repartition(5), ["k"], "v", PROBS).toPandas().set_index("k")
    assert set(got.index) == set(parts)
    for k, v in parts.items():
        np.testing.assert_allclose(
            got.loc[k, list(PROBS)].astype(float), np.quantile(v, list(PROBS.values())), rtol=1e-12
        )


def test_no_rows(spark):
    df = spark.createDataFrame([], "k string, v double")
    assert exact_quantiles(df, ["k"], "v", {"m": 0.5}).count() == 0


def test_only_nulls(spark):
    df = spark.range(3).select(F.lit("a").alias("k"), F.lit(None).cast("double").alias("v"))
    assert exact_quantiles(df, ["k"], "v", {"m": 0.5}).count() == 0


def test_few_rows_are_put_in_order(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame(pd.DataFrame({"k": "a", "v": rng.normal(size=50_000)})).repartition(4)
    for most in (1, None):
        plan = exact_quantiles(df, ["k"], "v", {"mid": 0.5}, most)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning") <= 3
    values = np.sort(df.toPandas()["v"].to_numpy())
    low, high = np.searchsorted(values, np.quantile(values, [0.5 - 2 * quantiles.MARGIN, 0.5 + 2 * quantiles.MARGIN]))
    assert high - low < 0.01 * len(values)


def test_boxplot_runs_four_exchanges(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"k": rng.choice(["a", "b"], 9000), "v": rng.standard_t(2, 9000)})
    stats = describe.boxplot_stats(spark.createDataFrame(pdf).repartition(3), ["k"], "v", max_groups=2)
    plan = stats._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 4
    for r in stats.collect():
        v = pdf.loc[pdf["k"] == r["k"], "v"]
        q1, q3 = np.quantile(v, [0.25, 0.75])
        inside = v[(v >= q1 - 1.5 * (q3 - q1)) & (v <= q3 + 1.5 * (q3 - q1))]
        np.testing.assert_allclose([r["q1"], r["median"], r["q3"], r["whisker_low"], r["whisker_high"]], [q1, v.median(), q3, inside.min(), inside.max()])
        assert r["n"] == len(v)
