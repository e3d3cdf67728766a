"""Joins to a side of few rows, and as-of joins."""

import random

import pytest
from pyspark.sql import functions as F

from gridpanel.operators import asof, joins
from gridpanel.sources import priority


def rows_of(spark):
    rng = random.Random(1)
    rows = [("hot" if i % 3 else rng.choice("abc"), i) for i in range(600)] + [(None, -1)]
    return spark.createDataFrame(rows, "k string, v int"), spark.createDataFrame([("hot", 1.5), ("a", 2.5), ("z", 0.0), (None, 9.0)], "k string, x double")


@pytest.mark.parametrize("how", joins.KINDS)
def test_both_ways_give_the_same_rows(spark, how):
    rows, few = rows_of(spark)
    want = sorted(map(str, rows.join(few, ["k"], how).collect()))
    for most in (1 << 20, 0):
        assert sorted(map(str, joins.join_few(rows, few, ["k"], how, max_bytes=most).collect())) == want
    with pytest.raises(ValueError):
        joins.join_few(rows, few, ["k"], "full")


def test_rows_are_not_moved_to_a_hot_key(spark):
    rows, few = rows_of(spark)
    plan = joins.join_few(rows, few, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "BroadcastHashJoin" in plan
    dealt = joins.join_few(rows, few, ["k"], max_bytes=0, salts=8)
    plan = dealt._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" in plan and "strategy=broadcast" not in plan


def test_expected_series_without_a_source(spark):
    t = F.timestamp_seconds(F.col("id") * 3600)
    source = spark.range(5).select(F.lit("a").alias("series"), t.alias("ts"), F.lit(2.0).alias("value"))
    calendar = spark.range(4).select(t.alias("ts"))
    for default, want in ((0.0, 0.0), (None, None)):
        got = priority.prioritized_source([source], 100, default, ["a", "b", "b"], calendar).collect()
        assert sorted(r["series"] for r in got) == ["a"] * 5 + ["b"] * 4
        assert {r["value"] for r in got if r["series"] == "b"} == {want}
    with pytest.raises(ValueError, match="calendar"):
        priority.prioritized_source([source], 100, 0.0, ["b"])


@pytest.mark.parametrize("direction", ["forward", "backward"])
@pytest.mark.parametrize("clamp", [False, True])
@pytest.mark.parametrize("salts", [1, 3])
def test_asof_against_a_search(spark, direction, clamp, salts):
    rng = random.Random(4)
    left = [(k, i, rng.choice([rng.uniform(-3, 12), float(rng.randint(-3, 12))])) for i in range(300) for k in (rng.choice("aab"),)]
    left += [("lonely", 900, 1.0), (None, 901, 1.0), ("a", 902, None)]
    right = [(k, float(rng.randint(0, 9)) + rng.choice([0, 0.5]), j) for j in range(40) for k in ("a" if j % 3 else "b",)]
    right += [(None, 1.0, 99), ("a", None, 98)]
    found = asof.asof_join(
        spark.createDataFrame(left, "k string, id int, t double"), spark.createDataFrame(right, "k string, s double, j int"),
        ["k"], "t", "s", 2.0, direction, clamp, salts,
    )
    got = {r["id"]: r["found"] and (r["found"]["s"], r["found"]["j"]) for r in found.collect()}
    assert found.columns == ["k", "id", "t", "found"] and len(got) == len(left)
    for k, i, t in left:
        own = sorted((s, j) for key, s, j in right if key is not None and key == k and s is not None)
        at = [x for x in own if t is not None and (x[0] >= t if direction == "forward" else x[0] <= t)]
        pick = None
        if t is not None and own:
            if at:
                place = at[0][0] if direction == "forward" else at[-1][0]
            else:
                place = (own[-1][0] if direction == "forward" else own[0][0]) if clamp else None
            pick = place is not None and min(x for x in own if x[0] == place) or None
        assert got[i] == pick, (k, i, t)


def test_asof_on_empty_tables(spark):
    left, right = spark.createDataFrame([("a", 1.0)], "k string, t double"), spark.createDataFrame([], "k string, s double")
    assert [r["found"] for r in asof.asof_join(left, right, ["k"], "t", "s", 1.0).collect()] == [None]
    assert asof.asof_join(left.limit(0), right, ["k"], "t", "s", 1.0).count() == 0
