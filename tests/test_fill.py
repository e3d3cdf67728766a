"""Gap filling against pandas, on gaps of 1, 2, 24 and 80 hours at all places."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridpanel.operators import blocks, fill

HOURS = pd.date_range("2024-01-01", periods=400, freq="h")


def gappy():
    rng = np.random.default_rng(3)
    frames = []
    gaps = {
        "start": [(0, 1)], "start_long": [(0, 80)], "end": [(398, 400)], "end_long": [(320, 400)],
        "middle": [(10, 11), (50, 52), (100, 124), (200, 280)], "price": [(5, 8), (100, 180)],
        "sparse": [(1, 150), (151, 399)], "empty": [(0, 400)],
    }
    for name, holes in gaps.items():
        v = rng.uniform(1, 100, len(HOURS)).round(3)
        for a, b in holes:
            v[a:b] = np.nan
        frames.append(pd.DataFrame({"series": name, "ts": HOURS, "value": v}))
    return pd.concat(frames, ignore_index=True)


def expected(df, price):
    out = []
    for name, g in df.groupby("series"):
        v = g.sort_values("ts")["value"].reset_index(drop=True)
        v = v.ffill(limit=1)
        if name not in price:
            for _ in range(3):
                v = v.fillna(v.shift(24))
        v = v.interpolate(method="linear").bfill()
        out.append(pd.DataFrame({"series": name, "ts": HOURS, "want": v.values}))
    return pd.concat(out, ignore_index=True)


def frame(spark, pdf):
    df = spark.createDataFrame(pdf)
    return df.withColumn("value", F.when(~F.isnan("value"), F.col("value")))


@pytest.mark.parametrize("block_hours", [24 * 28, 100, 48])
def test_impute_equals_pandas(spark, block_hours):
    pdf = gappy()
    got = fill.impute(frame(spark, pdf), ["price"], block_hours).toPandas()
    both = got.merge(expected(pdf, ["price"]), on=["series", "ts"], validate="one_to_one")
    assert len(both) == len(pdf)
    empty = both["series"] == "empty"
    assert both[empty]["value"].isna().all()
    np.testing.assert_allclose(both[~empty]["value"], both[~empty]["want"], rtol=1e-12)


def test_known_cells_are_kept_and_counted(spark):
    pdf = gappy()
    raw = frame(spark, pdf)
    done = fill.impute(raw, ["price"])
    j = raw.withColumnRenamed("value", "raw").join(done, ["series", "ts"])
    assert j.where("raw IS NOT NULL AND raw <> value").count() == 0
    audit = {r["series"]: r for r in fill.null_audit(raw, ["series"], ["value"]).collect()}
    assert audit["start_long"]["value_nulls"] == 80 and audit["end"]["value_nulls"] == 2
    left = {r["series"]: r["value_nulls"] for r in fill.null_audit(done, ["series"], ["value"]).collect()}
    assert left.pop("empty") == 400 and set(left.values()) == {0}


def test_ffill_bfill_equals_pandas(spark):
    pdf = gappy()
    df = frame(spark, pdf).withColumn("block", blocks.hour_block("ts", 30))
    got = fill.ffill_bfill(df, ["series"], "ts", "block", "value").toPandas()
    want = pdf.sort_values(["series", "ts"]).copy()
    want["want"] = want.groupby("series")["value"].transform(lambda v: v.ffill().bfill())
    both = got.merge(want[["series", "ts", "want"]], on=["series", "ts"])
    filled = both[both["series"] != "empty"]
    np.testing.assert_allclose(filled["value"], filled["want"])


def test_blockwise_running_sum_and_previous(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame(
        {"k": rng.integers(0, 3, 500), "o": rng.permutation(500), "v": rng.uniform(-1, 1, 500)}
    )
    df = spark.createDataFrame(pdf).withColumn("b", F.floor(F.col("o") / 37))
    run = blocks.with_running_sum(df, ["k"], ["o"], "b", F.col("v"), "s", inclusive=False)
    run = blocks.with_previous(run, ["k"], ["o"], "b", ["v"], "p")
    run = blocks.with_row_number(run, ["k"], ["o"], "b", "n")
    got = run.select("k", "o", "s", F.col("p.v").alias("p"), "n").toPandas().sort_values(["k", "o"])
    want = pdf.sort_values(["k", "o"])
    sums = want.groupby("k")["v"].transform(lambda v: v.cumsum().shift(1).fillna(0))
    np.testing.assert_allclose(got["s"], sums, atol=1e-12)
    np.testing.assert_allclose(
        got["p"].fillna(-9), want.groupby("k")["v"].shift(1).fillna(-9), atol=1e-12
    )
    assert (got["n"].values == (want.groupby("k").cumcount() + 1).values).all()
