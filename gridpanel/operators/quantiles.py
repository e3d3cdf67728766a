"""Exact quantiles of groups of any size.

The built-in exact percentile holds every distinct value of a group in one
task's memory. Here a sketch of bounded size, merged over tasks, first gives each wanted
rank a bracket of two values, a share ``MARGIN`` of the rows to either side. Rows outside the
brackets are only counted, in the task that reads them; values inside are counted each
and put in order. What is put in order so follows the rows: about ``2 * MARGIN`` of them for a quantile.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridpanel.functions.sizes import broadcast_within
from gridpanel.operators.joins import join_few

ACCURACY = 5000  # the sketch is right within a 5000th of the rows
MARGIN = 10 / ACCURACY
WHOLE = 4096  # groups up to this are put in order whole


def exact_quantiles(
    df: DataFrame, keys: list[str], value: str, probabilities: dict[str, float], max_groups: int | None = None,
) -> DataFrame:
    """One row per group with linearly interpolated quantiles, named by the dict; nulls are left out.

    ``max_groups`` is the number of groups if fixed lists bound it; without it the brackets are
    stored and measured. Reads the rows twice. A
    rank that its bracket does not hold, which the sketch rules out, is an error, not a wrong value.
    """
    known = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    points = [min(max(p + side * MARGIN, 0.0), 1.0) for p in probabilities.values() for side in (-1, 1)]
    sketch = known.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_least"), F.max("_v").alias("_most"),
        F.percentile_approx("_v", points, ACCURACY).alias("_at"),
    )
    whole = F.col("_n") <= WHOLE
    ends = {}
    for i, p in enumerate(probabilities.values()):
        low, high = (F.element_at("_at", 2 * i + 1), F.element_at("_at", 2 * i + 2))
        # where the margin reaches beyond the first or last row, all rows on that side are inside
        ends[f"_lo{i}"] = F.when(whole | F.lit(p <= MARGIN), F.col("_least")).otherwise(low)
        ends[f"_hi{i}"] = F.when(whole | F.lit(p >= 1 - MARGIN), F.col("_most")).otherwise(high)
    brackets = sketch.select(*keys, F.col("_n"), *[e.alias(n) for n, e in ends.items()])
    numbers = range(len(probabilities))
    inside = [F.col("_v").between(F.col(f"_lo{i}"), F.col(f"_hi{i}")) for i in numbers]
    anywhere = inside[0]
    for one in inside[1:]:
        anywhere = anywhere | one
    carried = ["_n", *ends]
    # rows outside all brackets are one row of a group here, before they are shuffled
    joined = join_few(known, brackets, keys) if max_groups is None else known.join(broadcast_within(brackets, max_groups), keys)
    counted = (
        joined
        .groupBy(*keys, *carried, F.when(anywhere, F.col("_v")).alias("_in"))
        .agg(
            *[F.count_if(F.col("_v") < F.col(f"_lo{i}")).alias(f"_below{i}") for i in numbers],
            F.count(F.lit(1)).alias("_copies"),
        )
    )
    group = Window.partitionBy(*keys)
    so_far = group.orderBy("_in").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = {}
    for i in numbers:
        here = F.when(F.col("_in").between(F.col(f"_lo{i}"), F.col(f"_hi{i}")), F.col("_copies")).otherwise(0)
        placed[f"_end{i}"] = F.sum(f"_below{i}").over(group) + F.sum(here).over(so_far)
        placed[f"_start{i}"] = F.sum(f"_below{i}").over(group) + F.sum(here).over(so_far) - here
    ranked = counted.withColumns(placed)
    out = []
    for i, (name, p) in enumerate(probabilities.items()):
        at = F.lit(p) * (F.max("_n") - 1)
        position = F.lit(p) * (F.col("_n") - 1)

        def at_rank(rank, i=i):
            return F.max(F.when((F.col(f"_start{i}") <= rank) & (rank < F.col(f"_end{i}")) & F.col("_in").isNotNull(), F.col("_in")))

        low, high = at_rank(F.floor(position)), at_rank(F.ceil(position))
        lost = F.raise_error(F.lit(f"the bracket of {name} does not hold its rank")).cast("double")
        quantile = low + (high - low) * (at - F.floor(at))
        out.append(F.when(quantile.isNotNull(), quantile).otherwise(lost).alias(name))
    return ranked.groupBy(*keys).agg(*out)
