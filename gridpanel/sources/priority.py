"""Choosing between sources of the same series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpanel import fixed_values as fv
from gridpanel.operators.joins import join_few
from gridpanel.sources.scratch import landed


def prioritized_source(
    sources: list[DataFrame], min_non_null: int = fv.MIN_SOURCE_ROWS, default: float | None = None,
    expected: list[str] | None = None, calendar: DataFrame | None = None,
) -> DataFrame:
    """Per series, the first source with more than ``min_non_null`` known values.

    The last source has no minimum: it is the fallback. Each source has
    ``series, ts, value``. Remaining nulls take ``default`` if one is given. A series that is
    ``expected`` and that no source has is the ``default`` (null without one) at every ``ts`` of the
    ``calendar``. There is one choice for a series, so rows are not moved to it.
    """
    last = len(sources) - 1
    tagged = None
    for i, df in enumerate(sources):
        part = df.select("series", "ts", "value", F.lit(i).alias("priority"))
        tagged = part if tagged is None else tagged.unionByName(part)
    enough = (
        tagged.groupBy("series", "priority")
        .agg(F.count("value").alias("known"))
        .where((F.col("known") > min_non_null) | ((F.col("priority") == last) & (F.col("known") > 0)))
        .groupBy("series")
        .agg(F.min("priority").alias("priority"))
    )
    if expected:
        enough = landed(enough, "chosen")
    chosen = join_few(tagged, enough, ["series", "priority"]).select("series", "ts", "value")
    if expected:
        if calendar is None:
            raise ValueError("expected series need a calendar")
        names = F.explode(F.array(*[F.lit(n) for n in sorted(set(expected))])).alias("series")
        constant = join_few(calendar.select(names, "ts"), enough.select("series"), ["series"], "left_anti")
        chosen = chosen.unionByName(constant.withColumn("value", F.lit(None).cast(chosen.schema["value"].dataType)))
    return chosen if default is None else chosen.fillna({"value": default})
