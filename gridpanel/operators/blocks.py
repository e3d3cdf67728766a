"""Ordered computations over long groups, one block of the order at a time.

A window over a whole series runs in one task, however long the series is. Here
each series is cut along its order into blocks; a window never spans more than
one block, and what one block must know about the others travels in a summary
row per block. The result is the same as that of the plain window.

``block`` is the name of a column that never decreases along the order, for
example the time divided by a fixed span.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridpanel.functions.calendars import hour_number

BLOCK_HOURS = 28 * 24


def hour_block(ts: Column | str, hours: int = BLOCK_HOURS) -> Column:
    return F.floor(hour_number(ts) / hours).cast("bigint")


def spread(df: DataFrame, keys: list[str], block: str) -> DataFrame:
    """Place rows by key and block.

    Asked for explicitly: a window would also accept an input placed by key
    alone, which leaves a long series in one task.
    """
    return df.repartition(*keys, block)


def with_halo(df: DataFrame, keys: list[str], position: str, size: int, reach: int) -> DataFrame:
    """Assign rows to blocks of ``size`` positions, each block preceded by a copy
    of the ``reach`` positions before it, and place them by key and block.

    Adds ``block`` and ``in_halo``; drop the halo rows after looking back.
    """
    own = F.floor(F.col(position) / size).cast("bigint")
    last = F.floor((F.col(position) + reach) / size).cast("bigint")
    cut = df.withColumn("block", F.explode(F.sequence(own, last))).withColumn(
        "in_halo", F.col("block") != own
    )
    return spread(cut, keys, "block")


def _carried(df: DataFrame, keys: list[str], block: str, summary: dict, carry: dict) -> DataFrame:
    """One row per key and block with values brought in from the other blocks."""
    ends = df.groupBy(*keys, block).agg(*[e.alias(n) for n, e in summary.items()])
    return ends.select(*keys, block, *[e.alias(n) for n, e in carry.items()])


def with_neighbours(
    df: DataFrame, keys: list[str], order: str, block: str, value: str,
    before: str = "before", after: str = "after",
) -> DataFrame:
    """Add the nearest non-null ``value`` at or before and at or after each row.

    ``before`` and ``after`` are structs of ``at`` (the order) and ``value``.
    """
    known = F.when(
        F.col(value).isNotNull(), F.struct(F.col(order).alias("at"), F.col(value).alias("value"))
    )
    inside = Window.partitionBy(*keys, block)
    so_far = (Window.unboundedPreceding, Window.currentRow)
    local = df.withColumn(
        "_b", F.last(known, ignorenulls=True).over(inside.orderBy(F.col(order)).rowsBetween(*so_far))
    ).withColumn(
        "_a",
        F.last(known, ignorenulls=True).over(inside.orderBy(F.col(order).desc()).rowsBetween(*so_far)),
    )
    blocks = Window.partitionBy(*keys)
    earlier = (Window.unboundedPreceding, -1)
    carried = _carried(
        df, keys, block,
        {"_first": F.min(known), "_last": F.max(known)},
        {
            "_cb": F.last("_last", ignorenulls=True).over(
                blocks.orderBy(F.col(block)).rowsBetween(*earlier)
            ),
            "_ca": F.last("_first", ignorenulls=True).over(
                blocks.orderBy(F.col(block).desc()).rowsBetween(*earlier)
            ),
        },
    )
    return (
        local.join(carried, [*keys, block])
        .withColumn(before, F.coalesce("_b", "_cb"))
        .withColumn(after, F.coalesce("_a", "_ca"))
        .drop("_b", "_a", "_cb", "_ca")
    )


def with_previous(
    df: DataFrame, keys: list[str], order: list[str], block: str, columns: list[str], out: str
) -> DataFrame:
    """Add struct ``out`` of the previous row's ``columns``; null on the first row."""
    row = F.struct(*columns)
    ordered = F.struct(*order)
    inside = Window.partitionBy(*keys, block).orderBy(*order)
    carried = _carried(
        df, keys, block,
        {"_last": F.max_by(row, ordered)},
        {"_cp": F.lag("_last").over(Window.partitionBy(*keys).orderBy(block))},
    )
    return (
        df.withColumn("_p", F.lag(row).over(inside))
        .join(carried, [*keys, block])
        .withColumn(out, F.coalesce("_p", "_cp"))
        .drop("_p", "_cp")
    )


FAN = 1024


def _sums_before(ends: DataFrame, keys: list[str], block: str, levels: int) -> DataFrame:
    """``_cs``: for each key and block the sum ``_s`` of the blocks before it.

    With more than one level, blocks are first added up in runs of ``FAN``, and the runs likewise,
    so a window holds a run's blocks and not all of a long series.
    """
    earlier = (Window.unboundedPreceding, -1)
    if levels == 1:
        along = Window.partitionBy(*keys).orderBy(block).rowsBetween(*earlier)
        return ends.select(*keys, block, F.sum("_s").over(along).alias("_cs"))
    run = f"_run{levels}"
    placed = ends.select(*keys, block, F.floor(F.col(block) / FAN).cast("bigint").alias(run), "_s")
    runs = placed.groupBy(*keys, run).agg(F.sum("_s").alias("_s"))
    before = _sums_before(runs, keys, run, levels - 1).withColumnRenamed("_cs", "_runs")
    inside = Window.partitionBy(*keys, run).orderBy(block).rowsBetween(*earlier)
    local = placed.withColumn("_in", F.sum("_s").over(inside))
    both = F.coalesce("_in", F.lit(0)) + F.coalesce("_runs", F.lit(0))
    return local.join(before, [*keys, run], "left").select(*keys, block, both.alias("_cs"))


def with_running_sum(
    df: DataFrame, keys: list[str], order: list[str], block: str, value: Column, out: str,
    inclusive: bool = True, levels: int = 1,
) -> DataFrame:
    """Add the running sum of ``value`` along the order, with or without the row's own.

    ``levels`` above 1 (for blocks that are numbers) is for series of more blocks than a task should
    put in order: each level takes the summaries down by ``FAN``. Key columns must not be null then.
    """
    end = Window.currentRow if inclusive else -1
    inside = Window.partitionBy(*keys, block).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, end
    )
    ends = df.groupBy(*keys, block).agg(F.sum(value).alias("_s"))
    carried = _sums_before(ends, keys, block, levels)
    zero = F.lit(0).cast("double")
    return (
        df.withColumn("_local", F.sum(value).over(inside))
        .join(carried, [*keys, block])
        .withColumn(out, F.coalesce("_local", zero) + F.coalesce("_cs", zero))
        .drop("_local", "_cs")
    )


def with_row_number(
    df: DataFrame, keys: list[str], order: list[str], block: str, out: str, levels: int = 1
) -> DataFrame:
    """Add the 1-based position along the order."""
    numbered = with_running_sum(df, keys, order, block, F.lit(1), out, levels=levels)
    return numbered.withColumn(out, F.col(out).cast("bigint"))
