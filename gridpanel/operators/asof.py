"""As-of joins: the nearest row of another table along an order.

Both tables are put in one order and the last (or next) row of the right one is carried to
the left rows. The order is cut into blocks: within a block a window carries it, between
blocks a summary row of each does, so neither a long series nor a long lookup has to
fit in a task. Hot keys are cut by their blocks, hot blocks by salts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpanel.operators.blocks import spread, with_neighbours


def asof_join(
    left: DataFrame, right: DataFrame, keys: list[str], at: str, right_at: str, width: float,
    direction: str = "forward", clamp: bool = False, salts: int = 1, out: str = "found",
) -> DataFrame:
    """``left`` with struct ``out``: of the right rows of the same keys the one at the left row's ``at`` or
    nearest after it (``forward``) or before it (``backward``), null where there is none. With ``clamp`` such rows get
    the last right row on the other side.

    ``width`` is the length of a block of the order, a number. Of right rows at the same place the
    smallest counts. ``salts`` deals the left rows of a block over as many tasks, each with a copy of
    the block's right rows. Rows whose keys or place are null find nothing.
    """
    if direction not in ("forward", "backward"):
        raise ValueError(f"unknown direction {direction!r}")
    # at the same place the right row has to come first on the way from it to the left one
    turn_right, turn_left = (1, 0) if direction == "forward" else (0, 1)
    lookup = right.groupBy(*keys, right_at).agg(F.min(F.struct(*[c for c in right.columns if c not in keys])).alias("_right"))
    order = F.struct(F.col("_at"), F.col("_turn"))
    rows = left.select(
        *keys, F.col(at).cast("double").alias("_at"), F.lit(turn_left).alias("_turn"), F.struct(*left.columns).alias("_left"),
        F.lit(None).cast(lookup.schema["_right"].dataType).alias("_right"), F.pmod(F.xxhash64(*left.columns), F.lit(salts)).alias("_salt"),
    )
    copies = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint")))
    known = lookup.select(
        *keys, F.col(right_at).cast("double").alias("_at"), F.lit(turn_right).alias("_turn"),
        F.lit(None).cast(rows.schema["_left"].dataType).alias("_left"), "_right", copies.alias("_salt"),
    )
    both = rows.unionByName(known).withColumns({"_order": order, "_block": F.floor(F.col("_at") / width).cast("bigint")})
    placed = spread(both.where(F.col("_at").isNotNull()), [*keys, "_salt"], "_block")
    near = with_neighbours(placed, [*keys, "_salt"], "_order", "_block", "_right", "_before", "_after")
    wanted, other = ("_after", "_before") if direction == "forward" else ("_before", "_after")
    found = F.coalesce(F.col(wanted)["value"], F.col(other)["value"]) if clamp else F.col(wanted)["value"]
    lost = left.where(F.col(at).isNull() | F.greatest(*[F.col(k).isNull().cast("int") for k in keys], F.lit(0)).cast("boolean"))
    hit = near.where(F.col("_left").isNotNull()).select("_left.*", found.alias(out))
    return hit.unionByName(lost.withColumn(out, F.lit(None).cast(lookup.schema["_right"].dataType)))
