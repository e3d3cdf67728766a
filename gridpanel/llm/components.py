"""Connected components of a table of links, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 64


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Links (a > b) after every node has passed its larger (or smaller) neighbours
    to its smallest one."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links
    least = both.groupBy("a").agg(F.min("b").alias("least")).withColumn("least", F.least("a", "least"))
    joined = both.join(least, "a")
    if large:
        return joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("least").alias("b"))
    moved = joined.select(F.col("b").alias("a"), F.col("least").alias("b"))
    own = least.select("a", F.col("least").alias("b"))
    return moved.unionByName(own)


def connected(links: DataFrame, a: str, b: str) -> DataFrame:
    """``node, root``: for every node of a link, the smallest node reachable.

    Each round ends with a checkpoint in the shared folder; the rounds needed grow
    with the logarithm of the longest chain.
    """
    edges = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct()
    edges = edges.checkpoint()
    seen = None
    for _ in range(ROUNDS):
        edges = _star(edges, large=True).where("a <> b").distinct()
        edges = _star(edges, large=False).where("a <> b").distinct().checkpoint()
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
