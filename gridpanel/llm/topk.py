"""Exact top-k search by inner product over ball trees, one a shard.

Components become whole numbers, so scores are exact and ties are settled by the smaller
id. Rows are dealt to shards of about ``SHARD`` vectors; a shard is stored as one row with
its ball tree: nodes with centre and radius, vectors in leaf order. Query blocks meet
shards by an equi-join on the shard number.

A block of queries descends a tree level by level; a query drops a node whose bound, centre . q +
radius |q|, is below its k-th score so far. Leaves are visited from the highest bound on, ``VISIT`` at a time, as
one matrix product with the queries they survive for; each visit may raise the k-th scores and so drop
leaves to come. The k-th score is shared: each block first searches one shard, and the others start
from the score it found there.

Vectors that are null, empty or hold null or non-finite components take no part, nor do
null ids. A query sees vectors of its own length only, and every row but its own: rows that repeat an
id are candidates one by one and, where the id asks, queries one by one. Rows are dealt by a number of
their own, so repeated ids or vectors do not meet in a shard. Scores that might not
fit in 64 bits are an error. Other columns, whatever their names, are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridpanel.sources.scratch import landed

SHARD = 8192
BLOCK = 1024
LEAF = 64
VISIT = 16  # leaves scored at a time


def whole_numbers(vectors: DataFrame, key: str, vector: str, scale: float) -> DataFrame:
    """``id, vector, length`` of the vectors that take part; components floor(scale * x)."""
    x = F.col(f"`{vector}`")
    fine = F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))
    scaled = F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("long"))
    rows = vectors.where(fine & (F.size(x) > 0) & F.col(f"`{key}`").isNotNull())
    return rows.select(
        F.monotonically_increasing_id().alias("row"), F.col(f"`{key}`").cast("long").alias("id"), scaled.alias("vector"), F.size(x).alias("length")
    )


def _check_range(rows: DataFrame) -> int:
    """Rows of a stored table; raises if an inner product might need more than 64 bits."""
    most = F.max(F.greatest(F.array_max("vector"), -F.array_min("vector")).cast("double"))
    found = rows.groupBy("length").agg(F.count("*").alias("n"), most.alias("most")).collect()
    if any(r["most"] * r["most"] * r["length"] >= 2.0**63 for r in found):
        raise ValueError("inner products of these vectors may not fit in 64 bits")
    return sum(r["n"] for r in found)


def _matrix(column: pa.ChunkedArray | pa.Array, length: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, length).astype(np.int64)


def _exact(values: np.ndarray) -> np.ndarray:
    """The numbers as float64 if all inner products stay exact in it, else as they are."""
    top = float(np.abs(values).max(initial=0))
    return values.astype(np.float64) if top * top * values.shape[1] < 2.0**52 else values


def ball_tree(vectors: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """The order of the vectors, and for each level the bounds of its nodes in that
    order, their centres and radii. Node i has the children 2i and 2i + 1."""
    order = np.arange(len(vectors))
    x = vectors.astype(np.float64)
    bounds = np.array([0, len(vectors)])
    levels = []
    while True:
        parts = list(zip(bounds[:-1].tolist(), bounds[1:].tolist()))
        centres = np.array([x[order[a:b]].mean(0) if b > a else np.zeros(x.shape[1]) for a, b in parts])
        radii = np.array([np.sqrt(((x[order[a:b]] - c) ** 2).sum(1).max(initial=0)) for (a, b), c in zip(parts, centres)])
        levels.append((bounds, centres, radii))
        if max(b - a for a, b in parts) <= leaf:
            return order, levels
        cuts = [0]
        for (a, b), c in zip(parts, centres):
            own = order[a:b]
            if b - a > 1:
                one = x[own[((x[own] - c) ** 2).sum(1).argmax()]]
                other = x[own[((x[own] - one) ** 2).sum(1).argmax()]]
                order[a:b] = own[np.argsort(x[own] @ (other - one), kind="stable")]
            cuts += [(a + b) // 2, b]
        bounds = np.array(cuts)


class _Tree:
    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, levels):
        self.rows, self.ids, self.vectors, self.levels = rows, ids, _exact(vectors), levels

    def bounds(self, q: np.ndarray, kth: np.ndarray) -> np.ndarray:
        """Queries x leaves: the most a vector of the leaf can score, -inf where a node above it was dropped."""
        size = np.sqrt((q**2).sum(1))
        alive, bound = np.ones((len(q), 1), bool), np.zeros((len(q), 1))
        for level, (_, centres, radii) in enumerate(self.levels):
            if level:
                alive = np.repeat(alive, 2, axis=1)
            nodes = np.flatnonzero(alive.any(0))
            bound = np.full(alive.shape, -np.inf)
            value = q @ centres[nodes].T + size[:, None] * radii[nodes]
            bound[:, nodes] = value + 1e-9 * (1 + np.abs(value))
            alive &= bound >= kth[:, None]
        return np.where(alive, bound, -np.inf)

    def search(self, query_rows: np.ndarray, queries: np.ndarray, kth: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query by place, id, score): all that may be among the k best of a query."""
        kth, edges = kth.copy(), self.levels[-1][0]
        bound = self.bounds(queries.astype(np.float64), kth)
        scored = queries if self.vectors.dtype == np.int64 else _exact(queries)
        best = tuple(np.zeros(0, np.int64) for _ in range(3))
        order = np.argsort(-bound.max(0, initial=-np.inf), kind="stable")
        for at in range(0, len(order), VISIT):
            leaves = order[at : at + VISIT]
            asking = np.flatnonzero((bound[:, leaves] >= kth[:, None]).any(1))
            if not len(asking):
                continue
            places = np.concatenate([np.arange(edges[n], edges[n + 1]) for n in leaves])
            scores = (scored[asking] @ self.vectors[places].T).astype(np.int64)
            q, v = np.nonzero((scores >= kth[asking, None]) & (self.rows[places] != query_rows[asking, None]))
            new = (asking[q], self.ids[places[v]], scores[q, v])
            best = _best_of(*(np.concatenate(x) for x in zip(best, new)), k)
            last = np.flatnonzero(np.diff(best[0], append=-1))
            full = last[np.bincount(best[0], minlength=len(kth))[best[0][last]] == k]
            kth[best[0][full]] = np.maximum(kth[best[0][full]], best[2][full])
        return best


def _best_of(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query, by query, falling."""
    order = np.lexsort((ids, -scores, query))
    query = query[order]
    first = np.flatnonzero(np.diff(query, prepend=-1))
    turn = np.arange(len(query)) - np.repeat(first, np.diff([*first, len(query)]))
    keep = turn < k
    return query[keep], ids[order][keep], scores[order][keep]


def _shards(rows: DataFrame, shards: int) -> DataFrame:
    def build(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        length = key[0].as_py()
        table = table.sort_by("row")
        rows, ids, vectors = table.column("row").to_numpy(), table.column("id").to_numpy(), _matrix(table.column("vector"), length)
        order, levels = ball_tree(vectors)
        tree = [(b.astype(np.int64).tobytes(), c.tobytes(), r.tobytes()) for b, c, r in levels]
        return pa.table(
            {
                "length": pa.array([length], pa.int32()),
                "shard": pa.array([key[1].as_py()], pa.int64()),
                "rows": pa.array([rows[order].tobytes()], pa.binary()),
                "ids": pa.array([ids[order].tobytes()], pa.binary()),
                "vectors": pa.array([vectors[order].tobytes()], pa.binary()),
                "bounds": pa.array([[t[0] for t in tree]], pa.list_(pa.binary())),
                "centres": pa.array([[t[1] for t in tree]], pa.list_(pa.binary())),
                "radii": pa.array([[t[2] for t in tree]], pa.list_(pa.binary())),
            }
        )

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)))
    return dealt.groupBy("length", "shard").applyInArrow(
        build, "length int, shard bigint, rows binary, ids binary, vectors binary, bounds array<binary>, centres array<binary>, radii array<binary>"
    )


def _blocks(queries: DataFrame, blocks: int) -> DataFrame:
    def build(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by("row")
        return pa.table(
            {
                "length": pa.array([key[0].as_py()], pa.int32()),
                "block": pa.array([key[1].as_py()], pa.int64()),
                "query_rows": pa.array([table.column("row").to_numpy().tobytes()], pa.binary()),
                "query_ids": pa.array([table.column("id").to_numpy().tobytes()], pa.binary()),
                "queries": pa.array([_matrix(table.column("vector"), key[0].as_py()).tobytes()], pa.binary()),
                "kth": pa.array([table.column("kth").to_numpy().astype(np.int64).tobytes()], pa.binary()),
            }
        )

    dealt = queries.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))
    return dealt.groupBy("length", "block").applyInArrow(
        build, "length int, block bigint, query_rows binary, query_ids binary, queries binary, kth binary"
    )


def _searched(shards: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """``query_row, query_id, id, score`` for blocks that have a shard number to meet."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                n = row["length"]
                rows, ids = (np.frombuffer(row[c], np.int64) for c in ("rows", "ids"))
                vectors = np.frombuffer(row["vectors"], np.int64).reshape(-1, n)
                levels = [
                    (np.frombuffer(b, np.int64), np.frombuffer(c, np.float64).reshape(-1, n), np.frombuffer(r, np.float64))
                    for b, c, r in zip(row["bounds"], row["centres"], row["radii"])
                ]
                query_rows, query_ids = (np.frombuffer(row[c], np.int64) for c in ("query_rows", "query_ids"))
                queries = np.frombuffer(row["queries"], np.int64).reshape(-1, n)
                place, found, scores = _Tree(rows, ids, vectors, levels).search(query_rows, queries, np.frombuffer(row["kth"], np.int64), k)
                arrays = [pa.array(x) for x in (query_rows[place], query_ids[place], found, scores)]
                yield pa.RecordBatch.from_arrays(arrays, ["query_row", "query_id", "id", "score"])

    both = shards.join(blocks, ["length", "shard"])
    return both.mapInArrow(run, "query_row bigint, query_id bigint, id bigint, score bigint")


def _best(found: DataFrame, k: int) -> DataFrame:
    turn = Window.partitionBy("query_row").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(turn)).where(F.col("rank") <= k)


def top_k(
    vectors: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = 20, scale: float = 64.0,
    shard: int = SHARD, block: int = BLOCK,
) -> DataFrame:
    """``query_id, rank, id, score``: the k highest scores of each row that ``is_query``
    (a condition on the column ``id``) picks, equal scores by smaller id."""
    rows = landed(whole_numbers(vectors, key, vector, scale), "vectors")
    shards = max(1, -(-_check_range(rows) // shard))
    stored = landed(_shards(rows, shards), "ball-trees")
    queries = rows.where(is_query)
    blocks = max(1, -(-queries.count() // block))
    lowest = F.lit(-(2**63)).cast("long")
    home = F.pmod(F.col("block"), F.lit(shards))
    first_blocks = _blocks(queries.withColumn("kth", lowest), blocks).withColumn("shard", home)
    first = landed(_best(_searched(stored, first_blocks, k), k), "first-shard")
    if shards == 1:
        return first.select("query_id", "rank", "id", "score")
    known = first.where(F.col("rank") == k).select(F.col("query_row").alias("row"), F.col("score").alias("kth"))
    informed = queries.join(known, "row", "left").withColumn("kth", F.coalesce("kth", lowest))
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")), lambda s: s != home)
    rest = _blocks(informed, blocks).withColumn("shard", F.explode(others))
    found = _searched(stored, rest, k).unionByName(first.select("query_row", "query_id", "id", "score"))
    return _best(found, k).select("query_id", "rank", "id", "score")
