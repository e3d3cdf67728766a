"""Near duplicates by SimHash over an inverted index of byte positions.

A 64-bit fingerprint is seen as a list of positional bytes. Two fingerprints that differ in at
most ``max_bits`` bits share at least ``8 - max_bits`` of them. Lists of single bytes would
hold a 256th of all fingerprints each, so the index is kept by groups of positions that every
pair with the guaranteed number of shared bytes has in common (``cover``). For fingerprints
that meet in a list the shared positional bytes are tallied; pairs that reach the guaranteed
minimum are retained, and those alone are verified by their differing bits.

A list hands on a minimum spanning forest of its links, not its pairs, so a group
of near copies costs as many rows as it has members. A list beyond ``LIST`` members
is cut into cells of two blocks each, so that no task holds all of it.

Rows with equal fingerprints are one node. Null text counts as empty. A text with
no words has fingerprint zero, which links like any other. Repeated rows stay in
``near_duplicates``; ``one_of_each`` keeps one. Other columns, whatever their names, are not read. An
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpanel.llm import words
from gridpanel.llm.components import connected
from gridpanel.llm.workers import in_small_batches, lean
from gridpanel.sources.scratch import landed

LIST = 1024
LINKS = 1 << 18
ROWS = 1 << 16
BROADCAST_ROWS = 1_000_000


def cover(positions: int, shared: int) -> list[tuple[int, ...]]:
    """Groups of positions of which any ``shared`` positions contain one.

    Three positions at least: Turan's triples, from three classes of positions, for
    any four. Otherwise pairs within ``shared - 1`` classes.
    """
    if shared == 4 and positions <= 12:
        parts = [list(range(i, positions, 3)) for i in range(3)]
        out = [t for p in parts for t in combinations(p, 3)]
        out += [(*pair, x) for i in range(3) for pair in combinations(parts[i], 2) for x in parts[(i + 1) % 3]]
        return [tuple(sorted(t)) for t in out]
    if shared < 2:
        raise ValueError("pairs need at least two shared bytes to be found")
    parts = [list(range(i, positions, shared - 1)) for i in range(shared - 1)]
    return [t for p in parts for t in combinations(p, 2)]


def _fingerprint(hashes: np.ndarray) -> bytes:
    """Bits set in over half the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), ROWS):
        h = hashes[at : at + ROWS]
        ones += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes)).tobytes()


def _shingles(texts: pa.Array, shingle: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of each row's shingles, repeats included; a shorter text is one."""
    data, offsets = words.flat(texts)
    data = words.LOWER[data]
    starts, ends, rows = words.spans(data, offsets, words.SPACED)
    body, starts, ends = words.joined(data, offsets, starts, ends)
    view, digest = memoryview(body.tobytes()), xxhash.xxh64_intdigest
    for a, b in zip(rows[:-1].tolist(), rows[1:].tolist()):
        if a == b:
            yield np.zeros(0, np.uint64)
            continue
        k = min(shingle, b - a)
        first, last = starts[a : b - k + 1].tolist(), ends[a + k - 1 : b].tolist()
        yield np.fromiter((digest(view[s:e], 42) for s, e in zip(first, last)), np.uint64, b - a - k + 1)


def fingerprints(rows: DataFrame, shingle: int) -> DataFrame:
    """The columns of ``rows`` but ``text``, and the text's ``fp`` (8 bytes, first bit first)."""
    kept = [c for c in rows.columns if c != "text"]

    def run(batches):
        for batch in batches:
            for part in words.slices(batch, "text"):
                hashes = _shingles(part.column("text"), shingle)
                fps = [_fingerprint(h) for h in hashes]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], pa.array(fps, pa.binary())], [*kept, "fp"])

    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept)
    return rows.mapInArrow(run, f"{schema}, fp binary")


def _matrix(fps: pa.Array) -> np.ndarray:
    data, _ = words.flat(fps)
    return data.reshape(-1, 8)


def _postings(nodes: DataFrame, groups: list[tuple[int, ...]]) -> DataFrame:
    """One row for each fingerprint and group: the group's number and byte values."""

    def run(batches):
        for batch in batches:
            m = _matrix(batch.column("fp")).astype(np.int64)
            for g, positions in enumerate(groups):
                key = np.full(len(m), g, np.int64)
                for p in positions:
                    key = (key << 8) | m[:, p]
                yield pa.RecordBatch.from_arrays([pa.array(key), batch.column("fp")], ["list", "fp"])

    return nodes.mapInArrow(run, "list bigint, fp binary")


def _forest(a: np.ndarray, b: np.ndarray, bits: np.ndarray, n: int) -> np.ndarray:
    """Which links make a minimum spanning forest of n nodes."""
    root = np.arange(n)
    keep = []

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    parent = root.tolist()
    for level in np.unique(bits):
        at = np.flatnonzero(bits == level)
        at = at[root[a[at]] != root[b[at]]]
        for i, x, y in zip(at.tolist(), a[at].tolist(), b[at].tolist()):
            x, y = find(x), find(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
                keep.append(i)
        if len(at):
            root = np.array(parent)
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root = up
    return np.array(keep, np.int64)


def _list_links(m: np.ndarray, ends: np.ndarray, min_shared: int, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a forest over sorted lists; ends: for each row, the end of its list."""
    n, found, held = len(m), [], 0
    wide = np.ascontiguousarray(m).view(np.uint64)[:, 0]
    active = np.arange(n)
    for step in range(1, n):
        active = active[active + step < ends[active]]
        if not len(active):
            break
        differ = wide[active] ^ wide[active + step]
        shared = (differ.view(np.uint8).reshape(-1, 8) == 0).sum(1)
        retained = np.flatnonzero(shared >= min_shared)
        bits = np.bitwise_count(differ[retained]).astype(np.int64)
        near = bits <= max_bits
        a = active[retained[near]]
        found.append((a, a + step, bits[near]))
        held += len(a)
        if held > LINKS:  # a forest of what is there keeps the memory bounded
            found = [_reduced(found, n)]
            held = len(found[0][0])
    return _reduced(found, n)[:2] if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _reduced(found: list[tuple[np.ndarray, ...]], n: int) -> tuple[np.ndarray, ...]:
    a, b, bits = (np.concatenate(x) for x in zip(*found))
    kept = _forest(a, b, bits, n)
    return a[kept], b[kept], bits[kept]


def links(nodes: DataFrame, groups: list[tuple[int, ...]], min_shared: int, max_bits: int) -> DataFrame:
    """``a, b`` (fingerprints): links whose components are those of all links found.

    ``nodes`` has one row for each distinct ``fp``; it is read twice, so it should be
    a stored table.
    """
    postings = _postings(nodes, groups)
    counts = postings.groupBy("list").count().where(F.col("count") > LIST)

    def linked(table, turns):
        fps = table.column("fp")
        a, b = _list_links(_matrix(fps), _ends(table, turns), min_shared, max_bits)
        yield pa.RecordBatch.from_arrays([fps.take(pa.array(a)), fps.take(pa.array(b))], ["a", "b"])

    return _in_cells(postings.join(counts, "list", "left"), linked).distinct()


def _ends(table: pa.RecordBatch, turns: np.ndarray) -> np.ndarray:
    """For each row, the end of its list."""
    bounds = np.concatenate([[0], turns, [table.num_rows]])
    return np.repeat(bounds[1:], np.diff(bounds))


def _in_cells(postings: DataFrame, linked) -> DataFrame:
    """``a, b``: what ``linked`` finds in runs of whole lists, those beyond ``LIST``
    (their ``count``) cut into cells of two blocks."""
    others = [c for c in postings.columns if c not in ("list", "fp", "count")]
    cells = postings.withColumn("blocks", F.ceil(F.coalesce("count", F.lit(1)) / LIST))
    block = F.pmod(F.xxhash64("fp"), F.col("blocks"))
    cells = cells.select("list", "fp", *others, "blocks", block.alias("block")).select(
        "list", "fp", *others, "block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("other")
    )
    cells = cells.select(
        "list", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "fp", *others
    )

    def run(batches):
        rest = None
        for batch in batches:
            table = batch if rest is None else pa.concat_batches([rest, batch])
            ids = np.stack([table.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
            turns = np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(0)) + 1
            last = int(turns[-1]) if len(turns) else 0
            if last > 1:
                yield from linked(table.slice(0, last), turns[:-1])
            rest = table.slice(last)
        if rest is not None and rest.num_rows > 1:
            yield from linked(rest, np.zeros(0, np.int64))

    dealt = cells.repartition("list", "low", "high").sortWithinPartitions("list", "low", "high")
    return dealt.mapInArrow(run, "a binary, b binary")


@in_small_batches
def _grouped(rows: DataFrame, shingle: int, max_bits: int, order) -> tuple[DataFrame, DataFrame]:
    """``rows`` (with a column ``text``) with their ``fp``, stored; and ``fp, head, root``: for each
    fingerprint the least row in an ``order`` and the least fingerprint of its component."""
    if not 0 <= max_bits <= 4:
        raise ValueError("64-bit fingerprints are linked at 0 to 4 bits")
    lean(rows.sparkSession)
    marked = landed(fingerprints(rows, shingle), "fingerprints")
    nodes = landed(marked.groupBy("fp").agg(F.min(order).alias("head")), "nodes")
    groups = connected(links(nodes.select("fp"), cover(8, 4), 8 - max_bits, max_bits), "a", "b")
    rooted = nodes.join(groups, nodes["fp"] == groups["node"], "left")
    return marked, rooted.select("fp", "head", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """``key, fp, component``: each row's 64-bit fingerprint and the smallest key
    reachable over links of at most ``max_bits`` bits (null if all keys are null).

    Complete for ``max_bits`` up to 4, for which four of the eight bytes agree.
    """
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    marked, rooted = _grouped(rows, shingle, max_bits, F.col("key"))
    smallest = rooted.groupBy("root").agg(F.min("head").alias("component"))
    # A fingerprint may hold a third of all rows: its component is brought to it by a join
    # of distinct fingerprints; Spark splits the rows of a frequent one.
    by_fp = rooted.join(smallest, "root").select("fp", "component")
    return marked.join(by_fp, "fp").select("key", "fp", "component")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """``docs`` without near duplicates: of each group of ``near_duplicates`` the row with the smallest
    key stays (null last; of rows with that key the one whose text has the smallest hash; of rows
    equal in both, one)."""
    own_text = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    mark = F.xxhash64(own_text).alias("mark")
    order = F.struct(F.col("key").isNull().alias("late"), "key", "mark")
    marked, rooted = _grouped(docs.select(F.col(f"`{key}`").alias("key"), mark, own_text.alias("text")), shingle, max_bits, order)
    least = rooted.groupBy("root").agg(F.min("head").alias("least"))
    by_fp = rooted.join(least, "root").select("fp", "least")
    own = marked.groupBy("fp", "key", "mark").agg(F.count("*").alias("copies")).join(by_fp, "fp")
    first = order.eqNullSafe(F.col("least"))
    judged = landed(own.select(F.col("key").alias("k"), F.col("mark").alias("m"), "copies", first.alias("first")), "judged")
    rows = docs.select(F.struct("*").alias("row"), F.col(f"`{key}`").alias("key"), mark)
    same = F.col("key").eqNullSafe(F.col("k")) & (F.col("mark") == F.col("m"))

    def listed(condition: str) -> DataFrame:
        """Keys and marks, 16 bytes a row if the key is a number; Spark measures them where it is not."""
        some = judged.where(condition).select("k", "m")
        narrow = judged.schema["k"].dataType.simpleString() in ("bigint", "int")
        return F.broadcast(some) if narrow and some.count() <= BROADCAST_ROWS else some

    alone = rows.join(listed("NOT first OR copies > 1"), same, "left_anti")
    repeated = rows.join(listed("first AND copies > 1"), same, "left_semi").dropDuplicates(["key", "mark"])
    return alone.unionByName(repeated).select("row.*")
