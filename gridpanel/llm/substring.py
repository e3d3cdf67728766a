"""Removal of passages that occur more than once, behind a count-min prefilter.

A window is ``window`` consecutive words of one document. Three steps:

1. Every task sketches its windows: each window is counted in one cell of each of
   the sketch's rows. The sketches are merged cell by cell, so a window's smallest
   cell is never below its true count. Only "two or more" matters, so the merged
   sketch is one bit a cell, which Spark broadcasts: ``CELLS_A_WINDOW`` cells for
   each window, up to ``MAX_CELLS`` (a bound in bytes; beyond it the sketch lets
   more windows through, it loses none). A second sketch, half as large, counts only
   the windows that the first lets through, by other cells.
2. Windows estimated at two or more by both are counted exactly, by a 96-bit hash. A task first
   groups its own: a window that it holds twice is settled there, and one entry for each
   different window goes through the shuffle, with its place if it still needs one. So a
   passage of a third of all documents costs an entry a task. Entries travel packed, in
   buckets by their hash, one for about ``BUCKET`` words of the corpus; settled places by key, text and
   ``BLOCK`` of the place, as copies of one text have all their places settled. Windows that occur again
   cover their words; equal rows hand on each place at most twice.
3. Each document drops its covered words. Where no more than ``BROADCAST_ROWS``
   documents have any, their keys are broadcast and the other texts are not shuffled;
   beyond that all are.

Windows are judged on the input, not on what is left; two copies in one document
count. A row's windows belong to its key and text, so equal rows share their result
(and make each other's windows repeat). Null text has no words; a document shorter
than a window keeps all its words; an empty table gives an empty result. Every
repeat is removed, the first place included. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpanel.llm import words
from gridpanel.llm.workers import in_small_batches, lean
from gridpanel.sources.scratch import landed

CELLS_A_WINDOW = 2
MIN_CELLS = 1 << 21
MAX_CELLS = 1 << 30
REGION = 1 << 20
ROWS = 2
GROUPED = 1 << 18
SKETCHED = 1 << 20
BUCKET = 1 << 20
LEAST_BUCKETS = 64
BLOCK = 1 << 12
SLICE = 1 << 20  # bytes of text worked on at once
BROADCAST_ROWS = 1_000_000


def _prepared(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, ``text`` and ``mark``, which with the key tells rows apart by content."""
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    return docs.select(F.col(f"`{key}`").alias("key"), t.alias("text")).withColumn("mark", F.xxhash64("text"))


def _windows(part: pa.RecordBatch, window: int, base: np.uint64 = words.WORD_BASES[0], second: bool = False):
    """Window hashes of a run of rows, with each window's place and row (and, if
    asked for, a second independent hash)."""
    data, offsets = words.flat(part.column("text"))
    starts, ends, rows = words.spans(data, offsets, words.SPACED)
    at = words.window_rows(rows, window)
    counts = np.maximum(np.diff(rows) - window + 1, 0)
    hashes = words.word_hashes(data, starts, ends)
    first = words.window_hashes(hashes, window, base)[at] if len(at) else np.zeros(0, np.uint64)
    if not second:
        return first, rows
    other = words.window_hashes(words.mix(hashes), window, words.WORD_BASES[1])[at] if len(at) else first
    row = np.repeat(np.arange(part.num_rows), counts)
    return first, other, row, at - rows[row], rows


def _cells(hashes: np.ndarray, cells: int, turn: int = 0) -> list[np.ndarray]:
    """The cell of each window in each row of a sketch (a power of two of cells)."""
    half = np.uint64(cells // ROWS - 1)
    if turn:
        hashes = words.mix(hashes + words.U64(turn))
    return [hashes & half, (hashes >> np.uint64(33) & half) + half + np.uint64(1)]


def _estimated(hashes: np.ndarray, sketches: list[np.ndarray]) -> np.ndarray:
    """Places of the windows that every sketch puts at two or more."""
    at = np.arange(len(hashes))
    for turn, bits in enumerate(sketches):
        for row in range(ROWS):
            cell = _cells(hashes[at], 8 * len(bits), turn)[row].astype(np.int64)
            at = at[(bits[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8) & 1).astype(bool)]
    return at


def _sketch(docs: DataFrame, window: int, cells: int, before, hashed=_windows) -> DataFrame:
    """``region, ones, twos``: for each region of cells, which were hit once and which
    more often, as one task saw it. ``before``: broadcasts of the sketches so far;
    ``hashed``: hashes (and row offsets) of a run of rows."""

    def packed(seen: list[np.ndarray]):
        cell = np.concatenate(seen)
        cell.sort()
        new = np.ones(len(cell), bool)
        new[1:] = cell[1:] != cell[:-1]
        value = cell[new]
        more = np.zeros(len(cell) + 1, bool)
        more[:-1] = ~new
        twice = more[np.flatnonzero(new) + 1]
        region = value // np.uint32(REGION)
        bounds = np.flatnonzero(np.concatenate([[True], region[1:] != region[:-1], [True]]))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            low = (value[a:b] % np.uint32(REGION)).astype(np.int64)
            again = twice[a:b]
            yield int(region[a]), _deltas(low[~again]), _deltas(low[again])

    def batch_of(rows):
        r, ones, twos = zip(*rows)
        return pa.RecordBatch.from_arrays(
            [pa.array(r, pa.int64()), pa.array(ones, pa.binary()), pa.array(twos, pa.binary())], ["region", "ones", "twos"]
        )

    def run(batches):
        seen, n, earlier = [], 0, [b.value for b in before]
        for batch in batches:
            for part in words.slices(batch, "text", SLICE):
                hashes, _ = hashed(part, window)
                hashes = hashes[_estimated(hashes, earlier)]
                for cell in _cells(hashes, cells, len(earlier)):
                    seen.append(cell.astype(np.uint32))
                n += len(hashes)
                if n >= SKETCHED:
                    yield batch_of(list(packed(seen)))
                    seen, n = [], 0
        if n:
            yield batch_of(list(packed(seen)))

    return docs.select("text").mapInArrow(run, "region bigint, ones binary, twos binary")


def _deltas(sorted_cells: np.ndarray) -> bytes:
    """Rising numbers as steps of one byte; 255 adds 255 and goes on."""
    if not len(sorted_cells):
        return b""
    steps = np.diff(sorted_cells, prepend=0)
    wraps = steps // 255
    out = np.full(len(steps) + int(wraps.sum()), 255, np.uint8)
    out[np.cumsum(wraps + 1) - 1] = steps % 255
    return out.tobytes()


def _cells_of(deltas: bytes) -> np.ndarray:
    steps = np.frombuffer(deltas, np.uint8)
    return np.cumsum(steps, dtype=np.int64)[steps < 255]


def _merged(sketches: DataFrame) -> DataFrame:
    """``region, bits``: which cells of a region were hit at least twice over all tasks."""

    def merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hit, twice = np.zeros(REGION, bool), np.zeros(REGION, bool)
        for batch in batches:
            for ones, twos in zip(batch.column("ones"), batch.column("twos")):
                for cells, again in ((_cells_of(ones.as_py()), False), (_cells_of(twos.as_py()), True)):
                    twice[cells] |= hit[cells] | again
                    hit[cells] = True
        yield pa.RecordBatch.from_arrays(
            [pa.array([key[0].as_py()], pa.int64()), pa.array([np.packbits(twice).tobytes()], pa.binary())], ["region", "bits"]
        )

    return sketches.groupBy("region").applyInArrow(merge, "region bigint, bits binary")


def _bits(sketches: DataFrame, cells: int) -> np.ndarray:
    """The merged sketch, one bit a cell, on the driver."""
    bits = np.zeros(cells // 8, np.uint8)
    for r in _merged(sketches).toLocalIterator():
        bits[r["region"] * REGION // 8 : (r["region"] + 1) * REGION // 8] = np.frombuffer(r["bits"], np.uint8)
    return bits


def _size(docs: DataFrame) -> tuple[int, int]:
    """Cells of the sketch, a power of two that follows the number of words, and buckets."""

    def run(batches):
        for batch in batches:
            n = 0
            for part in words.slices(batch, "text", SLICE):
                data, offsets = words.flat(part.column("text"))
                inside = words.SPACED[data]
                n += int((inside[1:] & ~inside[:-1]).sum()) + part.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    total = docs.select("text").mapInArrow(run, "n bigint").agg(F.sum("n")).first()[0] or 0
    cells = MIN_CELLS
    while cells < min(CELLS_A_WINDOW * total, MAX_CELLS):
        cells *= 2
    return cells, max(LEAST_BUCKETS, total // BUCKET)


def _new(*columns: np.ndarray) -> np.ndarray:
    """The rows in order of the last column, then the one before it, each different row once."""
    order = np.lexsort(columns)
    first = np.zeros(len(order), bool)
    first[:1] = True
    for c in columns:
        first[1:] |= c[order[1:]] != c[order[:-1]]
    return order[first]


def _dealt(deal: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Where a settled place goes: by its row's key and text and the block it is in."""
    return words.mix(deal.view(np.uint64) + (place // BLOCK).astype(np.uint64) * words.BASE)


def repeated_windows(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 35) -> DataFrame:
    """``key, mark, places``: the first words of the windows that occur elsewhere too,
    for documents that have any; ``mark`` is the hash of the text."""
    return _repeated(_prepared(docs, key, text), window)


@in_small_batches
def _repeated(prepared: DataFrame, window: int) -> DataFrame:
    spark = prepared.sparkSession
    lean(spark)
    cells, buckets = _size(prepared)
    shared: list = []
    for share in (1, 2):
        bits = _bits(_sketch(prepared, window, cells // share, list(shared)), cells // share)
        shared.append(spark.sparkContext.broadcast(bits))
    prepared = prepared.withColumn("deal", F.xxhash64("key", "mark"))
    key_type = prepared.schema["key"].dataType.simpleString()
    schema = f"bucket bigint, h1 binary, h2 binary, n binary, place binary, mark binary, key array<{key_type}>"
    names = ["bucket", "h1", "h2", "n", "place", "mark", "key"]

    def run(batches):
        sketches = [b.value for b in shared]
        found, n = [], 0
        for batch in batches:
            for part in words.slices(batch, "text", SLICE):
                first, second, row, place, _ = _windows(part, window, second=True)
                at = _estimated(first, sketches)
                rows = pa.array(row[at])
                own = (part.column(c).take(rows) for c in ("key", "mark", "deal"))
                found.append((first[at], second[at].astype(np.uint32), place[at], *own))
                n += len(at)
                if n >= GROUPED:
                    yield grouped(found)
                    found, n = [], 0
        if n:
            yield grouped(found)

    def grouped(found):
        h1, h2, place = (np.concatenate([x[i] for x in found]) for i in range(3))
        key, mark, deal = (pa.concat_arrays([x[i] for x in found]) for i in (3, 4, 5))
        found.clear()  # the parts are not held beside the whole
        mark, deal = mark.to_numpy(), deal.to_numpy()
        order = np.lexsort((h2, h1))
        a, b = h1[order], h2[order]
        head = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        count = np.diff(np.concatenate([head, [len(a)]]))
        # one entry for each window, and one for each place that is settled (n = 0)
        settled = order[np.repeat(count, count) > 1]
        settled = np.sort(settled[_new(place[settled], mark[settled], deal[settled])])
        at = np.concatenate([order[head], settled])
        n = np.concatenate([np.minimum(count, 2), np.zeros(len(settled), np.int64)]).astype(np.uint8)
        spread = np.where(n > 0, h1[at], _dealt(deal[at], place[at])) % np.uint64(buckets)
        by_bucket = np.lexsort((at, spread))  # by document within a bucket, which packs well
        at, n, spread = at[by_bucket], n[by_bucket], spread[by_bucket]
        edges = np.concatenate([[0], np.flatnonzero(spread[1:] != spread[:-1]) + 1, [len(at)]])
        columns = [h1[at], h2[at], n, place[at].astype(np.int32), mark[at]]
        packed = [pa.array([c[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:])], pa.binary()) for c in columns]
        keys = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), key.take(pa.array(at)))
        first = pa.array(spread[edges[:-1]].astype(np.int64))
        return pa.RecordBatch.from_arrays([first, *packed, keys], names)

    def again(bucket: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        kinds = (np.uint64, np.uint32, np.uint8, np.int32, np.int64)
        h1, h2, n, place, mark = (
            np.frombuffer(b"".join(table.column(c).to_pylist()), kind) for c, kind in zip(names[1:6], kinds)
        )
        key = table.column("key").combine_chunks().flatten()
        counted = np.flatnonzero(n > 0)
        counted = counted[np.lexsort((h2[counted], h1[counted]))]
        a, b = h1[counted], h2[counted]
        head = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else counted
        sums = np.add.reduceat(n[counted].astype(np.int64), head) if len(a) else head
        repeated = np.repeat(sums, np.diff(np.concatenate([head, [len(a)]]))) > 1
        placed = np.concatenate([np.flatnonzero(n == 0), counted[repeated & (n[counted] == 1)]])
        owner = key.dictionary_encode().indices.fill_null(-1).to_numpy()
        placed = placed[_new(place[placed], owner[placed], mark[placed])]
        m, o = mark[placed], owner[placed]
        heads = np.flatnonzero(np.concatenate([[True], (m[1:] != m[:-1]) | (o[1:] != o[:-1])])) if len(m) else placed
        ends = pa.array(np.concatenate([heads, [len(m)]]).astype(np.int32))
        own = pa.array(placed[heads])
        places = pa.ListArray.from_arrays(ends, pa.array(place[placed]))
        yield pa.RecordBatch.from_arrays([key.take(own), pa.array(mark).take(own), places], ["key", "mark", "places"])

    entries = prepared.mapInArrow(run, schema)
    kept = entries.groupBy("bucket").applyInArrow(again, f"key {key_type}, mark bigint, places array<int>")
    found = kept.groupBy("key", "mark").agg(F.flatten(F.collect_list("places")).alias("places"))
    found = landed(found, "repeats")
    for sketch in shared:  # they have done their work; what is stored needs them no more
        sketch.destroy()
    return found


def without_repeats(
    docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 35, result: str = "dedup"
) -> DataFrame:
    """``docs`` with a column ``result``: struct of ``n_words``, ``n_removed`` and ``kept``,
    the row's kept words joined by one space. Columns of ``docs`` may have any names but
    that one."""
    found = _repeated(_prepared(docs, key, text), window).select(F.col("key").alias("k"), F.col("mark").alias("m"), "places")
    own_text = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = docs.select(F.struct("*").alias("row"), F.col(f"`{key}`").alias("key"), F.xxhash64(own_text).alias("mark"))
    same = F.col("key").eqNullSafe(F.col("k")) & (F.col("mark") == F.col("m"))
    if found.count() <= BROADCAST_ROWS:
        keys = F.broadcast(found.select("k", "m"))
        without = rows.join(keys, same, "left_anti").withColumn("places", F.lit(None).cast("array<int>"))
        held = rows.join(keys, same, "left_semi").join(found, same)
        both = held.select("row", "places").unionByName(without.select("row", "places"))
    else:
        both = rows.join(found, same, "left")

    @F.arrow_udf("struct<n_words:bigint,n_removed:bigint,kept:string>")
    def removed(texts: pa.Array, places: pa.Array) -> pa.Array:
        one = pa.record_batch([texts, places], ["text", "places"])
        parts = [_removed(part, window) for part in words.slices(one, "text", SLICE)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.struct(_REMOVED))

    own_text = F.coalesce(F.col("row").getField(text).cast("string"), F.lit(""))
    return both.select("row.*", removed(own_text, "places").alias(result))


_REMOVED = [("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())]


def _removed(part: pa.RecordBatch, window: int) -> pa.StructArray:
    data, offsets = words.flat(part.column("text"))
    starts, ends, rows = words.spans(data, offsets, words.SPACED)
    places = part.column("places")
    lengths = places.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(part.num_rows), lengths)
    first = places.flatten().to_numpy(zero_copy_only=False).astype(np.int64) + rows[row]
    change = np.zeros(len(starts) + 1, np.int64)
    np.add.at(change, first, 1)
    np.add.at(change, first + window, -1)
    stays = np.cumsum(change[:-1]) == 0
    kept_rows = np.concatenate([[0], np.cumsum(stays)])[rows]
    body, new_starts, new_ends = words.joined(data, offsets, starts[stays], ends[stays])
    raw = body.tobytes()
    kept = [
        raw[new_starts[a] : new_ends[b - 1]].decode() if b > a else ""
        for a, b in zip(kept_rows[:-1].tolist(), kept_rows[1:].tolist())
    ]
    n_words = np.diff(rows)
    arrays = [pa.array(n_words), pa.array(n_words - np.diff(kept_rows)), pa.array(kept, pa.string())]
    return pa.StructArray.from_arrays(arrays, [name for name, _ in _REMOVED])
