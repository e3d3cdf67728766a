"""Passages of a benchmark in training texts, by rare n-gram seeds and alignment.

1. All n-grams of the benchmark's items are looked up in the texts and counted on both sides. A gram is
   rare if few texts or few items hold it (up to ``RARE`` of either): each place where a text and an item share a
   rare gram is a seed. Rarity is that of grams that do occur in a text, so a copy of which
   edits took the item's rarest grams away is found by what they left.
2. A gram that many texts and many items hold, a turn of phrase, is no seed by itself, as it would pair all of
   them. It takes a second one: two common grams that stand in text and item at the same distance, up to ``3 n`` words,
   are a seed together. Items of up to ``4 n`` words, which may have nothing rarer, take every gram; items of fewer than ``n``
   words are looked for whole.
3. A seed tells where the item would begin, and an alignment that reaches ``threshold``
   has at most ``2 * (1 - threshold)`` gaps a word of the item. Words that near to a seed are
   looked at; stretches that overlap are one.
4. The words of a stretch are aligned with the item by Smith-Waterman (match 1,
   mismatch and gap -1/2). The score is the share of the item's length that the best
   local alignment reaches; from ``threshold`` on the passage is reported, and the words
   before and after it are aligned in turn. A stretch that has too few of the item's
   words to reach ``threshold`` in any order is not aligned.

So a copy is looked at from ``n`` unchanged words in a row on that are not a turn of phrase, or two runs
that are. The looked-up grams, eight bytes each, are broadcast up to ``BROADCAST_ROWS``, by count, and the stretches of
numbered items likewise; item words are stored once, broadcast up to ``BROADCAST_WORDS``, else joined to the words of a
stretch. Beyond these bounds joins shuffle. Null texts have no words. Rows with the same key and text share one result, repeated items
(by id and text) one each. Other columns, whatever their names, are not read; texts may be of any length. Empty
tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridpanel.llm import words
from gridpanel.llm.workers import in_small_batches, lean
from gridpanel.sources.scratch import landed

N = 4
THRESHOLD = 0.5
RARE = 8
BROADCAST_ROWS = 1_000_000
BROADCAST_STRETCHES = 1 << 18
BROADCAST_WORDS = 4 << 20
MATCH, MISS, GAP = 2, -1, 1  # in halves


def _hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = words.flat(texts)
    data = words.LOWER[data]
    starts, ends, rows = words.spans(data, offsets, words.ALNUM)
    return words.word_hashes(data, starts, ends), rows


def _picked(df: DataFrame, key: str, text: str) -> DataFrame:
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    return df.select(F.col(f"`{key}`").alias("key"), t.alias("text")).select("key", F.xxhash64("text").alias("mark"), "text")


def _grams(picked: DataFrame, n: int) -> DataFrame:
    """``key, mark, gram, place`` for every n words."""
    key_type = picked.schema["key"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part in words.slices(batch, "text", 2 << 20):
                hashes, rows = _hashed(part.column("text"))
                at = words.window_rows(rows, n)
                row = np.repeat(np.arange(part.num_rows), np.maximum(np.diff(rows) - n + 1, 0))
                grams = words.window_hashes(hashes, n)[at].view(np.int64) if len(at) else np.zeros(0, np.int64)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [part.column("key").take(take), part.column("mark").take(take), pa.array(grams), pa.array((at - rows[row]).astype(np.int32))],
                    ["key", "mark", "gram", "place"],
                )

    return picked.mapInArrow(run, f"key {key_type}, mark bigint, gram bigint, place int")


def _item_words(items: DataFrame) -> DataFrame:
    key_type = items.schema["key"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part in words.slices(batch, "text"):
                hashes, rows = _hashed(part.column("text"))
                lists = pa.ListArray.from_arrays(pa.array(rows.astype(np.int32)), pa.array(hashes.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("mark"), lists], ["item", "item_mark", "item_words"])

    return items.mapInArrow(run, f"item {key_type}, item_mark bigint, item_words array<bigint>")


def _sized(df: DataFrame, rows: int) -> DataFrame:
    """A stored table, to be broadcast if it was counted and is small."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _pairs(common: DataFrame, on: list[str], n: int) -> DataFrame:
    """Two grams of a text (or item) that stand ``n`` to ``3 n`` words apart, as one: ``gram`` of both and the
    distance, ``place`` of the first."""
    along = Window.partitionBy(*on).orderBy("place").rangeBetween(n, 3 * n)
    behind = F.collect_list(F.struct("place", "gram")).over(along)  # of at most 2 n + 1 places
    both = common.withColumn("behind", behind).withColumn("next", F.explode("behind"))
    return both.select(*on, "place", F.xxhash64("gram", "next.gram", F.col("next.place") - F.col("place")).alias("gram"))


def _seeds(hits: DataFrame, grams: DataFrame, same_item: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Places in texts joined with those in items by grams that are rare on a side; and what is left of both."""
    texts = hits.groupBy("gram").agg(F.count("*").alias("in_texts"))
    listed = grams.groupBy("gram").agg(F.count_distinct("item_mark").alias("in_items"))
    many = texts.join(listed, "gram").where((F.col("in_texts") > RARE) & (F.col("in_items") > RARE)).select("gram")
    many = landed(many, "common-grams")
    common = _sized(many, many.count())
    rare = grams.join(common, "gram", "left_anti").select(*same_item, "size", "gram", F.col("place").alias("at"))
    return hits.join(rare, "gram"), hits.join(common, "gram", "left_semi"), grams.join(common, "gram", "left_semi")


@in_small_batches
def candidates(docs: DataFrame, items: DataFrame, n: int, threshold: float = THRESHOLD) -> DataFrame:
    """``key, mark, item, item_mark, low, high``: stretches of words to be aligned, which
    do not overlap for one text and item."""
    sizes = landed(_item_words(items).select("item", "item_mark", F.size("item_words").alias("size")).distinct(), "item-sizes")
    same_item, same_text = ["item", "item_mark"], ["key", "mark"]
    tiny = sorted(r[0] for r in sizes.where(F.col("size").between(1, n - 1)).select("size").distinct().collect())
    seeds = None
    for width in [n, *tiny]:
        named = F.col("key").alias("item"), F.col("mark").alias("item_mark"), "gram", "place"
        fits = F.col("size") >= n if width == n else F.col("size") == width
        grams = landed(_join_null_safe(_grams(items, width).select(*named).distinct(), sizes.where(fits), same_item), "item-grams")
        listed = landed(grams.select("gram").distinct(), "grams")
        hits = landed(_grams(docs, width).join(_sized(listed, listed.count()), "gram").distinct(), "gram-hits")
        short = F.col("size") <= 4 * n
        direct = grams.where(short).select(*same_item, "size", "gram", F.col("place").alias("at"))
        found = [hits.join(direct, "gram")]
        if width == n:
            rare, texts, others = _seeds(hits, grams.where(~short), same_item)
            texts, others = (landed(x, "common-hits") for x in (texts, others))
            pairs = _pairs(others, [*same_item, "size"], n).select(*same_item, "size", "gram", F.col("place").alias("at"))
            found += [rare, _pairs(texts, same_text, n).join(pairs, "gram")]
        for some in found:
            some = some.select(*same_text, *same_item, "size", (F.col("place") - F.col("at")).alias("begin"))
            seeds = some if seeds is None else seeds.unionByName(some)
    places = seeds.distinct()
    slack = F.ceil(F.col("size") * (2 * (1 - threshold))).cast("int")
    along = Window.partitionBy("key", "mark", *same_item).orderBy("begin")
    jump = F.coalesce((F.col("begin") - F.lag("begin").over(along) > 2 * slack + F.col("size")).cast("int"), F.lit(0))
    numbered = places.withColumn("jump", jump)
    numbered = numbered.withColumn("stretch", F.sum("jump").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("key", "mark", *same_item, "stretch").agg(
        F.greatest(F.min("begin") - F.first(slack), F.lit(0)).alias("low"),
        (F.max("begin") + F.first(slack) + F.first("size")).alias("high"),
    )


def _join_null_safe(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """An inner join in which null keys meet; the columns of ``a``, then the others of ``b``."""
    right = b.select(*[F.col(c).alias(f"_{c}" if c in on else c) for c in b.columns])
    test = [a[c].eqNullSafe(right[f"_{c}"]) for c in on]
    condition = test[0]
    for t in test[1:]:
        condition = condition & t
    return a.join(right, condition).drop(*[f"_{c}" for c in on])


def align(passage: np.ndarray, item: np.ndarray) -> tuple[int, int, int]:
    """The best local alignment of an item's words with a passage's: its score in
    halves, and the first and last aligned place in the passage."""
    width = len(passage)
    ramp = np.arange(width + 1) * GAP
    above = np.zeros(width + 1, np.int64)
    begun = np.arange(width + 1)  # where the alignment that ends here began
    best, first, last = 0, 0, -1
    for word in item:
        same = np.where(passage == word, MATCH, MISS)
        cells, starts = np.zeros(width + 1, np.int64), np.arange(width + 1)
        diagonal, upper = above[:-1] + same, above[1:] - GAP
        from_upper = upper > diagonal
        cells[1:] = np.where(from_upper, upper, diagonal)
        starts[1:] = np.where(from_upper, begun[1:], begun[:-1])
        empty = cells <= 0
        cells[empty] = 0
        starts[empty] = np.arange(width + 1)[empty]
        # gaps along the row: the best earlier cell less a gap for each step
        lifted = cells + ramp
        top = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == top, np.arange(width + 1), 0))
        moved = top - ramp
        better = moved > cells
        cells = np.where(better, moved, cells)
        starts = np.where(better, starts[source], starts)
        at = int(cells.argmax())
        if cells[at] > best:
            best, first, last = int(cells[at]), int(starts[at]), at - 1
        above, begun = cells, starts
    return best, first, last


def passages(own: np.ndarray, item: np.ndarray, threshold: float) -> Iterator[tuple[float, int, int]]:
    """Score, first and last place of the best passage, then of those before and after it."""
    left = [(0, len(own))]
    while left:
        low, high = left.pop()
        if MATCH * int(np.isin(item, own[low:high]).sum()) < threshold * MATCH * len(item):
            continue
        best, first, last = align(own[low:high], item)
        score = best / (MATCH * len(item))
        if best > 0 and score >= threshold:
            yield score, low + first, low + last
            left += [(low, low + first), (low + last + 1, high)]


def find(
    docs: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    n: int = N,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """``key, mark, item, score, first_word, last_word``: each passage of a document
    that scores ``threshold`` or more; ``mark`` is the hash of the text."""
    lean(docs.sparkSession)
    picked, items = _picked(docs, key, text), _picked(benchmark, item, item_text)
    found = landed(candidates(picked, items, n, threshold), "candidates")
    by_text = found.groupBy("key", "mark").agg(F.collect_list(F.struct("item", "item_mark", "low", "high")).alias("stretches"))
    by_text = landed(by_text, "candidate-texts")
    narrow = all(found.schema[c].dataType.simpleString() in ("int", "bigint") for c in ("key", "item"))
    small = narrow and found.count() <= BROADCAST_STRETCHES
    joined = _join_null_safe(picked, F.broadcast(by_text) if small else by_text, ["key", "mark"])
    item_type = items.schema["key"].dataType.simpleString()
    key_type = picked.schema["key"].dataType.simpleString()

    def cut(batches):
        """The words of each stretch."""
        for batch in batches:
            for part in words.slices(batch, "text"):
                hashes, rows = _hashed(part.column("text"))
                lists = part.column("stretches")
                own = lists.flatten()
                row = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
                low, high = (own.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("low", "high"))
                first = np.minimum(rows[row] + low, rows[row + 1])
                count = np.minimum(rows[row] + high, rows[row + 1]) - first
                ends = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
                held = pa.ListArray.from_arrays(pa.array(ends), pa.array(hashes.view(np.int64)[words.runs(first, count)]))
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [part.column("key").take(take), part.column("mark").take(take), own.field("item"), own.field("item_mark"), pa.array(low), held],
                    ["key", "mark", "item", "item_mark", "low", "own_words"],
                )

    def aligned(batches, words_of=None):
        for batch in batches:
            out = []
            listed = batch.column("item_words") if words_of is None else (words_of[m] for m in batch.column("item_mark").to_pylist())
            places = zip(batch.column("low").to_pylist(), batch.column("own_words"), listed)
            for i, (low, own, item) in enumerate(places):
                item = item if words_of else np.asarray(item.values)
                for score, first, last in passages(np.asarray(own.values), item, threshold):
                    out.append((i, score, low + first, low + last))
            r, score, first, last = zip(*out) if out else ((),) * 4
            take = pa.array(r, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c).take(take) for c in ("key", "mark", "item")),
                    pa.array(score, pa.float64()), pa.array(first, pa.int64()), pa.array(last, pa.int64()),
                ],
                ["key", "mark", "item", "score", "first_word", "last_word"],
            )

    result = f"key {key_type}, mark bigint, item {item_type}, score double, first_word bigint, last_word bigint"
    known = landed(_item_words(items).select("item_mark", "item_words").dropDuplicates(["item_mark"]), "item-words")
    size = known.agg(F.sum(F.size("item_words") + 4)).first()[0] or 0
    if size > BROADCAST_WORDS:
        stretches = joined.mapInArrow(cut, f"key {key_type}, mark bigint, item {item_type}, item_mark bigint, low bigint, own_words array<bigint>")
        return stretches.join(known, "item_mark").mapInArrow(aligned, result).distinct()
    table = known.toArrow()
    held = {m: np.asarray(w.values) for m, w in zip(table.column("item_mark").to_pylist(), table.column("item_words"))}
    shared = docs.sparkSession.sparkContext.broadcast(held)
    # one Python worker a task does both
    return joined.mapInArrow(lambda batches: aligned(cut(batches), shared.value), result).distinct()


def without_passages(
    docs: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    n: int = N,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """``docs`` without the rows that hold a passage of the benchmark."""
    found = find(docs, benchmark, key, text, item, item_text, n, threshold)
    found = landed(found.select(F.col("key").alias("k"), F.col("mark").alias("m")).distinct(), "contaminated")
    found = _sized(found, found.count())
    own_text = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = docs.select(F.struct("*").alias("row"), F.col(f"`{key}`").alias("key"), F.xxhash64(own_text).alias("mark"))
    held = F.col("key").eqNullSafe(F.col("k")) & (F.col("mark") == F.col("m"))
    return rows.join(found, held, "left_anti").select("row.*")
