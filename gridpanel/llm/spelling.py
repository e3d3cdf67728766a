"""Spelling variants: words one edit apart, found by an index of variable-length grams.

1. ``count_words``: the words of all texts and how often they occur, after the typing
   errors that ``errors`` asks for.
2. ``dictionary``: grams grow from ``SHORT`` code points on. A gram is kept as one to be
   extended while more than a floor of all places hold it; rarer ones are not, so the
   dictionary is pruned by frequency. It has at most ``GROWN`` grams a length (a bound on
   what is broadcast); the floor rises with the number of places.
3. A word, with ``PAD`` marks before it and one behind, is decomposed into the longest
   dictionary gram at each place. Grams that others contain are kept: then an edit leaves
   all grams alone that do not cover its place, since a gram's length follows from its own
   code points and the dictionary. A word's bound is the most grams that any one place
   is covered by, so two words one edit apart have all but that many in common.
4. With m grams affected at most, only the m + 1 rarest grams of a word are indexed
   (its other lists need no merging). Lists are kept by gram, place and length of the shorter word; a
   longer word is entered where the gram stands to the left of the edit and to the right.
   Lists longer than ``LIST`` are cut into cells of two blocks each.
5. Pairs that meet are verified code point by code point from both ends. Only verified pairs leave a task.

Two words are near if they differ by one inserted, deleted or replaced code point. A word's
form is its most frequent near word (ties: the smallest) if that is at least ``ratio`` times as
frequent; its root is the end of its chain of forms. Null texts have no words, a null key
counts as an empty one. Repeated rows count one by one. An empty table gives an empty result. Words
may be of any length. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpanel.llm import words
from gridpanel.sources.scratch import landed

SHORT, LONG = 2, 6
PAD = LONG - 1
GROWN = 50_000
FLOOR = 32
LIST = 2048
TABLED = 64  # bytes of a word up to which its checksum comes from a table
SLICE = 8 << 20
PAIRS = 1 << 21
BEFORE, BEHIND = 1, 2  # marks

LETTERS = np.zeros(256, bool)
LETTERS[0x41:0x5B] = LETTERS[0x61:0x7B] = True
I64 = np.int64


def _crc_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(0xEDB88320), out >> 1)
    return out


_CRC = _crc_table()


def _letter_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of A-Z, a-z and U+00C0 to U+00FF (in UTF-8: C3 and the byte after it)."""
    wide = data == 0xC3
    inside = LETTERS[data] | wide
    inside[1:] |= wide[:-1]
    kind = inside.view(np.uint8)
    return words.spans(kind, offsets, np.array([False, True]))


def _row_checksums(keys: list, most: int) -> np.ndarray:
    """Checksums of "key:" followed by 0, 1, ... zero bytes, rows x lengths, to be combined
    with the checksum of a word of that length."""
    now = np.array([zlib.crc32(f"{'' if k is None else k}:".encode()) for k in keys], np.uint32)
    out = np.empty((len(now), most + 1), np.uint32)
    for n in range(most + 1):
        out[:, n] = now
        now = (now >> np.uint32(8)) ^ _CRC[now & np.uint32(0xFF)]
    return out


def _counted(keys: list, texts: pa.Array, every: int, shortest: int) -> tuple[list[str], list[int]]:
    """Words of some rows and their occurrences, errors made."""
    data, offsets = words.flat(texts)
    data = words.LOWER[data]
    starts, ends, rows = _letter_spans(data, offsets)
    if not len(starts):
        return [], []
    _, first, number = np.unique(words.word_hashes(data, starts, ends), return_index=True, return_inverse=True)
    raw = data.tobytes()
    parts = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())]
    length = ends - starts
    row = np.repeat(np.arange(len(keys)), np.diff(rows))
    check = np.array([zlib.crc32(p) for p in parts], np.uint32)[number]
    short = length <= TABLED
    table = _row_checksums(keys, int(length[short].max(initial=0)))
    check[short] ^= table[row[short], length[short]]
    for i in np.flatnonzero(~short).tolist():
        check[i] = zlib.crc32(parts[number[i]], int(table[row[i], 0]))
    hit = check % np.uint32(every) == 0 if every else np.zeros(len(check), bool)
    counts: dict[str, int] = {}
    whole = np.bincount(number[~hit], minlength=len(parts))
    for i in np.flatnonzero(whole).tolist():
        if len(parts[i]) >= shortest and len(word := parts[i].decode()) >= shortest:
            counts[word] = int(whole[i])
    for i, h in zip(number[hit].tolist(), check[hit].tolist()):
        word = parts[i].decode()
        at = h % len(word)
        if len(word) > shortest:
            word = word[:at] + word[at + 1 :]
            counts[word] = counts.get(word, 0) + 1
    return list(counts), list(counts.values())


def count_words(docs: DataFrame, key: str = "doc_id", text: str = "text", every: int = 97, shortest: int = 5, least: int = 3) -> DataFrame:
    """``word, n`` of words with at least ``shortest`` code points and ``least`` occurrences.

    Where ``every`` divides the checksum (crc32) of "key:word", that word loses, in all its
    occurrences in the row, the code point numbered checksum modulo length; 0 changes none.
    """
    picked = docs.select(F.col(f"`{key}`").cast("string").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            for part in words.slices(batch, "text", SLICE):
                found, n = _counted(part.column("key").to_pylist(), part.column("text"), every, shortest)
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(n, pa.int64())], ["word", "n"])

    counted = picked.mapInArrow(run, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _stream(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Words as one code point a byte, marks around them, a zero behind each; where each
    word's marks begin (and the end)."""
    data, offsets = words.flat(column)
    lead = (data == 0xC3) | (data == 0xC2)
    if (data >= 0xC4).any() or (data <= BEHIND).any():
        raise ValueError("words have code points outside U+0003 to U+00FF")
    points = data.copy()
    points[1:][data[:-1] == 0xC3] |= 0x40
    before = np.concatenate([[0], np.cumsum(lead)])
    length = np.diff(offsets - before[offsets])
    begin = np.concatenate([[0], np.cumsum(length + PAD + 2)]).astype(I64)
    out = np.zeros(begin[-1] + LONG, np.uint8)
    out[words.runs(begin[:-1], np.full(len(length), PAD))] = BEFORE
    out[words.runs(begin[:-1] + PAD, length)] = points[~lead]
    out[begin[1:] - 2] = BEHIND
    return out, begin


def _grown(stream: np.ndarray, grown: np.ndarray, upto: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place, code and length of the longest dictionary gram of up to ``upto`` code points at
    each place, marks behind words excepted. Codes are the gram's bytes as a number."""
    place = np.flatnonzero((stream[:-LONG] > BEHIND) | (stream[:-LONG] == BEFORE))
    wide = stream.astype(I64)
    code = wide[place] << 8 | wide[place + 1]
    length = np.full(len(place), SHORT)
    active = np.arange(len(place))
    for n in range(SHORT, upto):
        if not len(grown):
            break
        at = np.searchsorted(grown, code[active])
        at[at == len(grown)] = 0
        nxt = wide[place[active] + n]
        active = active[(grown[at] == code[active]) & (nxt != 0)]
        code[active] = code[active] << 8 | wide[place[active] + n]
        length[active] = n + 1
    return place, code, length


def dictionary(counted: DataFrame, floor: int = FLOOR, grown: int = GROWN) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the grams that more places hold than the floor, in order, and how many do.
    Those shorter than ``LONG`` are extended."""
    spark = counted.sparkSession
    places = counted.agg(F.sum(F.length("word") + PAD)).first()[0] or 0
    least = max(floor, places // grown)
    codes, counts = np.zeros(0, I64), np.zeros(0, I64)
    for n in range(SHORT, LONG + 1):
        shared = spark.sparkContext.broadcast(codes)

        def run(batches, n=n, shared=shared):
            for batch in batches:
                for part in words.slices(batch, "word", SLICE):
                    _, code, length = _grown(*_stream(part.column("word"))[:1], shared.value, n)
                    code, count = np.unique(code[length == n], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(count)], ["code", "n"])

        level = counted.select("word").mapInArrow(run, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n"))
        found = level.where(F.col("n") > least).toArrow()
        shared.unpersist()
        if not found.num_rows:
            break
        codes = np.concatenate([codes, found.column("code").to_numpy()])
        counts = np.concatenate([counts, found.column("n").to_numpy()])
        order = np.argsort(codes)
        codes, counts = codes[order], counts[order]
    return codes, counts


def _entries(column: pa.Array, codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word number, code, place, length of word) of the grams each word is indexed by."""
    stream, begin = _stream(column)
    extended = codes[codes < 1 << 8 * (LONG - 1)]
    place, code, length = _grown(stream, extended, LONG)
    cover = np.zeros(len(stream) + 1, I64)
    np.add.at(cover, place, 1)
    np.add.at(cover, place + length, -1)
    cover = np.cumsum(cover)[:-1]
    # the places of edits: a word's code points and the mark behind them
    size = np.diff(begin) - PAD - 2
    edits = words.runs(begin[:-1] + PAD, size + 1)
    affected = np.maximum.reduceat(cover[edits], np.cumsum(size + 1) - size - 1) if len(size) else size
    word = np.searchsorted(begin, place, side="right") - 1
    often = np.zeros(len(code), I64)
    if len(codes):
        at = np.searchsorted(codes, code)
        at[at == len(codes)] = 0
        often = np.where(codes[at] == code, counts[at], 0)
    order = np.lexsort((place, code, often, word))
    first = np.cumsum(size + PAD) - size - PAD
    turn = np.arange(len(order)) - np.repeat(first, size + PAD)
    some = order[turn <= np.repeat(affected, size + PAD)]
    return word[some], code[some], place[some] - begin[word[some]], size[word[some]]


def index(counted: DataFrame, codes: np.ndarray, counts: np.ndarray) -> DataFrame:
    """``code, place, length, longer, word``: each word's entries."""
    shared = counted.sparkSession.sparkContext.broadcast((codes, counts))

    def run(batches):
        for batch in batches:
            for part in words.slices(batch, "word", 1 << 19):
                column = part.column("word")
                word, code, place, size = _entries(column, *shared.value)
                right = place > 0
                number = np.concatenate([word, word, word[right]])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([code, code, code[right]])),
                        pa.array(np.concatenate([place, place, place[right] - 1]).astype(np.int32)),
                        pa.array(np.concatenate([size, size - 1, size[right] - 1]).astype(np.int32)),
                        pa.array(np.arange(len(number)) >= len(word)),
                        column.take(pa.array(number)),
                    ],
                    ["code", "place", "length", "longer", "word"],
                )

    return counted.select("word").mapInArrow(run, "code bigint, place int, length int, longer boolean, word string")


def _one_edit(stream: np.ndarray, begin: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs of words (b as long as a or longer by one) differ by one edit."""
    left, right = begin[a] + PAD, begin[b] + PAD
    size_a, size_b = begin[a + 1] - 2 - left, begin[b + 1] - 2 - right
    head = np.zeros(len(a), I64)
    active = np.arange(len(a))
    while len(active):  # ends at the marks behind, or at a difference
        n = head[active]
        active = active[(stream[left[active] + n] == stream[right[active] + n]) & (n < size_a[active])]
        head[active] += 1
    rest = size_a - head - (size_a == size_b)  # code points of a behind the edit
    fine = np.flatnonzero((rest >= 0) & (size_b - size_a <= 1) & (size_b >= size_a))
    same, tail = np.zeros(len(a), bool), np.zeros(len(a), I64)
    active = fine
    while len(active):
        n = tail[active]
        over = n >= rest[active]
        same[active[over]] = True
        active, n = active[~over], n[~over]
        active = active[stream[left[active] + size_a[active] - 1 - n] == stream[right[active] + size_b[active] - 1 - n]]
        tail[active] += 1
    return same


def _near(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """Near pairs of a run of whole cells, entries of a cell side by side, longer ones last."""
    column = table.column("word").combine_chunks()
    stream, begin = _stream(column)
    cell = np.cumsum(table.column("first").to_numpy()) - 1
    behind = np.searchsorted(cell, cell, side="right")
    at = np.arange(len(cell))
    shorter = ~table.column("longer").to_numpy(zero_copy_only=False)
    count = np.where(shorter, behind - at - 1, 0)
    side = table.column("side").to_numpy()
    total, begin_at = np.cumsum(count), 0
    while begin_at < len(at):
        done = total[begin_at - 1] if begin_at else 0
        to = max(int(np.searchsorted(total, done + PAIRS, side="right")), begin_at + 1)
        some = at[begin_at:to]
        a = np.repeat(some, count[some])
        b = words.runs(some + 1, count[some])
        apart = side[a] != side[b]
        apart |= side[a] == 0
        a, b = a[apart], b[apart]
        near = _one_edit(stream, begin, a, b)
        a, b = a[near], b[near]
        yield pa.RecordBatch.from_arrays([column.take(pa.array(a)), column.take(pa.array(b))], ["a", "b"])
        begin_at = to


def _cells(entries: DataFrame, longest: int) -> DataFrame:
    """Entries with the ``block`` of the cell they go to and their ``side`` in it. A list up
    to ``longest`` is a cell (side 0). A longer one has a cell for every two of its blocks, in which
    entries of one block (side 1) meet those of another (side 2), and one for each block by itself."""
    keys = ["code", "place", "length"]
    long = landed(entries.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > longest), "long-lists")
    plain = F.array(F.struct(F.lit(0).alias("block"), F.lit(0).alias("side")))
    if long.isEmpty():
        return entries.withColumn("to", F.explode(plain)).select(*keys, "longer", "word", "to.*")
    blocks = F.ceil(F.col("n") / F.lit(longest)).cast("int")
    own = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")
    cells = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda other: F.struct(
            (F.least(F.col("own"), other) * F.col("blocks") + F.greatest(F.col("own"), other) + 1).alias("block"),
            F.when(F.col("own") == other, 0).when(F.col("own") < other, 1).otherwise(2).alias("side"),
        ),
    )
    dealt = entries.join(long, keys, "left").withColumn("blocks", blocks).withColumn("own", own)
    dealt = dealt.withColumn("to", F.explode(F.when(F.col("n").isNull(), plain).otherwise(cells)))
    return dealt.select(*keys, "longer", "word", "to.*")


def near_pairs(counted: DataFrame, floor: int = FLOOR, grown: int = GROWN, longest: int = LIST) -> DataFrame:
    """``a, b``: all pairs of words (a column ``word`` of different words) one edit apart, once each."""
    entries = index(counted, *dictionary(counted, floor, grown))
    cells = _cells(landed(entries, "gram-lists"), longest)
    keys = ["code", "place", "length", "block"]

    def run(batches):
        held, size, last = [], 0, None
        for batch in batches:
            columns = [batch.column(k).to_numpy() for k in keys]
            first = np.ones(batch.num_rows, bool)
            first[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
            now = tuple(c[-1] for c in columns) if batch.num_rows else last
            if batch.num_rows and last == tuple(c[0] for c in columns):
                first[0] = False
            last = now
            part = pa.table({n: batch.column(n) for n in ("longer", "word", "side")} | {"first": pa.array(first.astype(np.int64))})
            cut = np.flatnonzero(first)
            if size >= PAIRS // 8 and len(cut):
                yield from _near(pa.concat_tables([*held, part.slice(0, cut[-1])]))
                held, size = [part.slice(cut[-1])], 0
            else:
                held.append(part)
            size += batch.num_rows
        if size:
            yield from _near(pa.concat_tables(held))

    dealt = cells.repartition(*keys).sortWithinPartitions(*keys, "longer")
    found = dealt.mapInArrow(run, "a string, b string")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of words that have a form. A form is at least twice as frequent, so a
    chain has no more than 63 steps, and each round doubles those taken."""
    steps = landed(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        onward = steps.select(F.col("word").alias("root"), F.col("root").alias("far"))
        steps = landed(steps.join(onward, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), "roots")
        if steps.where("moved").isEmpty():
            return steps.select("word", "root")


def variants(counted: DataFrame, ratio: int = 2, **index_settings: int) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for each of the ``word, n``."""
    counted = landed(counted, "words")
    pairs = landed(near_pairs(counted, **index_settings), "near-pairs")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near")))
    known = both.join(counted.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = known.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), "near")).alias("best"))
    enough = -F.col("best.n") >= ratio * F.col("n")
    judged = landed(
        counted.join(best, "word", "left").select(
            "word", F.when(enough, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(enough, -F.col("best.n")).alias("form_n"),
        ),
        "variants",
    )
    rooted = judged.join(_roots(judged.where(F.col("form").isNotNull())), "word", "left")
    return rooted.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
