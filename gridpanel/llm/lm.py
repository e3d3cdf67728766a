"""Log-likelihood of documents under a gated recurrent model learned from the corpus.

1. Words of all training documents are counted, exactly, by their 64-bit hash.
2. The ``WORDS`` most frequent tokens, one for all other words and the document's end
   make the model's vocabulary. Every task trains a copy of the model over its own
   training documents by truncated backpropagation; copies are averaged by tokens. A
   first round takes an eighth of the documents, so that the copies of the second, over
   all of them, start close together.
3. Every document is scored whole. A word outside the vocabulary has the probability of
   "other" times its smoothed share among the other words, so scores are probabilities
   of texts. Frequent words' counts (up to ``HEAD`` words) are broadcast, the others' are
   brought by a join on the word.

The unigram score uses the same counts: (c + 0.5) / (N + 0.5 (V + 1)), with the end as a
token. Null text is empty: an end alone. A null key counts as training. Repeated rows are
learned from and scored one by one. Texts may be of any length: states are carried from window to
window. Other columns, whatever their names, are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridpanel.llm import gru, words
from gridpanel.sources.scratch import landed

WORDS = 1022
HEAD = 1 << 19
POOL = 1 << 21
CHUNKS = 8
SCORED = (
    "row bigint, key {key}, held_out boolean, n_tokens bigint, known bigint, base double, "
    "other double, n_other bigint, model double, tail array<bigint>"
)


def _hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = words.flat(texts)
    data = words.LOWER[data]
    starts, ends, rows = words.spans(data, offsets, words.SPACED)
    return words.word_hashes(data, starts, ends).view(np.int64), rows


def count_words(texts: DataFrame) -> DataFrame:
    """``word, n``: how often each word (by hash) occurs in the column ``text``."""

    def counted(seen):
        word, n = np.unique(np.concatenate(seen), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(word), pa.array(n)], ["word", "n"])

    def run(batches):
        seen, size = [], 0
        for batch in batches:
            for part in words.slices(batch, "text"):
                seen.append(_hashed(part.column("text"))[0])
                size += len(seen[-1])
                if size >= POOL:
                    yield counted(seen)
                    seen, size = [], 0
        if size:
            yield counted(seen)

    partial = texts.select("text").mapInArrow(run, "word bigint, n bigint")
    return partial.groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """Frequent words in order of their hash, with their counts and model numbers."""

    word: np.ndarray
    count: np.ndarray
    number: np.ndarray
    numbers: np.ndarray  # counts by model number, falling
    other: int
    end: int
    train_docs: int
    train_tokens: int
    distinct: int
    other_mass: float
    least: int  # counts below this are not in ``word``

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each word's place here, and whether it is here."""
        at = np.searchsorted(self.word, hashes)
        at[at == len(self.word)] = 0
        return at, (self.word[at] == hashes) if len(self.word) else np.zeros(len(hashes), bool)


def vocabulary(counts: DataFrame, train_docs: int) -> Vocabulary:
    """From a stored table of counts; at most ``HEAD`` words come to the driver."""
    level = F.floor(F.log2("n") * 16)
    levels = counts.groupBy(level.alias("level")).agg(F.count("*").alias("words"), F.sum("n").alias("n"), F.min("n").alias("least"))
    rows = sorted(levels.collect(), key=lambda r: -r["level"])
    total, distinct = sum(r["n"] for r in rows), sum(r["words"] for r in rows)
    held, least = 0, 1
    for r in rows:
        held += r["words"]
        if held > HEAD:
            break
        least = r["least"]
    else:
        least = 1
    if rows and held > HEAD and rows[0]["words"] > HEAD:
        least = rows[0]["least"] + 1
    head = counts.where(F.col("n") >= least).toArrow().sort_by("word")
    word, count = head.column("word").to_numpy(), head.column("n").to_numpy()
    top = np.lexsort((word, -count))[:WORDS]
    other_count = total - int(count[top].sum())
    listed = [(int(count[i]), 2, i) for i in top.tolist()] + [(other_count, 1, -1), (train_docs, 0, -1)]
    listed.sort(key=lambda x: (-x[0], -x[1], x[2]))
    other = next(i for i, x in enumerate(listed) if x[1] == 1)
    end = next(i for i, x in enumerate(listed) if x[1] == 0)
    number = np.full(len(word), other, np.int32)
    for i, (_, kind, at) in enumerate(listed):
        if kind == 2:
            number[at] = i
    return Vocabulary(
        word, count, number, np.array([x[0] for x in listed], np.float64), other, end, train_docs,
        total + train_docs, distinct + (train_docs > 0), other_count + 0.5 * (distinct - len(top)) + 0.5, least,
    )


def _pools(batches, column: str, pool: int) -> Iterator[tuple[list[pa.RecordBatch], list[np.ndarray], list[np.ndarray]]]:
    """Rows of a partition in groups of about ``pool`` words: batches, word hashes, offsets."""
    parts, hashes, offsets, size = [], [], [], 0
    for batch in batches:
        for part in words.slices(batch, column):
            h, rows = _hashed(part.column(column))
            parts.append(part)
            hashes.append(h)
            offsets.append(rows)
            size += len(h) + part.num_rows
            if size >= pool:
                yield parts, hashes, offsets
                parts, hashes, offsets, size = [], [], [], 0
    if parts:
        yield parts, hashes, offsets


def _with_ends(numbers: np.ndarray, rows: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens with an end behind each row, and their offsets."""
    n = len(rows) - 1
    out = np.full(len(numbers) + n, end, np.int32)
    offsets = rows + np.arange(n + 1)
    out[words.runs(offsets[:-1], np.diff(rows))] = numbers
    return out, offsets


def _joined(hashes: list[np.ndarray], offsets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    base = np.cumsum([0, *[len(h) for h in hashes]])
    rows = np.concatenate([[0], *[o[1:] + b for o, b in zip(offsets, base)]])
    return np.concatenate(hashes), rows


def train(texts: DataFrame, vocab: Vocabulary, start: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The mean, by tokens, of copies of the model that each task trained on its rows."""
    shared = texts.sparkSession.sparkContext.broadcast((vocab, start))

    def run(batches):
        known, first = shared.value
        trainer, done = gru.Trainer(first), 0
        for _, hashes, offsets in _pools(batches, "text", 2 * POOL):
            h, rows = _joined(hashes, offsets)
            at, here = known.find(h)
            numbers = np.where(here, known.number[at], known.other) if len(h) else np.zeros(0, np.int32)
            tokens, ends = _with_ends(numbers, rows, known.end)
            streams = int(np.clip(len(tokens) // (256 * gru.WINDOW), 8, gru.STREAMS))
            done += trainer.documents(tokens, ends, known.end, streams)
        if done:
            flat = np.frombuffer(gru.packed(trainer.p), "<f4").astype(np.float64) * done
            parts = [x.tobytes() for x in np.array_split(flat, CHUNKS)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(CHUNKS), pa.int32()), pa.array([float(done)] * CHUNKS), pa.array(parts, pa.binary())],
                ["chunk", "tokens", "values"],
            )

    schema = "chunk int, tokens double, values binary"

    def added(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, values = 0.0, 0.0
        for batch in batches:
            for n, raw in zip(batch.column("tokens").to_pylist(), batch.column("values")):
                tokens, values = tokens + n, values + np.frombuffer(raw.as_buffer(), np.float64)
        yield pa.RecordBatch.from_arrays(
            [pa.array([key[0].as_py()], pa.int32()), pa.array([tokens]), pa.array([values.tobytes()], pa.binary())],
            ["chunk", "tokens", "values"],
        )

    sums = texts.select("text").mapInArrow(run, schema).groupBy("chunk").applyInArrow(added, schema).collect()
    if not sums:
        return start
    sums.sort(key=lambda r: r["chunk"])
    flat = np.concatenate([np.frombuffer(r["values"], np.float64) / r["tokens"] for r in sums])
    return gru.unpacked(flat, start)


def _scored(docs: DataFrame, vocab: Vocabulary, model: dict[str, np.ndarray]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast((vocab, model))

    def run(batches):
        known, params = shared.value
        row = TaskContext.get().partitionId() << 40
        for parts, hashes, offsets in _pools(batches, "text", POOL):
            h, rows = _joined(hashes, offsets)
            at, here = known.find(h)
            count = np.where(here, known.count[at], 0) if len(known.count) else np.zeros(len(h), np.int64)
            numbers = np.where(here, known.number[at], known.other) if len(known.count) else np.full(len(h), known.other)
            logs = np.where(here, np.log10(count + 0.5), 0.0)
            other = numbers == known.other
            sums = lambda x: np.diff(np.concatenate([[0.0], np.cumsum(x)])[rows])
            tokens, ends = _with_ends(numbers, rows, known.end)
            model_score = gru.score(params, tokens, ends, known.end) / np.log(10)
            n = len(rows) - 1
            tail_rows = np.concatenate([[0], np.cumsum(~here)])[rows].astype(np.int32)
            tail = pa.ListArray.from_arrays(pa.array(tail_rows), pa.array(h[~here]))
            own = pa.Table.from_batches(parts).combine_chunks()
            columns = [
                pa.array(np.arange(row, row + n)), own.column("key"), own.column("held_out"),
                pa.array(np.diff(rows) + 1), pa.array(sums(here).astype(np.int64) + (known.train_docs > 0)),
                pa.array(sums(logs) + np.log10(known.train_docs + 0.5)), pa.array(sums(logs * other)),
                pa.array(sums(other).astype(np.int64)), pa.array(model_score), tail,
            ]
            row += n
            names = ["row", "key", "held_out", "n_tokens", "known", "base", "other", "n_other", "model", "tail"]
            yield from pa.Table.from_arrays(columns, names).to_batches(max_chunksize=4096)

    return docs.mapInArrow(run, SCORED.format(key=docs.schema["key"].dataType.simpleString()))


def log_likelihood(docs: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, held_out, n_tokens, n_known, train_tokens, base_score, score`` (log10) of
    every document; the model learns from those that ``held_out`` does not pick."""
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    picked = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(held_out, F.lit(False)).alias("held_out"), t.alias("text"))
    training = picked.where(~F.col("held_out"))
    counts = landed(count_words(training), "word-counts")
    vocab = vocabulary(counts, training.count())
    model = gru.start(vocab.numbers)
    eighth = F.pmod(F.xxhash64("key"), F.lit(8)) == 0
    for part in (training.where(eighth), training):
        model = train(part, vocab, model)
    scored = landed(_scored(picked, vocab, model), "scored")
    rare = counts.where(F.col("n") < vocab.least)
    tail = scored.select("row", F.explode("tail").alias("word")).join(rare, "word", "left")
    by_row = tail.groupBy("row").agg(
        F.sum(F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("tail_logs"), F.count("n").alias("tail_known")
    )
    joined = scored.drop("tail").join(by_row, "row", "left").fillna(0, ["tail_logs", "tail_known"])
    whole = float(np.log10(vocab.train_tokens + 0.5 * (vocab.distinct + 1)))
    others = float(np.log10(vocab.other_mass))
    return joined.select(
        "key",
        "held_out",
        "n_tokens",
        (F.col("known") + F.col("tail_known")).alias("n_known"),
        F.lit(vocab.train_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("tail_logs") - F.col("n_tokens") * whole).alias("base_score"),
        (F.col("model") + F.col("other") + F.col("tail_logs") - F.col("n_other") * others).alias("score"),
    )
