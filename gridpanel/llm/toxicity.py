"""Severity of toxic language by cumulative-link ordinal regression.

Labels say toxic or not. Words and beginnings of words (``PREFIXES`` bytes) that are telling
(chi-square of their documents, over all labelled rows of the fit) become sparse features,
log(1 + count in 100 words). Toxic rows are graded 1 to ``GRADES`` by how many telling
features they hold in 100 words, in equal shares; others are grade 0.
One weight vector serves all thresholds: P(grade <= k) = sigmoid(t_k - w x), with rising
t_k. A document gets the probability of each grade and the expected severity.

The fit uses at most ``SAMPLE`` labelled keys, the ones with the smallest key hash, and one document
of each: a bounded sample of fixed size, stored. A key that is labelled more than once is toxic if any of its labels says so;
of documents that share a key the one with the smallest text counts. All documents are scored, whole, repeated
rows alike. Null text has no words; null keys and labels that are null take no part in the fit; ties among telling
words go by their hash. Without labelled rows of both kinds, in empty tables for one, nothing is toxic.
Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridpanel.llm import words
from gridpanel.llm.workers import in_small_batches, lean
from gridpanel.sources.scratch import landed

SAMPLE = 20_000
FEATURES = 256
SLICE = 1 << 20  # bytes of text worked on at once
MIN_ROWS = 3
MIN_SCORE = 15.0  # chi-square; chance alone gives this to one word in ten thousand
PREFIXES = (4, 5, 6, 7, 8)
GRADES = 3
RESULT = "struct<severity:double,grade:int,p_toxic:double,probabilities:array<double>>"


@dataclass
class Model:
    features: np.ndarray  # sorted word hashes
    weights: np.ndarray
    thresholds: np.ndarray  # rising; one fewer than grades

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """P(grade = 0 ... GRADES) of rows of feature values."""
        return self.of_scores(x @ self.weights)

    def of_scores(self, scores: np.ndarray) -> np.ndarray:
        below = 1 / (1 + np.exp(np.clip(scores[:, None] - self.thresholds, -50, 50)))
        edges = np.concatenate([np.zeros((len(scores), 1)), below, np.ones((len(scores), 1))], axis=1)
        return np.diff(edges, axis=1)


def _hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and row of every word and of its beginnings; each row's number of words."""
    data, offsets = words.flat(texts)
    data = words.LOWER[data]
    starts, ends, rows = words.spans(data, offsets, words.ALNUM)
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    hashes, at = [words.word_hashes(data, starts, ends)], [row]
    for n in PREFIXES:
        longer = np.flatnonzero(ends - starts > n)
        head = words.word_hashes(data, starts[longer], starts[longer] + n)
        hashes.append(words.mix(head + words.U64(n)))
        at.append(row[longer])
    return np.concatenate(hashes).view(np.int64), np.concatenate(at), np.diff(rows)


def _values(texts: pa.Array, features: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, feature and value of the features that occur."""
    hashes, row, n_words = _hashed(texts)
    if not len(features) or not len(hashes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    at = np.searchsorted(features, hashes)
    at[at == len(features)] = 0
    hit = np.flatnonzero(features[at] == hashes)
    pair, count = np.unique(row[hit] * len(features) + at[hit], return_counts=True)
    row = pair // len(features)
    return row, pair % len(features), np.log1p(100 * count / n_words[row])


def _distinct_words(sample: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            for part in words.slices(batch, "text", SLICE):
                hashes, row, _ = _hashed(part.column("text"))
                seen = np.unique(np.rec.fromarrays([row, hashes], names="row,word"))
                toxic = part.column("toxic").take(pa.array(seen["row"].astype(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(seen["word"].astype(np.int64)), toxic], ["word", "toxic"])

    return sample.mapInArrow(run, "word bigint, toxic int")


def _telling(sample: DataFrame, n_toxic: int, n_clean: int) -> np.ndarray:
    """The features: words whose rows differ most from what chance would give."""
    in_toxic, in_clean = F.sum("toxic"), F.sum(1 - F.col("toxic"))
    counted = _distinct_words(sample).groupBy("word").agg(in_toxic.alias("a"), in_clean.alias("b"))
    c, d = F.lit(float(n_toxic)) - F.col("a"), F.lit(float(n_clean)) - F.col("b")
    n = float(n_toxic + n_clean)
    score = n * F.pow(F.col("a") * d - F.col("b") * c, F.lit(2.0)) / (
        n_toxic * n_clean * (F.col("a") + F.col("b")) * F.greatest(c + d, F.lit(1.0))
    )
    more = F.col("a") * n_clean > F.col("b") * n_toxic
    picked = counted.where(more & (F.col("a") >= MIN_ROWS)).withColumn("score", score)
    top = picked.where(F.col("score") >= MIN_SCORE).orderBy(F.desc("score"), "word").limit(FEATURES).collect()
    return np.sort(np.array([r["word"] for r in top], np.int64))


def fit_ordinal(x: np.ndarray, grades: np.ndarray, n_grades: int, steps: int = 400, rate: float = 0.1, l2: float = 1e-4):
    """Weights and rising thresholds by full-batch Adam on the mean log loss."""
    n = len(x)
    share = np.array([(grades <= k).mean() for k in range(n_grades)]).clip(1e-4, 1 - 1e-4)
    start = np.log(share / (1 - share))
    gaps = np.log(np.maximum(np.diff(start), 1e-2))
    params = np.concatenate([np.zeros(x.shape[1]), start[:1], gaps])
    m, v = np.zeros_like(params), np.zeros_like(params)
    d = x.shape[1]
    for step in range(1, steps + 1):
        w, first, raw = params[:d], params[d], params[d + 1 :]
        widths = np.exp(raw)
        t = first + np.concatenate([[0.0], np.cumsum(widths)])
        below = 1 / (1 + np.exp(np.clip((x @ w)[:, None] - t, -50, 50)))
        edges = np.concatenate([np.zeros((n, 1)), below, np.ones((n, 1))], axis=1)
        slopes = edges * (1 - edges)
        p = np.maximum(np.take_along_axis(edges, grades[:, None] + 1, 1) - np.take_along_axis(edges, grades[:, None], 1), 1e-9)
        up = np.take_along_axis(slopes, grades[:, None] + 1, 1) / p
        down = np.take_along_axis(slopes, grades[:, None], 1) / p
        # d log p / d score and d log p / d each threshold
        by_score = (down - up)[:, 0]
        by_t = np.zeros((n, n_grades + 2))
        np.put_along_axis(by_t, grades[:, None] + 1, up, 1)
        rows = np.arange(n)
        by_t[rows, grades] -= down[:, 0]
        g_t = by_t[:, 1:-1].mean(0)
        tail = np.cumsum(g_t[::-1])[::-1]
        gradient = np.concatenate([x.T @ by_score / n - l2 * w, tail[:1], tail[1:] * widths])
        m = 0.9 * m + 0.1 * gradient
        v = 0.999 * v + 0.001 * gradient**2
        params = params + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    w, first, raw = params[:d], params[d], params[d + 1 :]
    return w, first + np.concatenate([[0.0], np.cumsum(np.exp(raw))])


@in_small_batches
def fit(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE
) -> Model:
    """Fit on the labelled rows of ``docs``, one for each of ``sample`` keys at most."""
    lean(docs.sparkSession)
    named = labels.select(F.col(f"`{key}`").alias("key"), F.col(f"`{label}`").cast("int").alias("toxic"))
    named = named.where("toxic in (0, 1) and key is not null").groupBy("key").agg(F.max("toxic").alias("toxic"))
    named = named.orderBy(F.xxhash64("key"), "key").limit(sample)
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    # at most ``sample`` rows, so this side is small whatever the tables are
    held = docs.select(F.col(f"`{key}`").alias("key"), t.alias("text")).join(F.broadcast(named), "key")
    rows = landed(held.groupBy("key", "toxic").agg(F.min("text").alias("text")).select("text", "toxic"), "labelled")
    sizes = dict(rows.groupBy("toxic").count().collect())
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    never = Model(np.zeros(0, np.int64), np.zeros(0), np.linspace(20, 22, GRADES))
    if not n_toxic or not n_clean:
        return never
    features = _telling(rows, n_toxic, n_clean)
    if not len(features):
        return never

    def values(batches):
        for batch in batches:
            for part in words.slices(batch, "text", SLICE):
                row, feature, value = _values(part.column("text"), features)
                ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=part.num_rows))]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (feature.astype(np.int32), value)]
                yield pa.RecordBatch.from_arrays([part.column("toxic"), *lists], ["toxic", "feature", "value"])

    got = rows.mapInArrow(values, "toxic int, feature array<int>, value array<double>").collect()
    got.sort(key=lambda r: (r["toxic"], r["feature"], r["value"]))
    x = np.zeros((len(got), len(features)))
    for i, r in enumerate(got):
        x[i, r["feature"]] = r["value"]
    toxic = np.array([r["toxic"] for r in got])
    weights, thresholds = fit_ordinal(x, graded(x, toxic), GRADES)
    return Model(features, weights, thresholds)


def graded(x: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """0 for rows that are not toxic, 1 to ``GRADES`` for the others."""
    held = np.expm1(x).sum(1)
    cuts = np.quantile(held[toxic == 1], np.arange(1, GRADES) / GRADES)
    return np.where(toxic == 1, 1 + np.searchsorted(cuts, held, side="left"), 0)


def severity(model: Model, text: Column) -> Column:
    """Expected severity, likeliest grade, P(grade > 0) and all grades' probabilities."""

    @F.arrow_udf(RESULT)
    def scored(texts: pa.Array) -> pa.Array:
        one = pa.record_batch([texts], ["text"])
        parts = []
        for part in words.slices(one, "text", SLICE):
            row, feature, value = _values(part.column("text"), model.features)
            parts.append(np.bincount(row, value * model.weights[feature], part.num_rows))
        p = model.of_scores(np.concatenate(parts) if parts else np.zeros(0))
        n, k = p.shape
        flat = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * k), pa.array(p.ravel()))
        return pa.StructArray.from_arrays(
            [pa.array(p @ np.arange(k)), pa.array(p.argmax(1).astype(np.int32)), pa.array(1 - p[:, 0]), flat],
            ["severity", "grade", "p_toxic", "probabilities"],
        )

    return scored(F.coalesce(text.cast("string"), F.lit("")))
