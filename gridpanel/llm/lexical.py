"""Ranked lexical search of many items at once, sharing work between the items.

1. The different terms of every item are found, and items dealt to blocks of about
   ``BLOCK_TERMS`` (item, term) entries, items with the same least term hash side by side.
2. In a block, terms of the same set of items make one shared term set (a leaf). Pairs of
   nodes that most items hold together are joined to a new node, again and again while two
   items or more share a pair: a directed acyclic graph in which every item is the sum of
   its remaining nodes (``share``).
3. One pass over the documents counts N, L and each listed term's documents.
4. A second pass scores: for a run of documents, the score of each leaf is summed once,
   inner nodes are added up from their two children in the graph's order, and items from
   their nodes. Scores are 64-bit integers, so sums may be taken in any order.
   Each task keeps the k best of every item; the best of all tasks are the result.

Blocks are taken in rounds of up to ``ROUND_TERMS`` entries, a bound on what is broadcast;
the documents are read twice a round. A document costs a row only where it is among a task's best.

Terms are known by 64-bit hashes of their bytes. Null texts have no terms. Rows that repeat
an item's id (or have a null id) are one item with the terms of all of them. Rows that
repeat a document's id are documents of their own; ties go to the smaller id, null last. Items
without terms and empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridpanel.llm import words
from gridpanel.sources.scratch import landed

BLOCK_TERMS = 8192
ROUND_TERMS = 1 << 20
CELLS = 4 << 20  # accumulators held at a time: nodes x documents
HELD = 1 << 16  # rows a task adds, at least, before it keeps the best of them
SALTS = 64


def _terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = words.flat(texts)
    data = words.LOWER[data]
    starts, ends, rows = words.spans(data, offsets, words.ALNUM)
    return words.word_hashes(data, starts, ends).view(np.int64), rows


def item_terms(items: DataFrame, item: str, text: str) -> DataFrame:
    """``item, term``: the different terms of each item."""
    picked = items.select(F.col(f"`{item}`").alias("item"), F.col(f"`{text}`").cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            for part in words.slices(batch, "text"):
                terms, rows = _terms(part.column("text"))
                of = np.repeat(np.arange(part.num_rows), np.diff(rows))
                yield pa.RecordBatch.from_arrays([part.column("item").take(pa.array(of)), pa.array(terms)], ["item", "term"])

    kind = picked.schema["item"].dataType.simpleString()
    return picked.mapInArrow(run, f"item {kind}, term bigint").distinct()


def share(sets: list[list[int]]) -> tuple[list[tuple[int, int]], list[list[int]]]:
    """Sums that sets have in common: new nodes as pairs of earlier ones (numbered on from
    the largest member), and the nodes that each set is the sum of."""
    left = [set(s) for s in sets]
    number = max((x for s in left for x in s), default=-1) + 1
    holders: dict[int, set[int]] = defaultdict(set)
    for i, s in enumerate(left):
        for x in s:
            holders[x].add(i)
    together: Counter = Counter()
    for s in left:
        own = sorted(x for x in s if len(holders[x]) > 1)
        together.update((a, b) for i, a in enumerate(own) for b in own[i + 1 :])
    heap = [(-n, pair) for pair, n in together.items() if n > 1]
    heapify(heap)
    made = []
    while heap:
        n, (a, b) = heappop(heap)
        both = holders[a] & holders[b]
        if len(both) < 2:
            continue
        if -n != len(both):  # counted before a or b went into another node
            heappush(heap, (-len(both), (a, b)))
            continue
        made.append((a, b))
        near: Counter = Counter()
        for i in both:
            left[i] -= {a, b}
            near.update(x for x in left[i] if len(holders[x]) > 1)
            left[i].add(number)
        holders[a] -= both
        holders[b] -= both
        holders[number] = set(both)
        for x, count in near.items():
            if count > 1:
                heappush(heap, (-count, (x, number)))
        number += 1
    return made, [sorted(s) for s in left]


@dataclass
class Plan:
    """A block's graph: leaves 0 to ``leaves`` - 1, inner nodes, and each item's nodes."""

    items: pa.Array
    terms: np.ndarray  # by leaf_of
    leaf_of: np.ndarray
    leaves: int
    inner: list[tuple[int, int]]
    sums: list[list[int]]


def plan(entries: pa.Table) -> Plan:
    """From a block's ``place, item, term`` entries."""
    entries = entries.sort_by([("place", "ascending"), ("term", "ascending")])
    place = entries.column("place").to_numpy()
    first = np.flatnonzero(np.diff(place, prepend=-1))
    terms, number = np.unique(entries.column("term").to_numpy(), return_inverse=True)
    held: list[list[int]] = [[] for _ in terms]
    for i, (a, b) in enumerate(zip(first, [*first[1:], len(place)])):
        for t in number[a:b].tolist():
            held[t].append(i)
    leaf_of, known = np.empty(len(terms), np.int64), {}
    for t, who in enumerate(held):
        leaf_of[t] = known.setdefault(tuple(who), len(known))
    sets: list[list[int]] = [[] for _ in first]
    for who, leaf in known.items():
        for i in who:
            sets[i].append(leaf)
    # leaves of one item each stay as they are; shared ones are joined
    inner, sums = share(sets)
    return Plan(entries.column("item").combine_chunks().take(pa.array(first)), terms, leaf_of, len(known), inner, sums)


def accumulate(graph: Plan, leaf: np.ndarray, doc: np.ndarray, score: np.ndarray, docs: int) -> np.ndarray:
    """Scores, items x documents, from (leaf, document, score) entries."""
    nodes = np.zeros((graph.leaves + len(graph.inner), docs), np.int64)
    np.add.at(nodes, (leaf, doc), score)
    for n, (a, b) in enumerate(graph.inner, graph.leaves):
        np.add(nodes[a], nodes[b], out=nodes[n])
    return np.array([nodes[s].sum(0) for s in graph.sums]).reshape(len(graph.sums), docs)


def _counts(batch: pa.RecordBatch, listed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms of each document, and (document, listed term, occurrences) entries."""
    terms, rows = _terms(batch.column("text"))
    of = np.repeat(np.arange(batch.num_rows), np.diff(rows))
    if not len(listed):
        return np.diff(rows), *[np.zeros(0, np.int64)] * 3
    at = np.searchsorted(listed, terms)
    at[at == len(listed)] = 0
    here = listed[at] == terms
    both, tf = np.unique(of[here] * len(listed) + at[here], return_counts=True)
    return np.diff(rows), both // len(listed), both % len(listed), tf


def corpus_counts(texts: DataFrame, listed: np.ndarray) -> tuple[int, int, np.ndarray]:
    """N, L and the documents of each listed term (in the order of its hash)."""
    shared = texts.sparkSession.sparkContext.broadcast(listed)

    def run(batches):
        known = shared.value
        found = np.zeros(len(known) + 2, np.int64)
        for batch in batches:
            for part in words.slices(batch, "text"):
                n, _, term, _ = _counts(part, known)
                found[:-2] += np.bincount(term, minlength=len(known))
                found[-2:] += (int((n > 0).sum()), int(n.sum()))
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(found[some])], ["place", "n"])

    rows = texts.mapInArrow(run, "place bigint, n bigint").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(listed) + 2, np.int64)
    out[rows.column("place").to_numpy()] = rows.column("n").to_numpy()
    shared.unpersist()
    return int(out[-2]), int(out[-1]), out[:-2]


def _best(held: list[pa.Table], k: int) -> pa.Table:
    """The k best rows of each item."""
    table = pa.concat_tables(held).sort_by([("place", "ascending"), ("score", "descending"), ("key", "ascending")])
    place = table.column("place").to_numpy()
    first = np.flatnonzero(np.diff(place, prepend=-1))
    turn = np.arange(len(place)) - np.repeat(first, np.diff([*first, len(place)]))
    return table.filter(pa.array(turn < k))


def _searched(docs: DataFrame, plans: list[Plan], n_docs: int, n_terms: int, listed: np.ndarray, df: np.ndarray, k: int, item_type: str) -> DataFrame:
    """``item, key, score``: at least the k best of each item, from each task."""
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for n in df.tolist()], np.int64)
    shared = docs.sparkSession.sparkContext.broadcast((plans, listed, weights))

    def run(batches):
        graphs, known, weight = shared.value
        leaf_of = []
        for g in graphs:
            leaf = np.full(len(known), -1, np.int64)
            leaf[np.searchsorted(known, g.terms)] = g.leaf_of
            leaf_of.append(leaf)
        base = np.cumsum([0, *[len(g.items) for g in graphs]])
        items = pa.concat_arrays([g.items for g in graphs])
        kth = np.ones(base[-1], np.int64)
        run_of = max(1, CELLS // max(g.leaves + len(g.inner) + len(g.items) for g in graphs))
        held, size, most = [], 0, max(HELD, k * len(items))

        def kept():
            best = _best(held, k)
            place, score = best.column("place").to_numpy(), best.column("score").to_numpy()
            last = np.flatnonzero(np.diff(place, append=-1))
            full = last[np.bincount(place, minlength=len(kth))[place[last]] == k]
            kth[place[full]] = score[full]
            return best

        for batch in batches:
            for part in words.slices(batch, "text"):
                for at in range(0, part.num_rows, run_of):
                    some = part.slice(at, run_of)
                    n, doc, term, tf = _counts(some, known)
                    m = 100 - 90 + (90 * n * n_docs) // max(n_terms, 1)
                    score = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
                    for graph, leaf, a, b in zip(graphs, leaf_of, base, base[1:]):
                        own = leaf[term]
                        mine = own >= 0
                        scores = accumulate(graph, own[mine], doc[mine], score[mine], some.num_rows)
                        place, row = np.nonzero(scores >= kth[a:b, None])
                        if len(place):
                            keys = some.column("key").take(pa.array(row))
                            held.append(pa.table({"place": pa.array(place + a), "key": keys, "score": pa.array(scores[place, row])}))
                            size += len(place)
                    if size > most:
                        held, size = [kept()], 0
        if held:
            for found in kept().to_batches():
                yield pa.RecordBatch.from_arrays(
                    [items.take(found.column("place")), found.column("key"), found.column("score")], ["item", "key", "score"]
                )

    key_type = docs.schema["key"].dataType.simpleString()
    return docs.mapInArrow(run, f"item {item_type}, key {key_type}, score bigint")


def _top(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each item; first of each item and salt, so that no task gets
    what all tasks have kept of one item."""
    best = [F.desc("score"), F.asc_nulls_last("key")]
    salted = found.withColumn("salt", F.pmod(F.xxhash64("key", "score"), F.lit(SALTS)))
    for part in (["item", "salt"], ["item"]):
        turn = Window.partitionBy(*part).orderBy(*best)
        salted = salted.withColumn("rank", F.row_number().over(turn)).where(F.col("rank") <= k)
    return salted.select("item", "rank", "key", "score")


def _blocks(terms: DataFrame, block_terms: int) -> list[list[int]]:
    """Block numbers by round."""
    sizes = sorted((r["block"], r["n"]) for r in terms.groupBy("block").agg(F.count("*").alias("n")).collect())
    rounds, size = [], 0
    for block, n in sizes:
        if not rounds or size + n > max(ROUND_TERMS, block_terms):
            rounds.append([])
            size = 0
        rounds[-1].append(block)
        size += n
    return rounds


def rank(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
    k: int = 10, block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """``item, rank, key, score``: the k best documents with a score above 0 of each item.

    A term weighs w = floor(1000 ln((2N + 2) / (2 df + 1))) and a document's score is the
    sum of w * (10^9 tf div (1000 tf + 8 m)) over the item's terms, m = 10 + 90 n N div L.
    """
    texts = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    found = landed(item_terms(items, item, item_text), "item-terms")
    item_type = found.schema["item"].dataType.simpleString()
    blocks = max(1, -(-found.count() // block_terms))
    own = found.groupBy("item").agg(F.min("term").alias("least")).repartitionByRange(blocks, "least", F.xxhash64("item"))
    dealt = landed(own.select("item", F.spark_partition_id().cast("long").alias("block"), F.monotonically_increasing_id().alias("place")), "item-blocks")
    terms = landed(found.join(dealt, found["item"].eqNullSafe(dealt["item"])).select(dealt["item"], "block", "place", "term"), "block-terms")
    out = None
    for some in _blocks(terms, block_terms):
        table = terms.where(F.col("block").between(some[0], some[-1])).toArrow()
        numbers = table.column("block").to_numpy()
        plans = [plan(table.filter(pa.array(numbers == b))) for b in some]
        listed = np.unique(np.concatenate([p.terms for p in plans]))
        n_docs, n_terms, df = corpus_counts(texts.select("text"), listed)
        best = _top(_searched(texts, plans, n_docs, n_terms, listed, df, k, item_type), k)
        out = best if out is None else out.unionByName(best)
    if out is None:
        kind = texts.schema["key"].dataType.simpleString()
        return docs.sparkSession.createDataFrame([], f"item {item_type}, rank int, key {kind}, score bigint")
    return out
