import random

import numpy as np

from gridpanel.llm import lexical
from tests.llm import brute
from tests.llm.conftest import sentence


def found_by(spark, docs, items, **more):
    frame = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, score int")
    asked = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, `doc_id` int")
    rows = lexical.rank(frame, asked, **more).collect()
    return sorted(((r["item"], r["rank"], r["key"], r["score"]) for r in rows), key=str)


def cases(hard_rows):
    rng = random.Random(8)
    base = sentence(rng, 40).split()
    items = [(i, " ".join(rng.sample(base, 25) + sentence(rng, 5).split())) for i in range(12)]
    items += [(20, None), (21, ""), (22, "nowhere-to-be-found"), (23, hard_rows[4][1]), (23, "the word"), (None, "the"), (24, hard_rows[13][1])]
    docs = [*hard_rows, *((100 + i, " ".join(rng.choices(base, k=rng.randint(1, 60)))) for i in range(60))]
    docs += [(7, "the"), (7, "the"), (None, "The the"), (300, "the")] + [(400 + i, "Ties tie " + base[0]) for i in range(25)]
    return docs, [*items, (25, "ties")]


def test_against_brute_force(spark, hard_rows, monkeypatch):
    docs, items = cases(hard_rows)
    want = brute.ranked(docs, items)
    assert found_by(spark, docs, items) == want
    monkeypatch.setattr(lexical, "CELLS", 1)  # a document at a time
    monkeypatch.setattr(lexical, "HELD", 1)
    monkeypatch.setattr(lexical, "ROUND_TERMS", 64)
    assert found_by(spark, docs, items, block_terms=64) == want


def test_empty_tables(spark):
    assert found_by(spark, [], [(1, "a")]) == []
    assert found_by(spark, [(1, "a"), (2, None)], []) == []
    assert found_by(spark, [(1, None), (2, "")], [(1, "a")]) == []


def test_sets_share_sums():
    rng = random.Random(1)
    sets = [sorted(rng.sample(range(30), rng.randint(0, 20))) for _ in range(40)]
    made, sums = lexical.share(sets)
    value = {x: rng.randint(1, 99) for x in range(30)}
    first = max(x for s in sets for x in s) + 1
    for n, (a, b) in enumerate(made, first):
        value[n] = value[a] + value[b]
    assert [sum(value[x] for x in s) for s in sums] == [sum(value[x] for x in s) for s in sets]
    assert len(made) + sum(map(len, sums)) < 0.8 * sum(map(len, sets))  # fewer additions than without


def test_same_items_are_summed_once():
    made, sums = lexical.share([[0, 1, 2, 3]] * 5 + [[0, 1]])
    assert len(made) == 3 and all(len(s) == 1 for s in sums)


def test_accumulators_are_whole_numbers():
    graph = lexical.Plan(None, np.arange(3), np.arange(3), 3, [(0, 1)], [[3], [3, 2], []])
    big = 1 << 60
    scores = lexical.accumulate(graph, np.array([0, 1, 2, 0]), np.array([0, 0, 0, 1]), np.array([big, 1, 2, 5]), 2)
    assert scores.tolist() == [[big + 1, 5], [big + 3, 5], [0, 0]]
