import random
from itertools import combinations

import numpy as np
import pyarrow as pa

from gridpanel.llm import queries, simhash, substring
from gridpanel.llm.components import connected
from pyspark.sql import functions as F
from tests.llm import brute
from tests.llm.conftest import SF, sentence

SCHEMA = "doc_id long, text string"


def test_cover_holds_three_of_any_four_positions():
    groups = simhash.cover(8, 4)
    assert len(groups) == 20
    assert all(any(set(g) <= set(four) for g in groups) for four in combinations(range(8), 4))
    pairs = simhash.cover(12, 3)
    assert all(any(set(g) <= set(x) for g in pairs) for x in combinations(range(12), 3))


def test_simhash_against_brute_force(spark, hard_rows):
    rows = [*hard_rows, (None, "null key here"), (4, hard_rows[4][1])]
    found = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    got = sorted((str(r["key"]), r["fp"].hex(), r["component"]) for r in found)
    assert got == brute.simhash(rows)


def test_query_against_brute_force(spark):
    rows = [(r[0], r[1]) for r in queries.table(spark, SF, "documents").select("doc_id", "text").collect()]
    got = sorted((str(r[0]), r[1], r[2]) for r in queries.op2_simhash(spark, SF).collect())
    assert got == brute.simhash(rows)


def test_links_of_long_lists_are_cut_into_cells(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LIST", 8)
    rng = np.random.default_rng(3)
    centre = int(rng.integers(1 << 63))
    fps = {centre}
    while len(fps) < 150:  # a chain of near fingerprints and some far ones
        x = rng.choice(sorted(fps)) if len(fps) < 120 else int(rng.integers(1 << 63))
        for b in rng.choice(64, 3, replace=False):
            x = int(x) ^ (1 << int(b))
        fps.add(x)
    fps = sorted(fps)
    nodes = spark.createDataFrame([(x.to_bytes(8, "big"),) for x in fps], "fp binary")
    met = [(r["a"], r["b"]) for r in simhash.links(nodes, simhash.cover(8, 4), 4, 4).collect()]
    at = {x.to_bytes(8, "big"): i for i, x in enumerate(fps)}
    near = {(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4}
    found = {(max(at[bytes(a)], at[bytes(b)]), min(at[bytes(a)], at[bytes(b)])) for a, b in met}
    assert found <= near
    n = len(fps)
    assert brute.components(n, lambda i, j: (i, j) in found) == brute.components(n, lambda i, j: (i, j) in near)


def test_a_list_hands_on_a_forest():
    m = np.zeros((40, 8), np.uint8)
    m[:, 7] = np.arange(40) % 4
    a, b = simhash._list_links(m, np.full(40, 40), 4, 4)
    assert len(a) == 39


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (7, 7)]
    found = dict(connected(spark.createDataFrame(edges, "x long, y long"), "x", "y").collect())
    assert found == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}
    assert connected(spark.createDataFrame([], "x long, y long"), "x", "y").count() == 0


def test_one_of_each_against_brute_force(spark):
    rng = random.Random(11)
    rows = [(i, sentence(rng, 100)) for i in range(12)]
    for copy_of, changed in ((0, 1), (0, 2), (3, 1), (5, 40), (6, 0), (6, 0)):
        words = rows[copy_of][1].split()
        for at in rng.sample(range(100), changed):
            words[at] = "other" + str(at)
        rows.append((len(rows), " ".join(words)))
    rows += [(100, None), (101, ""), (102, "short text"), (103, "short text")]
    frame = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, `row` string")
    kept = simhash.one_of_each(frame)
    assert kept.columns == frame.columns
    assert {r["doc_id"] for r in kept.collect()} == brute.one_of_each(rows)


def test_one_of_each_agrees_with_the_operator(spark, hard_rows, monkeypatch):
    frame = spark.createDataFrame(hard_rows, SCHEMA)
    groups = {r["key"]: r["component"] for r in simhash.near_duplicates(frame).collect()}
    for most in (simhash.BROADCAST_ROWS, 0):
        monkeypatch.setattr(simhash, "BROADCAST_ROWS", most)
        assert {r["doc_id"] for r in simhash.one_of_each(frame).collect()} == set(groups.values())


def test_count_filter_decides(monkeypatch):
    """Pairs that share fewer positional bytes than guaranteed are not verified."""
    rng = np.random.default_rng(3)
    m = rng.integers(0, 256, (500, 8), dtype=np.uint8)
    m[:, [0, 3, 6]] = 7  # what brought them to one list
    m[1::50] = m[::50]
    m[1::50, 1] ^= 3
    seen, count = [], np.bitwise_count
    monkeypatch.setattr(simhash.np, "bitwise_count", lambda x: seen.append(len(x)) or count(x))
    a, b = simhash._list_links(m, np.full(500, 500), 4, 4)
    assert {(x, y) for x, y in zip(a.tolist(), b.tolist())} >= {(i, i + 1) for i in range(0, 500, 50)}
    assert sum(seen) < 0.05 * 500 * 499 / 2


def test_one_of_each_keeps_one_of_equal_rows(spark):
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (1, "p q r s t u"), (1, "p q r s t u"), (2, "v w")]
    kept = simhash.one_of_each(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(str, (r["doc_id"] for r in kept))) == ["1", "2", "None"]


def test_columns_with_clashing_names(spark, hard_rows):
    names = ["key", "fp", "component", "mark", "row", "k", "m", "first", "text.x", "head"]
    more = ", ".join(f"`{n}` int" for n in names)
    frame = spark.createDataFrame([(d, t, *range(len(names))) for d, t in hard_rows], f"{SCHEMA}, {more}")
    plain = spark.createDataFrame(hard_rows, SCHEMA)
    assert sorted(simhash.near_duplicates(frame).collect()) == sorted(simhash.near_duplicates(plain).collect())
    kept = simhash.one_of_each(frame)
    assert kept.columns == frame.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in simhash.one_of_each(plain).collect()}


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.one_of_each(empty).count() == 0
    assert substring.without_repeats(empty).count() == 0


def test_substrings_against_brute_force(spark, hard_rows):
    frame = spark.createDataFrame([(d, t, 1, 2) for d, t in hard_rows], "doc_id long, text string, `key` int, `places` int")
    for window in (5, 35):
        found = substring.without_repeats(frame, window=window)
        assert found.columns == [*frame.columns, "dedup"]
        got = [(r["doc_id"], r["dedup"]["n_words"], r["dedup"]["n_removed"], r["dedup"]["kept"]) for r in found.collect()]
        assert sorted(got) == sorted(brute.without_repeats(hard_rows, window))


def test_equal_rows_repeat_each_other(spark):
    text = sentence(random.Random(1), 40)
    frame = spark.createDataFrame([(None, text), (None, text), (3, text[: len(text) // 2])], SCHEMA)
    assert sorted(r["dedup"]["n_removed"] for r in substring.without_repeats(frame).collect()) == [0, 40, 40]


def test_equal_rows_hand_on_a_place_once(spark):
    text = sentence(random.Random(2), 60)
    found = substring.repeated_windows(spark.createDataFrame([(None, text)] * 300 + [(1, text)] * 300, SCHEMA)).collect()
    assert {r["key"] for r in found} == {None, 1}
    for r in found:
        assert set(r["places"]) == set(range(26)) and len(r["places"]) <= 2 * 26


def test_settled_places_of_copies_go_to_many_buckets(spark):
    text = sentence(random.Random(3), 3 * substring.BLOCK)
    prepared = substring._prepared(spark.createDataFrame([(i, text) for i in range(40)], SCHEMA), "doc_id", "text")
    assert prepared.select("mark").distinct().count() == 1
    deal = np.array([r[0] for r in prepared.select(F.xxhash64("key", "mark")).collect()])
    place = np.tile(np.arange(3 * substring.BLOCK), 40)
    bucket = substring._dealt(np.repeat(deal, 3 * substring.BLOCK), place) % np.uint64(64)
    assert np.bincount(bucket.astype(int)).max() < len(place) / 10


def test_many_repeats_are_joined_without_a_broadcast(spark, monkeypatch, hard_rows):
    monkeypatch.setattr(substring, "BROADCAST_ROWS", 0)
    found = substring.without_repeats(spark.createDataFrame(hard_rows, SCHEMA), window=5)
    got = [(r["doc_id"], r["dedup"]["n_words"], r["dedup"]["n_removed"], r["dedup"]["kept"]) for r in found.collect()]
    assert sorted(got) == sorted(brute.without_repeats(hard_rows, 5))


def test_sketch_never_counts_too_little(spark, monkeypatch, hard_rows):
    monkeypatch.setattr(substring, "MIN_CELLS", 1 << 10)
    monkeypatch.setattr(substring, "MAX_CELLS", 1 << 10)
    monkeypatch.setattr(substring, "REGION", 1 << 8)
    found = substring.without_repeats(spark.createDataFrame(hard_rows, SCHEMA), window=5)
    got = [(r["doc_id"], r["dedup"]["n_words"], r["dedup"]["n_removed"], r["dedup"]["kept"]) for r in found.collect()]
    assert sorted(got) == sorted(brute.without_repeats(hard_rows, 5))


def test_deltas_round_trip():
    for cells in ([], [0], [0, 1, 300, 555, 556, 70_000], [255, 510, 765]):
        assert substring._cells_of(substring._deltas(np.array(cells, np.int64))).tolist() == cells


def test_substring_query_against_brute_force(spark):
    rows = [(r[0], r[1]) for r in queries.table(spark, SF, "documents").select("doc_id", "text").collect()]
    want = sorted((d, n, removed, brute.sha(kept)) for d, n, removed, kept in brute.without_repeats(rows))
    assert sorted(tuple(r) for r in queries.op6_substring(spark, SF).collect()) == want


def test_flat_reads_slices():
    column = pa.array(["ab", None, "c"]).slice(1)
    data, offsets = simhash.words.flat(column)
    assert data.tobytes() == b"c" and offsets.tolist() == [0, 0, 1]
