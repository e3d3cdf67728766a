import random

import numpy as np
import pytest

from gridpanel.llm import decontaminate, licenses, queries, toxicity, words
from pyspark.sql import functions as F
from tests.llm import brute
from tests.llm.conftest import SF, sentence

SCHEMA = "doc_id long, text string"


def base_of(rows):
    return sorted(tuple(map(str, (r["key"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]))) for r in rows)


def test_license_phrases_against_brute_force(spark, hard_rows):
    rows = [
        *hard_rows,
        (20, "Under the MIT license. under THE mit-license! cc by nc cc by nc by nc"),
        (21, "Apache License, Version 2.0, apache license version 20"),
        (None, "cc-by-nc"),
        (None, "cc-by-nc"),
    ]
    found = licenses.scan(spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, `mark` int")).collect()
    want = sorted(tuple(map(str, (d, *brute.phrases(t, licenses.PHRASES)))) for d, t in rows)
    assert base_of(found) == want
    assert all(0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) for r in found)
    assert licenses.scan(spark.createDataFrame([], SCHEMA)).count() == 0


def test_license_notices_with_edits(spark):
    notice = licenses.NOTICES[0][1].split()
    edited = [*notice[:6], "hereby", *notice[6:12], *notice[13:]]
    half = notice[: len(notice) // 2]
    spread = [w for word in notice for w in (word, "x", "y", "z")]
    rows = [(i, sentence(random.Random(i), 30) + " " + " ".join(w) + " end") for i, w in enumerate((notice, edited, half, spread))]
    found = {r["key"]: r for r in licenses.scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [found[i]["labels"] for i in range(4)] == ["mit", "mit", "", ""]
    assert found[0]["score"] == 1 > found[1]["score"] > found[2]["score"]
    assert found[0]["spans"][0]["first"] == 30 and found[0]["spans"][0]["last"] == 29 + len(notice)


def test_license_query_against_brute_force(spark):
    rows = queries.table(spark, SF, "documents").select("doc_id", "text").collect()
    found = queries.op5_licenses(spark, SF).withColumnRenamed("doc_id", "key").collect()
    assert base_of(found) == sorted(tuple(map(str, (d, *brute.phrases(t, licenses.PHRASES)))) for d, t in rows)


def test_alignment_against_a_full_table():
    rng = np.random.default_rng(2)
    for _ in range(60):
        passage, item = rng.integers(0, 5, rng.integers(0, 25)), rng.integers(0, 5, rng.integers(1, 12))
        best, first, last = decontaminate.align(passage, item)
        assert best == brute.smith_waterman(passage, item)
        if best:
            assert brute.smith_waterman(passage[first : last + 1], item) == best


def items_and_docs():
    rng = random.Random(9)
    items = [(i, sentence(rng, 30)) for i in range(5)] + [(None, sentence(rng, 25)), (8, "too short"), (9, None)]
    edited = items[1][1].split()
    edited[7], edited[20] = "changed", "words"
    del edited[13]
    partial = items[2][1].split()[:9]
    docs = [(i, f"{sentence(rng, 200)} {''.join(c.upper() if c.isascii() else c for c in items[0][1])}, {sentence(rng, 50)}") for i in range(20)]
    docs += [
        (30, f"{sentence(rng, 3)} {' '.join(edited)}"),
        (31, f"{sentence(rng, 60)} {' '.join(partial)} {sentence(rng, 60)}"),
        (32, f"{items[3][1]} {items[3][1]} x {items[4][1]}"),
        (33, items[5][1]),
        (None, items[4][1]),
        (34, sentence(rng, 100)),
        (35, None),
        (36, ""),
        (37, "too short"),
    ]
    return items, docs


def test_passages_are_found_and_clean_texts_left(spark, monkeypatch):
    items, docs = items_and_docs()
    frame = spark.createDataFrame([(d, t, 0) for d, t in docs], "doc_id long, text string, `item` int")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    want = {(i, 0) for i in range(20)} | {(30, 1), (32, 3), (32, 4), (33, None), (None, 4), (37, 8)}
    for most in (1_000_000, 0):
        monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", most)
        monkeypatch.setattr(decontaminate, "BROADCAST_WORDS", most)
        found = decontaminate.find(frame, benchmark).collect()
        assert {(r["key"], r["item"]) for r in found} == want
        assert sum(r["key"] == 32 and r["item"] == 3 for r in found) == 2
        assert min(r["score"] for r in found if r["key"] != 30) == 1.0
    at = next(r for r in found if (r["key"], r["item"]) == (0, 0))
    assert (at["first_word"], at["last_word"]) == (200, 229)
    kept = decontaminate.without_passages(frame, benchmark)
    assert kept.columns == frame.columns
    assert {r["doc_id"] for r in kept.collect()} == {31, 34, 35, 36}
    assert decontaminate.find(frame.limit(0), benchmark).count() == 0
    assert decontaminate.without_passages(frame, benchmark.limit(0)).count() == len(docs)


def test_edited_and_half_items_against_full_alignment(spark):
    rng = random.Random(4)
    items = [(i, sentence(rng, 50)) for i in range(4)]
    docs = []
    for step in (5, 6, 7):
        copy = [f"edit{i}" if i % step == step - 1 else w for i, w in enumerate(items[0][1].split())]
        docs.append((step, f"{sentence(rng, 40)} {' '.join(copy)} {sentence(rng, 40)}"))
    half, spread = items[1][1].split()[:25], items[2][1].split()
    docs.append((20, f"{sentence(rng, 40)} {' '.join(half)} {sentence(rng, 40)}"))
    docs.append((21, " ".join([*spread[:25], *sentence(rng, 40).split(), *spread[25:]])))
    docs.append((22, f"{' '.join(items[3][1].split()[:10])} {sentence(rng, 90)}"))
    scores = {}
    for copied in (False, True):  # an exact copy beside them changes nothing
        rows = docs + [(100 + i, t) for i, t in items] * copied
        found = decontaminate.find(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, "item_id long, text string"))
        scores = {(r["key"], r["item"]): r["score"] for r in found.collect()}
        want = {}
        for d, t in rows:
            for i, item in items:
                score = brute.smith_waterman(brute.alnum(t), brute.alnum(item)) / (2 * len(brute.alnum(item)))
                if score >= 0.5:
                    want[d, i] = score
        assert scores == pytest.approx(want)
        assert {(5, 0), (6, 0), (7, 0), (20, 1), (21, 2)} <= set(want)


def test_a_turn_of_phrase_pairs_nothing(spark):
    rng = random.Random(12)

    def own(n):
        return " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))

    items = [(i, f"{own(20)} one of the most {own(20)}") for i in range(50)]
    docs = [(i, f"{own(15)} one of the most {own(15)}") for i in range(600)]
    docs += [(1000 + i, f"{own(9)} {items[i][1]} {own(9)}") for i in range(12)]
    frame, asked = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    picked, listed = decontaminate._picked(frame, "doc_id", "text"), decontaminate._picked(asked, "item_id", "text")
    found = decontaminate.candidates(picked, listed, 4).collect()
    assert {(r["key"], r["item"]) for r in found} == {(1000 + i, i) for i in range(12)}
    assert {(r["key"], r["item"]) for r in decontaminate.find(frame, asked).collect()} == {(1000 + i, i) for i in range(12)}


def test_variants_of_an_item_in_many_texts(spark):
    """Nothing in them is rare: seeds are pairs of common grams."""
    rng = random.Random(13)
    base = sentence(rng, 40).split()
    items = [(i, " ".join([*base[: 20 + i % 3], f"variant{i}", *base[21 + i % 3 :]])) for i in range(12)]
    docs = []
    for i in range(14):
        words = base[:]
        words[rng.randrange(40)] = "edited"
        docs.append((i, f"{sentence(rng, 20)} {' '.join(words)} {sentence(rng, 20)}"))
    docs.append((50, f"{sentence(rng, 20)} {' '.join(base[5:12])} {sentence(rng, 40)}"))
    found = decontaminate.find(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r["key"], r["item"]): r["score"] for r in found.collect()}
    want = {}
    for d, t in docs:
        for i, item in items:
            score = brute.smith_waterman(brute.alnum(t), brute.alnum(item)) / (2 * len(brute.alnum(item)))
            if score >= 0.5:
                want[d, i] = score
    assert got == pytest.approx(want) and len(want) == 14 * 12


def test_items_shorter_than_a_gram(spark):
    items = [(1, "zero"), (2, "alpha beta"), (3, "gamma, Delta epsilon"), (4, "..."), (None, "beta zeta")]
    docs = [(10, "x alpha beta y"), (11, "beta alpha"), (12, "a GAMMA delta epsilon gamma delta epsilon"), (13, "Zero zero"), (14, None), (15, "beta zeta")]
    found = decontaminate.find(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = sorted(str((r["key"], r["item"], r["score"], r["first_word"], r["last_word"])) for r in found)
    want = [(10, 2, 1.0, 1, 2), (12, 3, 1.0, 1, 3), (12, 3, 1.0, 4, 6), (13, 1, 1.0, 0, 0), (13, 1, 1.0, 1, 1), (15, None, 1.0, 0, 1)]
    assert got == sorted(map(str, want))


def test_decontamination_query_finds_every_whole_item(spark):
    docs = queries.table(spark, SF, "documents").collect()
    items = queries.table(spark, SF, "benchmark").collect()
    spaced = {r["doc_id"]: f" {' '.join(brute.alnum(r['text']))} " for r in docs}
    whole = {(d, i["item_id"]) for i in items for d, t in spaced.items() if f" {' '.join(brute.alnum(i['text']))} " in t}
    found = queries.op3_decontamination(spark, SF).collect()
    assert whole <= {(r["doc_id"], r["item_id"]) for r in found}
    for r in found:
        words, item = spaced[r["doc_id"]].split(), brute.alnum(next(i["text"] for i in items if i["item_id"] == r["item_id"]))
        best = brute.smith_waterman(words[r["first_word"] : r["last_word"] + 1], item)
        assert r["score"] == pytest.approx(best / (2 * len(item)))


def test_ordinal_regression_orders_grades():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 2))
    score = 2 * x[:, 0] - x[:, 1] + rng.logistic(size=3000)
    grades = np.searchsorted([0.0, 1.5, 3.0], score)
    weights, thresholds = toxicity.fit_ordinal(x, grades, 3, steps=600)
    assert weights == pytest.approx([2, -1], abs=0.2)
    assert thresholds == pytest.approx([0, 1.5, 3], abs=0.25)
    p = toxicity.Model(np.arange(2), weights, thresholds).probabilities(x)
    assert p.sum(1) == pytest.approx(1) and (p >= 0).all()


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(3)
    bad = ["vile", "rotten"]

    def text(toxic):
        words = sentence(rng, 80).split()
        for _ in range(rng.randint(2, 6) if toxic else 0):
            words.insert(rng.randrange(80), rng.choice(bad) + rng.choice(["", "!", "ness"]))
        return " ".join(words)

    rows = [(i, text(i % 5 == 0), i % 5 == 0) for i in range(500)]
    docs = spark.createDataFrame([(i, t, 0.5) for i, t, _ in rows] + [(900, None, 0.1), (901, "", 0.1)], "doc_id long, text string, severity double")
    labels = spark.createDataFrame([(i, int(y)) for i, _, y in rows if i < 300] + [(None, 1), (900, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    scored = docs.withColumn("s", toxicity.severity(model, F.col("text"))).select("doc_id", "s.*").collect()
    wrong = [r["doc_id"] for r in scored if 300 <= r["doc_id"] < 500 and (r["p_toxic"] >= 0.5) != (r["doc_id"] % 5 == 0)]
    assert len(wrong) <= 2
    assert all(r["p_toxic"] < 0.5 for r in scored if r["doc_id"] >= 900)
    assert all(r["severity"] == pytest.approx(sum(k * p for k, p in enumerate(r["probabilities"]))) for r in scored)
    none = toxicity.fit(docs, labels.limit(0))
    assert docs.where(toxicity.severity(none, F.col("text"))["p_toxic"] >= 0.5).count() == 0
    assert docs.limit(0).select(toxicity.severity(model, F.col("text"))).count() == 0


def test_toxicity_against_a_plain_fit(spark):
    rng = random.Random(7)
    rows = []
    for i in range(240):
        own = sentence(rng, 40).split()
        for _ in range(rng.randint(1, 5) if i % 4 == 0 else 0):
            own.insert(rng.randrange(len(own)), rng.choice(["vilest", "vilely", "rotten"]))
        rows.append((i, " ".join(own)))
    rows += [(0, "zzz")] * 200 + [(None, "vilest"), (5, None)]  # one labelled key on many documents
    labels = [(i, int(i % 4 == 0)) for i in range(200)] + [(3, 0), (3, 1), (8, None), (None, 1)]
    by_key = {}
    for d, y in labels:
        if d is not None and y is not None:
            by_key[d] = max(y, by_key.get(d, 0))
    frame = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, toxic int")
    model = toxicity.fit(frame, spark.createDataFrame(labels, "doc_id long, toxic int"))
    counted = brute.toxicity_rows(rows, by_key)
    wanted = brute.telling(counted)

    def hashed(w):
        raw, n = (w.encode(), None) if isinstance(w, str) else w
        data = np.frombuffer(raw, np.uint8)
        h = words.word_hashes(data, np.array([0]), np.array([len(data)]))
        return int((h if n is None else words.mix(h + words.U64(n))).view(np.int64)[0])

    by_hash = {hashed(w): w for w in wanted}
    assert set(model.features.tolist()) == set(by_hash) and len(by_hash) >= 4
    names = [by_hash[h] for h in model.features.tolist()]
    x = np.array([[np.log1p(100 * c[w] / n) if n else 0.0 for w in names] for c, n, _ in counted])
    toxic = np.array([y for *_, y in counted])
    order = np.lexsort((*x.T[::-1], toxic))
    weights, thresholds = toxicity.fit_ordinal(x[order], toxicity.graded(x[order], toxic[order]), toxicity.GRADES)
    assert model.weights == pytest.approx(weights, abs=0.05) and model.thresholds == pytest.approx(thresholds, abs=0.05)
    got = frame.select("doc_id", "text", toxicity.severity(model, F.col("text")).alias("s")).collect()
    for r in got:
        c, n, _ = (brute.toxicity_rows([(1, r["text"])], {1: 0}))[0]
        score = sum(w * (np.log1p(100 * c[name] / n) if n else 0.0) for w, name in zip(model.weights, names))
        below = [1 / (1 + np.exp(score - t)) for t in model.thresholds]
        p = np.diff([0.0, *below, 1.0])
        assert r["s"]["probabilities"] == pytest.approx(p, abs=1e-9)
        assert r["s"]["severity"] == pytest.approx(sum(k * q for k, q in enumerate(p)), abs=1e-9)


def test_toxicity_query_agrees_with_labels(spark):
    labels = {r["doc_id"]: r["toxic"] for r in queries.table(spark, SF, "labels").collect()}
    found = {r["doc_id"]: r for r in queries.op9_toxicity(spark, SF).collect()}
    assert len(found) == queries.table(spark, SF, "documents").count()
    assert sum(found[d]["toxic"] == bool(t) for d, t in labels.items() if d in found) >= 0.9 * len(labels)
