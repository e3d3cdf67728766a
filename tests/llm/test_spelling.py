import random

import numpy as np
import pytest

from gridpanel.llm import queries, spelling
from pyspark.sql import functions as F
from tests.llm import brute
from tests.llm.conftest import SF


def docs_of(spark, rows):
    return spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, word string")


def test_counts_against_brute_force(spark, hard_rows):
    rng = random.Random(2)
    rows = [*hard_rows, (None, "Éclair ÉCLAIR éclairs ×÷ÿÀ"), (3, "x" * 200 + " " + "y" * 70), (3, "x" * 200)]
    rows += [(i, " ".join(rng.choices(["résumé", "resumé", "resume", "Naïveté", "z" * 66, "a-b", "voilà"], k=30))) for i in range(60)]
    for every in (97, 3, 0):
        found = spelling.count_words(docs_of(spark, rows), every=every).collect()
        assert {r["word"]: r["n"] for r in found} == brute.word_counts(rows, every)
    assert spelling.count_words(docs_of(spark, [])).count() == 0


@pytest.mark.parametrize("settings", [{}, {"floor": 1, "grown": 1 << 20}, {"floor": 1 << 30}, {"floor": 4, "longest": 8}])
def test_variants_against_brute_force(spark, settings):
    rng = random.Random(3)
    counts = {}
    for _ in range(500):
        word = "".join(rng.choice(["ba", "ko", "li", "nü", "ß", "ter", "a", "ba"]) for _ in range(rng.randint(3, 5)))
        for _ in range(rng.randint(1, 3)):
            if len(word) >= 5:
                counts[word] = rng.choice([3, 3, 4, 6, 12, 25, 50])
            at, letter = rng.randrange(len(word)), rng.choice("abkñÿ")
            word = rng.choice([word[:at] + word[at + 1 :], word[:at] + letter + word[at:], word[:at] + letter + word[at + 1 :], word + letter])
    counts |= {"aaaaa": 3, "aaaaaa": 7, "aaaaaaa": 20, "b" * 5000: 3, "b" * 5001: 6}
    frame = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    found = spelling.variants(frame, **settings).collect()
    assert sorted(tuple(r) for r in found) == brute.variants(counts)
    assert sum(r["n_near"] for r in found) > 300 and any(r["root"] not in (r["word"], r["form"]) for r in found)


def test_no_words(spark):
    assert spelling.variants(spark.createDataFrame([], "word string, n long")).count() == 0
    with pytest.raises(Exception, match="outside"):
        spelling.variants(spark.createDataFrame([("日本日本日", 3)], "word string, n long")).count()


def test_an_edit_leaves_all_but_the_bound_alone(spark):
    words = ["banana", "banane", "bananas", "anana", "ananas", "bandana", "cabana"]
    frame = spark.createDataFrame([(w, 3) for w in words], "word string, n long")
    codes, counts = spelling.dictionary(frame, floor=2)
    import pyarrow as pa

    stream, begin = spelling._stream(pa.array(words))
    place, code, length = spelling._grown(stream, codes[codes < 1 << 40], spelling.LONG)
    number = np.searchsorted(begin, place, side="right") - 1
    grams = [{(c, p) for c, p in zip(code[number == i].tolist(), (place - begin[number])[number == i].tolist())} for i in range(len(words))]
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            if brute.near(a, b):
                alike = sum((c, p + d) in grams[j] for c, p in grams[i] for d in {0, len(b) - len(a)})
                assert alike >= len(grams[i]) - spelling.LONG


def test_query_against_brute_force(spark):
    rows = queries.table(spark, SF, "documents").select("doc_id", "text").collect()
    found = queries.op12_spelling_variants(spark, SF)
    counts = brute.word_counts(rows)
    by_start = {}
    for w in counts:  # a word one edit away has the same first or the same last two code points
        for part in {("a", w[:2]), ("z", w[-2:])}:
            by_start.setdefault(part, []).append(w)
    got = {r["word"]: r for r in found.collect()}
    assert {w: r["n"] for w, r in got.items()} == counts
    for w in sorted(counts)[::7]:
        close = {x for part in (("a", w[:2]), ("z", w[-2:])) for x in by_start[part] if brute.near(w, x)}
        best = min(close, key=lambda x: (-counts[x], x), default=None)
        form = best if best and counts[best] >= 2 * counts[w] else None
        assert (got[w]["n_near"], got[w]["form"], got[w]["form_n"]) == (len(close), form, form and counts[form])
        assert got[w]["root"] == (got[form]["root"] if form else w)
    assert found.where(F.col("form").isNotNull()).count() > 0
