import hashlib
import random

import numpy as np

from gridpanel.llm import private, queries, words
from tests.llm import brute
from tests.llm.conftest import SF, sentence

ODD = [
    "a@b.c@d.e.f x@y z@.a q.w+e%r-t_u@m-n.o.p", "@a.b a@-.- é@b.c aé@b.cé", "1.2.3.4.5.6.7.8 256.1.1.1 1.2.3 00255.0.0.000 1.2.3.4.", "٣.٣.٣.٣",
    "4111 1111 1111 1111 4111-1111-1111-1111 4111  1111 41111111111111111111111", "1234567890123 5105105105105100x", "+1 (017) 555-7713 +49-30.1234567+1 234 +1+12345678901",
    "+4111111111111111 +1234567890 12 . . . x", "a" * 3000 + "@" + "b" * 3000 + "." + "1" * 3000, "1." * 500, "1 " * 500, "+1" + " " * 999, "a@a." * 300, "x\x00a@b.c\x001.1.1.1\x00",
]


def entities(rng):
    card = next(c for c in (str(rng.randrange(10**15, 10**16)) for _ in range(999)) if brute.private_spans(c))
    return [f"{rng.randrange(99)}@mail.example.com", f"10.0.{rng.randrange(256)}.7", card, f"+1 ({rng.randrange(100, 999)}) 555-1234"]


def corpus(hard_rows):
    rng = random.Random(6)
    rows = [*hard_rows, *((50 + i, t) for i, t in enumerate(ODD))]
    owner, plain = entities(rng), entities(rng)
    for i in range(30):
        rows.append((100 + i, f"{sentence(rng, 15)} {owner[i % 4]} {'Zaphodia Zaphodius' * (i % 4 == 0)} {sentence(rng, 15)}"))
        rows.append((200 + i, f"{sentence(rng, 15)} {plain[i % 4] if i < 4 else ''} {sentence(rng, 15)} unrelated"))
    rows += [(300 + i, f"{sentence(rng, 40)}") for i in range(60)] + [(400, "Zaphodia alone, zaphodius."), (401, "copy " + plain[0]), (402, "copy " + plain[0])]
    return [*rows, (None, f"{owner[0]} zaphodia"), (None, f"{owner[0]} zaphodia"), (9, "zaphod")]


def test_patterns_against_plain_ones(hard_rows):
    texts = [t or "" for _, t in corpus(hard_rows)]
    rng = random.Random(1)
    texts += ["".join(rng.choices("0123456789.@+-( )aé%_", weights=[9] * 10 + [8, 3, 3, 3, 1, 4, 1, 3, 1, 1, 1], k=200)) for _ in range(400)]
    for t in texts:
        joined = np.frombuffer(t.encode() + b"\0", np.uint8)
        raw = t.encode()
        got = [(len(raw[:a].decode()), k, len(raw[:b].decode()), v.decode()) for a, k, b, v in private.base_spans(joined)]
        assert got == brute.private_spans(t)


def test_find_against_brute_force(spark, hard_rows):
    rows = corpus(hard_rows)
    frame = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, `key` string, mark int")
    want = brute.disclosed(rows)
    found = private.find(frame).collect()
    got = sorted(str((r["key"], [(s["kind"], s["start"], s["end"]) for s in r["base"]], [tuple(s) for s in r["terms"]])) for r in found)
    names = list(brute.PRIVATE)
    assert got == sorted(str((d, [(names[k], a, b) for a, k, b, _ in brute.private_spans(t)], want[d, t])) for d, t in rows)
    assert any(want.values()) and want[400, "Zaphodia alone, zaphodius."]
    kinds = {general for spans in want.values() for _, _, general in spans}
    assert kinds <= {True, False}
    assert private.find(frame.limit(0)).count() == 0


def test_sanitised_texts(spark, hard_rows):
    rows = corpus(hard_rows)
    frame = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, `key` string, mark int")
    clean = private.sanitise(frame)
    assert clean.columns == frame.columns
    got = clean.collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r["text"] for r in got if r["doc_id"] is not None}
    assert by_id[400] in ("<term> alone, <term>.", "Zap* alone, zap*.")
    assert by_id[401] == "copy <email>" and by_id[0] is None and by_id[300] == dict(rows)[300]
    assert not any(k in t for k, t in ((x, r["text"]) for r in got for x in ("555-1234", "mail.example")) if t)


def test_filter_loses_nothing(spark):
    values = np.random.default_rng(0).integers(-(2**62), 2**62, 5000)
    made = private.bloom(spark.createDataFrame([(int(v),) for v in values], "term long"), "term")
    assert private.passes(made, values.view(np.uint64)).all()
    other = words.mix(np.arange(100_000, dtype=np.uint64))
    assert private.passes(made, other).mean() < 0.01
    assert not private.passes(private.bloom(spark.createDataFrame([], "term long"), "term"), other).any()


def test_query_against_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in queries.table(spark, SF, "documents").select("doc_id", "text").collect()]
    terms, names, want = brute.disclosed(rows), list(brute.PRIVATE), []
    for d, t in rows:
        spans = [(a, k, b) for a, k, b, _ in brute.private_spans(t)]
        base = ",".join(f"{names[k]}:{a}:{b}" for a, k, b in spans)
        every = sorted([*spans, *((a, 9, b) for a, b, _ in terms[d, t])])
        counts = [sum(k == i for _, k, _ in spans) for i in range(4)]
        want.append((d, *counts, hashlib.sha256(base.encode()).hexdigest(), ",".join(f"{[*names, *[0] * 5, 'term'][k]}:{a}:{b}" for a, k, b in every)))
    assert sorted(tuple(r) for r in queries.op13_personal_data(spark, SF).collect()) == sorted(want)
