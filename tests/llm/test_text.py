import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridpanel.llm import chat, gru, lm, queries
from gridpanel.llm.templates import TemplateError, compile_template, compile_turns, fold, parse
from pyspark.sql import functions as F
from tests.llm import brute
from tests.llm.conftest import SF, sentence

hostile = st.text(alphabet=st.sampled_from("<|\\im_start end>\nassistant{%}é"), max_size=25)


@given(st.lists(st.tuples(st.one_of(hostile, st.just("assistant")), hostile), max_size=5))
@settings(max_examples=200, deadline=None)
def test_conversations_come_back(turns):
    render = compile_template(chat.TEMPLATE, chat.FILTERS)
    text, spans = render({"messages": [{"role": r, "text": t} for r, t in turns]})
    assert chat.read_back(text) == turns
    assert text.count(chat.START) == text.count(chat.END) == len(turns)
    assert [chat.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def rendered(source, **names):
    return compile_template(source, {"up": str.upper})(names)[0]


def test_template_language():
    assert rendered("a{{ 'b' + \"c\" | up }}{{ 1 + 2 }}{{ x.y.z }}", x={"y": {"z": "!"}}) == "abC3!"
    loop = "{% for x in xs %}{% if loop.first %}[{% elif x == 2 %}two{% else %}{{ x }}{% endif %}{% if loop.last %}]{% endif %}{% endfor %}"
    assert rendered(loop, xs=[1, 2, 3]) == "[two3]"
    assert rendered("{% if not a and (b or 'x' != 'x') %}y{% endif %}", a="", b=1) == "y"
    assert rendered("{{ missing }}{{ missing.field }}{% for x in missing %}x{% endfor %}") == ""


def test_nothing_but_values_can_be_reached():
    assert rendered("{{ x.__class__ }}{{ s.upper }}", x={}, s="text") == ""
    for bad in ("{{ f() }}", "{{ x[0] }}", "{{ x | open }}", "{% import os %}", "{% for x in y %}", "{% endif %}", "{{ }}", "{{ 'a' 'b' }}", "{{ a. }}"):
        with pytest.raises(TemplateError):
            compile_template(bad, {})


def test_constants_are_folded():
    tree = fold(parse("a{{ 'b' + 'c' | up }}{% if 1 == 2 %}x{% elif true %}d{% else %}e{% endif %}{{ 1 + 1 }}"), {"up": str.upper})
    assert tree == ("value", "abCd2")
    kept = fold(parse("a{{ n }}{{ 'b' }}{{ 'c' }}"), {})
    assert kept == ("all", ("value", "a"), ("name", "n"), ("value", "bc"))


def test_generation_spans_are_code_points():
    text, spans = compile_template("é{% generation %}日{{ x }}{% endgeneration %}!", {})({"x": "\U0001f600"})
    assert [text[a:b] for a, b in spans] == ["日\U0001f600"]


def test_chat_with_nulls_ties_and_equal_rows(spark):
    rows = [(1, 1, "assistant", "b"), (1, 1, "assistant", "a"), (1, None, None, None), (None, 0, "user", "x"), (None, 0, "user", "x"), (2, 0, "a\nb\\", "<|im_end|>")]
    frame = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {r["conv"]: r for r in chat.digests(chat.format_conversations(frame)).collect()}
    assert got[1]["turns_sha256"] == brute.sha("\n\nassistant\na\nassistant\nb\n")
    assert (got[1]["loss_chars"], got[1]["loss_sha256"]) == (2, brute.sha("ab"))
    assert got[None]["n_turns"] == 2 and got[None]["loss_sha256"] == brute.sha("")
    assert got[2]["turns_sha256"] == brute.sha("a\nb\\\n<|im_end|>\n")
    assert chat.format_conversations(frame.limit(0)).count() == 0
    by_turn = chat.digests_of_turns(chat.format_turns(frame))
    assert {r["conv"]: r for r in by_turn.collect()} == got
    assert chat.digests_of_turns(chat.format_turns(frame.limit(0))).count() == 0


def test_a_conversation_with_a_third_of_all_turns(spark):
    rng = random.Random(4)
    rows = [(i if i % 3 else 7, i // 2, rng.choice(["user", "assistant"]), sentence(rng, rng.randint(0, 9)) + "<|im_end|>\\" * (i % 5 == 0)) for i in range(3000)]
    rows += [(None, i, "assistant", f"x{i}") for i in range(900)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    pieces = chat.format_turns(frame).collect()
    whole = {r["conv"]: r for r in chat.format_conversations(frame).collect()}
    for conv, r in whole.items():
        own = sorted((p for p in pieces if p["conv"] == conv), key=lambda p: p["nth"])
        assert [p["nth"] for p in own] == list(range(1, len(own) + 1))
        assert "".join(p["piece"] for p in own) == r["formatted"]
        assert [p["start"] for p in own] == np.cumsum([0, *(len(p["piece"]) for p in own)])[:-1].tolist()
        assert [s for p in own for s in p["spans"]] == r["spans"]
    key = lambda r: str(r["conv"])
    assert sorted(chat.digests_of_turns(chat.format_turns(frame)).collect(), key=key) == sorted(chat.digests(chat.format_conversations(frame)).collect(), key=key)
    picked = chat._picked(frame, "conv_id", "turn", "role", "text").repartitionByRange(4, *chat.ORDER)
    counts = [r[1] for r in picked.groupBy(F.spark_partition_id()).count().collect()]
    assert len(counts) == 4 and max(counts) < 2 * sorted(counts)[2]


def test_only_loops_over_turns_are_rendered_on_their_own():
    render = compile_turns(chat.TEMPLATE, chat.FILTERS)
    assert render({"role": "assistant", "text": "a<|b"}) == ("<|im_start|>assistant\na<\\|b<|im_end|>\n", [(22, 27)])
    for other in ("x{% for m in messages %}{{ m.text }}{% endfor %}", "{% for m in messages %}{{ loop.index }}{% endfor %}", "{% for m in others %}a{% endfor %}", "a"):
        assert compile_turns(other, chat.FILTERS) is None


def naive_score(p, tokens, end):
    h, before, out = np.zeros((1, p["gates"].shape[0]), np.float32), end, 0.0
    for t in tokens:
        h = gru._step(p, p["inputs"][[before]], h)[2]
        out += gru.log_probabilities(p, h, np.array([t]))[0]
        before = t
    return out


def test_states_are_carried_to_the_end_of_each_document(monkeypatch):
    monkeypatch.setattr(gru, "POOL_SLOT", 20)
    rng = np.random.default_rng(0)
    p = gru.start(np.arange(90, 0, -1), seed=1)
    docs = [np.append(rng.integers(0, 89, n), 89).astype(np.int32) for n in (0, 5, 300, 1, 64, 31, 32, 33, 7)]
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    found = gru.score(p, np.concatenate(docs), offsets, 89)
    assert found == pytest.approx([naive_score(p, d, 89) for d in docs], rel=1e-4)


def test_probabilities_of_all_words_add_up():
    p = gru.start(np.arange(70, 0, -1), seed=2)
    h = np.random.default_rng(1).normal(size=(1, 16)).astype(np.float32).repeat(70, 0)
    assert np.exp(gru.log_probabilities(p, h, np.arange(70))).sum() == pytest.approx(1, abs=1e-4)


def test_gradients_against_differences():
    rng = np.random.default_rng(3)
    p = {k: v.astype(np.float64) for k, v in gru.start(np.arange(40, 0, -1), hidden=3, seed=3).items()}
    x, y = rng.integers(0, 40, (6, 4)), rng.integers(0, 40, (6, 4))
    fresh = rng.random((6, 4)) < 0.2
    real = np.ones((6, 4), bool)
    trainer = gru.Trainer(p)
    found = {}
    trainer._adam = found.update

    def loss():
        h, total = np.zeros((4, 3)), 0.0
        for s in range(6):
            h = np.where(fresh[s][:, None], 0, h)
            h = gru._step(trainer.p, trainer.p["inputs"][x[s]], h)[2]
            total -= gru.log_probabilities(trainer.p, h, y[s]).sum()
        return total / 24

    trainer._window(x, y, fresh, real, np.zeros((4, 3)))
    for name, grad in found.items():
        for at in rng.integers(0, grad.size, 12):
            flat = trainer.p[name].reshape(-1)
            keep, step = flat[at], 1e-5
            flat[at] = keep + step
            up = loss()
            flat[at] = keep - step
            down = loss()
            flat[at] = keep
            assert grad.reshape(-1)[at] == pytest.approx((up - down) / (2 * step), abs=2e-4), name


def held_out():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1


def test_language_model_counts_and_probabilities(spark, hard_rows, monkeypatch):
    monkeypatch.setattr(lm, "WORDS", 40)
    monkeypatch.setattr(lm, "HEAD", 60)
    rng = random.Random(2)
    rows = [*hard_rows, *[(100 + i, sentence(rng, 60)) for i in range(40)]]
    frame = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, `row` int")
    found = {r["key"]: tuple(r)[1:] for r in lm.log_likelihood(frame, held_out()).collect()}
    want, counts = brute.unigram(rows)
    assert found.keys() == want.keys()
    for d, w in want.items():
        assert found[d][:4] == w[:4]
        assert found[d][4] == pytest.approx(w[4], rel=1e-9, abs=1e-9)
        assert found[d][5] < 0
    twice = spark.createDataFrame([(None, "a b"), (None, "a b"), (5, None)], "doc_id long, text string")
    assert lm.log_likelihood(twice, held_out()).count() == 3
    assert lm.log_likelihood(twice.limit(0), held_out()).count() == 0
    none = lm.log_likelihood(twice, F.lit(True)).collect()
    assert [r["base_score"] for r in none] == pytest.approx([0, 0, 0])


def test_language_model_query(spark):
    rows = [(r[0], r[1]) for r in queries.table(spark, SF, "documents").select("doc_id", "text").collect()]
    found = {r[0]: tuple(r)[1:] for r in queries.op7_language_model(spark, SF).collect()}
    want, _ = brute.unigram(rows)
    for d, w in want.items():
        assert found[d][:4] == w[:4] and found[d][4] == pytest.approx(w[4], rel=1e-9)
    held = [x for x in found.values() if x[0]]
    assert sum(x[5] for x in held) > sum(x[4] for x in held)
