import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gridpanel.llm import packing, queries
from gridpanel.llm.tokens import ENTRY_BYTES, Generations, WordTokenizer
from tests.llm.conftest import SF

PATH = public_tokenizers.path("word_bpe_49k.json")
WHOLE, WORDS = Tokenizer.from_file(PATH), WordTokenizer(PATH, 50)


def ids_of(text):
    return np.array(WHOLE.encode(text or "", add_special_tokens=False).ids + [1], "<u4")


def check(rows, found, longest=2048):
    """Every id in one piece, sequences gapless and short enough; returns the padding."""
    by_doc, by_sequence = {}, {}
    for r in found:
        by_doc.setdefault(r[0], []).append(r)
        by_sequence.setdefault(r[5], []).append(r)
    for d, text in rows:
        want, at = ids_of(text), 0
        for _, start, length, crc, total, *_ in sorted(by_doc[d], key=lambda r: r[1]):
            assert start == at and total == len(want)
            assert crc == zlib.crc32(want[at : at + length].tobytes())
            at += length
        assert at == len(want)
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r[6]):
            assert r[6] == at
            at += r[2]
        assert at <= longest
        padding += 0 if at & (at - 1) == 0 else longest - at
    return padding


def columns(packed):
    from pyspark.sql import functions as F

    return packed.select("key", "start", "length", F.crc32("ids"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")


@given(st.text(alphabet=st.one_of(st.characters(), st.sampled_from("aB9 'éßÖ|<>strelvmd\u0301\x1c\n*")), max_size=40))
@settings(max_examples=300, deadline=None)
def test_ids_are_those_of_the_whole_tokenizer(text):
    assert WORDS.plain
    assert WORDS.ids(text.encode("utf-8", "ignore")) == ids_of(text.encode("utf-8", "ignore").decode())[:-1].tobytes()


def test_other_tokenizers_take_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    own = WordTokenizer(path)
    assert not own.plain
    want = Tokenizer.from_file(path).encode("two  words", add_special_tokens=False).ids
    assert np.frombuffer(own.ids(b"two  words"), "<u4").tolist() == want


def test_generations_keep_what_is_asked_for():
    made = []
    cache = Generations(lambda x: made.append(x) or x * 2, 4 * (ENTRY_BYTES + 3))
    assert [cache[i] for i in "12131451"] == ["11", "22", "11", "33", "11", "44", "55", "11"]
    assert made == list("12345") and len(cache) + len(cache.old) <= 4
    for i in range(1000):
        cache[str(i)]
    assert len(cache) + len(cache.old) <= 4


@given(st.lists(st.integers(1, 64), max_size=60))
@settings(max_examples=200, deadline=None)
def test_windows_are_full_but_the_last(lengths):
    windows = packing.plan(lengths, (16, 32, 64))
    held = {}
    for tier, inside in windows:
        assert sum(n for *_, n in inside) <= tier
        for piece, start, n in inside:
            held.setdefault(piece, []).append((start, n))
    assert all(sum(n for *_, n in inside) == tier for tier, inside in windows[:-1])
    for piece, n in enumerate(lengths):
        at = 0
        for start, part in sorted(held[piece]):
            assert start == at
            at += part
        assert at == n


def test_packing_of_hard_rows(spark, hard_rows):
    frame = spark.createDataFrame([(d, t, 0) for d, t in hard_rows], "doc_id long, text string, `ids` int")
    for block in (1 << 12, 4 << 20):
        found = [tuple(r) for r in columns(packing.pack(frame, block_bytes=block)).collect()]
        check(hard_rows, found)


def test_step_groups_hold_equal_tokens(spark):
    docs = queries.table(spark, SF, "documents")
    rows = packing.sequences(packing.pack(docs, step_tokens=8192)).collect()
    assert all(len(r["ids"]) == 4 * sum(r["lengths"]) <= 4 * r["tier"] for r in rows)
    sizes = {}
    for r in rows:
        sizes[r["step_group"]] = sizes.get(r["step_group"], 0) + r["tier"]
    assert sorted(sizes.values())[1:] == [8192] * (len(sizes) - 1)


def test_equal_rows_and_null_keys_are_packed_once_each(spark):
    frame = spark.createDataFrame([(None, "a b"), (None, "a b"), (7, None)], "doc_id long, text string")
    found = packing.pack(frame).collect()
    assert sum(r["length"] for r in found) == 3 + 3 + 1
    assert packing.pack(frame.limit(0)).count() == 0


def test_equal_rows_go_to_all_blocks(spark):
    rows = [(None, "the same words in each of them") if i % 3 == 0 else (i, f"row {i} " * (i % 9)) for i in range(3000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    dealt = packing.pieces(frame, "doc_id", "text", PATH, 1, 2048, 8)
    sizes = [r["count"] for r in dealt.groupBy("block").count().collect()]
    assert len(sizes) == 8 and sum(sizes) == 3000 and max(sizes) < 1.5 * np.median(sizes)


def test_query_against_the_tokenizer(spark):
    rows = [(r[0], r[1]) for r in queries.table(spark, SF, "documents").select("doc_id", "text").collect()]
    found = [tuple(r) for r in queries.op1_packing(spark, SF).collect()]
    assert check(rows, found) < 2048
