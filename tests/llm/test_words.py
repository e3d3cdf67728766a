import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from gridpanel.llm import words
from tests.llm import brute

texts = st.lists(st.one_of(st.none(), st.text(alphabet="aB 9\t\né日\x00|<", max_size=30)), max_size=8)


@given(texts)
@settings(max_examples=60, deadline=None)
def test_words_and_windows_are_those_of_a_regular_expression(rows):
    column = pa.array(rows, pa.string())
    data, offsets = words.flat(column)
    starts, ends, at = words.spans(data, offsets, words.SPACED)
    found = [data[s:e].tobytes().decode() for s, e in zip(starts, ends)]
    want = [brute.spaced(r) for r in rows]
    assert [found[a:b] for a, b in zip(at[:-1], at[1:])] == want
    hashes = words.word_hashes(data, starts, ends)
    assert len(set(hashes.tolist())) == len(set(found))
    places = words.window_rows(at, 2)
    windows = words.window_hashes(hashes, 2)
    named = {}
    for p in places:
        named.setdefault(int(windows[p]), set()).add((found[p], found[p + 1]))
    pairs = {pair for w in want for pair in zip(w, w[1:])}
    assert all(len(v) == 1 for v in named.values())
    assert {next(iter(v)) for v in named.values()} == pairs


def test_hashes_do_not_depend_on_chunks(monkeypatch):
    text = " ".join(f"w{i % 977}" for i in range(5000)) + " " + "long" * 900
    data, offsets = words.flat(pa.array([text]))
    starts, ends, _ = words.spans(data, offsets, words.SPACED)
    whole = words.word_hashes(data, starts, ends), words.window_hashes(words.word_hashes(data, starts, ends), 7)
    monkeypatch.setattr(words, "CHUNK", 256)
    monkeypatch.setattr(words, "_UP", {})
    hashes = words.word_hashes(data, starts, ends)
    assert (hashes == whole[0]).all()
    assert (words.window_hashes(hashes, 7) == whole[1]).all()


def test_slices_cover_a_batch_and_split_large_ones():
    batch = pa.record_batch([pa.array(["a" * n for n in (5, 0, 50, 3, 3, 3)])], ["text"])
    parts = list(words.slices(batch, "text", 8))
    assert sum(p.num_rows for p in parts) == 6
    assert [p.num_rows for p in parts] == [2, 1, 2, 1]
    assert pa.Table.from_batches(parts).column("text").to_pylist() == batch.column("text").to_pylist()


def test_joined_puts_one_space_between_words():
    data, offsets = words.flat(pa.array(["a  b", None, "\tc "]))
    starts, ends, _ = words.spans(data, offsets, words.SPACED)
    body, s, e = words.joined(data, offsets, starts, ends)
    assert body.tobytes() == b"a b c "
    assert [body[a:b].tobytes() for a, b in zip(s, e)] == [b"a", b"b", b"c"]


def test_runs():
    assert words.runs(np.array([5, 9, 2]), np.array([2, 0, 3])).tolist() == [5, 6, 2, 3, 4]
    assert words.runs(np.array([], int), np.array([], int)).tolist() == []
