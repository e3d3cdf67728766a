"""Words, n-grams and windows of whole Arrow text columns, as numpy arrays.

All functions work on the UTF-8 bytes of a batch at once. A null text counts as
an empty one. Hashes are 64 bits wide and the same on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20

# Byte classes of the two word definitions: everything but ASCII white space, and
# digits, a-z and whatever is not ASCII (after A-Z were lower-cased).
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C15)
WORD_BASES = (U64(0xD1342543DE82EF95), U64(0xAF251AF3B0F025B5))


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _inverse(odd: np.uint64) -> np.uint64:
    return U64(pow(int(odd), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    out[0] = 1
    return np.cumprod(out, dtype=U64)


BYTE_CODES = mix(np.arange(1, 257, dtype=U64) * BASE) | U64(1)
_UP: dict[int, np.ndarray] = {}


def _power_tables(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse, kept up to one chunk."""
    if n > CHUNK + 1:
        return _powers(base, n), _powers(_inverse(base), n)
    for key, b in ((int(base), base), (-int(base), _inverse(base))):
        if key not in _UP:
            _UP[key] = _powers(b, CHUNK + 1)
    return _UP[int(base)][:n], _UP[-int(base)][:n]


def flat(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column, end to end, and the n + 1 offsets of its rows."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    n, at = len(texts), texts.offset
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], kind)[at : at + n + 1].astype(np.int64)
    body = texts.buffers()[2]
    data = np.zeros(0, np.uint8) if body is None else np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows with up to ``most`` bytes of text; a longer row alone."""
    _, offsets = flat(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
        to = min(max(to, at + 1), batch.num_rows)
        yield batch.slice(at, to - at)
        at = to


def spans(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end of each word, and the n + 1 word offsets of the rows."""
    inside = kind[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside
    before[offsets] = False
    starts = np.flatnonzero(inside & ~before[:-1])
    after = np.zeros(len(data) + 1, bool)
    after[:-1] = inside
    after[offsets] = False
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word's bytes, from running sums over pieces of bounded size."""
    out = np.empty(len(starts), U64)
    at = 0
    while at < len(starts):
        base = starts[at]
        to = max(int(np.searchsorted(ends, base + CHUNK, side="right")), at + 1)
        up, down = _power_tables(BASE, int(ends[to - 1] - base) + 1)
        sums = np.zeros(len(up), U64)
        np.cumsum(BYTE_CODES[data[base : ends[to - 1]]] * up[:-1], out=sums[1:])
        s, e = starts[at:to] - base, ends[at:to] - base
        out[at:to] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(U64))
        at = to
    return out


def window_hashes(hashes: np.ndarray, k: int, base: np.uint64 = WORD_BASES[0]) -> np.ndarray:
    """A hash of each k consecutive words (of the whole array; see window_rows)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.empty(n, U64)
    for at in range(0, n, CHUNK - k):
        part = hashes[at : at + CHUNK - 1]
        up, down = _power_tables(base, len(part) + 1)
        sums = np.zeros(len(part) + 1, U64)
        np.cumsum(part * up[:-1], out=sums[1:])
        m = min(len(part) - k + 1, n - at)
        out[at : at + m] = mix((sums[k : k + m] - sums[:m]) * down[:m])
    return out


def window_rows(word_offsets: np.ndarray, k: int) -> np.ndarray:
    """Indices of the windows of k words that lie within one row."""
    starts, ends = word_offsets[:-1], word_offsets[1:]
    counts = np.maximum(ends - starts - k + 1, 0)
    return runs(starts, counts)


def runs(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for count items each, end to end."""
    total = int(counts.sum())
    out = np.ones(total, np.int64)
    filled = counts > 0
    s, c = starts[filled], counts[filled]
    if total == 0:
        return np.zeros(0, np.int64)
    out[0] = s[0]
    heads = np.cumsum(c)[:-1]
    out[heads] = s[1:] - (s[:-1] + c[:-1] - 1)
    return np.cumsum(out)


def joined(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words end to end with one space after each: the bytes, and each word's start and end there."""
    lengths = ends - starts
    new_starts = np.zeros(len(starts), np.int64)
    if len(starts):
        np.cumsum(lengths[:-1] + 1, out=new_starts[1:])
    new_ends = new_starts + lengths
    out = np.full(int(new_ends[-1]) + 1 if len(starts) else 0, 0x20, np.uint8)
    out[runs(new_starts, lengths)] = data[runs(starts, lengths)]
    return out, new_starts, new_ends
