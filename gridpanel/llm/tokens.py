"""Token ids by the ``tokenizers`` library, part by part through a bounded cache.

For tokenizers that split at white space and drop it, a text's ids are its words'
ids end to end. Words of plain letters and signs are cut and lower-cased here as the
tokenizer's own pattern does it, for a whole batch at once, so that its merges alone
remain to be run, once for each different part of the batch that is not in the cache.
Other words go through the pattern, or the whole tokenizer, one by one.
"""

from __future__ import annotations

import json
import os
import re
import struct

import numpy as np

from gridpanel.llm import words

CACHE_BYTES = 48 << 20  # of a worker's parts and their ids
ENTRY_BYTES = 170  # what Python takes for an entry besides its bytes

# The split pattern of the word-level vocabulary, for ASCII and the
# letters of Latin-1, which NFC leaves as they are.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PLAIN = re.compile(r"(?!.*<\|)[!-~À-ÖØ-öø-ÿ]+")
# Kinds of bytes: white space, letters (ASCII and, by their two bytes, Latin-1), signs;
# 3, a word that is not cut here: digits, apostrophes, "<", control and all other bytes.
SPACE, LETTER, SIGN, OTHER = range(4)
KINDS = np.full(256, OTHER, np.uint8)
KINDS[0x21:0x7F] = SIGN
KINDS[~words.SPACED] = SPACE
KINDS[[*range(0x41, 0x5B), *range(0x61, 0x7B), 0xC3, *range(0x80, 0xC0)]] = LETTER
KINDS[[*range(0x30, 0x3A), 0x27, 0x3C]] = OTHER
LETTERS = re.compile(r"[a-zß-öø-ÿ]+")
PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")


class Generations(dict):
    """A cache of two generations within a bound in bytes: when the young one has half of
    it, it becomes the old one, whose entries come back only when they are asked for."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.old, self.size = make, most // 2, {}, 0

    def __missing__(self, item):
        value = self.old.get(item)
        if value is None:
            value = self.make(item)
        if self.size >= self.most:
            self.old = dict(self)
            self.clear()
            self.size = 0
        self.size += ENTRY_BYTES + len(item) + len(value)
        self[item] = value
        return value


class WordTokenizer:
    """Little-endian unsigned 32-bit ids of whole texts."""

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        # of these two alone: as a whole it would bring the vocabulary along
        parts = (self.whole.normalizer, self.whole.pre_tokenizer)
        normalizer, steps = (json.loads(p.__getstate__()) if p is not None else {} for p in parts)
        self.plain = self._is_plain(normalizer, steps)
        self.model = self.whole.model
        shown = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.shown = {c: shown.pre_tokenize_str(chr(c))[0][0] for c in range(0xC0, 0x100)}
        self.parts = Generations(self._run, cache_bytes)

    @staticmethod
    def _is_plain(normalizer: dict, pre_tokenizer: dict) -> bool:
        kinds = [x["type"] for x in normalizer.get("normalizers", [])]
        steps = pre_tokenizer.get("pretokenizers", [])
        return (
            kinds == ["NFC", "Replace", "Lowercase"]
            and [x["type"] for x in steps] == ["Split", "ByteLevel"]
            and steps[0]["pattern"] == {"Regex": PATTERN}
            and steps[0]["behavior"] == "Removed"
        )

    def _encoded(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _part(self, part: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(part if part.isascii() else part.translate(self.shown))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _run(self, run: bytes) -> bytes:
        """A run of letters or signs, or a word that was not cut."""
        if run.isalpha():  # of bytes: ASCII letters only
            return self._part(run.decode())
        text = run.decode()
        if LETTERS.fullmatch(text):
            return self._part(text)
        if not PLAIN.fullmatch(text):
            return self._encoded(text)
        return b"".join(map(self._part, PARTS.findall(text.lower())))

    def batch(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts that lie end to end (see ``words.flat``), and their offsets."""
        if not self.plain:
            raw = data.tobytes()
            each = [self._encoded(raw[a:b].decode()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            return np.frombuffer(b"".join(each), "<u4"), np.cumsum([0, *[len(x) // 4 for x in each]])
        kind, lower = KINDS[data], words.LOWER[data]
        second = np.zeros(len(data), bool)
        second[1:] = data[:-1] == 0xC3
        kind[second & ((data == 0x97) | (data == 0xB7))] = OTHER  # the signs for times and divided by
        lower[second & (data >= 0x80) & (data <= 0x9E)] += 0x20
        starts, ends, _ = words.spans(data, offsets, words.SPACED)
        others = np.zeros(len(data) + 1, np.int64)
        np.cumsum(kind == OTHER, out=others[1:])
        uncut = others[ends] > others[starts]
        inside = words.runs(starts[uncut], (ends - starts)[uncut])
        kind[inside] = OTHER
        lower[inside] = data[inside]
        near = np.zeros(len(data) + 1, np.uint8)
        near[1:] = kind
        near[offsets] = SPACE
        starts = np.flatnonzero((kind != SPACE) & (kind != near[:-1]))
        near[:-1] = kind
        near[offsets] = SPACE
        ends = np.flatnonzero((kind != SPACE) & (kind != near[1:])) + 1
        rows = np.searchsorted(starts, offsets)
        first, which = _distinct(words.word_hashes(lower, starts, ends))
        raw = lower.tobytes()
        found = [self.parts[raw[a:b]] for a, b in zip(starts[first].tolist(), ends[first].tolist())]
        sizes = np.array([len(x) // 4 for x in found], np.int64)
        flat = np.frombuffer(b"".join(found), "<u4")
        counts = sizes[which]
        ids = flat[words.runs((np.cumsum(sizes) - sizes)[which], counts)]
        return ids, np.concatenate([[0], np.cumsum(counts)])[rows]

    def ids(self, text: bytes) -> bytes:
        return self.batch(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0].astype("<u4").tobytes()


def _distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of one of each different hash, and which of these each hash is."""
    order = np.argsort(hashes)
    new = np.ones(len(order), bool)
    new[1:] = hashes[order[1:]] != hashes[order[:-1]]
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    return order[new], which


_LOADED: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One tokenizer a worker, whose cache lasts over its tasks."""
    if path not in _LOADED:
        _LOADED[path] = WordTokenizer(path)
    return _LOADED[path]
