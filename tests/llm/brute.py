"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import xxhash

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SMALL = {c: c + 32 for c in range(65, 91)}


def spaced(text, lower=False):
    return SPACED.findall((text or "").translate(SMALL) if lower else text or "")


def alnum(text):
    return ALNUM.findall((text or "").translate(SMALL))


def fingerprint(text, k=4):
    w = spaced(text, True)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(n, linked):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def simhash(rows, bits=4):
    fps = np.array([fingerprint(t) for _, t in rows], np.uint64)
    roots = components(len(rows), lambda i, j: int(np.bitwise_count(fps[i] ^ fps[j])) <= bits)
    least = {}
    for (d, _), r in zip(rows, roots):
        if d is not None:
            least[r] = min(d, least.get(r, d))
    return sorted((str(d), f"{int(f):016x}", least.get(r)) for (d, _), f, r in zip(rows, fps, roots))


def one_of_each(rows, bits=4):
    """Keys that stay (unique keys)."""
    fps = np.array([fingerprint(t) for _, t in rows], np.uint64)
    roots = components(len(rows), lambda i, j: int(np.bitwise_count(fps[i] ^ fps[j])) <= bits)
    return {min(d for (d, _), r in zip(rows, roots) if r == root) for root in set(roots)}


def without_repeats(rows, k=35):
    seen = Counter()
    for _, t in rows:
        w = spaced(t)
        seen.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for d, t in rows:
        w = spaced(t)
        covered = [False] * len(w)
        for i in range(len(w) - k + 1):
            if seen[tuple(w[i : i + k])] > 1:
                covered[i : i + k] = [True] * k
        out.append((d, len(w), sum(covered), " ".join(x for x, c in zip(w, covered) if not c)))
    return out


def phrases(text, listed):
    w = alnum(text)
    places, labels = [], set()
    for label, phrase in listed:
        p = phrase.split()
        found = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        places += found
        if found:
            labels.add(label)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def unigram(rows):
    """doc_id -> held_out, n_tokens, n_known, N, base score; and the counts."""
    counts, docs = Counter(), 0
    held = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d, _ in rows}
    for d, t in rows:
        if not held[d]:
            counts.update(spaced(t, True))
            docs += 1
    if docs:
        counts["\n"] = docs
    n, v = sum(counts.values()), len(counts)
    out = {}
    for d, t in rows:
        tokens = [*spaced(t, True), "\n"]
        base = sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in tokens)
        out[d] = (held[d], len(tokens), sum(counts[x] > 0 for x in tokens), n, base)
    return out, counts


def smith_waterman(passage, item):
    """Best local score in halves: match 2, mismatch -1, gap -1."""
    table = np.zeros((len(item) + 1, len(passage) + 1), int)
    for i, a in enumerate(item):
        for j, b in enumerate(passage):
            table[i + 1, j + 1] = max(0, table[i, j] + (2 if a == b else -1), table[i, j + 1] - 1, table[i + 1, j] - 1)
    return int(table.max())


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def ranked(docs, items, k=10):
    """(item, rank, doc, score), sorted."""
    texts = [(d, Counter(x.translate(SMALL) for x in TERM.findall(t or ""))) for d, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in texts), sum(sum(c.values()) for _, c in texts)
    spread = Counter(x for _, c in texts for x in c)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(x.translate(SMALL) for x in TERM.findall(t or ""))
    out = []
    for i, terms in wanted.items():
        found = []
        for d, c in texts:
            m = 100 - 90 + (90 * sum(c.values()) * n_docs) // n_terms if n_terms else 0
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * spread[x] + 1))) * ((1_000_000_000 * c[x]) // (1000 * c[x] + 8 * m))
                for x in terms
                if c[x]
            )
            found.append((-score, d is None, d))
        for r, (s, _, d) in enumerate(sorted(x for x in found if x[0] < 0)[:k], 1):
            out.append((i, r, d, -s))
    return sorted(out, key=str)


LETTERS = re.compile("[A-Za-zÀ-ÿ]+")


def word_counts(rows, every=97, shortest=5, least=3):
    counts = Counter()
    for d, t in rows:
        for w in LETTERS.findall(t or ""):
            w = w.translate(SMALL)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if every and h % every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    return {w: n for w, n in counts.items() if len(w) >= shortest and n >= least}


def near(a, b):
    """One inserted, deleted or replaced code point."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[at + (len(a) == len(b)) :] == b[at + 1 :]


def variants(counts):
    """(word, form, root, n, n_near, form_n), sorted."""
    close = {w: [x for x in counts if near(w, x)] for w in counts}
    form = {}
    for w, some in close.items():
        best = min(some, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None
    out = []
    for w, f in form.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, f, root, counts[w], len(close[w]), f and counts[f]))
    return sorted(out)


PRIVATE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def private_spans(text):
    """(start, kind number, end, value), sorted."""
    out = []
    for k, (kind, pattern) in enumerate(PRIVATE.items()):
        for m in pattern.finditer(text or ""):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            value = "".join(map(str, digits))
            if kind == "email":
                value = m[0].lower()
            if kind == "ip":
                value = m[0]
                if any(int(p) > 255 for p in m[0].split(".")):
                    continue
            if kind == "card":
                total = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits)))
                if not 14 <= len(digits) <= 19 or total % 10:
                    continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end(), value))
    return sorted(out)


def disclosed(rows, around=8, support=2, gain=3.0, left=1.0):
    """(key, text) -> (start, end, general) of terms that disclose an entity."""
    parsed = []
    for _, t in rows:
        spans = private_spans(t)
        found = [(m.start(), m.end(), m[0].translate(SMALL)) for m in TERM.finditer(t or "")]
        free = [not any(m < b and e > a for a, _, b, _ in spans) for m, e, _ in found]
        parsed.append((t, spans, found, free))
    spread, together, texts, holders = Counter(), Counter(), {}, Counter()
    for t, spans, found, free in parsed:
        spread.update({x for (_, _, w), f in zip(found, free) if f for x in (w, w[:3] + "*")})
        own = {}
        for a, k, b, v in spans:
            before = [i for i, w in enumerate(found) if w[1] <= a][-around:]
            behind = [i for i, w in enumerate(found) if w[0] >= b][:around]
            own.setdefault((k, v), set()).update(x for i in before + behind if free[i] for x in (found[i][2], found[i][2][:3] + "*"))
        for e, terms in own.items():
            holders[e] += 1
            for x in terms:
                together[e, x] += 1
                texts.setdefault((e, x), set()).add(t)
    bad = set()
    for (e, x), n in together.items():
        pmi = math.log2(len(rows) * n / (spread[x] * holders[e]))
        if len(texts[e, x]) >= support and pmi >= gain and -math.log2(n / spread[x]) <= left:
            bad.add(x)
    out = {}
    for (d, t), (_, _, found, free) in zip(rows, parsed):
        out[d, t] = [(a, b, w[:3] + "*" not in bad) for (a, b, w), f in zip(found, free) if f and w in bad]
    return out


def toxicity_rows(rows, labels):
    """Per row the counts of its words and beginnings (4 to 8 bytes), and the label; one row a key."""
    by_key = {}
    for d, t in rows:
        if d in labels:
            by_key[d] = min(by_key.get(d, t or ""), t or "")
    out = []
    for d, t in by_key.items():
        own = alnum(t)
        counts = Counter(own)
        counts.update((w.encode()[:n], n) for w in own for n in (4, 5, 6, 7, 8) if len(w.encode()) > n)
        out.append((counts, len(own), labels[d]))
    return out


def telling(counted, least_rows=3, least=15.0):
    """Score of each word or beginning whose rows are toxic more often than chance gives."""
    n, toxic = len(counted), sum(y for *_, y in counted)
    out = {}
    for w in {w for c, *_ in counted for w in c}:
        a = sum(y for c, _, y in counted if w in c)
        b = sum(1 - y for c, _, y in counted if w in c)
        c, d = toxic - a, n - toxic - b
        score = n * (a * d - b * c) ** 2 / (toxic * (n - toxic) * (a + b) * max(c + d, 1))
        if a * (n - toxic) > b * toxic and a >= least_rows and score >= least:
            out[w] = score
    return out
