"""A gated recurrent language model in numpy.

The unit is the update-gate network: one gate decides how much of the state a candidate
replaces, both from the input word and the state before. Input words are looked up in a
table that already holds their part of gate and candidate. The output is factored: a
softmax over classes, then one over the words of a class; words are numbered by falling
count and a class is a run of ``CLASS`` numbers. Training is truncated backpropagation
through windows of time steps over many streams at once, with Adam; scoring carries each
document's state from window to window to its end.
"""

from __future__ import annotations

import heapq

import numpy as np

CLASS = 32
HIDDEN = 16
STREAMS = 512
WINDOW = 32
POOL_SLOT = 2048
f32 = np.float32


def start(counts: np.ndarray, hidden: int = HIDDEN, seed: int = 7) -> dict[str, np.ndarray]:
    """Parameters for words with these counts (falling); output begins at their shares."""
    rng = np.random.default_rng(seed)
    n, classes = len(counts), -(-len(counts) // CLASS)
    share = np.full(classes * CLASS, 1e-12)
    share[:n] = (counts + 0.5) / (counts + 0.5).sum()
    share = share.reshape(classes, CLASS)
    by_class = share.sum(1)
    return {
        "inputs": rng.normal(0, 0.3, (n, 2 * hidden)).astype(f32),
        "gates": (rng.normal(0, 1, (hidden, 2 * hidden)) / np.sqrt(hidden)).astype(f32),
        "class_w": rng.normal(0, 0.1, (hidden, classes)).astype(f32),
        "class_b": np.log(by_class).astype(f32),
        "word_w": rng.normal(0, 0.1, (classes, hidden, CLASS)).astype(f32),
        "word_b": np.log(share / by_class[:, None]).astype(f32),
    }


def _step(p, a: np.ndarray, h: np.ndarray):
    """One time step: a, the input's part, is overwritten; returns gate, candidate, state.
    The gate's half goes through the same tanh: sigmoid(2 x) = (1 + tanh(x)) / 2."""
    k = h.shape[1]
    a += h @ p["gates"]
    np.tanh(a, out=a)
    z, c = a[:, :k], a[:, k:]
    z += 1
    z *= f32(0.5)
    new = c - h
    new *= z
    new += h
    return z, c, new


def _by_class(targets: np.ndarray) -> list[tuple[int, np.ndarray]]:
    classes = (targets // CLASS).astype(np.uint16)  # small integers sort in linear time
    order = np.argsort(classes, kind="stable")
    edges = np.flatnonzero(np.diff(classes[order])) + 1
    return [(int(classes[rows[0]]), rows) for rows in np.split(order, edges) if len(rows)]


def _chosen(logits: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log probability of the chosen column of each row; the exponentials, and their sums.
    Logits stay far below the range of float32 exponentials."""
    picked = logits[np.arange(len(at)), at]
    np.minimum(logits, 60, out=logits)
    np.exp(logits, out=logits)
    sums = logits.sum(1)
    return picked - np.log(sums), logits, sums


def log_probabilities(p, states: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Natural log probability of each target after its state."""
    logits = states @ p["class_w"]
    logits += p["class_b"]
    out = _chosen(logits, targets // CLASS)[0]
    for c, rows in _by_class(targets):
        logits = states[rows] @ p["word_w"][c]
        logits += p["word_b"][c]
        out[rows] += _chosen(logits, targets[rows] % CLASS)[0]
    return out


def score(p, tokens: np.ndarray, offsets: np.ndarray, end: int) -> np.ndarray:
    """Natural log probability of each document: tokens[offsets[i]:offsets[i + 1]], whose
    last token is ``end``. Documents are laid end to end in slots of about equal length,
    which run side by side; a state is zero where a document begins and is carried from
    window to window until it ends."""
    lengths = np.diff(offsets)
    n, total = len(lengths), int(offsets[-1])
    if n == 0:
        return np.zeros(0)
    slots = max(1, min(1024, n, total // POOL_SLOT))
    heap = [(0, s, []) for s in range(slots)]
    for d in np.argsort(-lengths, kind="stable").tolist():
        size, s, docs = heapq.heappop(heap)
        docs.append(d)
        heapq.heappush(heap, (size + int(lengths[d]), s, docs))
    heap.sort(reverse=True)
    order = np.array([d for _, _, docs in heap for d in docs])
    laid_lengths = lengths[order]
    place = np.repeat(offsets[:-1][order], laid_lengths) + np.arange(total) - np.repeat(np.cumsum(laid_lengths) - laid_lengths, laid_lengths)
    laid = tokens[place]
    heads = np.zeros(total, bool)
    heads[np.cumsum(laid_lengths) - laid_lengths] = True
    before = np.empty_like(laid)
    before[0], before[1:] = end, laid[:-1]  # a document ends with ``end``, so it also stands before the next
    sizes = np.array([x[0] for x in heap])
    begins = np.cumsum(sizes) - sizes
    hidden = p["gates"].shape[0]
    h = np.zeros((slots, hidden), f32)
    found = np.empty(total, f32)
    for t in range(0, int(sizes[0]), WINDOW):
        live = int(np.searchsorted(-sizes, -t, side="left"))
        steps = min(WINDOW, int(sizes[0]) - t)
        at = begins[:live, None] + t + np.arange(steps)
        inside = (t + np.arange(steps)) < sizes[:live, None]
        at = np.where(inside, at, 0)
        a = p["inputs"][before[at].T]
        fresh = heads[at].T
        states = np.empty((steps, live, hidden), f32)
        h = h[:live]
        for s in range(steps):
            if fresh[s].any():
                h = np.where(fresh[s][:, None], f32(0), h)
            h = _step(p, a[s], h)[2]
            states[s] = h
        inside, at = inside.T, at.T
        found[at[inside]] = log_probabilities(p, states[inside], laid[at[inside]])
    by_token = np.empty(total)
    by_token[place] = found
    return np.add.reduceat(by_token, offsets[:-1])


class Trainer:
    """Adam over the gradients of one window at a time."""

    def __init__(self, p: dict[str, np.ndarray], rate: float = 0.01):
        self.p = {k: v.copy() for k, v in p.items()}
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.v = {k: np.zeros_like(v) for k, v in p.items()}
        self.rate, self.steps = rate, 0

    def documents(self, tokens: np.ndarray, offsets: np.ndarray, end: int, streams: int = STREAMS) -> int:
        """Train once over documents laid end to end and cut into equal streams; returns
        the number of tokens (the last few that do not fill a row of streams included,
        with the streams shortened to fit them)."""
        total = len(tokens)
        streams = max(1, min(streams, total // WINDOW))
        before = np.empty_like(tokens)
        if total == 0:
            return 0
        before[0], before[1:] = end, tokens[:-1]
        heads = np.zeros(total, bool)
        heads[offsets[:-1][np.diff(offsets) > 0]] = True
        length = -(-total // streams)
        at = np.minimum(np.arange(streams)[:, None] * length + np.arange(length), total - 1)
        real = np.arange(streams)[:, None] * length + np.arange(length) < total
        h = np.zeros((streams, self.p["gates"].shape[0]), f32)
        for t in range(0, length, WINDOW):
            cut = at[:, t : t + WINDOW].T
            h = self._window(before[cut], tokens[cut], heads[cut], real[:, t : t + WINDOW].T, h)
        return total

    def _window(self, x, y, fresh, real, h):
        p, (steps, b), k = self.p, x.shape, h.shape[1]
        a = p["inputs"][x]
        kept = []
        states = np.empty((steps, b, k), f32)
        for s in range(steps):
            if fresh[s].any():
                h = np.where(fresh[s][:, None], f32(0), h)
            z, c, new = _step(p, a[s], h)
            kept.append((h, z, c))
            states[s] = h = new
        flat, targets = states.reshape(-1, k), y.reshape(-1)
        weight = real.reshape(-1).astype(f32) / max(1, real.sum())
        g = {"word_w": np.zeros_like(p["word_w"]), "word_b": np.zeros_like(p["word_b"])}
        _, up, sums = _chosen(flat @ p["class_w"] + p["class_b"], targets // CLASS)
        up *= (weight / sums)[:, None]
        up[np.arange(len(targets)), targets // CLASS] -= weight
        g["class_w"], g["class_b"] = flat.T @ up, up.sum(0)
        d_states = up @ p["class_w"].T
        for c, rows in _by_class(targets):
            own, w = flat[rows], weight[rows]
            _, e, sums = _chosen(own @ p["word_w"][c] + p["word_b"][c], targets[rows] % CLASS)
            e *= (w / sums)[:, None]
            e[np.arange(len(rows)), targets[rows] % CLASS] -= w
            g["word_w"][c], g["word_b"][c] = own.T @ e, e.sum(0)
            d_states[rows] += e @ p["word_w"][c].T
        d_states = d_states.reshape(steps, b, k)
        d_a = np.empty((steps, b, 2 * k), f32)
        back = np.zeros((b, k), f32)
        for s in range(steps - 1, -1, -1):
            before, z, c = kept[s]
            d = d_states[s]
            d += back
            dz = d * z
            np.multiply(dz, 1 - c * c, out=d_a[s, :, k:])
            np.multiply(dz * (1 - z), 2 * (c - before), out=d_a[s, :, :k])
            back = d_a[s] @ p["gates"].T
            back += d
            back -= dz
            if fresh[s].any():
                back = np.where(fresh[s][:, None], f32(0), back)
        earlier = np.stack([x[0] for x in kept]).reshape(-1, k)
        g["gates"] = earlier.T @ d_a.reshape(-1, 2 * k)
        order = np.argsort(x.reshape(-1).astype(np.uint16), kind="stable")
        sorted_words = x.reshape(-1)[order]
        first = np.flatnonzero(np.concatenate([[True], sorted_words[1:] != sorted_words[:-1]]))
        g["inputs"] = np.zeros_like(p["inputs"])
        g["inputs"][sorted_words[first]] = np.add.reduceat(d_a.reshape(-1, 2 * k)[order], first, axis=0)
        self._adam(g)
        return h

    def _adam(self, g) -> None:
        self.steps += 1
        rate = self.rate * np.sqrt(1 - 0.999**self.steps) / (1 - 0.9**self.steps)
        norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        shrink = min(1.0, 1.0 / (norm + 1e-9))
        for name, grad in g.items():
            grad = grad * f32(shrink)
            m, v = self.m[name], self.v[name]
            m += f32(0.1) * (grad - m)
            v += f32(0.001) * (grad * grad - v)
            self.p[name] -= f32(rate) * m / (np.sqrt(v) + f32(1e-8))


def packed(p: dict[str, np.ndarray]) -> bytes:
    return b"".join(p[k].astype("<f4").tobytes() for k in sorted(p))


def unpacked(raw: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = raw[at : at + like[k].size].reshape(like[k].shape).astype(f32)
        at += like[k].size
    return out
