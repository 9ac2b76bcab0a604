"""A small gated recurrent language model in numpy with a class-factored softmax.

Words are ids: 0 is the end of a document, 1 any word outside the vocabulary, the
rest the vocabulary by frequency.  Ids are grouped into classes of equal size in
that order; P(word) = P(class | state) * P(word | class, state).  The state before a
word predicts it; the word's own gate inputs then update the state.
"""

from __future__ import annotations

import math

import numpy as np

HIDDEN = 16
CLASS_SIZE = 32
WINDOW = 16       # steps of truncated backpropagation; the state goes on beyond
STREAMS = 128     # documents trained side by side
RATE = 0.1
CLIP = 1.0


def _exp_sums(x: np.ndarray, blocks: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """exp(x) in place and its row sums, block by block; rows are shifted by their largest value only where that is needed."""
    shift = 0.0
    if x.size and max(float(x.max()), 0.0) > 60:
        shift = x.max(1, keepdims=True)
        x -= shift
    np.exp(x, x)
    sums, ones = np.empty(len(x), x.dtype), np.ones(x.shape[1], x.dtype)
    for _, a, b in blocks:
        np.matmul(x[a:b], ones, sums[a:b])
    return sums, shift


def _picked(x: np.ndarray, at: np.ndarray, blocks: list[tuple[int, int, int]]) -> np.ndarray:
    """Log softmax of one column per row; x is used up."""
    one = x[np.arange(len(at)), at]
    sums, shift = _exp_sums(x, blocks)
    return one - np.log(sums) - (shift[:, 0] if isinstance(shift, np.ndarray) else shift)


def _slope(x: np.ndarray, at: np.ndarray, blocks: list[tuple[int, int, int]]) -> None:
    """Gradient of -log softmax at one column per row, in place."""
    x /= _exp_sums(x, blocks)[0][:, None]
    x[np.arange(len(at)), at] -= 1


def _row_sums(x: np.ndarray, first: np.ndarray, out: np.ndarray) -> None:
    """Sums of runs of rows, each from its first row on; a run of one row is that row."""
    size = np.diff(first, append=len(x))
    out[:] = x.take(first, 0)
    many = np.flatnonzero(size > 1)
    if len(many):
        rows = np.flatnonzero(np.repeat(size > 1, size))
        out[many] = np.add.reduceat(x.take(rows, 0), np.cumsum(size[many]) - size[many])


class _Steps:
    """Documents side by side, the longest first: how many run at each step, and the words of a run of steps."""

    def __init__(self, ids: np.ndarray, offsets: np.ndarray, order: np.ndarray) -> None:
        size = np.diff(offsets)[order]
        self.ids, self.order, self.n = ids, order, len(order)
        self.first = offsets[:-1][order]
        self.lives = np.searchsorted(-size, -np.arange(int(size.max(initial=0))))  # documents with more than t words
        self.at = np.concatenate([[0], np.cumsum(self.lives)])

    def words(self, t: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Words of the steps from ``t`` to before ``end``, step by step, and their documents."""
        lives = self.lives[t:end]
        who = np.arange(self.at[t], self.at[end]) - np.repeat(self.at[t:end], lives)
        return self.ids[self.first[who] + np.repeat(np.arange(t, end), lives)], who


class Gru:
    """Parameters: gate inputs per word, recurrent weights, class and word outputs."""

    def __init__(self, counts: np.ndarray, hidden: int = HIDDEN, size: int = CLASS_SIZE, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        n, self.hidden, self.size = len(counts), hidden, size
        self.n, self.classes = n, -(-n // size)
        p = np.full(self.classes * size, 0.0)
        p[:n] = counts + 0.5
        p = p.reshape(self.classes, size)
        f = np.float32
        self.shapes = {"win": (n, 3 * hidden), "u": (hidden, 3 * hidden), "b": (3 * hidden,), "wc": (hidden, self.classes), "bc": (self.classes,), "ww": (self.classes, hidden, size), "bw": (self.classes, size)}
        self.p = {"win": rng.normal(0, 0.1, self.shapes["win"]).astype(f), "u": rng.normal(0, 0.25, self.shapes["u"]).astype(f), "b": np.zeros(3 * hidden, f),
                  "wc": rng.normal(0, 0.05, self.shapes["wc"]).astype(f), "bc": np.log(p.sum(1) / p.sum()).astype(f),
                  "ww": rng.normal(0, 0.05, self.shapes["ww"]).astype(f), "bw": np.log(np.maximum(p / p.sum(1, keepdims=True), 1e-12)).astype(f)}
        self.p["bw"][p == 0] = -1e9  # places without a word
        self.cache = {k: np.full(v.shape, 1e-3, f) for k, v in self.p.items()}
        self.room: dict[str, np.ndarray] = {}

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in self.shapes])

    def load(self, flat: np.ndarray) -> Gru:
        at = 0
        for k, shape in self.shapes.items():
            size = int(np.prod(shape))
            self.p[k] = flat[at : at + size].reshape(shape).astype(np.float32)
            at += size
        return self

    def _space(self, name: str, *shape: int) -> np.ndarray:
        """A work array, the same memory each time; its values are left over."""
        size = math.prod(shape)
        if name not in self.room or self.room[name].size < size:
            self.room[name] = np.empty(size, np.float32)
        return self.room[name][:size].reshape(shape)

    def _tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each word's part of the gates and of n, and the recurrent weights; sigmoid(x) is (1 + tanh(x / 2)) / 2, the half is in them."""
        k, half = self.hidden, np.float32(0.5)
        word, u = self.p["win"] + self.p["b"], self.p["u"].copy()
        u[:, : 2 * k] *= half
        return half * word[:, : 2 * k], np.ascontiguousarray(word[:, 2 * k :]), u

    def _step(self, h: np.ndarray, gates: np.ndarray, inner: np.ndarray, hz: np.ndarray, hn: np.ndarray, zr: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The next states, from the words' and the states' parts; fills the gates ``zr`` and ``n``."""
        k = self.hidden
        np.add(hz, gates, zr)
        np.tanh(zr, zr)
        zr += np.float32(1)
        zr *= np.float32(0.5)
        np.multiply(zr[:, k:], hn, n)
        n += inner
        np.tanh(n, n)
        h = h - n
        h *= zr[:, :k]
        h += n
        return h

    def _walk(self, words: np.ndarray, lives: np.ndarray, h: np.ndarray):
        """States before each word of some steps, their gates z and r, n, the states' part of n, and the states at the end.

        ``words`` are in order of steps, ``lives`` of them in each: those of the
        documents still running, the longest first.
        """
        k, size = self.hidden, len(words)
        at = [0, *np.cumsum(lives).tolist()]
        gates, inner, u = self._tables()
        gates = np.take(gates, words, 0, self._space("gates", size, 2 * k), "clip")
        inner = np.take(inner, words, 0, self._space("inner", size, k), "clip")
        before, new, zr, hu = (self._space(name, size, width) for name, width in (("before", k), ("new", k), ("zr", 2 * k), ("hu", 3 * k)))
        hz, hn = hu[:, : 2 * k], hu[:, 2 * k :]
        for a, b in zip(at, at[1:]):
            now = before[a:b]
            now[:] = h[: b - a]
            np.matmul(now, u, hu[a:b])
            h = self._step(now, gates[a:b], inner[a:b], hz[a:b], hn[a:b], zr[a:b], new[a:b])
        return before, zr, new, hn, h

    def _by_class(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
        """Classes, places inside them, the words' order by class, and each present class with its range there."""
        kind, inner = np.divmod(words, self.size)
        order = np.argsort(kind.astype(np.uint16) if self.classes <= 1 << 16 else kind, kind="stable")
        ends = np.cumsum(np.bincount(kind, minlength=self.classes)).tolist()
        return kind, inner, order, [(c, a, b) for c, (a, b) in enumerate(zip([0, *ends], ends)) if b > a]

    def _class_outputs(self, states: np.ndarray) -> np.ndarray:
        x = np.matmul(states, self.p["wc"], self._space("outputs", len(states), self.classes))
        x += self.p["bc"]
        return x

    def _word_outputs(self, states: np.ndarray, blocks: list[tuple[int, int, int]]) -> np.ndarray:
        """Outputs inside each row's class; rows are ordered by class.  They take the place of the class outputs."""
        x = self._space("outputs", len(states), self.size)
        for c, a, b in blocks:
            here = x[a:b]
            np.matmul(states[a:b], self.p["ww"][c], here)
            here += self.p["bw"][c]
        return x

    def log_chance(self, states: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Natural log of each word's probability in its state."""
        kind, inner, order, blocks = self._by_class(words)
        out = _picked(self._class_outputs(states), kind, [(0, 0, len(kind))])
        states = np.take(states, order, 0, self._space("states", *states.shape), "clip")
        out[order] += _picked(self._word_outputs(states, blocks), inner[order], blocks)
        return out

    def score(self, ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Natural log probability of each document, given all ids (each document ends with 0) and offsets."""
        docs, k = _Steps(ids, offsets, np.argsort(-np.diff(offsets), kind="stable")), self.hidden
        gates, inner, u = self._tables()
        uz, un = np.ascontiguousarray(u[:, : 2 * k]), np.ascontiguousarray(u[:, 2 * k :])
        # one step's parts; only the states are kept for a window
        of_gates, hz, zr = (self._space(name, docs.n, 2 * k) for name in ("gates", "hz", "zr"))
        of_inner, hn, new = (self._space(name, docs.n, k) for name in ("inner", "hn", "new"))
        h, total = np.zeros((docs.n, k), np.float32), np.zeros(docs.n)
        for t in range(0, len(docs.lives), WINDOW):
            words, who = docs.words(t, min(t + WINDOW, len(docs.lives)))
            before, a = self._space("before", len(words), k), 0
            for live in docs.lives[t : t + WINDOW].tolist():
                b = a + live
                now, here, z, n = before[a:b], words[a:b], hz[:live], hn[:live]
                now[:] = h[:live]
                np.matmul(now, uz, z)
                np.matmul(now, un, n)
                h = self._step(now, np.take(gates, here, 0, of_gates[:live], "clip"), np.take(inner, here, 0, of_inner[:live], "clip"), z, n, zr[:live], new[:live])
                a = b
            total += np.bincount(who, weights=self.log_chance(before, words), minlength=docs.n)
        out = np.zeros(docs.n)
        out[docs.order] = total
        return out

    def _output_gradient(self, s: np.ndarray, words: np.ndarray, grad: dict) -> np.ndarray:
        kind, inner, order, blocks = self._by_class(words)
        d = self._class_outputs(s)
        _slope(d, kind, [(0, 0, len(kind))])
        grad["wc"], grad["bc"] = s.T @ d, d.sum(0)
        ds = np.matmul(d, self.p["wc"].T, self._space("ds", *s.shape))
        grad["ww"], grad["bw"] = (self._space(name, *self.shapes[name]) for name in ("ww", "bw"))
        grad["ww"].fill(0)
        grad["bw"].fill(0)
        s, inside = np.take(s, order, 0, self._space("states", *s.shape), "clip"), self._space("inside", *s.shape)
        d = self._word_outputs(s, blocks)
        _slope(d, inner[order], blocks)
        ones, back = np.ones(len(d), np.float32), self.p["ww"].transpose(0, 2, 1)
        for c, a, b in blocks:
            here = d[a:b]
            np.matmul(s[a:b].T, here, grad["ww"][c])
            np.matmul(ones[a:b], here, grad["bw"][c])
            np.matmul(here, back[c], inside[a:b])
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        ds += np.take(inside, place, 0, s, "clip")
        return ds

    def learn(self, ids: np.ndarray, offsets: np.ndarray) -> None:
        """One pass of truncated backpropagation over the documents, ``STREAMS`` at a time, alike lengths together."""
        order = np.argsort(-np.diff(offsets), kind="stable")
        for a in range(0, len(order), STREAMS):
            docs = _Steps(ids, offsets, order[a : a + STREAMS])
            h = np.zeros((docs.n, self.hidden), np.float32)
            for t in range(0, len(docs.lives), WINDOW):
                end = min(t + WINDOW, len(docs.lives))
                h = self._learn_window(docs.words(t, end)[0], docs.lives[t:end], h)

    def _learn_window(self, words: np.ndarray, lives: np.ndarray, h: np.ndarray) -> np.ndarray:
        k, p, size = self.hidden, self.p, len(words)
        before, zr, n, hn, h = self._walk(words, lives, h)
        grad: dict = {}
        ds = self._output_gradient(before, words, grad)
        # the state's gradient times these is that of the gates z, r and n
        z, r = (self._space(name, size, k) for name in "zr")
        z[:], r[:] = zr[:, :k], zr[:, k:]
        rest, part, to_n = (self._space(name, size, k) for name in ("rest", "part", "to_n"))
        to_g, to_u, du, dg = (self._space(name, size, 3, k) for name in ("to_g", "to_u", "du", "dg"))
        np.subtract(1, z, rest)
        np.multiply(n, n, part)
        np.subtract(1, part, part)
        np.multiply(rest, part, to_n)
        np.subtract(before, n, part)
        part *= z
        np.multiply(part, rest, to_g[:, 0])
        np.subtract(1, r, rest)
        np.multiply(to_n, hn, part)
        part *= r
        np.multiply(part, rest, to_g[:, 1])
        to_g[:, 2] = to_n
        to_u[:] = to_g
        np.multiply(to_n, r, to_u[:, 2])
        back, flat = np.ascontiguousarray(p["u"].T), du.reshape(size, 3 * k)
        kept, through = self._space("kept", size, 1, k), self._space("through", int(lives[0]), k)
        full = np.zeros((int(lives[0]), 1, k), np.float32)  # cut at the window's end
        b = size
        for live in lives[::-1].tolist():
            a = b - live
            dh, flow = full[:live], through[:live]
            kept[a:b] = dh
            np.multiply(to_u[a:b], dh, du[a:b])
            np.matmul(flat[a:b], back, flow)
            dh = dh[:, 0]
            dh *= z[a:b]
            dh += flow
            dh += ds[a:b]
            b = a
        dg = np.multiply(to_g, kept, dg).reshape(size, 3 * k)
        grad["u"], grad["b"] = before.T @ flat, dg.sum(0)
        order = np.argsort(words.astype(np.uint16) if self.n <= 1 << 16 else words, kind="stable")
        now = words[order]
        first = np.flatnonzero(np.concatenate([[True], now[1:] != now[:-1]]))
        met = now[first]
        touched = self._space("touched", len(met), 3 * k)
        _row_sums(np.take(dg, order, 0, to_u.reshape(size, 3 * k), "clip"), first, touched)
        grad["win"] = self._space("win", *self.shapes["win"])
        grad["win"].fill(0)
        grad["win"][met] = touched
        scale = 1.0 / STREAMS
        norm = np.sqrt(sum(float(np.vdot(g, g)) for g in grad.values())) * scale
        scale *= min(1.0, CLIP / max(norm, 1e-9))
        for name, g in grad.items():
            cache, here = self.cache[name], p[name]
            if name == "win":  # words that did not occur stay as they are
                g, cache, here = touched, cache.take(met, 0), here.take(met, 0)
            g *= np.float32(scale)
            square = np.multiply(g, g, self._space("square", *g.shape))
            cache += square
            np.sqrt(cache, square)
            g *= np.float32(RATE)
            g /= square
            here -= g
            if name == "win":
                self.cache[name][met], p[name][met] = cache, here
        return h
