"""Words of whole Arrow string columns as numpy arrays.

Texts are cut into words on their UTF-8 bytes.  Every separator of the operators
is ASCII, so cutting bytes and cutting code points give the same words.  Work goes
in pieces of about one megabyte of text; only word-level arrays are kept longer.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 20
LONG_WORD = 48  # bytes; longer words are hashed one by one

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: words are runs of anything but \x20 and \x09-\x0D
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
#: words are runs of 0-9, a-z (after lower-casing) and everything from U+0080 on
LETTERS = np.zeros(256, bool)
LETTERS[48:58] = LETTERS[97:123] = LETTERS[128:] = True

_MUL = np.uint64(0x9E3779B97F4A7C15)
_FNV = np.uint64(0x100000001B3)
_SEED = np.uint64(0xCBF29CE484222325)


_MALLOC_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc


def give_back() -> None:
    """Return free memory to the system: a worker that is kept for later tasks would hold it beside theirs."""
    pa.default_memory_pool().release_unused()
    if _MALLOC_TRIM:
        _MALLOC_TRIM(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, and once it has ended and its arrays are gone, ``give_back``."""

    def tidied(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    return tidied


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty."""
    if not len(column) or pa.types.is_null(column.type):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    if column.null_count:
        column = pc.fill_null(column, "")
    _, offsets, data = column.buffers()
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    at = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def pieces(data: np.ndarray, offsets: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of documents of about ``limit`` bytes, at least one document each."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1))
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def slices(batches: Iterator[pa.RecordBatch], column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows whose texts take about ``limit`` bytes; one row at least."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        at, n = np.concatenate([[0], np.cumsum(size)]), batch.num_rows
        i = 0
        while i < n:
            j = min(n, max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1))
            yield batch.slice(i, j - i)
            i = j
        pa.default_memory_pool().release_unused()


def spans(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of every word; words end at document borders."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    w = np.zeros(n + 1, bool)
    w[:n] = kind[data]
    first = w[:n].copy()
    first[1:] &= ~w[: n - 1]
    border = offsets[:-1][offsets[:-1] < n]
    first[border] = w[border]
    last = w[:n] & ~w[1:]
    border = border[border > 0] - 1
    last[border] = w[border]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word."""
    h = np.full(len(starts), _SEED)
    size = ends - starts
    live = np.flatnonzero(size <= LONG_WORD)
    at, k = starts[live], 0
    left = size[live]
    while len(live):
        h[live] = (h[live] ^ data[at + k]) * _FNV
        k += 1
        on = left > k
        live, at, left = live[on], at[on], left[on]
    for i in np.flatnonzero(size > LONG_WORD):
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return mix(h)


class Words:
    """Word hashes of a column: ``hash``, ``doc`` and, where kept, the byte spans."""

    def __init__(self, column: pa.Array, kind: np.ndarray = NOT_SPACE, keep_spans: bool = False) -> None:
        data, offsets = utf8(column)
        self.n = len(offsets) - 1
        hashes, docs, first, last = [], [], [], []
        for i, _, piece, at in pieces(data, offsets):
            low = LOWER[piece]
            s, e, d = spans(low, at, kind)
            hashes.append(hashed(low, s, e))
            docs.append(d + i)
            if keep_spans:
                first.append(s + offsets[i])
                last.append(e + offsets[i])
        none = np.zeros(0, np.int64)
        self.data = data
        self.hash = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.doc = np.concatenate(docs) if docs else none
        self.start = np.concatenate(first) if first else none
        self.end = np.concatenate(last) if last else none
        self.count = np.bincount(self.doc, minlength=self.n).astype(np.int64)
        self.offset = np.concatenate([[0], np.cumsum(self.count)])

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each run of ``k`` words inside one document, and the index of its first word."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.doc[:n] == self.doc[k - 1 :])
        g = self.hash[:n].copy()
        for j in range(1, k):
            g *= _MUL
            g += self.hash[j : n + j]
        return mix(g[at]), at

    def word(self, i: int) -> str:
        return LOWER[self.data[self.start[i] : self.end[i]]].tobytes().decode("utf-8", "replace")


def sets(words: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes per document: hash, document, offsets per document; ordered by (document, hash).

    A document of fewer than ``k`` words has its whole word sequence as its one
    shingle, one without words has none.
    """
    g, at = words.grams(k)
    d = words.doc[at]
    short = np.flatnonzero((words.count > 0) & (words.count < k))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for i, s in enumerate(short):
            acc = int(words.count[s])
            for x in words.hash[words.offset[s] : words.offset[s + 1]].tolist():
                acc = (acc * 0x9E3779B97F4A7C15 + x) & 0xFFFFFFFFFFFFFFFF
            whole[i] = acc
        g, d = np.concatenate([g, mix(whole)]), np.concatenate([d, short])
    order = np.lexsort((g, d))
    g, d = g[order], d[order]
    if len(g):
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (d[1:] != d[:-1])
        g, d = g[new], d[new]
    return g, d, np.concatenate([[0], np.cumsum(np.bincount(d, minlength=words.n))]).astype(np.int64)
