"""Benchmark decontamination by greedy string tiling.

Seeds are runs of five words (lower-cased letters and digits) that a document and a
benchmark item share.  Where an item has seeds enough, the longest common run of
unmarked words is found by running Karp-Rabin hashes, all such runs that do not
overlap are marked as tiles, and so on down to five words.  Tiles may stand in any
order, so reordered passages count.  A document is contaminated by an item when the
tiles cover ``share`` of the item's words.

The benchmark is cut into blocks of bounded size; each block's seed table is
broadcast and all documents are matched against it in one pass without a shuffle.
More benchmark means more blocks, not larger ones.

Defined results: null and empty texts match nothing; items of fewer than five words
are never matched; equal rows are matched each for itself; empty tables leave every
document clean; other columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of
from .words import LETTERS, Words, give_back, slices

SEED_WORDS = 5
SHARE = 0.6
BLOCK_BYTES = 4 << 20
SLICE_BYTES = 1 << 20  # of text, matched at a time

_B = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class Rolling:
    """Karp-Rabin hashes of all runs of any length over a sequence of word hashes, skipping marked words."""

    def __init__(self, words: np.ndarray, free: np.ndarray) -> None:
        self.free, self.back = free.copy(), _powers(_INV, len(words) + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * _powers(_B, len(words)), dtype=np.uint64)])

    def runs(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of unmarked runs of ``size`` words, and their hashes."""
        taken = np.concatenate([[0], np.cumsum(~self.free)])
        at = np.flatnonzero(taken[size:] == taken[: len(taken) - size])
        return at, (self.sums[at + size] - self.sums[at]) * self.back[at]


def tiles(item: np.ndarray, doc: np.ndarray, free: np.ndarray | None = None, least: int = SEED_WORDS) -> list[tuple[int, int, int]]:
    """Greedy tiles (start in item, start in doc, words); ``free`` marks the words of doc that may be used."""
    a = Rolling(item, np.ones(len(item), bool))
    b = Rolling(doc, np.ones(len(doc), bool) if free is None else free)
    out: list[tuple[int, int, int]] = []
    longest = min(len(item), len(doc))

    def shared(size: int):
        i, hi = a.runs(size)
        j, hj = b.runs(size)
        i, j = i[np.isin(hi, hj)], j[np.isin(hj, hi)]
        return (i, j) if len(i) else None

    while longest >= least and shared(least):
        low, high = least, longest
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if shared(mid) else (low, mid - 1)
        i, j = shared(low)
        at: dict[bytes, list[int]] = {}
        for y in j.tolist():
            at.setdefault(doc[y : y + low].tobytes(), []).append(y)
        marked = False
        for x in i.tolist():
            if not a.free[x : x + low].all():
                continue
            for y in at.get(item[x : x + low].tobytes(), ()):  # the words themselves verify the hash
                if b.free[y : y + low].all():
                    a.free[x : x + low] = b.free[y : y + low] = False
                    out.append((x, y, low))
                    marked = True
                    break
        longest = low if marked else low - 1
    return out


@dataclass
class Block:
    """Word hashes and seeds of a block of benchmark items."""

    ids: list
    words: np.ndarray
    offset: np.ndarray
    seeds: np.ndarray   # distinct, sorted
    first: np.ndarray   # seed -> range of postings
    item: np.ndarray    # postings: item of each occurrence
    least: np.ndarray   # occurrences an item must share before tiling can reach the share

    @staticmethod
    def of(ids: list, texts: pa.Array, share: float) -> Block:
        w = Words(texts, LETTERS)
        grams, at = w.grams(SEED_WORDS)
        order = np.argsort(grams, kind="stable")
        seeds, first = np.unique(grams[order], return_index=True)
        # tiles of k >= 5 words hold k - 4 >= k / 5 seeds
        least = np.maximum(1, np.ceil(np.ceil(share * w.count) / SEED_WORDS)).astype(np.int64)
        return Block(ids, w.hash, w.offset, seeds, np.append(first, len(grams)), w.doc[at][order], least)


def _matches(block: Block, column: pa.Array, share: float) -> dict[int, list[tuple[int, int, int, int]]]:
    """Document -> (item, its words, covered words, tiles) for each item covered enough."""
    if not len(block.seeds):
        return {}
    words = Words(column, LETTERS)
    grams, at = words.grams(SEED_WORDS)
    slot = np.minimum(np.searchsorted(block.seeds, grams), len(block.seeds) - 1)
    hit = np.flatnonzero(block.seeds[slot] == grams)
    docs, found = words.doc[at[hit]], {}
    for lo, hi in zip(*(lambda c: (c[:-1], c[1:]))(np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1], [True]]))) if len(docs) else ((), ())):
        d = int(docs[lo])
        mine, where = slot[hit[lo:hi]], at[hit[lo:hi]] - words.offset[d]
        distinct = np.unique(mine)
        items, counts = np.unique(np.concatenate([block.item[block.first[s] : block.first[s + 1]] for s in distinct]), return_counts=True)
        for item in items[counts >= block.least[items]].tolist():
            text = block.words[block.offset[item] : block.offset[item + 1]]
            own = np.array([item in block.item[block.first[s] : block.first[s + 1]] for s in distinct])
            starts = where[own[np.searchsorted(distinct, mine)]]
            # only words inside a seed can be in a tile; a gap between them stays as one marked word
            spots = np.unique(np.concatenate([starts + x for x in range(SEED_WORDS)]))
            gap = np.concatenate([[0], np.cumsum(np.diff(spots) > 1)])
            cut = np.zeros(len(spots) + int(gap[-1]), np.uint64)
            free = np.zeros(len(cut), bool)
            cut[np.arange(len(spots)) + gap] = words.hash[words.offset[d] + spots]
            free[np.arange(len(spots)) + gap] = True
            got = tiles(text, cut, free)
            covered = sum(t[2] for t in got)
            if covered >= share * len(text):
                found.setdefault(d, []).append((item, len(text), covered, len(got)))
    return found


def blocks(benchmark: DataFrame, share: float) -> Iterator:
    """Broadcast blocks of the benchmark (item_id, text)."""
    rows = benchmark.select("item_id", text_of().alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-size // BLOCK_BYTES))
    for b in range(n):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).toArrow()  # about BLOCK_BYTES
        yield benchmark.sparkSession.sparkContext.broadcast(Block.of(part.column(0).to_pylist(), part.column(1).combine_chunks() if part.num_rows else pa.array([], pa.string()), share))


def contaminated(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """One row per contaminated document and item: doc_id, item_id, item_words, covered_words, tiles, coverage."""
    id_type, item_type = dict(docs.dtypes)["doc_id"], dict(benchmark.dtypes)["item_id"]
    out = None
    for block in blocks(benchmark, share):

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, 1, SLICE_BYTES):
                rows = [(d, *m) for d, ms in _matches(block.value, batch.column(1), share).items() for m in ms]
                cols = list(zip(*rows)) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(cols[0], pa.int64())), pa.array([block.value.ids[i] for i in cols[1]], _item_type(block.value.ids)), *[pa.array(c, pa.int64()) for c in cols[2:]]],
                    ["doc_id", "item_id", "item_words", "covered_words", "tiles"])

        part = docs.select("doc_id", text_of().alias("text")).mapInArrow(run, f"doc_id {id_type}, item_id {item_type}, item_words long, covered_words long, tiles long")
        out = part if out is None else out.unionByName(part)
    return out.withColumn("coverage", F.col("covered_words") / F.col("item_words"))


def _item_type(ids: list) -> pa.DataType:
    known = [i for i in ids if i is not None]
    return pa.array(known[:1]).type if known else pa.int64()


def decontaminate(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """The documents that no benchmark item contaminates, with their columns as they are."""
    for block in blocks(benchmark, share):
        docs = docs.where(F.arrow_udf(_cleaner(block, share), "boolean")("text"))
    return docs


def _cleaner(block, share: float):
    """Which texts no item of the block contaminates."""

    def clean(text: pa.Array) -> pa.Array:
        out, first = np.ones(len(text), bool), 0
        for part in slices([pa.RecordBatch.from_arrays([text], ["text"])], 0, SLICE_BYTES):
            out[[first + d for d in _matches(block.value, part.column(0), share)]] = False
            first += part.num_rows
        give_back()
        return pa.array(out)

    return clean
