"""Language-model scores of whole documents.

Word counts cover all training documents: tasks sum their words, hash buckets sum
the tasks.  The vocabulary of the recurrent model is the most frequent words; the
model first learns on about ``WARM_DOCS`` documents in one task, then every task goes
on from there with all its own training documents and the weights are averaged,
weighed by tokens.

Scoring is one pass: a document's state runs through all its words.  A word outside
the vocabulary has the model's probability of such a word times the word's share of
all such words in the counts.  Counts of frequent words are broadcast, a table of
bounded length; the others are asked for from the hash buckets, each once per batch.

Defined results: null and empty texts are the end token alone; a null id counts as
the empty text in the split; without training documents every count is 0; equal
texts get equal scores; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_of_id, numbers, settled, text_of
from .gru import Gru
from .words import Words, slices

VOCABULARY = 1022
KNOWN_WORDS = 1 << 20       # longest broadcast table of counts
WARM_DOCS = 1500            # for the first weights, in one task
BUCKET_BYTES = 8 << 20     # of text, for one bucket of words
SLICE_BYTES = 4 << 20       # of text, trained on at a time
COUNT_BYTES = 1 << 20       # of text, counted at a time
END, OTHER = 0, 1


@dataclass
class Counts:
    """Words of the training documents: tokens with end tokens, distinct ones, documents, and the table of (bucket, hash, c)."""

    tokens: int
    distinct: int
    docs: int
    buckets: int
    table: DataFrame


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)


def _packed(h: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """Distinct hashes ordered by (bucket, hash): the ranges of the buckets."""
    b = _bucket(h, buckets)
    cut = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1], [True]])) if len(b) else np.zeros(1, int)
    return [(int(b[x]), int(x), int(y)) for x, y in zip(cut[:-1], cut[1:])]


def _by_bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return np.lexsort((h, _bucket(h, buckets)))


def count_words(docs: DataFrame, learn) -> Counts:
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text_of())), F.lit(0))).first()[0]
    buckets = int(size // BUCKET_BYTES) + 1

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0, COUNT_BYTES):
            h, n = np.unique(Words(batch.column(0)).hash, return_counts=True)
            order = _by_bucket(h, buckets)
            h, n = h[order], n[order]
            rows = _packed(h, buckets)
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([h[x:y].tobytes() for _, x, y in rows], pa.binary()), pa.array([n[x:y].astype(np.int64).tobytes() for _, x, y in rows], pa.binary())], ["bucket", "h", "n"])

    def gather(table: pa.Table) -> pa.Table:
        h = np.concatenate([np.frombuffer(x, np.uint64) for x in table["h"].to_pylist()])
        n = np.concatenate([np.frombuffer(x, np.int64) for x in table["n"].to_pylist()])
        words, back = np.unique(h, return_inverse=True)
        c = np.bincount(back, weights=n, minlength=len(words)).astype(np.int64)
        return pa.table({"bucket": pa.array(np.full(len(words), table["bucket"][0].as_py()), pa.int32()), "h": pa.array(words.view(np.int64)), "c": pa.array(c)})

    chosen = docs.where(learn)
    table = settled(chosen.select(text_of().alias("text")).mapInArrow(scatter, "bucket int, h binary, n binary").groupBy("bucket").applyInArrow(gather, "bucket int, h long, c long"), "words")
    tokens, distinct = table.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    ends = chosen.count()
    return Counts(tokens + ends, distinct + (ends > 0), ends, buckets, table)


def known_counts(counts: Counts) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashes, counts and least count of the broadcast table: all words with that count or more."""
    level = F.when(F.col("c") < 1024, F.col("c")).otherwise(F.pow(F.lit(2), F.floor(F.log2("c"))).cast("long"))
    levels = counts.table.groupBy(level.alias("c")).agg(F.count(F.lit(1)).alias("n")).collect()  # at most 1 100 rows
    least, left = 1 << 62, KNOWN_WORDS
    for row in sorted(levels, key=lambda r: -r["c"]):
        if row["n"] > left:
            break
        left -= row["n"]
        least = row["c"]
    h, c = numbers(counts.table.where(F.col("c") >= least), ["h", "c"])
    h = h.view(np.uint64)
    order = np.argsort(h)
    return h[order], c[order], least


class Vocabulary:
    """Ids of frequent words and counts of known ones."""

    def __init__(self, counts: Counts) -> None:
        self.h, self.c, self.least = known_counts(counts)
        top = np.lexsort((self.h, -self.c))[:VOCABULARY]
        self.ids = np.full(len(self.h) + 1, OTHER, np.int32)
        self.ids[top] = np.arange(len(top)) + 2
        top_by_hash = np.sort(top)
        self.frequent, self.frequent_ids = self.h[top_by_hash], self.ids[top_by_hash]
        inside = int(self.c[top].sum())
        self.tokens, self.distinct = counts.tokens, counts.distinct
        self.other_tokens = counts.tokens - counts.docs - inside
        self.other_distinct = counts.distinct - (counts.docs > 0) - len(top)
        self.docs = counts.docs
        self.counts = np.concatenate([[counts.docs, self.other_tokens], self.c[top]]).astype(np.float64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Place of each word in the table of known counts; -1 for the others."""
        if not len(self.h):
            return np.full(len(h), -1)
        h, back = np.unique(h, return_inverse=True)  # each word is looked up once, in the table's order
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        return np.where(self.h[at] == h, at, -1)[back]

    def ids_of(self, h: np.ndarray) -> np.ndarray:
        """Id of each word, from the short table of the frequent ones alone."""
        if not len(self.frequent):
            return np.full(len(h), OTHER, np.int32)
        at = np.minimum(np.searchsorted(self.frequent, h), len(self.frequent) - 1)
        return np.where(self.frequent[at] == h, self.frequent_ids[at], np.int32(OTHER))

    def sequences(self, words: Words, of_words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents, given those of their words, each document closed by the end, and the offsets."""
        offsets = words.offset + np.arange(words.n + 1)
        ids = np.full(int(offsets[-1]), END, np.int32)
        ids[np.arange(len(of_words)) + words.doc] = of_words
        return ids, offsets


def _train(docs: DataFrame, vocabulary, start: np.ndarray | None) -> np.ndarray | None:
    """Weights averaged over the tasks that train on ``docs`` from ``start``; null if there is nothing to learn."""
    shared = docs.sparkSession.sparkContext.broadcast(start)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        model, seen, part = Gru(known.counts), 0, 0
        if shared.value is not None:
            model.load(shared.value)
        for batch in slices(batches, 0, SLICE_BYTES):
            words = Words(batch.column(0))
            if words.n:
                ids, offsets = known.sequences(words, known.ids_of(words.hash))
                model.learn(ids, offsets)
                seen, part = seen + len(ids), part or int(words.hash[:1].sum() % np.uint64(1 << 20))
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([part % 32], pa.int32()), pa.array([float(seen)]), pa.array([(model.flat().astype(np.float64) * seen).tobytes()], pa.binary())], ["part", "seen", "flat"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py()) for x in table["flat"])
        return pa.table({"part": pa.array([table["part"][0].as_py()], pa.int32()), "seen": pa.array([pc.sum(table["seen"]).as_py()]), "flat": pa.array([total.tobytes()], pa.binary())})

    shape = "part int, seen double, flat binary"
    got = docs.select(text_of().alias("text")).mapInArrow(learn, shape).groupBy("part").applyInArrow(add, shape).collect()  # 32 rows at most
    if not got:
        return None
    return (sum(np.frombuffer(r["flat"]) for r in got) / sum(r["seen"] for r in got)).astype(np.float32)


def train(docs: DataFrame, learn, vocabulary) -> np.ndarray:
    """Weights of the recurrent model, from a first task on few documents and then all tasks on all of them."""
    spot = F.pmod(F.xxhash64("doc_id", text_of(), F.lit("train")), F.lit(1_000_000)) / F.lit(1e6)
    known = vocabulary.value
    chosen = docs.where(learn)
    first = _train(chosen.where(spot < min(1.0, WARM_DOCS / max(1, known.docs))).coalesce(1), vocabulary, None)
    if first is None:
        return Gru(known.counts).flat()
    return _train(chosen, vocabulary, first)


_COLUMNS = ["bucket", "base", "h", "place", "doc_id", "held_out", "n", "known", "logs", "model", "others", "rest"]


def score(docs: DataFrame, counts: Counts, vocabulary, weights: np.ndarray, held) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    kind, buckets = dict(docs.dtypes)["doc_id"], counts.buckets
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary.value
        model = Gru(v.counts).load(shared.value)
        logs = np.log10(v.c + 0.5)
        for batch in slices(batches, 3, SLICE_BYTES):
            base, n = batch.column(1)[0].as_py(), batch.num_rows
            words = Words(batch.column(3))
            at = v.find(words.hash)
            of_words = v.ids[at]  # -1 takes the last entry: OTHER
            ids, offsets = v.sequences(words, of_words)
            chance = model.score(ids, offsets) / np.log(10)
            found = at >= 0
            other = np.bincount(words.doc, weights=of_words == OTHER, minlength=n)
            part = np.zeros(len(at))
            part[found] = logs[at[found]]
            both = np.bincount(words.doc, weights=part, minlength=n)
            outside = np.bincount(words.doc, weights=part * (of_words == OTHER), minlength=n)
            ask, back = np.unique(words.hash[~found], return_inverse=True)
            order = _by_bucket(ask, buckets)
            place = np.empty(len(order), np.uint32)
            place[order] = np.arange(len(order))
            ask = ask[order]
            rows = _packed(ask, buckets)
            k, none = len(rows), pa.nulls
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([base] * k, pa.int64()), pa.array([ask[x:y].tobytes() for _, x, y in rows], pa.binary()), none(k, pa.int32()), none(k, batch.column(0).type), none(k, pa.bool_()),
                                              none(k, pa.int64()), none(k, pa.int64()), none(k, pa.float64()), none(k, pa.float64()), none(k, pa.float64()), none(k, pa.binary())], _COLUMNS)
            rest, spots = place[back], np.searchsorted(np.flatnonzero(~found), words.offset)
            packed = [rest[spots[i] : spots[i + 1]].tobytes() for i in range(n)]
            seat = np.arange(n)
            model_part = chance - other * np.log10(v.other_tokens + 0.5 * (v.other_distinct + 1))
            yield pa.RecordBatch.from_arrays([pa.array((seat + base) % buckets, pa.int32()), pa.array([base] * n, pa.int64()), none(n, pa.binary()), pa.array(seat, pa.int32()), batch.column(0), batch.column(2), pa.array(words.count), pa.array(np.bincount(words.doc[found], minlength=n), pa.int64()),
                                              pa.array(both), pa.array(model_part), pa.array(outside), pa.array(packed, pa.binary())], _COLUMNS)

    def answer(asked: pa.Table, table: pa.Table) -> pa.Table:
        rows = asked.filter(pc.is_valid(asked["place"])).drop_columns(["bucket"])
        packed = asked.filter(pc.is_valid(asked["h"]))
        h = table["h"].to_numpy().view(np.uint64)
        order = np.argsort(h)
        h, c = h[order], table["c"].to_numpy()[order]
        replies = []
        for raw in packed["h"].to_pylist():
            want = np.frombuffer(raw, np.uint64)
            if len(h):
                at = np.minimum(np.searchsorted(h, want), len(h) - 1)
                replies.append(np.where(h[at] == want, c[at], 0).astype(np.int64).tobytes())
            else:
                replies.append(np.zeros(len(want), np.int64).tobytes())
        out, k = [rows], packed.num_rows
        if k:
            first = [np.frombuffer(x, np.uint64)[0] for x in packed["h"].to_pylist()]
            bucket = [int(_bucket(np.array([f], np.uint64), buckets)[0]) for f in first]
            cols = {c: pa.nulls(k, rows.schema.field(c).type) for c in rows.column_names}
            cols |= {"base": packed["base"], "h": pa.array(replies, pa.binary()), "n": pa.array(bucket, pa.int64())}
            out.append(pa.table(cols, schema=rows.schema))
        return pa.concat_tables(out)

    end = float(np.log10(vocabulary.value.docs + 0.5))
    below = float(np.log10(counts.tokens + 0.5 * (counts.distinct + 1)))
    tokens, has_end = counts.tokens, int(counts.docs > 0)

    def gather(table: pa.Table) -> pa.Table:
        rows = table.filter(pc.is_valid(table["place"])).combine_chunks()
        packed = table.filter(pc.is_null(table["place"])).sort_by("n")
        parts = [np.frombuffer(x, np.int64) for x in packed["h"].to_pylist()]
        c = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        logs, lists = np.log10(c + 0.5), [np.frombuffer(x, np.uint32) for x in rows["rest"].to_pylist()]
        extra = np.array([logs[x].sum() for x in lists])
        known = rows["known"].to_numpy() + np.array([(c[x] > 0).sum() for x in lists], np.int64) + has_end
        n = rows["n"].to_numpy() + 1
        base = rows["logs"].to_numpy() + extra + end - n * below
        model = rows["model"].to_numpy() + rows["others"].to_numpy() + extra
        k = rows.num_rows
        return pa.table({"doc_id": rows["doc_id"], "held_out": rows["held_out"], "n_tokens": pa.array(n, pa.int64()), "n_known": pa.array(known, pa.int64()), "train_tokens": pa.array(np.full(k, tokens), pa.int64()), "base_score": pa.array(base), "score": pa.array(model)})

    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("rid"), held.alias("held_out"), text_of().alias("text"))
    middle = f"base long, h binary, place int, doc_id {kind}, held_out boolean, n long, known long, logs double, model double, others double, rest binary"
    asked = rows.mapInArrow(scatter, f"bucket int, {middle}")
    rare = counts.table.where(F.col("c") < vocabulary.value.least)
    told = asked.groupBy("bucket").cogroup(rare.groupBy("bucket")).applyInArrow(answer, middle)
    return told.groupBy("base").applyInArrow(gather, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def score_digest(docs: DataFrame, remainder: int = 1, parts: int = 5) -> DataFrame:
    """Scores of all documents, learnt from those whose id's crc32 leaves another remainder."""
    docs = docs.select("doc_id", "text")
    held = crc_of_id() % parts == remainder
    counts = count_words(docs, ~held)
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary(counts))
    return score(docs, counts, vocabulary, train(docs, ~held, vocabulary), held)
