"""Exact duplicates by recipes of content-defined chunks.

Texts, with each whitespace run as one space, are cut where a rolling hash of the
last 16 bytes says so, so equal texts are cut alike wherever they stand.  A chunk's
identifier is its digest, verified by comparing the contents of all chunks that
share it: contents move once, each distinct chunk at most once per task.  Documents
are then compared by their ordered lists of identifiers, 16 bytes per about two
kilobytes of text.  Should two contents share a digest, the documents holding it are
told apart by their whole text instead, so the result is exact for any digest.

Defined results: a null text equals the empty one; of rows with the same smallest
id one stays; a null id ranks after all others; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settled, text_of
from .words import NOT_SPACE, pieces, utf8

MASK = np.uint32((1 << 11) - 1)
FIRST_CUT = 64       # no cut before: the rolling hash must only see the text itself
LONGEST = 16_384
DIGEST = 16
BAD_LIMIT = 1 << 20

_GEAR = np.random.default_rng(16).integers(0, 1 << 32, 256, dtype=np.uint32)


def normalised(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each whitespace run as one space."""
    if not len(data):
        return data, offsets
    space = ~NOT_SPACE[data]
    keep = np.ones(len(data), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    border = offsets[:-1][offsets[:-1] < len(data)]
    keep[border] = True
    return np.where(space, np.uint8(32), data)[keep], np.concatenate([[0], np.cumsum(keep)])[offsets]


def cuts(data: np.ndarray) -> np.ndarray:
    """Positions where the rolling hash of the last 16 bytes asks for a cut."""
    h = _GEAR[data]
    for step in (1, 2, 4, 8):
        h[step:] += h[:-step] << np.uint32(step)
    return np.flatnonzero(((h >> np.uint32(15)) & MASK) == 0) + 1


def chunk_ends(asked: np.ndarray, start: int, end: int) -> list[int]:
    """Chunk ends of the text in [start, end): asked cuts, and a cut after each ``LONGEST`` bytes without one."""
    if start == end:
        return []
    inner = asked[np.searchsorted(asked, start + FIRST_CUT) : np.searchsorted(asked, end)].tolist()
    out, last = [], start
    for stop in [*inner, end]:
        while stop - last > LONGEST:
            last += LONGEST
            out.append(last)
        out.append(stop)
        last = stop
    return out


def chunks(column: pa.Array) -> Iterator[tuple[bytes, list[bytes]]]:
    """Normalised text and its chunks, per document."""
    data, offsets = utf8(column)
    for _, _, piece, at in pieces(data, offsets):
        norm, ends = normalised(piece, at)
        asked, raw = cuts(norm) if len(norm) else np.zeros(0, np.int64), norm.tobytes()
        for start, end in zip(ends[:-1].tolist(), ends[1:].tolist()):
            last, got = start, []
            for stop in chunk_ends(asked, start, end):
                got.append(raw[last:stop])
                last = stop
            yield raw[start:end], got


def _digest(chunk: bytes, size: int) -> bytes:
    return hashlib.blake2b(chunk, digest_size=size).digest()


def _contents(size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = {c: None for _, got in chunks(batch.column(0)) for c in got}
            yield pa.RecordBatch.from_arrays([pa.array([_digest(c, size) for c in seen], pa.binary()), pa.array(list(seen), pa.binary())], ["digest", "content"])

    return run


def _recipes(size: int, bad, every: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wrong = bad.value
        for batch in batches:
            sha, recipe, rest = [], [], []
            for text, got in chunks(batch.column(2)):
                ids = [_digest(c, size) for c in got]
                sha.append(hashlib.sha256(text).hexdigest())
                recipe.append(b"".join(ids))
                rest.append(text if every or (wrong and not wrong.isdisjoint(ids)) else b"")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sha, pa.string()), pa.array(recipe, pa.binary()), pa.array(rest, pa.binary())],
                                             ["doc_id", "_rid", "text_sha256", "_recipe", "_rest"])

    return run


def exact_groups(docs: DataFrame, digest: int = DIGEST) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 for each row of ``docs``."""
    spark = docs.sparkSession
    texts = docs.select(text_of().alias("text"))
    contents = texts.mapInArrow(_contents(digest), "digest binary, content binary")
    once = contents.groupBy("digest").agg(F.min("content").alias("a"), F.max("content").alias("b"))
    wrong = [r[0] for r in once.where(F.col("a") != F.col("b")).select("digest").limit(BAD_LIMIT + 1).collect()]  # none is expected
    every = len(wrong) > BAD_LIMIT
    bad = spark.sparkContext.broadcast(frozenset() if every else frozenset(map(bytes, wrong)))

    id_type = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("_rid"), text_of().alias("text"))
    listed = settled(rows.mapInArrow(_recipes(digest, bad, every), f"doc_id {id_type}, _rid long, text_sha256 string, _recipe binary, _rest binary"), "recipes")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("id"), F.col("_rid").alias("rid")))
    groups = settled(listed.groupBy("_recipe", "_rest").agg(first.alias("_first"), F.count(F.lit(1)).alias("group_size")), "groups")
    # both sides are read from tables, so Spark can split a partition with a hot group
    both = listed.join(groups, ["_recipe", "_rest"])
    return both.select("doc_id", F.col("_first.id").alias("keep_id"), "group_size", (F.col("_rid") == F.col("_first.rid")).alias("kept"), "text_sha256")


GROUPS_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM n WINDOW g AS (PARTITION BY t)
"""
