"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

Each partition sends a drawn number of rows to each block of each shard; rows are
permuted inside their partition, exchanged, and permuted again inside their block.
A shard is cut into blocks of bounded size, so no task holds a shard.

The matrix is never built.  Its row for partition p follows from splitting the
blocks' sizes along a binary tree over partitions: at each node the left half
draws how many of its rows fall into each block (multivariate hypergeometric, from
a generator seeded with the node).  A task walks from the root to its partition,
one draw per level, and needs only the partitions' cumulative row counts.

Law ``rows``: shard sizes differ by at most one.  Defined results: any column may
be null and rows may repeat, each row gets its own place; an empty table gives no
rows; columns named ``shard`` or ``slot`` are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import named, settled, text_of

SHARDS = 24
BLOCK_ROWS = 16_384
SEED = 7
NUMPY_LIMIT = 10**9


def hypergeometric(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """Good ones among ``sample`` drawn; beyond numpy's range by inversion around the mode."""
    low, high = max(0, sample - bad), min(good, sample)
    if low == high:
        return low
    if good + bad < NUMPY_LIMIT:
        return int(rng.hypergeometric(good, bad, sample))
    total = good + bad
    mode = min(high, max(low, int((sample + 1) * (good + 1) // (total + 2))))
    spread = int(14 * np.sqrt(sample * (good / total) * (bad / total) * ((total - sample) / max(total - 1, 1))) + 64)
    k = np.arange(max(low, mode - spread), min(high, mode + spread) + 1, dtype=np.float64)
    step = np.log((good - k[:-1]) * (sample - k[:-1])) - np.log((k[:-1] + 1) * (bad - sample + k[:-1] + 1))
    logs = np.concatenate([[0.0], np.cumsum(step)])
    odds = np.cumsum(np.exp(logs - logs.max()))
    return int(k[min(len(k) - 1, int(np.searchsorted(odds, rng.random() * odds[-1], "right")))])


def split(rng: np.random.Generator, sizes: np.ndarray, sample: int) -> np.ndarray:
    """How many of ``sample`` rows fall into each block, the blocks' sizes given."""
    out = np.zeros(len(sizes), np.int64)
    rest = int(sizes.sum())
    for j in np.flatnonzero(sizes):
        if not sample:
            break
        good = int(sizes[j])
        rest -= good
        out[j] = hypergeometric(rng, good, rest, sample)
        sample -= int(out[j])
    return out


def matrix_row(sizes: np.ndarray, before: np.ndarray, p: int, seed: int) -> np.ndarray:
    """Rows that partition ``p`` sends to each block; ``before`` has the cumulative counts, one more than partitions."""
    low, high = 0, len(before) - 1
    while high - low > 1:
        mid = (low + high) // 2
        left = split(np.random.default_rng([seed, low, high]), sizes, int(before[mid] - before[low]))
        if p < mid:
            sizes, high = left, mid
        else:
            sizes, low = sizes - left, mid
    return sizes


def block_plan(rows: int, shards: int, block_rows: int) -> pd.DataFrame:
    """Shard, first slot and size of each block; shards differ by one row at most, blocks of a shard too."""
    sizes = [rows // shards + (s < rows % shards) for s in range(shards)]
    plan = []
    for s, n in enumerate(sizes):
        cut = max(1, -(-n // block_rows))
        first = 0
        for b in range(cut):
            size = n // cut + (b < n % cut)
            plan.append((s, first, size))
            first += size
    return pd.DataFrame(plan, columns=["shard", "first", "size"])


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Every row of ``docs`` with its ``shard`` and its gapless ``slot`` there, shuffled uniformly.

    Rows are settled once with their partition and place in it, so that the draw is
    the same whatever task is run again.
    """
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    placed = docs.select(F.struct(*named(kept)).alias("_row"), F.monotonically_increasing_id().alias("_rid"))
    base = settled(placed, "shard-rows")
    part, place = F.shiftright("_rid", 33), F.col("_rid").bitwiseAND(F.lit((1 << 33) - 1))
    counted = base.select(part.alias("_p")).groupBy("_p").agg(F.count(F.lit(1)).alias("n")).orderBy("_p")
    counts = counted.toPandas()  # one number per partition
    before = np.concatenate([[0], np.cumsum(counts["n"].to_numpy(np.int64))]) if len(counts) else np.zeros(1, np.int64)
    plan = block_plan(int(before[-1]), shards, block_rows)
    known = spark.sparkContext.broadcast((counts["_p"].to_numpy(np.int64), before, plan["size"].to_numpy(np.int64)))

    def deal(columns: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        names, cumulative, sizes = known.value
        ready: dict[int, np.ndarray] = {}
        for p, i in columns:
            out = np.empty(len(p), np.int64)
            for one in p.unique():
                if one not in ready:
                    ready.clear()  # a task reads few partitions, one after the other
                    k = int(np.searchsorted(names, one))
                    sends = matrix_row(sizes, cumulative, k, seed)
                    target = np.repeat(np.arange(len(sizes), dtype=np.int32), sends)
                    ready[one] = np.random.default_rng([seed, 1, k]).permutation(target)
                here = (p == one).to_numpy()
                out[here] = ready[one][i[here].to_numpy()]
            yield pd.Series(out)

    dealt = F.pandas_udf(deal, "long")(part, place)
    blocks = spark.createDataFrame(plan.reset_index(names="_block"), "_block long, shard int, first long, size long")
    inside = Window.partitionBy("_block").orderBy(F.xxhash64(F.lit(seed), F.lit("again"), "_rid"), "_rid")
    moved = base.withColumn("_block", dealt).withColumn("_nth", F.row_number().over(inside) - 1)
    both = moved.join(F.broadcast(blocks), "_block")  # one row per block of block_rows rows
    return both.select("_row.*", F.col("shard").cast("int").alias("shard"), (F.col("first") + F.col("_nth")).cast("long").alias("slot"))


def shard_digest(docs: DataFrame, shards: int = SHARDS, **options) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of each row; a null text counts as empty."""
    raw = F.encode(text_of(), "UTF-8")
    thin = docs.select("doc_id", (F.octet_length(raw) + 8).cast("long").alias("size"), F.crc32(raw).cast("long").alias("text_crc32"))
    got = shard(thin, shards, **options)
    return got.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
