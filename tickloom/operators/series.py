"""Ordered-series building blocks that never put a whole key into one task.

A symbol may hold a large share of all rows, so windows are not partitioned by
symbol alone.  Four shapes cover every ordered operator of the library:

* ``with_position`` - the row number of a key, from per-bucket counts;
* ``Blocks`` - bounded frames: rows are cut into position blocks and each block
  also sees a halo of the rows before and after it;
* ``running`` - unbounded frames: running values inside a bucket plus the carry
  of the earlier buckets, taken from a table with one row per bucket;
* ``recursive_means`` - recursions: each block is an affine map, composed in a tree.

Keys and buckets must not be null.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_dir

BUCKET_ROWS = 65_536
RANGE_ROWS = 2_000_000  # most rows of a range partition
TASK_ROWS = 1_000_000   # of a partition cut by keys, about
MAX_EXPONENT = 600.0  # keeps r ** -block inside the double range


def settle(df: DataFrame) -> DataFrame:
    """Write a derived table to the shared checkpoint folder and go on from there.

    The prefix operators below read their input twice (bucket totals, then rows).
    Chained on an unsettled plan that doubles the upstream work at every step, so
    derived inputs are settled first; plain table scans need not be.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint()


def by_rows(df: DataFrame, keys: Sequence[str | Column], times: int = 1, rows: int | None = None) -> DataFrame:
    """The table cut by ``keys`` into as many partitions as its rows, ``times`` over, need.

    A grouping or join on these keys then holds about ``TASK_ROWS`` rows in a task,
    however large the table; ``rows`` saves the count where it is known.
    """
    needed = -(-(df.count() if rows is None else rows) * times // TASK_ROWS)  # a number
    return df.repartition(max(needed, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)


def ranged(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], bucket: str = "_rb") -> DataFrame:
    """Settle a table in range partitions of (keys, order) and note the partition as ``bucket``.

    For series without a grid: Spark samples the full sort key, so a crowded hour,
    value or key is spread over as many buckets as its rows need.  The bucket is
    stored with the rows, which keeps it the same in every later pass.  Should a
    partition hold more than ``RANGE_ROWS`` rows, the settled rows are cut again into
    as many partitions as they need.
    """
    by = [*keys, *order]
    cut = settle(df.repartitionByRange(*by).withColumn(bucket, F.spark_partition_id().cast("long")))
    rows, largest = cut.groupBy(bucket).agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n"), F.max("n")).first()  # two numbers
    if (largest or 0) <= RANGE_ROWS:
        return cut
    parts = 2 * -(-rows // RANGE_ROWS) + 1
    return settle(cut.drop(bucket).repartitionByRange(parts, *by).withColumn(bucket, F.spark_partition_id().cast("long")))


def time_bucket(time: str, step_seconds: int, rows: int = BUCKET_ROWS) -> Column:
    """Bucket of ``rows`` grid slots; bars sit on a grid, so a bucket is bounded."""
    width = int(step_seconds) * int(rows)
    return F.floor(F.unix_seconds(F.col(time)) / F.lit(width)).cast("long")


def with_position(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    name: str = "pos",
    total: str | None = None,
) -> DataFrame:
    """Add the 0-based row number per key (and the row count as ``total``).

    Only rows of one bucket meet in a task; the offsets come from bucket counts.
    """
    keys = list(keys)
    marked = df.withColumn("_bk", bucket)
    counts = marked.groupBy(*keys, "_bk").agg(F.count(F.lit(1)).alias("_n"))
    per_key = Window.partitionBy(*(keys or [F.lit(0)]))
    before = per_key.orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    cols = [*keys, "_bk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off")]
    if total:
        cols.append(F.sum("_n").over(per_key).alias(total))
    offsets = counts.select(*cols)
    inside = Window.partitionBy(*keys, "_bk").orderBy(*order)
    return (
        marked.withColumn("_rn", F.row_number().over(inside) - F.lit(1))
        .join(offsets, [*keys, "_bk"])
        .withColumn(name, (F.col("_off") + F.col("_rn")).cast("long"))
        .drop("_bk", "_rn", "_off")
    )


class Blocks:
    """Position blocks with a halo of ``before`` and ``after`` rows.

    Every frame that reaches at most that far is exact on the rows a block owns,
    and all frames share one exchange and one sort.
    """

    def __init__(
        self,
        df: DataFrame,
        keys: Sequence[str],
        before: int,
        after: int = 0,
        block: int = 4096,
        pos: str = "pos",
    ) -> None:
        self.keys, self.pos, self.block = list(keys), pos, int(block)
        p, b = F.col(pos), F.lit(self.block)
        first = F.greatest(F.floor((p - F.lit(after)) / b), F.lit(0)).cast("long")
        last = F.floor((p + F.lit(before)) / b).cast("long")
        self.df = df.withColumn("_blk", F.explode(F.sequence(first, last)))
        self.w = Window.partitionBy(*self.keys, "_blk").orderBy(pos)

    @property
    def offset(self) -> Column:
        """Row offset inside the block, negative in the leading halo."""
        return F.col(self.pos) - F.col("_blk") * F.lit(self.block)

    def rows(self, start: int, end: int):
        return self.w.rowsBetween(start, end)

    def full(self, value: Column, n: int) -> Column:
        """``value`` only where ``n`` rows of history exist."""
        return F.when(F.col(self.pos) >= F.lit(n - 1), value)

    def owned(self, df: DataFrame) -> DataFrame:
        own = F.floor(F.col(self.pos) / F.lit(self.block)) == F.col("_blk")
        return df.where(own).drop("_blk")


FOLD = 128  # blocks whose maps are composed in one fold


def scan_block(alphas: Sequence[float], history: int = 0) -> int:
    """The largest block whose weights (1-alpha) ** -rows stay inside the double range."""
    rates = [-math.log(1.0 - a) for a in alphas if a < 1.0]
    return max(8, min(4096, int(MAX_EXPONENT / max(rates)) - history)) if rates else 4096


def longest_key(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the key with most rows; one number."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0


def _after(x: Column, y: Column, name: str, r: float) -> Column:
    """The recursive mean after a block (count c, local sum l, first value f) that began with the mean ``y``."""
    c = x[f"c_{name}"]
    return F.when(c == 0, y).otherwise(x[f"l_{name}"] + F.pow(F.lit(r), c) * F.coalesce(y, x[f"f_{name}"]))


def _block_means(blocks: DataFrame, keys: Sequence[str], rates: dict[str, float], top: int, fold: int) -> DataFrame:
    """The means after each block ``b`` (columns y_<name>, null before a first value).

    A block is an affine map of the mean; maps compose.  ``fold`` neighbouring blocks are
    folded in one row; their totals are blocks of the next level, which hands down the
    means they begin with.
    """
    fields = [f"{k}_{n}" for n in rates for k in "clf"]
    group = F.floor(F.col("b") / F.lit(fold)).cast("long").alias("s")
    lists = blocks.groupBy(*keys, group).agg(F.sort_array(F.collect_list(F.struct("b", *fields))).alias("_xs"))  # at most ``fold`` blocks
    start = {n: F.lit(None).cast("double") for n in rates}
    if top >= fold:
        def total(n: str, r: float) -> list[Column]:
            count = F.aggregate("_xs", F.lit(0).cast("long"), lambda a, x: a + x[f"c_{n}"])
            local = F.aggregate("_xs", F.lit(0.0), lambda a, x: x[f"l_{n}"] + F.pow(F.lit(r), x[f"c_{n}"]) * a)
            first = F.aggregate("_xs", F.lit(None).cast("double"), lambda a, x: F.coalesce(a, x[f"f_{n}"]))
            return [count.alias(f"c_{n}"), local.alias(f"l_{n}"), first.alias(f"f_{n}")]

        lists = settle(lists)
        totals = lists.select(*keys, F.col("s").alias("b"), *[c for n, r in rates.items() for c in total(n, r)])
        above = _block_means(totals, keys, rates, top // fold, fold).withColumn("s", F.col("b") + 1).drop("b")
        lists = lists.join(above.withColumnsRenamed({f"y_{n}": f"_y_{n}" for n in rates}), [*keys, "s"], "left")
        start = {n: F.col(f"_y_{n}") for n in rates}
    kind = "struct<" + "".join(f"y_{n}:double," for n in rates)
    out = kind + "b:bigint>"
    zero = F.struct(*[start[n].alias(f"y_{n}") for n in rates], F.array().cast(f"array<{out}>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        now = [_after(x, a[f"y_{n}"], n, r).alias(f"y_{n}") for n, r in rates.items()]
        return F.struct(*now, F.concat(a["out"], F.array(F.struct(*now, x["b"].alias("b")))).alias("out"))

    done = lists.select(*keys, F.explode(F.aggregate("_xs", zero, step, lambda a: a["out"])).alias("_o"))
    return done.select(*keys, "_o.*")


def recursive_means(b: Blocks, df: DataFrame, means: dict[str, tuple[Column, float]], history: int, longest: int, fold: int = FOLD) -> DataFrame:
    """Add y = alpha * x + (1 - alpha) * y' for each (x, alpha), exact at any length.

    ``df`` is ``b.df`` with more columns.  y begins at the key's first x; where x is null
    y stays.  Blocks compute from nothing over their own rows and ``history`` rows before;
    the mean they begin with comes from composing the earlier blocks' affine maps, one
    row per block, so no rows are copied for it.  ``longest`` bounds the rows of a key;
    if they are one block, nothing is composed.
    """
    seen = b.w.rowsBetween(Window.unboundedPreceding, 0)
    inside = b.offset >= F.lit(-history)
    xs = {n: F.when(inside, x.cast("double")) for n, (x, _) in means.items()}
    df = df.select("*", *[x.alias(f"_x_{n}") for n, x in xs.items()])
    df = df.select("*", *[F.count(f"_x_{n}").over(seen).alias(f"c_{n}") for n in means])
    rates = {n: max(0.0, 1.0 - alpha) for n, (_, alpha) in means.items()}

    def local(n: str) -> Column:
        x, r, c = F.col(f"_x_{n}"), F.lit(rates[n]), F.col(f"c_{n}").cast("double")
        if rates[n] == 0.0:
            return F.last(x, ignorenulls=True).over(seen)
        return F.coalesce(F.sum(x * F.lit(means[n][1]) * F.pow(r, -c)).over(seen), F.lit(0.0)) * F.pow(r, c)

    first = lambda n: F.first(F.col(f"_x_{n}"), ignorenulls=True).over(seen)
    df = df.select("*", *[c for n in means for c in (local(n).alias(f"l_{n}"), first(n).alias(f"f_{n}"))])
    helpers = [f"{k}_{n}" for n in means for k in "clf"]
    before = {n: F.lit(None).cast("double") for n in means}
    gone = [*helpers, *[f"_x_{n}" for n in means]]
    if longest > b.block - history:
        own = F.floor(F.col(b.pos) / F.lit(b.block)) == F.col("_blk")
        ends = df.where(own & (b.offset == F.lit(b.block - history - 1))).select(*b.keys, F.col("_blk").alias("b"), *helpers)
        means_after = _block_means(settle(ends), b.keys, rates, longest // b.block, fold)
        carry = means_after.withColumn("_blk", F.col("b") + 1).drop("b").withColumnsRenamed({f"y_{n}": f"_y_{n}" for n in means})
        df = df.join(carry, [*b.keys, "_blk"], "left")
        before = {n: F.col(f"_y_{n}") for n in means}
        gone += [f"_y_{n}" for n in means]
    row = {f"{k}_{n}": F.col(f"{k}_{n}") for n in means for k in "clf"}
    return df.select("*", *[_after(row, before[n], n, r).alias(n) for n, r in rates.items()]).drop(*gone)


def recursive_mean(df: DataFrame, keys: Sequence[str], value: str, alpha: float, name: str, block: int | None = None) -> DataFrame:
    """One recursive mean of a table with ``pos``."""
    b = Blocks(df, keys, 0, 0, block or scan_block([alpha]))
    return b.owned(recursive_means(b, b.df, {name: (F.col(value), alpha)}, 0, longest_key(df, keys)))


_COMBINE = {"sum": F.sum, "max": F.max, "min": F.min}


def running(
    df: DataFrame,
    keys: Sequence[str],
    bucket: Column,
    order: Sequence[str],
    specs: dict[str, tuple[str, Column]],
    seq: Column | None = None,
    inclusive: bool = True,
) -> DataFrame:
    """Running ``sum``/``max``/``min``/``last`` over all earlier rows of a key.

    ``last`` skips nulls and needs ``seq``, a single sortable value that rises
    with ``order`` (used to pick the last value of a bucket).
    """
    keys = list(keys)
    marked = df.select("*", bucket.alias("_bk"), *[col.alias(f"_v_{name}") for name, (_, col) in specs.items()])
    aggs = []
    for name, (kind, _) in specs.items():
        v = F.col(f"_v_{name}")
        if kind == "last":
            aggs.append(F.max_by(v, F.when(v.isNotNull(), seq)).alias(f"_b_{name}"))
        else:
            aggs.append(_COMBINE[kind](v).alias(f"_b_{name}"))
    table = marked.groupBy(*keys, "_bk").agg(*aggs)
    earlier = (
        Window.partitionBy(*(keys or [F.lit(0)]))
        .orderBy("_bk")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carries = []
    for name, (kind, _) in specs.items():
        b = F.col(f"_b_{name}")
        over = F.last(b, ignorenulls=True) if kind == "last" else _COMBINE[kind](b)
        carries.append(over.over(earlier).alias(f"_c_{name}"))
    carry = table.select(*keys, "_bk", *carries)

    inside = (
        Window.partitionBy(*keys, "_bk")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    )
    locals_ = []
    for name, (kind, _) in specs.items():
        v = F.col(f"_v_{name}")
        over = F.last(v, ignorenulls=True) if kind == "last" else _COMBINE[kind](v)
        locals_.append(over.over(inside).alias(f"_l_{name}"))
    out = marked.select("*", *locals_).join(carry, [*keys, "_bk"])
    final = []
    for name, (kind, _) in specs.items():
        here, past = F.col(f"_l_{name}"), F.col(f"_c_{name}")
        if kind == "sum":
            both = F.when(
                here.isNotNull() | past.isNotNull(),
                F.coalesce(here, F.lit(0)) + F.coalesce(past, F.lit(0)),
            )
        elif kind == "max":
            both = F.greatest(here, past)
        elif kind == "min":
            both = F.least(here, past)
        else:
            both = F.coalesce(here, past)
        final.append(both.alias(name))
    return out.select(*df.columns, *final)


def exact_median(df: DataFrame, keys: Sequence[str], value: str, name: str = "median") -> DataFrame:
    """Exact median per key from ranks.

    The built-in median holds all values of a key in one task; here values are
    range-partitioned and only the one or two middle rows are kept.
    """
    known = df.where(F.col(value).isNotNull()).select(*keys, value)
    ranks = with_position(ranged(known, keys, [value]), keys, [value], F.col("_rb"), "_p", "_n")
    low, high = F.floor((F.col("_n") - 1) / F.lit(2)), F.floor(F.col("_n") / F.lit(2))
    middle = ranks.where((F.col("_p") == low) | (F.col("_p") == high))
    return middle.groupBy(*keys).agg(F.avg(value).alias(name))


def asof_last(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    at: str,
    payload: Sequence[str],
    bucket_rows: int = BUCKET_ROWS,
    name: str = "hit",
) -> DataFrame:
    """For each left row the last right row with the same key and ``at`` <= its own.

    ``at`` is an integer position or epoch on both sides.  The right columns come
    back as the struct ``name``, null when nothing precedes.
    """
    keys = list(keys)
    packed = F.struct(*[F.col(c) for c in payload])
    lhs = left.select(*keys, F.col(at).alias("_at"), F.lit(1).alias("_side"),
                      F.struct(*[F.col(c) for c in left.columns]).alias("_row"))
    rhs = right.select(*keys, F.col(at).alias("_at"), F.lit(0).alias("_side"),
                       packed.alias("_pay"))
    both = lhs.unionByName(rhs, allowMissingColumns=True)
    bucket = F.floor(F.col("_at") / F.lit(bucket_rows)).cast("long")
    found = running(both, keys, bucket, ["_at", "_side"], {name: ("last", F.col("_pay"))},
                    seq=F.col("_at"))
    return found.where(F.col("_side") == 1).select("_row.*", name)


def pos_bucket() -> Column:
    return F.floor(F.col("pos") / F.lit(BUCKET_ROWS)).cast("long")


LEAF_ROWS = 16_384


def _leaf_aggregate(rank: np.ndarray, value: np.ndarray, side: str, kind: str) -> np.ndarray:
    """Aggregate of earlier elements that rank below (above) each element, by doubling blocks."""
    n = len(rank)
    size = 1 << max(1, int(n - 1).bit_length())
    neutral = {"sum": 0.0, "min": np.inf, "max": -np.inf}[kind]
    merge = {"sum": np.add, "min": np.minimum, "max": np.maximum}[kind]
    key = np.full(size, np.iinfo(np.int64).max)
    key[:n] = rank if side == "below" else -rank
    val = np.full(size, neutral)
    val[:n] = value
    out = np.full(size, neutral)
    half = 1
    while half < size:
        # rows of two neighbouring blocks: the left one is earlier than the right one
        order = np.argsort(key.reshape(-1, 2 * half), axis=1)
        left = order < half
        picked = np.where(left, np.take_along_axis(val.reshape(-1, 2 * half), order, 1), neutral)
        seen = np.where(left, neutral, merge.accumulate(picked, axis=1))
        back = np.empty_like(seen)
        np.put_along_axis(back, order, seen, 1)
        out = merge(out, back.reshape(-1))
        half *= 2
    return out[:n]


def earlier_ranked(
    df: DataFrame,
    keys: Sequence[str],
    rank_order: Sequence[str | Column],
    side: str,
    kind: str,
    value: Column,
    name: str,
    leaf_rows: int = LEAF_ROWS,
) -> DataFrame:
    """Sum, min or max (a double) over earlier rows by ``pos`` that rank ``below`` or ``above`` a row.

    Ranks are cut into leaves of ``leaf_rows``.  Inside a leaf the rows meet in one
    bounded task.  Across leaves the base-8 digits of the leaf number form a tree:
    at each level a row adds the earlier rows of its node whose digit is smaller
    (larger), eight running values inside (key, node).  Null when there are none.
    No task holds a key and no pairs are built.
    """
    keys, base = list(keys), 8
    df = ranged(df, keys, rank_order)
    rows = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1  # one number: the depth of the tree
    digits = 0
    while leaf_rows * base**digits < rows:
        digits += 1
    cur = with_position(df, keys, rank_order, F.col("_rb"), "_rank").drop("_rb")
    cur = settle(cur.withColumns({"_v": value.cast("double"), "_leaf": F.floor(F.col("_rank") / F.lit(leaf_rows)).cast("long")}))

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos", ignore_index=True)
        got = _leaf_aggregate(pdf["_rank"].to_numpy(), pdf["_v"].to_numpy(dtype=float), side, kind)
        return pdf[[*keys, "pos"]].assign(_in=np.where(np.isfinite(got), got, np.nan))

    types = dict(cur.dtypes)
    shape = ", ".join(f"`{c}` {types[c]}" for c in (*keys, "pos")) + ", _in double"
    local = cur.select(*keys, "pos", "_leaf", "_rank", "_v").groupBy(*keys, "_leaf").applyInPandas(inside, shape)
    local = local.withColumn("_in", F.when(~F.isnan("_in"), F.col("_in")))

    join = (lambda a, b: F.coalesce(a + b, a, b)) if kind == "sum" else {"max": F.greatest, "min": F.least}[kind]
    cur = cur.withColumn(name, F.lit(None).cast("double"))
    for level in reversed(range(digits)):
        cur = cur.withColumns({
            "_node": F.floor(F.col("_leaf") / F.lit(base ** (level + 1))).cast("long"),
            "_digit": F.floor(F.col("_leaf") / F.lit(base**level)).cast("long") % base,
        })
        specs = {f"_d{j}": (kind, F.when(F.col("_digit") == j, F.col("_v"))) for j in range(base)}
        cur = running(settle(cur), [*keys, "_node"], pos_bucket(), ["pos"], specs, inclusive=False)
        total = F.col(name)
        for j in range(base):
            counts = F.col("_digit") > j if side == "below" else F.col("_digit") < j
            total = join(total, F.when(counts, F.col(f"_d{j}")))
        cur = cur.withColumn(name, total).drop("_node", "_digit", *specs)
    both = cur.join(local, [*keys, "pos"])
    return both.withColumn(name, join(F.col(name), F.col("_in"))).drop("_rank", "_v", "_leaf", "_in")
