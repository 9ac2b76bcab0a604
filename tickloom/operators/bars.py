"""Bars: building them from ticks, coercing, resampling, paging and merging."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clock import floor_time, timeframe_keep, timeframe_seconds
from .series import time_bucket, with_position

BAR_COLUMNS = ("time", "open", "high", "low", "close", "volume")


class SchemaMismatch(ValueError):
    """A table cannot be read as bars."""


def ticks_to_bars(ticks: DataFrame, seconds: int = 3600, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Price ticks (symbol, time, price, seq) to bars; volume counts the ticks.

    ``seq`` is the arrival number.  It is a plain long, so the first and last
    price stay in the hash aggregate and are combined before the shuffle.
    """
    return ticks.groupBy(*keys, floor_time(F.col("time"), seconds).alias("time")).agg(
        F.min_by("price", "seq").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "seq").alias("close"),
        F.count(F.lit(1)).alias("volume"),
    )


def snapshots_to_bars(ticks: DataFrame, seconds: int = 3600, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Ticks that carry the running bar (h1_open..h1_close) to bars.

    Volume is the last non-zero quoted volume, not a sum; ticks without a bar are ignored.
    """
    quoted = F.when(F.col("volume") != 0, F.col("volume"))
    return (
        ticks.where(F.col("h1_open").isNotNull())
        .groupBy(*keys, floor_time(F.col("time"), seconds).alias("time"))
        .agg(
            F.round(F.min_by("h1_open", "seq"), 5).alias("open"),
            F.round(F.max("h1_high"), 5).alias("high"),
            F.round(F.min("h1_low"), 5).alias("low"),
            F.round(F.max_by("h1_close", "seq"), 5).alias("close"),
            F.coalesce(
                F.max_by(quoted, F.when(quoted.isNotNull(), F.col("seq"))), F.lit(0)
            ).cast("long").alias("volume"),
        )
    )


def resample(bars: DataFrame, seconds: int, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Bars of a higher timeframe; buckets start at UTC midnight, empty ones are absent."""
    return bars.groupBy(*keys, floor_time(F.col("time"), seconds).alias("time")).agg(
        F.min_by("open", F.unix_micros("time")).alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", F.unix_micros("time")).alias("close"),
        F.sum("volume").alias("volume"),
    )


def as_time(df: DataFrame, column: str = "time") -> Column:
    """Timestamps as they are, numbers as epoch seconds."""
    kind = df.schema[column].dataType.typeName()
    if kind in ("timestamp", "timestamp_ntz"):
        return F.col(column).cast("timestamp")
    return F.timestamp_seconds(F.col(column))


def coerce_bars(df: DataFrame, keys: Sequence[str] = (), order: Sequence[str] = ()) -> DataFrame:
    """Canonical columns and types, one row per time, the first by ``order`` kept.

    Missing columns are rejected from the analysed schema, before any job runs.
    """
    missing = [c for c in BAR_COLUMNS if c not in df.columns]
    if missing:
        raise SchemaMismatch(f"missing columns: {missing}")
    typed = df.select(
        *keys,
        F.date_trunc("millisecond", as_time(df)).alias("time"),
        *[F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close")],
        F.col("volume").cast("long").alias("volume"),
        *[F.col(c) for c in order if c not in BAR_COLUMNS],
    )
    kept = first_by_key(typed, [*keys, "time"], order or ["open", "high", "low", "close"])
    return kept.select(*keys, *BAR_COLUMNS)


def normalise_download(df: DataFrame, time_column: str = "Date", keys: Sequence[str] = ()) -> DataFrame:
    """Downloaded prices with capitalised columns to bars, missing volume as 0."""
    return df.select(
        *keys,
        F.col(time_column).cast("timestamp").alias("time"),
        *[F.col(c.capitalize()).cast("double").alias(c) for c in ("open", "high", "low", "close")],
        F.coalesce(F.col("Volume").cast("long"), F.lit(0).cast("long")).alias("volume"),
    )


def first_by_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One whole row per key, the smallest by ``order``, by aggregation.

    ``min_by`` combines duplicates on the map side, so a key with many copies
    does not travel to one task row by row.
    """
    sort_key = F.struct(*[F.col(o).alias(f"o{i}") if isinstance(o, str) else o.alias(f"o{i}")
                          for i, o in enumerate(order)])
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), sort_key).alias("_row"))
    return best.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns)


def _merge(first: DataFrame, second: DataFrame, keys: Sequence[str], tie: Sequence[str | Column]) -> DataFrame:
    both = first.withColumn("_rank", F.lit(0)).unionByName(second.withColumn("_rank", F.lit(1)), allowMissingColumns=True)
    return first_by_key(both, keys, ["_rank", *tie]).drop("_rank")


def merge_stored_wins(stored: DataFrame, fetched: DataFrame, keys: Sequence[str] = ("symbol", "time"),
                      tie: Sequence[str | Column] = ()) -> DataFrame:
    """Union of both by key; a stored row is never replaced."""
    return _merge(stored, fetched, keys, tie)


def upsert_incoming_wins(stored: DataFrame, incoming: DataFrame, keys: Sequence[str] = ("symbol", "time"),
                         seq: str | None = None) -> DataFrame:
    """Union of both by key; an incoming row replaces the stored one, the last of a batch wins."""
    tie = [(-F.coalesce(F.col(seq), F.lit(0)))] if seq else []
    return _merge(incoming, stored, keys, tie)


def union_pages(*pages: DataFrame) -> DataFrame:
    out = pages[0]
    for page in pages[1:]:
        out = out.unionByName(page)
    return out


def newest_rows(bars: DataFrame, keep: Column | int, keys: Sequence[str], step_seconds: int,
                skip: int = 0, total: str | None = None) -> DataFrame:
    """The last ``keep`` rows per key, after skipping the last ``skip``.

    Rows per bucket are counted first; buckets that cannot reach the page are
    dropped before any row is sorted.
    """
    keys = list(keys)
    keep = F.lit(keep) if isinstance(keep, int) else keep
    marked = bars.withColumn("_bk", time_bucket("time", step_seconds))
    counts = marked.groupBy(*keys, "_bk").agg(F.count(F.lit(1)).alias("_n"))
    per_key = Window.partitionBy(*(keys or [F.lit(0)]))
    later = per_key.orderBy(F.desc("_bk")).rowsBetween(Window.unboundedPreceding, -1)
    bounds = counts.select(*keys, "_bk", "_n", F.coalesce(F.sum("_n").over(later), F.lit(0)).alias("_after"), F.sum("_n").over(per_key).alias("_total"))
    bounds = bounds.where((F.col("_after") < keep + F.lit(skip)) & (F.col("_after") + F.col("_n") > F.lit(skip)))
    inside = Window.partitionBy(*keys, "_bk").orderBy(F.desc("time"))
    near = marked.join(bounds, [*keys, "_bk"]).withColumn("_p", F.col("_after") + F.row_number().over(inside) - F.lit(1))
    kept = near.where((F.col("_p") >= F.lit(skip)) & (F.col("_p") < keep + F.lit(skip)))
    if total:
        kept = kept.withColumn(total, F.col("_total"))
    return kept.drop("_p", "_bk", "_n", "_after", "_total")


def cap_history(bars: DataFrame, keys: Sequence[str] = ("symbol", "tf"), step_seconds: int = 60) -> DataFrame:
    """Only the newest rows a timeframe keeps, per symbol and timeframe."""
    return newest_rows(bars, timeframe_keep(F.col("tf")), keys, step_seconds)


def history_page(bars: DataFrame, rows: int, offset: int = 0, until=None, keys: Sequence[str] = ("symbol",),
                 step_seconds: int = 3600) -> DataFrame:
    """A page counted from the newest bar, with how many bars there are in all."""
    if until is not None:
        bars = bars.where(F.col("time") <= F.lit(until).cast("timestamp"))
    return newest_rows(bars, rows, keys, step_seconds, offset, "total_available")


def ingest_batches(batches: DataFrame, stored: DataFrame | None = None, seq: str = "batch_id") -> DataFrame:
    """Batches with an array of bars to a capped bar table.

    Unknown timeframes are rejected, a later batch wins over an earlier one and
    both win over what is stored.
    """
    known = batches.where(timeframe_seconds(F.col("timeframe")).isNotNull())
    flat = known.select(
        "symbol", F.upper("timeframe").alias("tf"), F.col(seq).alias("_seq"), F.posexplode("bars").alias("_i", "_bar")
    ).select(
        "symbol", "tf", "_seq", "_i", F.timestamp_seconds(F.col("_bar.time")).alias("time"),
        *[F.col(f"_bar.{c}").alias(c) for c in BAR_COLUMNS if c != "time"],
    )
    keys = ["symbol", "tf", "time"]
    latest = first_by_key(flat, keys, [-F.col("_seq"), -F.col("_i")]).drop("_seq", "_i")
    if stored is not None:
        latest = upsert_incoming_wins(stored, latest, keys)
    return cap_history(latest)


def tail_holdout(bars: DataFrame, share: float, keys: Sequence[str] = ("symbol",), step_seconds: int = 3600) -> DataFrame:
    """Drop the first ``int(rows * share)`` rows of each key; no share keeps all."""
    if share is None or share <= 0:
        return bars
    placed = with_position(bars, keys, ["time"], time_bucket("time", step_seconds), "_p", "_total")
    cut = F.floor(F.col("_total") * F.lit(min(share, 0.999)))
    return placed.where(F.col("_p") >= cut).drop("_p", "_total")


def fold_bars(bars: DataFrame, folds: int, embargo: int, keys: Sequence[str] = ("symbol",),
              step_seconds: int = 3600, fold: str = "fold") -> DataFrame:
    """Test fold of each bar with its position inside the fold.

    Contiguous blocks of rows // folds, the last takes the rest.  With too few
    rows only the last 1/folds is a test block, as fold 0.
    """
    placed = with_position(bars, keys, ["time"], time_bucket("time", step_seconds), "pos", "n_rows")
    n, p = F.col("n_rows"), F.col("pos")
    small = F.lit(folds < 2) | (n < F.lit(folds * (embargo * 2 + 2)))
    size = F.greatest(F.floor(n / F.lit(max(folds, 1))), F.lit(1))
    cut = F.floor(n * F.lit(1 - 1 / max(folds, 2)))
    k = F.when(small, F.when(p >= cut, F.lit(0))).otherwise(F.least(F.floor(p / size), F.lit(folds - 1)))
    start = F.when(small, cut).otherwise(F.col(fold) * size)
    end = F.when(small, n).otherwise(F.when(F.col(fold) == folds - 1, n).otherwise((F.col(fold) + 1) * size))
    return (
        placed.withColumn(fold, k.cast("long"))
        .withColumn("test_start", start.cast("long"))
        .withColumn("test_end", end.cast("long"))
    )


def fold_bounds(bars: DataFrame, folds: int, embargo: int, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Per key and fold the test range and the two purged train ranges, from row counts."""
    n = F.col("n_rows")
    counts = bars.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    small = F.lit(folds < 2) | (n < F.lit(folds * (embargo * 2 + 2)))
    size = F.floor(n / F.lit(max(folds, 1)))
    cut = F.floor(n * F.lit(1 - 1 / max(folds, 2)))
    last = F.when(small, F.lit(0)).otherwise(F.lit(max(folds, 1) - 1))
    out = counts.withColumn("fold", F.explode(F.sequence(F.lit(0), last)))
    start = F.when(small, cut).otherwise(F.col("fold") * size)
    end = F.when(small | (F.col("fold") == folds - 1), n).otherwise((F.col("fold") + 1) * size)
    out = out.withColumn("test_start", start.cast("long")).withColumn("test_end", end.cast("long"))
    return out.select(
        *keys,
        F.col("fold").cast("long").alias("fold"),
        "test_start",
        "test_end",
        F.greatest(F.col("test_start") - F.lit(embargo), F.lit(0)).cast("long").alias("train_until"),
        F.when(small, n).otherwise(F.least(n, F.col("test_end") + F.lit(embargo))).cast("long").alias("train_from"),
    )


def enough_rows(bars: DataFrame, wanted: int, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Row count per key and whether it suffices to serve ``wanted`` rows."""
    return bars.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).withColumn(
        "accepted", F.col("n_rows") >= F.lit(max(100, wanted // 2))
    )


def unique_times(bars: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Rows, distinct times and whether a table may be written, per key."""
    per_time = bars.groupBy(*keys, "time").agg(F.count(F.lit(1)).alias("_n"))
    return per_time.groupBy(*keys).agg(
        F.sum("_n").alias("n_rows"),
        F.count(F.lit(1)).alias("n_times"),
        (F.max("_n") == 1).alias("is_unique"),
    )


def backfill_stats(stored: DataFrame, fetched: DataFrame, target: int, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """What a backfill would do per key: rows before, fetched, after, added, and the status."""
    keys = list(keys)
    sides = stored.select(*keys, "time", F.lit(1).alias("s"), F.lit(0).alias("f")).unionByName(
        fetched.select(*keys, "time", F.lit(0).alias("s"), F.lit(1).alias("f"))
    )
    per_time = sides.groupBy(*keys, "time").agg(F.sum("s").alias("s"), F.sum("f").alias("f"))
    counted = per_time.groupBy(*keys).agg(
        F.sum("s").alias("cached_before"), F.sum("f").alias("_f"), F.count(F.lit(1)).alias("_all")
    )
    noop = F.col("cached_before") >= target
    return counted.select(
        *keys,
        F.when(noop, F.lit("noop")).otherwise(F.lit("fetched")).alias("status"),
        "cached_before",
        F.when(noop, F.lit(0)).otherwise(F.col("_f")).cast("long").alias("fetched"),
        F.when(noop, F.col("cached_before")).otherwise(F.col("_all")).cast("long").alias("cached_after"),
        F.when(noop, F.lit(0)).otherwise(F.col("_all") - F.col("cached_before")).cast("long").alias("added"),
    )


def allowed_shrink(stored: DataFrame, incoming: DataFrame, keys: Sequence[str] = ("symbol", "tf")) -> DataFrame:
    """Per partition whether the incoming rows may replace the stored ones, given as bars or as counts (n_stored)."""
    new = incoming.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_new"))
    old = stored if "n_stored" in stored.columns else stored.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_stored"))
    return new.join(old, list(keys), "left").select(
        *keys, "n_new", F.coalesce("n_stored", F.lit(0)).alias("n_stored"),
        (F.col("n_new") >= F.coalesce("n_stored", F.lit(0))).alias("accepted"),
    )
