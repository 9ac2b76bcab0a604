"""Market structure: swings, trend, breaks of structure, higher-timeframe bias, pins.

"As of a row" means: with the bars up to that row only.  A swing needs ``right``
later bars, so as of row i only swings up to i - right are known.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bars import resample
from .indicators import placed
from .series import BUCKET_ROWS, Blocks, running, settle

# Retracement zone and pin-bar shape.
ZONE_NEAR, ZONE_FAR = 0.618, 0.786
PIN_BODY = 1.0 / 3.0
PIN_TAIL = 2.0
PIN_TAIL_PREMIUM = 1.5


def _bucket() -> Column:
    return F.floor(F.col("pos") / F.lit(BUCKET_ROWS)).cast("long")


def swings(bars: DataFrame, left: int = 2, right: int = 2, keys: Sequence[str] = ("symbol",),
           step_seconds: int = 3600) -> DataFrame:
    """Flag bars strictly above (below) the ``left`` bars before and ``right`` bars after."""
    if left < 1 or right < 1:
        raise ValueError("left and right must both be >= 1")
    b = Blocks(placed(bars, keys, step_seconds), keys, left, right)
    past, ahead = b.rows(-left, -1), b.rows(1, right)
    whole = (F.count(F.lit(1)).over(past) == left) & (F.count(F.lit(1)).over(ahead) == right)
    up = whole & (F.col("high") > F.max("high").over(past)) & (F.col("high") > F.max("high").over(ahead))
    down = whole & (F.col("low") < F.min("low").over(past)) & (F.col("low") < F.min("low").over(ahead))
    return b.owned(b.df.withColumn("swing_high", up).withColumn("swing_low", down))


def last_two_swings(df: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Latest and previous swing high (h1, h2) and low (l1, l2) at or before each row."""
    hi = F.when(F.col("swing_high"), F.col("high"))
    lo = F.when(F.col("swing_low"), F.col("low"))
    pos = F.col("pos")
    df = settle(df)
    one = running(df, keys, _bucket(), ["pos"],
                  {"_ph": ("last", hi), "_pl": ("last", lo)}, seq=pos, inclusive=False)
    pair_h = F.when(F.col("swing_high"), F.struct(F.col("high").alias("a"), F.col("_ph").alias("b")))
    pair_l = F.when(F.col("swing_low"), F.struct(F.col("low").alias("a"), F.col("_pl").alias("b")))
    two = running(settle(one), keys, _bucket(), ["pos"],
                  {"_h": ("last", pair_h), "_l": ("last", pair_l)}, seq=pos)
    return two.select(
        *df.columns,
        F.col("_h.a").alias("h1"), F.col("_h.b").alias("h2"), F.col("_l.a").alias("l1"), F.col("_l.b").alias("l2"),
    )


def trend_of(h1: Column, h2: Column, l1: Column, l2: Column) -> Column:
    """Both rising is an uptrend, both falling a downtrend, anything else a range."""
    return (
        F.when((h1 > h2) & (l1 > l2), F.lit("uptrend"))
        .when((h1 < h2) & (l1 < l2), F.lit("downtrend"))
        .otherwise(F.lit("range"))
    )


def trend(bars: DataFrame, left: int = 2, right: int = 2, keys: Sequence[str] = ("symbol",), step_seconds: int = 3600) -> DataFrame:
    """Trend of each bar from the last two swings flagged at or before it."""
    df = last_two_swings(swings(bars, left, right, keys, step_seconds), keys)
    return df.withColumn("trend", trend_of(*[F.col(c) for c in ("h1", "h2", "l1", "l2")]))


def structure_as_of(bars: DataFrame, left: int = 2, right: int = 2, keys: Sequence[str] = ("symbol",),
                    step_seconds: int = 3600) -> DataFrame:
    """Known swings and the last break of structure as of each bar.

    Adds known_high and known_low (latest swing levels confirmed by this bar) and
    bos_pos, bos_direction, bos_level.  A bar older than ``right`` bars is judged
    by the last swing before it; the newest bars by the last confirmed swing.
    """
    df = last_two_swings(swings(bars, left, right, keys, step_seconds), keys)
    b = Blocks(df, keys, right + 1)
    x = b.df
    c = F.col("close")

    def event(close: Column, hi: Column, lo: Column, pos: Column) -> Column:
        return F.when(close > hi, F.struct(pos.alias("pos"), F.lit("bullish").alias("direction"), hi.alias("level"))).when(
            close < lo, F.struct(pos.alias("pos"), F.lit("bearish").alias("direction"), lo.alias("level"))
        )

    x = x.select(
        "*",
        F.lag("h1", 1).over(b.w).alias("_ph"), F.lag("l1", 1).over(b.w).alias("_pl"),
        F.lag("h1", right).over(b.w).alias("known_high"), F.lag("l1", right).over(b.w).alias("known_low"),
        *[F.lag(c, k).over(b.w).alias(f"_c{k}") for k in range(1, right)],
    )
    x = x.withColumn("_final", event(c, F.col("_ph"), F.col("_pl"), F.col("pos")))
    fresh = [event(c if k == 0 else F.col(f"_c{k}"), F.col("known_high"), F.col("known_low"), F.col("pos") - k)
             for k in range(right)]
    x = x.withColumn("_fresh", F.coalesce(*fresh))
    x = b.owned(x).drop("_ph", "_pl", *[f"_c{k}" for k in range(1, right)])
    x = running(settle(x), keys, _bucket(), ["pos"], {"_settled": ("last", F.col("_final"))}, seq=F.col("pos"))
    b2 = Blocks(x, keys, right)
    y = b2.df.withColumn("_old", F.lag("_settled", right).over(b2.w))
    bos = F.coalesce(F.col("_fresh"), F.col("_old"))
    y = y.withColumn("_bos", bos)
    y = b2.owned(y)
    return y.select(
        *[k for k in df.columns if k not in ("h1", "h2", "l1", "l2")],
        "known_high", "known_low",
        F.col("_bos.pos").alias("bos_pos"), F.col("_bos.direction").alias("bos_direction"), F.col("_bos.level").alias("bos_level"),
    )


def higher_bias(bars: DataFrame, seconds: int = 14400, left: int = 2, right: int = 2, lookback: int = 10,
                keys: Sequence[str] = ("symbol",), step_seconds: int = 3600) -> DataFrame:
    """Higher-timeframe trend as of each bar, with its unfinished bucket included.

    Adds htf_rows, htf_bias and reversal (an opposite trend among the last
    ``lookback`` finished higher bars).  The higher table has one row per bucket
    and meets the bars on an equi-join; only the unfinished bucket is per bar.
    """
    keys = list(keys)
    htf = swings(settle(resample(bars, seconds, keys)), left, right, keys, seconds)
    htf = last_two_swings(htf, keys)
    b = Blocks(htf, keys, max(left + right, lookback + right) + right + 2)
    h = b.df
    lagged = {n: F.lag(n, right + 1).over(b.w) for n in ("h1", "h2", "l1", "l2")}
    mid_h, mid_l = F.lag("high", right).over(b.w), F.lag("low", right).over(b.w)
    near, far = b.rows(-(right - 1), -1), b.rows(-(right + left), -(right + 1))
    deep = F.col("pos") >= left + right
    above = F.lit(True) if right == 1 else mid_h > F.max("high").over(near)
    below = F.lit(True) if right == 1 else mid_l < F.min("low").over(near)
    h = h.select(
        "*",
        *[v.alias(f"_{n}") for n, v in lagged.items()],
        F.when(deep & above & (mid_h > F.max("high").over(far)), mid_h).alias("_cand_h"),
        F.when(deep & below & (mid_l < F.min("low").over(far)), mid_l).alias("_cand_l"),
        trend_of(*[F.lag(n, right).over(b.w) for n in ("h1", "h2", "l1", "l2")]).alias("_label"),
    )
    prior = b.rows(-lookback, -1)
    h = h.withColumn("_had_up", F.max(F.col("_label") == "uptrend").over(prior)).withColumn(
        "_had_down", F.max(F.col("_label") == "downtrend").over(prior)
    )
    h = b.owned(h).select(
        *keys, F.col("time").alias("_htf"), (F.col("pos") + 1).alias("htf_rows"),
        "_h1", "_h2", "_l1", "_l2", "_cand_h", "_cand_l", "_had_up", "_had_down",
    )
    low = bars.withColumn("_htf", F.timestamp_seconds(F.floor(F.unix_seconds("time") / F.lit(seconds)) * F.lit(seconds)))
    inside = Window.partitionBy(*keys, "_htf").orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    low = low.withColumn("_part_h", F.max("high").over(inside)).withColumn("_part_l", F.min("low").over(inside))
    x = low.join(h, [*keys, "_htf"])
    is_h = F.coalesce(F.col("_cand_h") > F.col("_part_h"), F.lit(False))
    is_l = F.coalesce(F.col("_cand_l") < F.col("_part_l"), F.lit(False))
    bias = trend_of(
        F.when(is_h, F.col("_cand_h")).otherwise(F.col("_h1")), F.when(is_h, F.col("_h1")).otherwise(F.col("_h2")),
        F.when(is_l, F.col("_cand_l")).otherwise(F.col("_l1")), F.when(is_l, F.col("_l1")).otherwise(F.col("_l2")),
    )
    opposite = F.when(F.col("htf_bias") == "uptrend", F.col("_had_down")).when(F.col("htf_bias") == "downtrend", F.col("_had_up"))
    out = x.withColumn("htf_bias", bias).withColumn("reversal", F.coalesce(opposite, F.lit(False)))
    return out.select(*bars.columns, "htf_rows", "htf_bias", "reversal")


def in_zone(direction: Column, close: Column, high: Column, low: Column) -> Column:
    """Close inside the deep retracement of the latest swing leg."""
    span = high - low
    down = (close >= high - F.lit(ZONE_FAR) * span) & (close <= high - F.lit(ZONE_NEAR) * span)
    up = (close >= low + F.lit(ZONE_NEAR) * span) & (close <= low + F.lit(ZONE_FAR) * span)
    return F.coalesce((span > 0) & F.when(direction == "bullish", down).otherwise(up), F.lit(False))


def pin_bar(direction: str, prior_close: Column, tail: float = PIN_TAIL, body_max: float = PIN_BODY) -> Column:
    """Long tail against the direction, small body at the other end, follow-through close."""
    o, h, lo, c = (F.col(n) for n in ("open", "high", "low", "close"))
    rng, body = h - lo, F.abs(c - o)
    top, bottom = F.greatest(o, c), F.least(o, c)
    shaped = (rng > 0) & (F.try_divide(body, rng) <= body_max)
    least_tail = F.lit(tail) * F.greatest(body, rng * F.lit(1e-9))
    if direction == "bullish":
        ok = (bottom - lo >= least_tail) & (bottom >= lo + F.lit(1.0 - body_max) * rng)
        follow = prior_close.isNull() | (c > prior_close)
    elif direction == "bearish":
        ok = (h - top >= least_tail) & (top <= h - F.lit(1.0 - body_max) * rng)
        follow = prior_close.isNull() | (c < prior_close)
    else:
        raise ValueError("direction must be 'bullish' or 'bearish'")
    return F.coalesce(shaped & ok & follow, F.lit(False))


def pin_bars(bars: DataFrame, tail: float = PIN_TAIL, keys: Sequence[str] = ("symbol",), step_seconds: int = 3600) -> DataFrame:
    b = Blocks(placed(bars, keys, step_seconds), keys, 1)
    df = b.df.withColumn("_prior", F.lag("close").over(b.w))
    df = df.withColumn("pin_bull", pin_bar("bullish", F.col("_prior"), tail))
    df = df.withColumn("pin_bear", pin_bar("bearish", F.col("_prior"), tail))
    return b.owned(df).drop("_prior")
