"""Strategies: each turns bars into one signal row per bar.

Signal columns: action (BUY, SELL, HOLD), strength 0..1, reason, entry_price,
sl, tp, atr.  ``STRATEGIES`` is the registry; a strategy is any callable
``bars -> bars + signal columns``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .indicators import indicator_frame, join_legs, pair_statistics, placed
from .series import settle
from .structure import PIN_TAIL_PREMIUM, higher_bias, in_zone, pin_bars, structure_as_of

SIGNAL_COLUMNS = ("action", "strength", "reason", "entry_price", "sl", "tp", "atr")
FALLBACK_FAST, FALLBACK_SLOW = 9, 21


def bracket(action: Column, close: Column, atr: Column, stop: float | Column, target: float | Column) -> tuple[Column, Column]:
    """Stop and target at multiples of ATR on either side of the close."""
    buy, sell = action == "BUY", action == "SELL"
    stop, target = (x if isinstance(x, Column) else F.lit(x) for x in (stop, target))
    sl = F.when(buy, close - stop * atr).when(sell, close + stop * atr)
    tp = F.when(buy, close + target * atr).when(sell, close - target * atr)
    return sl, tp


def capped(x: Column) -> Column:
    return F.least(F.lit(1.0), x)


def separation(gap: Column, close: Column) -> Column:
    """Distance relative to price, one basis point counting 0.1, capped at 1."""
    return capped(F.abs(gap) / F.greatest(F.abs(close), F.lit(1e-9)) * F.lit(1000.0))


def cross_columns(fast: int, slow: int, atr_n: int, stop: float, target: float, prev: Column) -> dict[str, Column]:
    """Signal columns of an average cross; ``prev`` is the previous row's gap."""
    close, atr = F.col("close"), F.coalesce(F.col(f"atr_{atr_n}"), F.lit(0.0))
    gap = F.col(f"ema_{fast}") - F.col(f"ema_{slow}")
    ready = F.col("pos") + 1 >= max(slow, atr_n) + 2
    up, down = (prev <= 0) & (gap > 0), (prev >= 0) & (gap < 0)
    action = F.when(ready & up, F.lit("BUY")).when(ready & down, F.lit("SELL")).otherwise(F.lit("HOLD"))
    sl, tp = bracket(action, close, atr, stop, target)
    return {
        "action": action,
        "strength": F.when(action == "HOLD", F.lit(0.0)).otherwise(separation(gap, close)),
        "reason": F.when(~ready, F.lit("insufficient_bars"))
        .when(up, F.lit("fast_ema_crossed_above_slow"))
        .when(down, F.lit("fast_ema_crossed_below_slow"))
        .otherwise(F.lit("no_cross")),
        "entry_price": close, "sl": sl, "tp": tp, "atr": atr,
    }


def ema_cross(bars: DataFrame, fast: int = 9, slow: int = 21, atr_n: int = 14, stop: float = 1.5,
              target: float = 3.0, keys: Sequence[str] = ("symbol",), step_seconds: int = 3600) -> DataFrame:
    if fast >= slow:
        fast, slow = FALLBACK_FAST, FALLBACK_SLOW

    def finish(b, df):
        df = df.withColumn("_gap", F.col(f"ema_{fast}") - F.col(f"ema_{slow}"))
        return df.withColumn("prev_gap", F.lag("_gap").over(b.w))

    df = indicator_frame(bars, keys, emas=[fast, slow], atrs=[atr_n], step_seconds=step_seconds,
                         keep_history=1, finish=finish)
    sig = cross_columns(fast, slow, atr_n, stop, target, F.col("prev_gap"))
    return df.select(*placed_columns(bars), F.col(f"ema_{fast}").alias("ema_fast"), F.col(f"ema_{slow}").alias("ema_slow"),
                     *[c.alias(n) for n, c in sig.items()])


def placed_columns(bars: DataFrame) -> list[str]:
    return [*bars.columns] if "pos" in bars.columns else [*bars.columns, "pos"]


def reversion_columns(bb_n: int, bb_k: float, rsi_n: int, low: float, high: float, atr_n: int,
                      stop: float, target: float) -> dict[str, Column]:
    """Signal columns of a band reversion confirmed by the oscillator."""
    close = F.col("close")
    atr = F.coalesce(F.col(f"atr_{atr_n}"), F.lit(0.0))
    rsi = F.coalesce(F.col(f"rsi_{rsi_n}"), F.lit(50.0))
    mid, dev = F.col(f"bb_mid_{bb_n}"), F.col(f"bb_std_{bb_n}")
    upper, lower = F.coalesce(mid + F.lit(bb_k) * dev, close), F.coalesce(mid - F.lit(bb_k) * dev, close)
    ready = F.col("pos") + 1 >= max(bb_n, rsi_n, atr_n) + 2
    buy, sell = (close <= lower) & (rsi < low), (close >= upper) & (rsi > high)
    action = F.when(ready & buy, F.lit("BUY")).when(ready & sell, F.lit("SELL")).otherwise(F.lit("HOLD"))
    sl, tp = bracket(action, close, atr, stop, target)
    half = F.lit(0.5)
    strength = (
        F.when(action == "BUY", capped((F.lit(1.0) - rsi / F.lit(low)) * half + half))
        .when(action == "SELL", capped((rsi / F.lit(high) - F.lit(1.0)) * half + half))
        .otherwise(F.lit(0.0))
    )
    reason = (
        F.when(~ready, F.lit("insufficient_bars"))
        .when(buy, F.lit("price_at_lower_band_rsi_oversold"))
        .when(sell, F.lit("price_at_upper_band_rsi_overbought"))
        .otherwise(F.lit("no_signal"))
    )
    return {"action": action, "strength": strength, "reason": reason, "entry_price": close, "sl": sl, "tp": tp, "atr": atr}


def mean_reversion(bars: DataFrame, bb_n: int = 20, bb_k: float = 2.0, rsi_n: int = 14, low: float = 30.0,
                   high: float = 70.0, atr_n: int = 14, stop: float = 1.5, target: float = 2.0,
                   keys: Sequence[str] = ("symbol",), step_seconds: int = 3600) -> DataFrame:
    df = indicator_frame(bars, keys, atrs=[atr_n], rsis=[rsi_n], bands=[(bb_n, bb_k)], step_seconds=step_seconds)
    sig = reversion_columns(bb_n, bb_k, rsi_n, low, high, atr_n, stop, target)
    return df.select(*placed_columns(bars), F.col(f"rsi_{rsi_n}").alias("rsi"), *[c.alias(n) for n, c in sig.items()])


GO = "bos_aligned_with_htf_bias"


def trend_setups(bars: DataFrame, seconds: int = 14400, left: int = 2, right: int = 2, atr_n: int = 14, lookback: int = 10,
                 mode: str = "standard", keys: Sequence[str] = ("symbol",), step_seconds: int = 3600) -> DataFrame:
    """Per bar what the trend strategy sees before stops are set.

    Adds htf_bias, bos_direction, bos_level, known_low, known_high, atr and ``setup``, the
    reason not to trade or ``GO``.
    """
    if mode not in ("standard", "premium"):
        raise ValueError("mode must be 'standard' or 'premium'")
    keys = list(keys)
    base = settle(placed(bars, keys, step_seconds))
    cols = base.columns
    df = indicator_frame(base, keys, atrs=[atr_n], step_seconds=step_seconds)
    df = structure_as_of(df, left, right, keys, step_seconds)
    if mode == "premium":
        df = pin_bars(df, PIN_TAIL_PREMIUM, keys, step_seconds)
    df = higher_bias(settle(df), seconds, left, right, lookback, keys, step_seconds)
    bullish = F.col("bos_direction") == "bullish"
    aligned = F.col("htf_bias") == F.when(bullish, F.lit("uptrend")).otherwise(F.lit("downtrend"))
    need = max(left + right + 4, atr_n + 2, 20)
    setup = (
        F.when(F.col("pos") + 1 < need, F.lit("insufficient_bars"))
        .when(F.col("htf_rows") < left + right + 4, F.lit("insufficient_htf_bars"))
        .when(F.col("reversal"), F.lit("structural_reversal_in_progress"))
        .when(F.col("htf_bias") == "range", F.lit("htf_range_no_trade"))
        .when(F.col("bos_direction").isNull(), F.lit("no_break_of_structure"))
        .when(~aligned, F.lit("bos_against_htf_bias"))
    )
    if mode == "premium":
        zone = in_zone(F.col("bos_direction"), F.col("close"), F.col("known_high"), F.col("known_low"))
        pin = F.when(bullish, F.col("pin_bull")).otherwise(F.col("pin_bear"))
        setup = setup.when(~zone, F.lit("not_in_premium_zone")).when(~pin, F.lit("no_pin_bar_confirmation"))
    return df.select(*cols, "htf_bias", "bos_direction", "bos_level", "known_low", "known_high",
                     F.coalesce(F.col(f"atr_{atr_n}"), F.lit(0.0)).alias("atr"), setup.otherwise(F.lit(GO)).alias("setup"))


def trend_bracket(bullish: Column, stop: Column, buffer: Column, r_target: Column) -> tuple[Column, Column, Column]:
    """Structural stop (an ATR stop where no swing is known), target at a multiple of the risk, and the risk."""
    close, atr = F.col("close"), F.col("atr")
    low = F.coalesce(F.col("known_low") - atr * buffer, close - stop * atr)
    high = F.coalesce(F.col("known_high") + atr * buffer, close + stop * atr)
    sl = F.when(bullish, low).otherwise(high)
    risk = F.abs(close - sl)
    return sl, F.when(bullish, close + r_target * risk).otherwise(close - r_target * risk), risk


def trend_following(bars: DataFrame, seconds: int = 14400, left: int = 2, right: int = 2, r_target: float = 1.5,
                    atr_n: int = 14, stop: float = 1.5, buffer: float = 1.0, lookback: int = 10,
                    mode: str = "standard", keys: Sequence[str] = ("symbol",), step_seconds: int = 3600) -> DataFrame:
    """Breaks of structure taken in the direction of the higher timeframe."""
    if r_target < 1.0:
        raise ValueError("r_target must be >= 1.0")
    df = trend_setups(bars, seconds, left, right, atr_n, lookback, mode, keys, step_seconds)
    close, bullish = F.col("close"), F.col("bos_direction") == "bullish"
    sl, tp, risk = trend_bracket(bullish, F.lit(stop), F.lit(buffer), F.lit(r_target))
    reason = F.when((F.col("setup") == GO) & (risk <= 0), F.lit("zero_risk")).otherwise(F.col("setup"))
    go = reason == GO
    action = F.when(go & bullish, F.lit("BUY")).when(go, F.lit("SELL")).otherwise(F.lit("HOLD"))
    cols = [c for c in df.columns if c not in ("htf_bias", "bos_direction", "bos_level", "known_low", "known_high", "atr", "setup")]
    return df.select(
        *cols, "htf_bias", "bos_direction", "bos_level",
        action.alias("action"),
        F.when(go, separation(close - F.col("bos_level"), close)).otherwise(F.lit(0.0)).alias("strength"),
        reason.alias("reason"), close.alias("entry_price"),
        F.when(go, sl).alias("sl"), F.when(go, tp).alias("tp"), "atr",
    )


PAIR_ROWS = 60


def pairs_signal(pair: DataFrame, entry_z: float = 2.0, spread: int = PAIR_ROWS, hedge: int = PAIR_ROWS, stop: float = 1.5,
                 atr_n: int = 14, require_stationary: bool = False, critical_t: float = -3.37,
                 keys: Sequence[str] = (), step_seconds: int = 3600) -> DataFrame:
    """Signals of the first leg from the spread of two joined legs.

    ``require_stationary`` keeps only rows whose Dickey-Fuller t on the window
    residuals lies below the tabulated 5 % value.
    """
    df = pair_statistics(pair, hedge, spread, atr_n, keys, step_seconds)
    z, half = F.col("zscore"), F.col("half_life")
    close, atr = F.col("close_1"), F.col("atr")
    reason = F.when(F.col("pos") + 1 < max(spread, hedge) + 2, F.lit("insufficient_bars"))
    if require_stationary:
        reason = reason.when(F.coalesce(F.col("df_t") >= critical_t, F.lit(True)), F.lit("not_cointegrated"))
    reason = (
        reason.when(z.isNull(), F.lit("insufficient_spread_data"))
        .when(~F.col("reverts") | (half > spread), F.lit("half_life_too_long"))
        .when(z < -entry_z, F.lit("spread_low"))
        .when(z > entry_z, F.lit("spread_high"))
        .otherwise(F.lit("no_signal"))
    )
    df = df.withColumn("reason", reason)
    action = F.when(F.col("reason") == "spread_low", F.lit("BUY")).when(F.col("reason") == "spread_high", F.lit("SELL")).otherwise(F.lit("HOLD"))
    sl, tp = bracket(action, close, atr, stop, 2.0 * stop)
    return df.select(
        *[c for c in pair.columns if c != "pos"], "pos", "beta", "spread", "zscore", "half_life", "reverts", "reason",
        action.alias("action"),
        F.when(action == "HOLD", F.lit(0.0)).otherwise(capped(F.abs(z) / F.lit(entry_z))).alias("strength"),
        close.alias("entry_price"), sl.alias("sl"), tp.alias("tp"), "atr",
    )


def pairs_trading(bars: DataFrame, first: str, second: str, **params) -> DataFrame:
    return pairs_signal(join_legs(bars, first, second), **params)


STRATEGIES: dict[str, Callable[..., DataFrame]] = {
    "ema_crossover": ema_cross,
    "mean_reversion": mean_reversion,
    "trend_following": trend_following,
    "pairs_trading": pairs_trading,
}


def run_strategy(name: str, bars: DataFrame, **params) -> DataFrame:
    """Signals of a registered strategy; unknown names fall back to the average cross."""
    return STRATEGIES.get(name, ema_cross)(bars, **params)
