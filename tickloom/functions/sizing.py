"""Position size and risk-tier columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .money import PIP, PIP_VALUE

# Risk limits and drawdown tiers.
LOT_STEP = 0.01
RISK_PER_TRADE = 0.01
ATR_STOP = 1.5
MAX_LOTS = 10.0
KELLY_DEFAULT = 0.25
KELLY_MIN_TRADES = 30
WARN, REDUCE, HALT = 0.10, 0.15, 0.20
DAILY_LOSS_LIMIT = 0.02
LOSS_STREAK_HALT = 5


def position_size(
    balance: Column,
    atr: Column,
    kelly: Column,
    correlation: Column,
    max_lots: float = MAX_LOTS,
) -> Column:
    """Lots that risk 1 % of the balance at 1.5 ATR, in steps of 0.01, at least 0.01."""
    pips = atr * F.lit(ATR_STOP) / F.lit(PIP)
    lots = F.try_divide(balance * F.lit(RISK_PER_TRADE), pips * F.lit(PIP_VALUE))
    lots = lots * kelly * F.greatest(F.lit(0.0), F.lit(1.0) - correlation)
    lots = F.least(lots, F.lit(max_lots))
    stepped = F.bround(F.bround(lots / F.lit(LOT_STEP)) * F.lit(LOT_STEP), 2)
    usable = (balance > 0) & (atr > 0)
    return F.when(usable, F.greatest(F.lit(LOT_STEP), stepped)).otherwise(F.lit(LOT_STEP))


def drawdown(peak: Column, equity: Column) -> Column:
    return F.greatest(F.lit(0.0), F.try_divide(peak - equity, peak))


def _tiers(peak: Column, equity: Column, warn: float, reduce: float) -> Column:
    dd = drawdown(peak, equity)
    return (
        F.when(peak <= 0, F.lit(1.0))
        .when(dd >= HALT, F.lit(0.0))
        .when(dd >= REDUCE, F.lit(reduce))
        .when(dd >= WARN, F.lit(warn))
        .otherwise(F.lit(1.0))
    )


def drawdown_size_factor(peak: Column, equity: Column) -> Column:
    return _tiers(peak, equity, warn=0.7, reduce=0.5)


def preservation_factor(peak: Column, equity: Column) -> Column:
    return _tiers(peak, equity, warn=0.5, reduce=0.25)


def kelly_multiplier(
    trades: Column, wins: Column, losses: Column, sum_win: Column, sum_loss: Column,
    fraction: float = KELLY_DEFAULT,
) -> Column:
    """Half-Kelly from counts and sums of earlier results, capped at ``fraction``."""
    cap = F.lit(fraction)
    b = F.try_divide(F.try_divide(sum_win, wins), F.try_divide(sum_loss, losses))
    rate = F.try_divide(wins, trades)
    half = F.try_divide(b * rate - (F.lit(1.0) - rate), b) * F.lit(0.5)
    return (
        F.when(trades < KELLY_MIN_TRADES, cap)
        .when(wins == 0, F.lit(0.0))
        .when(losses == 0, cap)
        .otherwise(F.least(cap, F.greatest(F.lit(0.0), half)))
    )


def order_check(sl: Column, volume: Column, max_lots: float = MAX_LOTS) -> Column:
    """``ok`` or the first failing reason."""
    stop, lots = F.coalesce(sl, F.lit(0.0)), F.coalesce(volume, F.lit(0.0))
    return (
        F.when(stop == 0, F.lit("sl_required"))
        .when(lots <= 0, F.lit("volume_must_be_positive"))
        .when(lots > max_lots, F.lit(f"volume>{max_lots}"))
        .otherwise(F.lit("ok"))
    )


def breaker(
    equity: Column, peak: Column, day_start: Column, streak: Column
) -> Column:
    """First circuit breaker that trips, else ``ok``."""
    dd = drawdown(peak, equity)
    day = F.try_divide(equity - day_start, day_start)
    return (
        F.when((peak > 0) & (dd >= HALT), F.lit("trailing_dd_halt"))
        .when(streak >= LOSS_STREAK_HALT, F.lit("consecutive_losses"))
        .when((day_start > 0) & (day <= -DAILY_LOSS_LIMIT), F.lit("daily_loss_limit"))
        .otherwise(F.lit("ok"))
    )
