"""Price, cost and profit columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Pip sizes, the dollar value of a pip per lot, and default costs.
PIP = 0.0001
PIP_JPY = 0.01
PIP_VALUE = 10.0
DEFAULT_SPREAD = 1.0
DEFAULT_SPREAD_JPY = 1.5
DEFAULT_SLIPPAGE = 0.5


def pip_size(symbol: Column) -> Column:
    return F.when(F.upper(symbol).contains("JPY"), F.lit(PIP_JPY)).otherwise(F.lit(PIP))


def default_spread(symbol: Column) -> Column:
    return F.when(F.upper(symbol).contains("JPY"), F.lit(DEFAULT_SPREAD_JPY)).otherwise(
        F.lit(DEFAULT_SPREAD)
    )


def gross_pnl(side: Column, entry: Column, exit_: Column, volume: Column, pip: Column) -> Column:
    """Direction-adjusted profit in USD before costs."""
    pips = (exit_ - entry) / pip
    return F.when(side == "SELL", -pips).otherwise(pips) * F.lit(PIP_VALUE) * volume


def trade_cost(
    volume: Column, is_stop: Column, spread: Column, slippage: Column, commission: Column
) -> Column:
    """Spread always, slippage on stops, commission on both sides."""
    slip = F.when(is_stop, slippage * F.lit(PIP_VALUE) * volume).otherwise(F.lit(0.0))
    return spread * F.lit(PIP_VALUE) * volume + slip + F.lit(2.0) * commission * volume


def paper_pnl(side: Column, volume: Column, opened: Column, closed: Column) -> Column:
    """Journal profit: always the small pip, rounded half-even to cents."""
    return F.bround(gross_pnl(side, opened, closed, volume, F.lit(PIP)), 2)


def entry_price(side: Column, next_open: Column, spread_pips: Column, pip: Column) -> Column:
    """Next open moved by half the spread against the trader."""
    half = spread_pips * pip / F.lit(2.0)
    return F.when(side == "BUY", next_open + half).otherwise(next_open - half)


def expected_rr(entry: Column, sl: Column, tp: Column) -> Column:
    risk = F.abs(entry - sl)
    return F.when(risk > 0, F.try_divide(F.abs(tp - entry), risk)).otherwise(F.lit(0.0))


def r_proxy(profit: Column, opened: Column, sl: Column) -> Column:
    """Profit per price unit of stop distance; null without a usable stop."""
    distance = F.abs(opened - sl)
    return F.when((sl != 0) & (distance > 0), F.try_divide(profit, distance))


def mid(bid: Column, ask: Column) -> Column:
    return (bid + ask) / F.lit(2.0)


def spread_pips(spread: Column, bid: Column, ask: Column) -> Column:
    """The quoted spread, or the bid-ask distance in pips when absent or zero."""
    return F.when(spread != 0, spread).otherwise((ask - bid) / F.lit(PIP))


def break_even_stop(side: Column, entry: Column, buffer_pips: float = 1.0) -> Column:
    offset = F.lit(buffer_pips * PIP)
    return F.bround(F.when(side == "BUY", entry + offset).otherwise(entry - offset), 5)


def target_reached(side: Column, tp: Column, bid: Column, ask: Column) -> Column:
    """First target touched by the closing side of the quote; no target, no touch."""
    hit = ((side == "BUY") & (bid >= tp)) | ((side == "SELL") & (ask <= tp))
    return F.coalesce((tp != 0) & hit, F.lit(False))


def closed_volume(volume: Column, fraction: float) -> Column:
    return F.bround(volume * F.lit(fraction), 2)


def remaining_volume(volume: Column, fraction: float) -> Column:
    return F.bround(volume - closed_volume(volume, fraction), 2)
