"""Entry gates on signals: sessions, news, regime.  Exits are never gated."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.clock import in_session
from .joins import news_blackout


def regime_gate(signals: DataFrame, allowed: Mapping[str, Sequence[int]], strategy: str = "strategy", regime: str = "regime") -> DataFrame:
    """Keep signals whose regime is allowed for their strategy; strategies without a list pass."""
    ok = F.lit(True)
    for name, states in allowed.items():
        if states:
            ok = F.when(F.col(strategy) == name, F.col(regime).isin([int(s) for s in states])).otherwise(ok)
    return signals.where(F.coalesce(ok, F.lit(True)))


def entry_gates(signals: DataFrame, sessions: Sequence[str] | None = None, calendar: DataFrame | None = None, minutes: int = 30) -> DataFrame:
    """Keep signals inside a session and away from news."""
    out = signals
    if sessions is not None:
        out = out.where(in_session(F.col("time"), sessions))
    if calendar is not None:
        out = news_blackout(out, calendar, minutes)
    return out
