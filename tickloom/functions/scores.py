"""Score columns: deflated and probabilistic Sharpe, guards and decisions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

ANNUAL_DAYS = 252

# Guard thresholds.
TARGET_SHARPE = 1.5
MAX_DRAWDOWN = 0.05
WIN_FLOOR = 0.30
WIN_FLOOR_REVERSION = 0.50


def expected_max_normal(n: Column) -> Column:
    """Expected maximum of n standard normal draws (extreme-value approximation)."""
    log_n = F.ln(n.cast("double"))
    root = F.sqrt(F.lit(2.0) * log_n)
    gumbel = root - (F.ln(log_n) + F.lit(math.log(4.0 * math.pi))) / (F.lit(2.0) * root)
    return F.when(n == 2, F.lit(0.5641895835)).when(n > 2, gumbel)


def deflated_sharpe(observed: Column, n: Column, mean: Column, std: Column) -> Column:
    """Observed minus what the best of n random trials would show."""
    usable = (n >= 2) & (std > 0)
    return F.when(usable, observed - (mean + std * expected_max_normal(n))).otherwise(observed)


def finite(x: Column) -> Column:
    """x, or null when it is NaN or infinite."""
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


# Rational approximation 7.1.26 of erf (Abramowitz and Stegun).
_ERF_P = 0.3275911
_ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def normal_cdf(z: Column) -> Column:
    """Standard normal CDF, absolute error below 1.5e-7."""
    x = F.abs(z) / F.lit(math.sqrt(2.0))
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(_ERF_P) * x)
    poly = F.lit(0.0)
    for a in reversed(_ERF_A):
        poly = (poly + F.lit(a)) * t
    erf = F.lit(1.0) - poly * F.exp(-x * x)
    return F.lit(0.5) * (F.lit(1.0) + F.when(z < 0, -erf).otherwise(erf))


def probabilistic_sharpe(
    sharpe: Column, n: Column, skew: Column | None = None, kurt: Column | None = None,
    benchmark: float = 0.0,
) -> Column:
    """Probability that the true Sharpe exceeds the benchmark; degenerate input gives 0."""
    skew = F.lit(0.0) if skew is None else skew
    kurt = F.lit(3.0) if kurt is None else kurt
    spread = F.lit(1.0) - skew * sharpe + (kurt - F.lit(1.0)) / F.lit(4.0) * sharpe * sharpe
    z = (sharpe - F.lit(benchmark)) * F.sqrt(F.greatest(n - F.lit(1), F.lit(0)).cast("double"))
    z = finite(F.try_divide(z, F.sqrt(F.greatest(spread, F.lit(0.0)))))
    fine = (n >= 2) & (spread > 0) & z.isNotNull()
    return F.when(fine, normal_cdf(z)).otherwise(F.lit(0.0))


def confidence(dsr: Column) -> Column:
    return (
        F.when(dsr.isNull(), F.lit("pending"))
        .when(dsr > 0.5, F.lit("high"))
        .when(dsr > 0.0, F.lit("moderate"))
        .otherwise(F.lit("noise"))
    )


def promotable(dsr: Column, guard: Column, error: Column, threshold: float = 0.0) -> Column:
    return F.coalesce((dsr > threshold) & (guard == "PASS") & error.isNull(), F.lit(False))


def guard_reasons(
    sharpe: Column, max_dd: Column, win_rate: Column,
    target: float = TARGET_SHARPE, dd_limit: float = MAX_DRAWDOWN, win_floor: Column | float = WIN_FLOOR,
) -> Column:
    """Names of the failed checks; an empty array is a pass."""
    floor = F.lit(win_floor) if isinstance(win_floor, float) else win_floor
    return F.array_compact(F.array(
        F.when(F.coalesce(sharpe > target, F.lit(False)), None).otherwise(F.lit("sharpe")),
        F.when(F.coalesce(max_dd < dd_limit, F.lit(False)), None).otherwise(F.lit("drawdown")),
        F.when(F.coalesce(win_rate > floor, F.lit(False)), None).otherwise(F.lit("win_rate")),
    ))


def win_floor_for(strategy: Column) -> Column:
    return F.when(strategy == "mean_reversion", F.lit(WIN_FLOOR_REVERSION)).otherwise(F.lit(WIN_FLOOR))


def keep_or_rollback(
    guard_pass: Column, sharpe: Column, base_sharpe: Column, win: Column, base_win: Column
) -> Column:
    better = (sharpe > base_sharpe) & (win >= base_win)
    return F.when(F.coalesce(guard_pass | better, F.lit(False)), F.lit("keep")).otherwise(F.lit("rollback"))
