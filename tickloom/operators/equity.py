"""Equity statistics: daily values, Sharpe, Sortino, drawdown, Calmar, fold aggregates."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import ANNUAL_DAYS
from .series import pos_bucket, running, settle

ROOT = math.sqrt(ANNUAL_DAYS)
MIN_FOLD_BARS = 50


def daily_equity(points: DataFrame, keys: Sequence[str] = ("symbol",), order: str = "pos") -> DataFrame:
    """Last equity per calendar day; days without a point repeat the day before.

    Each known day fills the gap to the next one, so there is no calendar join.
    Windows here run over days, which the calendar bounds.
    """
    day = points.groupBy(*keys, F.to_date("time").alias("day")).agg(F.max_by("equity", order).alias("equity"))
    nxt = F.lead("day").over(Window.partitionBy(*keys).orderBy("day"))
    until = F.coalesce(F.date_sub(nxt, 1), F.col("day"))
    return day.withColumn("_until", until).select(*keys, F.explode(F.sequence("day", "_until")).alias("day"), "equity")


def return_statistics(points: DataFrame, keys: Sequence[str] = ("symbol",), order: str = "pos") -> DataFrame:
    """Sharpe and Sortino of daily returns, forward-filled days counting as zero returns.

    Filled days add nothing to the sums, so they only enter through the day count.
    """
    day = points.groupBy(*keys, F.to_date("time").alias("day")).agg(F.max_by("equity", order).alias("e"))
    prev = F.lag("e").over(Window.partitionBy(*keys).orderBy("day"))  # days of a key: bounded by the calendar
    d = day.withColumn("r", F.try_divide(F.col("e") - prev, prev))
    a = d.groupBy(*keys).agg(
        F.datediff(F.max("day"), F.min("day")).alias("m"),
        F.coalesce(F.sum("r"), F.lit(0.0)).alias("s1"), F.coalesce(F.sum(F.col("r") * F.col("r")), F.lit(0.0)).alias("s2"),
        F.count(F.when(F.col("r") < 0, 1)).alias("dn"), F.stddev_samp(F.when(F.col("r") < 0, F.col("r"))).alias("ds"),
    )
    m = F.col("m")
    mean = F.try_divide(F.col("s1"), m)
    var = F.try_divide(F.col("s2") - F.col("s1") * mean, m - 1)
    std = F.sqrt(F.greatest(var, F.lit(0.0)))
    enough = m >= 2

    def ratio(dev: Column, ok: Column) -> Column:
        return F.coalesce(F.when(enough & ok & (dev > 0), mean / F.nullif(dev, F.lit(0.0)) * F.lit(ROOT)), F.lit(0.0))

    return a.select(*keys, ratio(std, F.lit(True)).alias("sharpe"), ratio(F.col("ds"), F.col("dn") >= 2).alias("sortino"))


def max_drawdown(points: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Largest fall from the running peak; a peak at or below zero counts as none."""
    p = running(points, keys, pos_bucket(), ["pos"], {"peak": ("max", F.col("equity"))})
    dd = F.when(F.col("peak") > 0, F.try_divide(F.col("peak") - F.col("equity"), F.col("peak"))).otherwise(F.lit(0.0))
    return p.groupBy(*keys).agg(F.greatest(F.lit(0.0), F.max(dd)).alias("max_drawdown"))


def calmar(sharpe: Column, dd: Column) -> Column:
    """Sharpe over drawdown; 0 without a positive Sharpe or a drawdown."""
    return F.when((sharpe > 0) & (dd > 0), F.try_divide(sharpe, dd)).otherwise(F.lit(0.0))


def equity_statistics(points: DataFrame, keys: Sequence[str] = ("symbol",), order: str = "pos") -> DataFrame:
    points = settle(points)
    x = return_statistics(points, keys, order).join(max_drawdown(points, keys), list(keys))
    return x.withColumn("calmar", calmar(F.col("sharpe"), F.col("max_drawdown")))


def day_start_equity(curve: DataFrame, trades: DataFrame, keys: Sequence[str] = ("symbol",), start: float = 10_000.0) -> DataFrame:
    """Realised equity at the first bar of each UTC date, before that bar's exits."""
    first = curve.groupBy(*keys, F.to_date("time").alias("day")).agg(F.min("pos").alias("pos"))
    done = trades.select(*keys, F.col("exit_pos").alias("_x"), "profit")
    by_exit = done.groupBy(*keys, "_x").agg(F.sum("profit").alias("_p"))
    both = first.select(*keys, "pos", "day", F.lit(0).alias("_side"), F.lit(0.0).alias("_p")).unionByName(
        by_exit.select(*keys, F.col("_x").alias("pos"), F.lit(None).cast("date").alias("day"), F.lit(1).alias("_side"), "_p")
    )
    run = running(both, keys, pos_bucket(), ["pos", "_side"], {"_sum": ("sum", F.col("_p"))})
    return run.where(F.col("_side") == 0).select(*keys, "day", (F.lit(start) + F.coalesce("_sum", F.lit(0.0))).alias("day_start"))


def fold_summary(folds: DataFrame, keys: Sequence[str], min_trades: int = 0) -> DataFrame:
    """Mean scores, worst drawdown and trades over the folds of each key.

    Folds below 50 bars are skipped.  Too few trades per fold zero the scores.
    """
    used = folds.where(F.col("bars") >= MIN_FOLD_BARS)
    a = used.groupBy(*keys).agg(
        *[F.avg(c).alias(c) for c in ("sharpe", "sortino", "calmar", "win_rate")],
        F.max("max_drawdown").alias("max_drawdown"), F.sum("trades").alias("trades"), F.count(F.lit(1)).alias("n_folds"),
    )
    thin = (F.lit(min_trades) > 0) & (F.col("trades") / F.col("n_folds") < min_trades)
    scores = ("sharpe", "sortino", "calmar", "win_rate", "max_drawdown")
    return a.select(*keys, *[F.when(thin, F.lit(0.0)).otherwise(F.col(c)).alias(c) for c in scores], "trades", "n_folds")
