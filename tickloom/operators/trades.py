"""Trade journals: splits, equity, streaks, statistics, breakdowns, size history.

Journal order is (close_time, ticket).  A whole journal is one series without a
key and any hour of it may be crowded, so ordered values run over range buckets
of that order and never over one global window.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores, sizing
from ..functions.clock import day_name, session_label
from .series import ranged, running, settle, with_position

ORDER = ("close_time", "ticket")
START_EQUITY = 10_000.0


def _seq(time: str = "close_time", ticket: str = "ticket") -> Column:
    return F.struct(F.col(time).alias("t"), F.col(ticket).alias("k"))


def is_closed(trades: DataFrame) -> Column:
    """Closed when close_time holds anything but blanks."""
    c = F.col("close_time")
    if trades.schema["close_time"].dataType.typeName() == "string":
        return c.isNotNull() & (F.trim(c) != "")
    return c.isNotNull()


def closed_trades(trades: DataFrame) -> DataFrame:
    return trades.where(is_closed(trades))


def open_trades(trades: DataFrame) -> DataFrame:
    return trades.where(~is_closed(trades))


def list_trades(trades: DataFrame, side: str = "ALL", symbol: str | None = None, limit: int = 100) -> DataFrame:
    """The newest closed trades of a side and symbol, oldest first."""
    out = closed_trades(trades)
    if (side or "ALL").upper() in ("BUY", "SELL"):
        out = out.where(F.upper("type") == side.upper())
    if symbol:
        out = out.where(F.upper("symbol") == symbol.upper())
    newest = out.orderBy(F.desc("close_time"), F.desc("ticket")).limit(limit)
    return newest.orderBy("close_time", "ticket")


def recent(trades: DataFrame, days: int, as_of) -> DataFrame:
    cut = F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(days))
    return trades.where(F.col("open_time") >= cut)


def loss_alerts(trades: DataFrame, usd: float) -> DataFrame:
    """Closed results worse than the threshold; unreadable profits raise nothing."""
    return trades.where(F.col("profit").try_cast("double") < F.lit(-usd))


def equity_series(trades: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Running profit, peak and drawdown in close order; drawdown base is max(|peak|, 1)."""
    rows = closed_trades(trades).select(*keys, "ticket", "close_time", F.coalesce("profit", F.lit(0.0)).alias("profit"))
    df = ranged(rows, keys, ORDER)
    df = settle(running(df, keys, F.col("_rb"), ORDER, {"equity": ("sum", F.col("profit"))}))
    df = running(df, keys, F.col("_rb"), ORDER, {"peak": ("max", F.col("equity"))}).drop("_rb")
    gap = (F.col("peak") - F.col("equity")) / F.greatest(F.abs("peak"), F.lit(1.0))
    return df.withColumn("drawdown", F.greatest(gap, F.lit(0.0)))


def loss_streaks(trades: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Losses in a row up to and including each closed trade."""
    df = ranged(closed_trades(trades).select(*keys, "ticket", "close_time", "profit"), keys, ORDER)
    df = settle(with_position(df, keys, ORDER, F.col("_rb")))
    stop = F.when(F.coalesce(F.col("profit") >= 0, F.lit(True)), F.col("pos"))
    df = running(df, keys, F.col("_rb"), ORDER, {"_stop": ("max", stop)})
    return df.withColumn("streak", F.col("pos") - F.coalesce("_stop", F.lit(-1))).drop("_stop", "_rb")


def max_loss_streak(trades: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    s = loss_streaks(trades, keys)
    return s.groupBy(*keys).agg(F.max("streak").alias("max_streak"), F.max_by("streak", _seq()).alias("current_streak"))


def _win(p: Column) -> Column:
    return F.when(p > 0, p)


def _loss(p: Column) -> Column:
    return F.when(p < 0, -p)


def daily_sharpe(trades: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Sharpe of profits summed by close date (open date when not closed); per trade below two days."""
    p = F.coalesce("profit", F.lit(0.0))
    day = F.to_date(F.coalesce("close_time", "open_time"))
    dated = trades.select(*keys, day.alias("_day"), p.alias("_p"))
    daily = dated.groupBy(*keys, "_day").agg(
        F.sum("_p").alias("_d"), F.count(F.lit(1)).alias("_n"), F.sum(F.col("_p") * F.col("_p")).alias("_sq")
    )
    d = F.when(F.col("_day").isNotNull(), F.col("_d"))
    a = daily.groupBy(*keys).agg(
        F.count(d).alias("days"), F.avg(d).alias("_m"), F.stddev_samp(d).alias("_s"),
        F.sum("_n").alias("_n"), F.sum("_d").alias("_sum"), F.sum("_sq").alias("_sq"),
    )
    mean = F.try_divide(F.col("_sum"), F.col("_n"))
    var = F.try_divide(F.col("_sq") - F.col("_sum") * mean, F.col("_n") - 1)
    m = F.when(F.col("days") >= 2, F.col("_m")).otherwise(mean)
    s = F.when(F.col("days") >= 2, F.col("_s")).otherwise(F.sqrt(F.greatest(var, F.lit(0.0))))
    ratio = F.when((F.col("_n") >= 2) & (s > 0), m / F.nullif(s, F.lit(0.0)) * F.lit(math.sqrt(scores.ANNUAL_DAYS)))
    return a.select(*keys, "days", F.coalesce(ratio, F.lit(0.0)).alias("sharpe"))


def statistics(trades: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Count, win rate, profit factor, payoff, expectancy, R and drawdown of closed trades.

    All are 0 below two trades.  A profit factor without losses has no value; the
    flag ``no_losses`` tells it from a missing one.
    """
    closed = closed_trades(trades)
    p = F.coalesce("profit", F.lit(0.0))
    a = closed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("trade_count"),
        F.count(_win(p)).alias("_w"), F.count(_loss(p)).alias("_l"),
        F.coalesce(F.sum(_win(p)), F.lit(0.0)).alias("_sw"), F.coalesce(F.sum(_loss(p)), F.lit(0.0)).alias("_sl"),
    )
    eq = equity_series(closed, keys)
    base = F.when(F.abs("peak") > 1e-9, F.abs("peak")).otherwise(F.lit(1.0))
    dd = eq.groupBy(*keys).agg(F.max((F.col("peak") - F.col("equity")) / base).alias("_dd"))
    sharpe = daily_sharpe(closed, keys)
    if keys:
        a = a.join(dd, list(keys)).join(sharpe, list(keys))
    else:
        a = a.crossJoin(F.broadcast(dd)).crossJoin(F.broadcast(sharpe))  # one row each
    n, w, lo, sw, sl = (F.col(c) for c in ("trade_count", "_w", "_l", "_sw", "_sl"))
    rate = F.try_divide(w, n)
    avg_w, avg_l = F.coalesce(F.try_divide(sw, w), F.lit(0.0)), F.coalesce(F.try_divide(sl, lo), F.lit(0.0))
    expectancy = rate * avg_w - (F.lit(1.0) - rate) * avg_l
    few = n < 2

    def guard(x: Column) -> Column:
        return F.when(few, F.lit(0.0)).otherwise(F.coalesce(x, F.lit(0.0)))

    return a.select(
        *keys, "trade_count",
        guard(F.col("sharpe")).alias("sharpe"),
        guard(F.greatest(F.lit(0.0), F.col("_dd"))).alias("max_drawdown"),
        guard(rate).alias("win_rate"),
        F.when(few, F.lit(0.0)).when(sl > 0, sw / F.nullif(sl, F.lit(0.0))).when(sw == 0, F.lit(0.0)).alias("profit_factor"),
        (~few & (sl == 0) & (sw > 0)).alias("no_losses"),
        guard(F.when((w > 0) & (lo > 0), F.try_divide(avg_w, avg_l))).alias("payoff_ratio"),
        guard(expectancy).alias("expectancy"),
        guard(F.when(avg_l > 0, F.try_divide(expectancy, avg_l))).alias("avg_r_multiple"),
    )


def review(trades: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Headline numbers of a review; break-even trades weigh on the loss side."""
    p = F.col("profit")
    closed = closed_trades(trades).where(p.isNotNull())
    a = closed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("trades"), F.sum(p).alias("total_pnl"), F.count(_win(p)).alias("_w"),
        F.avg(_win(p)).alias("_aw"), F.avg(F.when(p < 0, p)).alias("_al"),
        F.sum(_win(p)).alias("_sw"), F.sum(_loss(p)).alias("_sl"),
        F.max(p).alias("largest_win"), F.min(p).alias("largest_loss"),
        F.avg(F.when(F.abs(F.col("open_price") - F.col("sl")) > 0,
                     F.try_divide(F.abs(F.col("tp") - F.col("open_price")), F.abs(F.col("open_price") - F.col("sl"))))).alias("avg_expected_rr"),
    )
    rate = F.col("_w") / F.col("trades")
    aw, al = F.coalesce("_aw", F.lit(0.0)), F.coalesce("_al", F.lit(0.0))
    return a.select(
        *keys, "trades", rate.alias("win_rate"), "total_pnl",
        F.try_divide(F.coalesce("_sw", F.lit(0.0)), F.nullif(F.col("_sl"), F.lit(0.0))).alias("profit_factor"),
        F.col("_sl").isNull().alias("no_losses"),
        (rate * aw + (F.lit(1.0) - rate) * al).alias("expectancy"),
        aw.alias("avg_win"), al.alias("avg_loss"),
        F.coalesce(F.abs(F.try_divide(aw, al)), F.lit(0.0)).alias("realised_rr"),
        "largest_win", "largest_loss", "avg_expected_rr",
    )


def breakdown(trades: DataFrame) -> DataFrame:
    """Trades, win rate and profit by weekday, session and symbol in one pass over the journal."""
    closed = closed_trades(trades).where(F.col("profit").isNotNull())
    tagged = closed.select(
        "profit",
        F.explode(F.array(
            F.struct(F.lit("weekday").alias("by"), day_name(F.col("open_time")).alias("value")),
            F.struct(F.lit("session").alias("by"), session_label(F.col("open_time")).alias("value")),
            F.struct(F.lit("symbol").alias("by"), F.col("symbol").alias("value")),
        )).alias("g"),
    )
    return tagged.groupBy(F.col("g.by").alias("by"), F.col("g.value").alias("value")).agg(
        F.count(F.lit(1)).alias("trades"),
        F.avg(F.when(F.col("profit") > 0, 1.0).otherwise(0.0)).alias("win_rate"),
        F.sum("profit").alias("pnl"),
    )


def extremes(trades: DataFrame, n: int = 5, newest: int = 10) -> DataFrame:
    """Worst and best trades by profit and the newest by close time, each with its rank."""
    closed = closed_trades(trades).where(F.col("profit").isNotNull())

    def top(name: str, order: list, k: int) -> DataFrame:
        best = closed.orderBy(*order).limit(k)
        rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order))  # k rows only
        return best.select(F.lit(name).alias("list"), rank.cast("long").alias("rank"), "ticket", "symbol", "type", "profit", "open_time", "close_time")

    return (
        top("worst", [F.asc("profit"), F.asc("ticket")], n)
        .unionByName(top("best", [F.desc("profit"), F.asc("ticket")], n))
        .unionByName(top("newest", [F.desc("close_time"), F.desc("ticket")], newest))
    )


def kelly_at_entry(trades: DataFrame, keys: Sequence[str] = (), fraction: float = sizing.KELLY_DEFAULT) -> DataFrame:
    """Size multiplier of each entry from the trades closed by then."""
    p = F.coalesce("profit", F.lit(0.0))
    closes = closed_trades(trades).select(*keys, F.col("close_time").alias("_t"), F.lit(0).alias("_side"), "ticket", p.alias("_p"))
    entries = trades.select(*keys, F.col("open_time").alias("_t"), F.lit(1).alias("_side"), "ticket", F.lit(None).cast("double").alias("_p"))
    x, one = F.col("_p"), F.lit(1)
    specs = {
        "_n": ("sum", F.when(x.isNotNull(), one)), "_w": ("sum", F.when(x > 0, one)), "_l": ("sum", F.when(x < 0, one)),
        "_sw": ("sum", _win(x)), "_sl": ("sum", _loss(x)),
    }
    order = ["_t", "_side", "ticket"]
    both = running(ranged(closes.unionByName(entries), keys, order), keys, F.col("_rb"), order, specs)
    z = {c: F.coalesce(F.col(c), F.lit(0)) for c in specs}
    mult = sizing.kelly_multiplier(z["_n"], z["_w"], z["_l"], z["_sw"], z["_sl"], fraction)
    return both.where(F.col("_side") == 1).select(*keys, "ticket", F.col("_t").alias("open_time"), z["_n"].cast("long").alias("history"), mult.alias("kelly"))


def breakers(trades: DataFrame, start: float = START_EQUITY, keys: Sequence[str] = ()) -> DataFrame:
    """Circuit breaker after each closed trade, with the equity it was judged on."""
    rows = closed_trades(trades).select(*keys, "ticket", "close_time", "profit", F.coalesce("profit", F.lit(0.0)).alias("_p"))
    df = with_position(ranged(rows, keys, ORDER), keys, ORDER, F.col("_rb"))  # one range sort carries equity, peak and streak
    stop = F.when(F.coalesce(F.col("profit") >= 0, F.lit(True)), F.col("pos"))
    df = settle(running(df, keys, F.col("_rb"), ORDER, {"equity": ("sum", F.col("_p")), "_stop": ("max", stop)}))
    df = running(df, keys, F.col("_rb"), ORDER, {"peak": ("max", F.col("equity"))})
    eq = settle(df.select(*keys, "ticket", "close_time", F.col("_p").alias("profit"), (F.col("equity") + F.lit(start)).alias("equity"), F.greatest(F.col("peak") + F.lit(start), F.lit(start)).alias("peak"),
                          (F.col("pos") - F.coalesce("_stop", F.lit(-1))).alias("streak"), F.to_date("close_time").alias("_day")))
    days = eq.groupBy(*keys, "_day").agg(F.sum("profit").alias("_d"))
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select(*keys, "_day", (F.coalesce(F.sum("_d").over(before), F.lit(0.0)) + F.lit(start)).alias("day_start"))  # one row per day
    df = eq.join(days, [*keys, "_day"])
    reason = sizing.breaker(F.col("equity"), F.col("peak"), F.col("day_start"), F.col("streak"))
    return df.select(*keys, "ticket", "close_time", "equity", "peak", "day_start", "streak", reason.alias("reason"))


def journal_metrics(trades: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The statistics of the closed trades and ``dsr``, the probability that their true Sharpe is above 0."""
    return statistics(trades, keys).withColumn("dsr", scores.probabilistic_sharpe(F.col("sharpe"), F.col("trade_count")))


def log_delta(trades: DataFrame, last_count: int, checks: dict[str, Column]) -> DataFrame:
    """Row count now against the last count, and the names of the failing checks.

    A check is a condition on aggregates of the log; one without a value has failed.
    """
    n = trades.agg(F.count(F.lit(1)).alias("trade_count"), *[F.coalesce(ok, F.lit(False)).alias(name) for name, ok in checks.items()])
    alerts = F.array_compact(F.array(*[F.when(~F.col(name), F.lit(name)) for name in checks]))
    return n.select("trade_count", (F.col("trade_count") - F.lit(last_count)).alias("delta"), alerts.alias("alerts"))
