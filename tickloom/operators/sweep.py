"""Parameter sweeps: all combinations, symbols and folds in one job.

Indicators are computed once per distinct period; a bar never gets copied per
parameter set.  Sets are rows of a table that only bars that act are joined with.
"""

from __future__ import annotations

import functools
import itertools
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores
from .bars import fold_bars
from .equity import fold_summary, max_drawdown, return_statistics, calmar
from .experiments import across_symbols, with_global_dsr
from .indicators import indicator_frame
from .outcomes import equity_points, label_signals
from .series import settle
from .signals import FALLBACK_FAST, FALLBACK_SLOW, GO, bracket, trend_bracket, trend_setups

ATR_N = 14
WARMUP_EXTRA = 5


def grid(space: dict[str, Sequence[float]]) -> list[dict]:
    """Every combination of the values, numbered; the list lives on the driver and is short."""
    names = list(space)
    return [dict(zip(names, values), param_id=i) for i, values in enumerate(itertools.product(*space.values()))]


def folds_of(bars: DataFrame, folds: int, embargo: int, keys: Sequence[str] = ("symbol",), step_seconds: int = 3600) -> DataFrame:
    """Bars of the test folds, each fold a series of its own with positions from 0."""
    f = fold_bars(bars, folds, embargo, keys, step_seconds).where(F.col("fold").isNotNull())
    return f.withColumn("pos", F.col("pos") - F.col("test_start")).withColumn("n_rows", F.col("test_end") - F.col("test_start")).drop(
        "test_start", "test_end"
    )


def _crosses(bars: DataFrame, keys: list[str], actions: list[tuple]) -> tuple[DataFrame, tuple]:
    """Bars with the averages of all spans as one array and the row before's; what an action key says of a bar."""
    spans = sorted({n for pair in actions for n in pair})
    place = {n: i for i, n in enumerate(spans)}

    def finish(b, df):
        df = df.withColumn("now", F.array(*[F.col(f"ema_{n}") for n in spans]))
        return df.withColumn("was", F.lag("now").over(b.w))

    df = indicator_frame(bars, keys, emas=spans, atrs=[ATR_N], keep_history=1, finish=finish)

    def says(k: Column) -> Column:
        gap = F.get("now", k["a"]) - F.get("now", k["b"])
        before = F.get("was", k["a"]) - F.get("was", k["b"])
        return F.when((before <= 0) & (gap > 0), F.lit("BUY")).when((before >= 0) & (gap < 0), F.lit("SELL"))

    return df, ([{"a": place[f], "b": place[s]} for f, s in actions], "a:int,b:int", says)


def _reversions(bars: DataFrame, keys: list[str], actions: list[tuple]) -> tuple[DataFrame, tuple]:
    """Bars with the middles, deviations and oscillators of all periods as arrays; what an action key says of a bar."""
    bands, rsis = sorted({a[0] for a in actions}), sorted({a[2] for a in actions})
    df = indicator_frame(bars, keys, atrs=[ATR_N], rsis=rsis, bands=[(n, 0.0) for n in bands])
    df = df.withColumns({"mid": F.array(*[F.col(f"bb_mid_{n}") for n in bands]), "dev": F.array(*[F.col(f"bb_std_{n}") for n in bands]),
                         "osc": F.array(*[F.coalesce(F.col(f"rsi_{n}"), F.lit(50.0)) for n in rsis])})

    def says(k: Column) -> Column:
        close, mid, wide, rsi = F.col("close"), F.get("mid", k["b"]), k["k"] * F.get("dev", k["b"]), F.get("osc", k["o"])
        buy = (close <= F.coalesce(mid - wide, close)) & (rsi < k["low"])
        sell = (close >= F.coalesce(mid + wide, close)) & (rsi > k["high"])
        return F.when(buy, F.lit("BUY")).when(sell, F.lit("SELL"))

    return df, ([{"b": bands.index(n), "k": k, "o": rsis.index(o), "low": low, "high": high} for n, k, o, low, high in actions],
                "b:int,k:double,o:int,low:double,high:double", says)


def action_key(strategy: str, p: dict) -> tuple:
    """What of a parameter set decides the action; stops and targets do not."""
    if strategy == "ema_crossover":
        pair = int(p["ema_fast"]), int(p["ema_slow"])
        return pair if pair[0] < pair[1] else (FALLBACK_FAST, FALLBACK_SLOW)
    if strategy == "mean_reversion":
        return (int(p.get("bb_period", 20)), float(p.get("bb_std", 2.0)), int(p.get("rsi_period", 14)), float(p.get("rsi_os", 30.0)), float(p.get("rsi_ob", 70.0)))
    if strategy == "trend_following":
        return (int(p.get("htf_seconds", 14_400)), int(p.get("swing_left", 2)), int(p.get("swing_right", 2)), int(p.get("atr_period", 14)),
                int(p.get("reversal_lookback", 10)), str(p.get("mode", "standard")))
    raise ValueError(f"no sweep for strategy {strategy!r}")


def set_table(spark: SparkSession, strategy: str, params: list[dict]) -> DataFrame:
    """The parameter sets as rows: param_id, action_id, warmup, stop, target, buffer."""
    ids = {k: i for i, k in enumerate(sorted({action_key(strategy, p) for p in params}))}
    trend = strategy == "trend_following"
    if trend and any(float(p.get("tp_r_multiple", 1.5)) < 1.0 for p in params):
        raise ValueError("tp_r_multiple must be >= 1.0")
    stop, target, buffer = ("atr_sl_multiplier", "tp_r_multiple", "sl_atr_buffer") if trend else ("atr_multiplier", "atr_tp_multiplier", "")
    wide = {"ema_crossover": 3.0, "mean_reversion": 2.0, "trend_following": 1.5}[strategy]
    rows = [(int(p["param_id"]), ids[action_key(strategy, p)], warmup_of(strategy, p), float(p.get(stop, 1.5)), float(p.get(target, wide)), float(p.get(buffer, 1.0)))
            for p in params]
    return spark.createDataFrame(rows, "param_id long, action_id int, warmup long, stop double, target double, buffer double")


def grid_signals(bars: DataFrame, strategy: str, params: list[dict], keys: Sequence[str]) -> DataFrame:
    """Signals of all parameter sets: keys, pos, n_rows, time, param_id, action, sl, tp, atr.

    The plan does not grow with the number of sets.  What decides an action is told apart
    from stops and targets: the bars that act are found once per distinct action key,
    keys being a constant array that a bar is tested against in place, and then joined
    with the rows of the parameter sets.
    """
    keys = list(keys)
    actions = sorted({action_key(strategy, p) for p in params})
    table = F.broadcast(set_table(bars.sparkSession, strategy, params))  # the list of sets, from the driver
    if strategy == "trend_following":
        parts = []
        for i, (seconds, left, right, atr_n, lookback, mode) in enumerate(actions):  # one pass per reading of the structure
            found = trend_setups(bars, seconds, left, right, atr_n, lookback, mode, keys).where(F.col("setup") == GO)
            parts.append(found.select(*keys, "pos", "n_rows", "time", "close", "atr", "known_low", "known_high", "bos_direction", F.lit(i).alias("action_id")))
        hits = functools.reduce(DataFrame.unionByName, parts).join(table, "action_id").where(F.col("pos") >= F.col("warmup"))
        bullish = F.col("bos_direction") == "bullish"
        sl, tp, risk = trend_bracket(bullish, F.col("stop"), F.col("buffer"), F.col("target"))
        return hits.where(risk > 0).select(*keys, "pos", "n_rows", "time", "param_id", F.when(bullish, F.lit("BUY")).otherwise(F.lit("SELL")).alias("action"),
                                           sl.alias("sl"), tp.alias("tp"), "atr")
    df, (constants, shape, says) = {"ema_crossover": _crosses, "mean_reversion": _reversions}[strategy](bars, keys, actions)
    listed = F.from_json(F.lit(json.dumps([{**c, "id": i} for i, c in enumerate(constants)])), f"array<struct<id:int,{shape}>>")
    told = F.filter(F.transform(listed, lambda k: F.struct(k["id"].alias("action_id"), says(k).alias("action"))), lambda x: x["action"].isNotNull())
    hits = df.select(*keys, "pos", "n_rows", "time", "close", F.coalesce(f"atr_{ATR_N}", F.lit(0.0)).alias("atr"), F.explode(told).alias("_s"))
    hits = hits.select("*", "_s.*").drop("_s").join(table, "action_id").where(F.col("pos") >= F.col("warmup"))
    sl, tp = bracket(F.col("action"), F.col("close"), F.col("atr"), F.col("stop"), F.col("target"))
    return hits.select(*keys, "pos", "n_rows", "time", "param_id", "action", sl.alias("sl"), tp.alias("tp"), "atr")


TREND_WARMUP = 50


def warmup_of(strategy: str, p: dict) -> int:
    key = action_key(strategy, p)
    if strategy == "trend_following":
        return TREND_WARMUP
    return (max(key[1], ATR_N) if strategy == "ema_crossover" else max(key[0], key[2], ATR_N)) + WARMUP_EXTRA


def fold_scores(trades: DataFrame, bars: DataFrame, params: list[dict], strategy: str, keys: Sequence[str] = ("symbol", "fold"),
                start: float = 10_000.0) -> DataFrame:
    """Score of every parameter set on every series, also where it never traded."""
    keys = list(keys)
    full = [*keys, "param_id"]
    table = set_table(bars.sparkSession, strategy, params).select("param_id", "warmup")
    ends = bars.groupBy(*keys).agg(F.max("n_rows").alias("bars"))
    cells = ends.crossJoin(F.broadcast(table))  # series x parameter sets; the sets are a short driver list
    # the first marked bar and the last but one frame the days of a series
    edges = cells.where(F.col("bars") >= F.col("warmup") + 2).select(*full, "bars", F.explode(F.array(
        F.struct(F.col("warmup").alias("pos"), F.lit(0).alias("late")), F.struct((F.col("bars") - 2).alias("pos"), F.lit(1).alias("late"))
    )).alias("_e")).select(*full, F.col("_e.pos").alias("pos"), F.col("_e.late").alias("late"))
    times = bars.select(*keys, "pos", "time")
    trades = settle(trades)
    totals = trades.groupBy(*full).agg(
        F.sum("profit").alias("_total"), F.count(F.lit(1)).alias("trades"), F.count_if(F.col("profit") > 0).alias("_wins"), F.min("pos").alias("_first"),
    )
    edges = edges.join(times, [*keys, "pos"]).join(totals, full, "left")
    idle = F.coalesce(F.col("_first") > F.col("pos"), F.lit(True))
    edges = edges.where((F.col("late") == 1) | idle).select(
        *full, "pos", "time", (F.lit(start) + F.when(F.col("late") == 1, F.coalesce("_total", F.lit(0.0))).otherwise(F.lit(0.0))).alias("equity"),
        (F.col("pos") - F.lit(0.5)).alias("order"),
    )
    pts = equity_points(trades, bars, keys, ["param_id"], start).select(*full, "pos", "time", "equity", F.col("pos").cast("double").alias("order"))
    # a closing edge under an open position is not a point of the curve
    curve = settle(pts.unionByName(edges))
    rets = return_statistics(curve, full, "order")
    dds = max_drawdown(settle(curve.groupBy(*full, "pos").agg(F.max_by("equity", "order").alias("equity"))), full)
    out = cells.join(rets, full, "left").join(dds, full, "left").join(totals, full, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return out.select(
        *full, "bars", zero("sharpe").alias("sharpe"), zero("sortino").alias("sortino"), zero("max_drawdown").alias("max_drawdown"),
        calmar(zero("sharpe"), zero("max_drawdown")).alias("calmar"),
        F.coalesce(F.try_divide(F.col("_wins"), F.col("trades")), F.lit(0.0)).alias("win_rate"),
        F.coalesce("trades", F.lit(0)).cast("long").alias("trades"),
    )


def sweep(bars: DataFrame, strategy: str, params: list[dict], folds: int = 5, embargo: int = 24, min_trades: int = 0,
          volume: float = 0.1, gate=None, step_seconds: int = 3600) -> DataFrame:
    """Scoreboard: per parameter set the mean over folds and symbols, guard, and deflated Sharpe.

    ``gate`` is an optional DataFrame -> DataFrame filter on signals (sessions,
    news, regime); it blocks entries only.
    """
    series = settle(folds_of(bars, folds, embargo, step_seconds=step_seconds))
    keys = ["symbol", "fold"]
    signals = grid_signals(series, strategy, params, keys)
    if gate is not None:
        signals = gate(signals)
    trades = label_signals(settle(signals), series, keys, ["param_id"], volume)
    cells = fold_scores(trades, series, params, strategy, keys)
    per_symbol = fold_summary(cells, ["symbol", "param_id"], min_trades)
    floor = scores.WIN_FLOOR_REVERSION if strategy == "mean_reversion" else scores.WIN_FLOOR
    failed = scores.guard_reasons(F.col("sharpe"), F.col("max_drawdown"), F.col("win_rate"), win_floor=floor)
    per_symbol = per_symbol.withColumn("guard_pass", F.size(failed) == 0).withColumnRenamed("max_drawdown", "max_dd")
    board = across_symbols(per_symbol, ["param_id"])
    traded = per_symbol.groupBy("param_id").agg(F.sum("trades").alias("trades"))
    return with_global_dsr(board.join(traded, "param_id"))
