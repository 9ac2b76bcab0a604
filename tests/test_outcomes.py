import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import walk
from tickloom.operators import equity as E
from tickloom.operators import outcomes as O
from tickloom.operators import sweep as S
from tickloom.operators.series import settle
from tickloom.operators.signals import ema_cross, mean_reversion, trend_following


def test_first_touch_matches_brute_force_on_a_deep_tree(spark, monkeypatch):
    monkeypatch.setattr(O, "FAN", 4)
    pdf = walk(300, 21)
    bars = O.mark_positions(spark.createDataFrame(pdf))
    g = np.random.default_rng(2)
    pts = pd.DataFrame({"symbol": "EURUSD", "start": g.integers(0, 300, 60)})
    pts["down"] = 1.10 - g.uniform(0, 0.02, 60)
    pts["up"] = 1.10 + g.uniform(0, 0.02, 60)
    got = O.first_touch(spark.createDataFrame(pts), bars, ["symbol"], "start", "down", "up").toPandas()
    for row in got.itertuples():
        hit = np.flatnonzero((pdf.low[row.start:] <= row.down) | (pdf.high[row.start:] >= row.up))
        assert (np.isnan(row.touch_pos) and not len(hit)) or row.touch_pos == row.start + hit[0]


@pytest.mark.parametrize("island_rows", [2048, 2])
def test_one_at_a_time_is_the_greedy_choice(spark, island_rows):
    g = np.random.default_rng(4)
    rows = []
    for k in ("a", "b"):
        start = np.sort(g.choice(2000, 150, replace=False))
        rows.append(pd.DataFrame({"k": k, "pos": start, "exit_pos": start + g.integers(1, 90, 150)}))
    pdf = pd.concat(rows, ignore_index=True)
    got = O.one_at_a_time(spark.createDataFrame(pdf), ["k"], island_rows=island_rows).toPandas()
    for k, p in pdf.groupby("k"):
        free, want = -1, []
        for row in p.itertuples():
            if row.pos >= free:
                want.append(row.pos)
                free = row.exit_pos
        assert sorted(got[got.k == k].pos) == want


def simulate(pdf, signals, start=10_000.0, warmup=26):
    """Bar loop used as the yardstick: one position, stop before target, marked every bar."""
    by_pos = {s.pos: s for s in signals.itertuples()}
    cash, pos, trades, curve = start, None, [], []
    n = len(pdf)
    pnl = lambda p, x: (1 if p["side"] == "BUY" else -1) * (x - p["entry"]) / 0.0001

    def close(i, price, reason):
        nonlocal cash, pos
        profit = pnl(pos, price) - 1.0 - (0.5 if reason == "sl_hit" else 0.0)
        cash += profit
        trades.append((pos["at"], i, reason, profit))
        pos = None

    for i in range(warmup, n - 1):
        bar = pdf.iloc[i]
        if pos is not None:
            buy = pos["side"] == "BUY"
            if (bar.low <= pos["sl"]) if buy else (bar.high >= pos["sl"]):
                close(i, pos["sl"], "sl_hit")
            elif (bar.high >= pos["tp"]) if buy else (bar.low <= pos["tp"]):
                close(i, pos["tp"], "tp_hit")
        if pos is None and i in by_pos:
            s = by_pos[i]
            half = 0.00005 if s.action == "BUY" else -0.00005
            pos = {"side": s.action, "entry": pdf.open[i + 1] + half, "sl": s.sl, "tp": s.tp, "at": i}
        curve.append(cash + (pnl(pos, bar.close) if pos is not None else 0.0))
    if pos is not None:
        close(n - 1, pdf.close[n - 1], "end_of_series")
        curve.append(cash)
    return trades, curve


def test_trades_and_equity_equal_a_bar_loop(spark):
    pdf = walk(500, 0)
    bars = O.mark_positions(spark.createDataFrame(pdf))
    sig = ema_cross(bars, fast=3, slow=8).where((F.col("pos") >= 26) & (F.col("action") != "HOLD"))
    trades = O.label_signals(sig, bars)
    want, curve = simulate(pdf, sig.toPandas())
    got = trades.orderBy("pos").toPandas()
    assert [(r.pos, r.exit_pos, r.reason) for r in got.itertuples()] == [w[:3] for w in want] and len(want) > 5
    np.testing.assert_allclose(got.profit, [w[3] for w in want], atol=1e-9)
    eq = O.equity_curve(trades, bars, warmup=26).orderBy("pos").toPandas().equity
    np.testing.assert_allclose(eq, curve, atol=1e-7)


def points(spark, values, start="2024-01-01"):
    pdf = pd.DataFrame({"symbol": "A", "pos": range(len(values)), "time": pd.date_range(start, periods=len(values), freq="D"), "equity": [float(v) for v in values]})
    return spark.createDataFrame(pdf)


def test_equity_statistics_cases(spark):
    fall = E.equity_statistics(points(spark, [5000, 5000, 4500, 4000, 4000])).first()
    assert fall.max_drawdown == pytest.approx(0.20) and fall.sharpe < 0 and fall.calmar == 0.0
    flat = E.equity_statistics(points(spark, [10000] * 30)).first()
    assert (flat.sharpe, flat.sortino, flat.max_drawdown) == (0.0, 0.0, 0.0)


def test_daily_equity_repeats_missing_days(spark):
    pdf = pd.DataFrame({"symbol": "A", "pos": [0, 1, 2], "time": pd.to_datetime(["2024-01-05 10:00", "2024-01-05 20:00", "2024-01-08 01:00"]), "equity": [1.0, 2.0, 3.0]})
    got = E.daily_equity(spark.createDataFrame(pdf)).orderBy("day").toPandas()
    assert got.equity.tolist() == [2.0, 2.0, 2.0, 3.0]


def test_fold_summary_zeroes_thin_results(spark):
    df = spark.createDataFrame([(1, 100, 1.0, 1.0, 1.0, 0.5, 0.1, 2), (1, 100, 3.0, 1.0, 1.0, 0.7, 0.3, 2), (1, 40, 9.0, 9.0, 9.0, 0.9, 0.9, 9)],
                               "param_id long, bars long, sharpe double, sortino double, calmar double, win_rate double, max_drawdown double, trades long")
    full = E.fold_summary(df, ["param_id"]).first()
    assert (full.sharpe, full.max_drawdown, full.trades, full.n_folds) == (2.0, 0.3, 4, 2)
    assert E.fold_summary(df, ["param_id"], min_trades=3).first().sharpe == 0.0


def test_sweep_agrees_with_a_bar_loop_per_fold(spark):
    pdf = walk(600, 8)
    params = S.grid({"ema_fast": [3], "ema_slow": [8, 12]})
    bars = spark.createDataFrame(pdf)
    series = S.folds_of(bars, 3, 5)
    keys = ["symbol", "fold"]
    cells = S.fold_scores(O.label_signals(S.grid_signals(series, "ema_crossover", params, keys), series, keys, ["param_id"]), series, params, "ema_crossover").toPandas()
    for fold in range(3):
        part = pdf.iloc[fold * 200:(fold + 1) * 200].reset_index(drop=True)
        for p in params:
            warm = S.warmup_of("ema_crossover", p)
            sig = ema_cross(O.mark_positions(spark.createDataFrame(part)), 3, int(p["ema_slow"]))
            sig = sig.where((F.col("pos") >= warm) & (F.col("action") != "HOLD")).toPandas()
            trades, curve = simulate(part, sig, warmup=warm)
            cell = cells[(cells.fold == fold) & (cells.param_id == p["param_id"])].iloc[0]
            eq = pd.Series(curve, index=part.time[warm:warm + len(curve)])
            ret = eq.resample("1D").last().ffill().pct_change().dropna()
            assert cell.trades == len(trades)
            assert cell.sharpe == pytest.approx(ret.mean() / ret.std() * np.sqrt(252) if ret.std() else 0.0, abs=1e-6)
            assert cell.max_drawdown == pytest.approx(((eq.cummax() - eq) / eq.cummax()).max(), abs=1e-9)


def test_a_grid_of_thousands_of_sets_has_a_small_plan(spark, bars):
    space = {"ema_fast": list(range(3, 13)), "ema_slow": [13, 18, 21, 26, 30], "atr_multiplier": [1.0, 1.5, 2.0, 2.5, 3.0, 3.5, 4.0, 4.5], "atr_tp_multiplier": [2.0, 2.5, 3.0, 3.5, 4.0]}
    sets = S.grid(space)
    assert len(sets) == 2000
    series = settle(O.mark_positions(bars))
    df = S.grid_signals(series, "ema_crossover", sets, ["symbol"])
    small = S.grid_signals(series, "ema_crossover", sets[:1990:40], ["symbol"])
    lines = lambda d: d._jdf.queryExecution().analyzed().toString().count("\n")
    assert lines(df) <= lines(small) + 2
    got = df.groupBy("param_id").count().toPandas().set_index("param_id")["count"]
    one = ema_cross(series, 5, 21, stop=2.0).where("action <> 'HOLD' AND pos >= 26").select("symbol", "pos", "action", "sl", "tp").toPandas()
    k = next(p["param_id"] for p in sets if p["ema_fast"] == 5 and p["ema_slow"] == 21 and p["atr_multiplier"] == 2.0 and p["atr_tp_multiplier"] == 3.0)
    mine = df.where(f"param_id = {k}").select("symbol", "pos", "action", "sl", "tp").toPandas()
    by = ["symbol", "pos"]
    pd.testing.assert_frame_equal(mine.sort_values(by, ignore_index=True), one.sort_values(by, ignore_index=True))
    assert len(got) > 1500


def test_reversion_sets_equal_the_strategy(spark, bars):
    series = settle(O.mark_positions(bars))
    sets = S.grid({"bb_period": [15, 20], "bb_std": [1.5, 2.0], "rsi_period": [7, 14], "rsi_os": [40.0], "rsi_ob": [60.0]})
    df = S.grid_signals(series, "mean_reversion", sets, ["symbol"]).toPandas()
    for p in sets:
        n, rs = p["bb_period"], p["rsi_period"]
        want = mean_reversion(series, n, p["bb_std"], rs, 40.0, 60.0).where(f"action <> 'HOLD' AND pos >= {max(n, rs, 14) + 5}").select("symbol", "pos", "action", "sl", "tp").toPandas()
        mine = df[df.param_id == p["param_id"]][["symbol", "pos", "action", "sl", "tp"]]
        pd.testing.assert_frame_equal(mine.sort_values(["symbol", "pos"], ignore_index=True), want.sort_values(["symbol", "pos"], ignore_index=True))


def test_trend_sets_are_told_apart_and_checked(spark, bars):
    with pytest.raises(ValueError, match="tp_r_multiple"):
        S.grid_signals(bars, "trend_following", [{"param_id": 0, "tp_r_multiple": 0.5}], ["symbol"])
    with pytest.raises(ValueError, match="no sweep"):
        S.grid_signals(bars, "pairs", [{"param_id": 0}], ["symbol"])
    series = settle(O.mark_positions(bars))
    sets = S.grid({"tp_r_multiple": [1.5, 3.0], "swing_left": [2, 3]})
    df = S.grid_signals(series, "trend_following", sets, ["symbol"]).toPandas()
    for p in sets:
        want = trend_following(series, left=p["swing_left"], r_target=p["tp_r_multiple"]).where("action <> 'HOLD' AND pos >= 50").select("symbol", "pos", "action", "sl", "tp").toPandas()
        mine = df[df.param_id == p["param_id"]][["symbol", "pos", "action", "sl", "tp"]]
        pd.testing.assert_frame_equal(mine.sort_values(["symbol", "pos"], ignore_index=True), want.sort_values(["symbol", "pos"], ignore_index=True))
