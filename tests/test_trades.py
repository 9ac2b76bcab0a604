import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.operators import experiments as X
from tickloom.operators import series as Q
from tickloom.operators import trades as R
from tickloom.operators.accounts import account_state, account_verdicts, STATE_SCHEMA
from tickloom.operators.experiments import flat_runs, pareto_front, quiet_iterations, with_running_dsr

SCHEMA = "ticket long, symbol string, type string, open_time timestamp, close_time timestamp, profit double, open_price double, sl double, tp double"


def journal(spark, profits, closed=True):
    rows = []
    for i, p in enumerate(profits):
        at = pd.Timestamp("2026-01-01") + pd.Timedelta(days=i)
        rows.append((i, "EURUSD", "BUY", at.to_pydatetime(), (at + pd.Timedelta(hours=1)).to_pydatetime() if closed else None, float(p), 1.1, 1.09, 1.12))
    return spark.createDataFrame(rows, SCHEMA)


def test_equity_series_case(spark):
    e = R.equity_series(journal(spark, [10, 5, -10])).orderBy("close_time").toPandas()
    assert e.equity.tolist() == [10, 15, 5] and e.peak.tolist() == [10, 15, 15]
    assert e.drawdown.iloc[-1] == pytest.approx(10 / 15)


def test_expectancy_case(spark):
    s = R.statistics(journal(spark, [10, 10, -5, -5])).first()
    assert s.payoff_ratio == pytest.approx(2.0) and s.expectancy == pytest.approx(2.5) and s.avg_r_multiple == pytest.approx(0.5)
    assert s.profit_factor == pytest.approx(2.0) and s.win_rate == 0.5


def test_small_and_one_sided_journals(spark):
    one = R.statistics(journal(spark, [10])).first()
    assert one.trade_count == 1 and one.win_rate == 0.0 and one.profit_factor == 0.0
    won = R.statistics(journal(spark, [10, 20])).first()
    assert won.no_losses and won.profit_factor is None
    empty = R.statistics(journal(spark, [1]).limit(0))
    assert empty.count() in (0, 1)


def test_review_weighs_break_evens_as_losses(spark):
    v = R.review(journal(spark, [10, 0, -4])).first()
    assert v.expectancy == pytest.approx(10 / 3 + 2 / 3 * -4)


def test_streaks_and_breakers(spark):
    t = journal(spark, [5, -1, -1, 0, -1, -1, -1, -1, -1])
    m = R.max_loss_streak(t).first()
    assert (m.max_streak, m.current_streak) == (5, 5)
    b = R.breakers(t).orderBy("ticket").toPandas()
    assert b.reason.tolist()[-1] == "consecutive_losses" and b.reason.tolist()[0] == "ok"
    loss = R.breakers(journal(spark, [-300])).first()
    assert loss.reason == "daily_loss_limit" and loss.day_start == 10_000


def test_blank_close_times_are_open(spark):
    df = spark.createDataFrame([(1, "2026-01-01"), (2, "  "), (3, None)], "ticket long, close_time string")
    assert [r.ticket for r in R.closed_trades(df).collect()] == [1]


def test_kelly_uses_only_earlier_closes(spark):
    k = R.kelly_at_entry(journal(spark, [100, -50] * 20)).orderBy("ticket").toPandas()
    assert k.history.tolist() == list(range(40))
    assert (k.kelly[:30] == 0.25).all() and (k.kelly[30:] <= 0.25).all()


def test_account_state_carries_over_batches(spark):
    rows = [(1, (pd.Timestamp("2026-01-01") + pd.Timedelta(hours=i)).to_pydatetime(), e, s, f) for i, (e, s, f) in enumerate(
        [(10_000.0, 0, True), (12_000.0, 0, True), (9_000.0, 0, True), (11_900.0, 5, True), (1.0, 0, False), (11_950.0, 6, True)])]
    df = spark.createDataFrame(rows, "account long, time timestamp, equity double, streak int, fresh boolean")
    none = spark.createDataFrame([], STATE_SCHEMA)
    whole = account_verdicts(df, none).orderBy("time").toPandas()
    assert whole.reason.tolist() == ["ok", "ok", "trailing_dd_halt", "consecutive_losses", "skipped", "consecutive_losses"]
    cut = F.lit("2026-01-01 03:00:00").cast("timestamp")
    first = account_verdicts(df.where(F.col("time") < cut), none)
    second = account_verdicts(df.where(F.col("time") >= cut), account_state(first, none)).orderBy("time").toPandas()
    cols = ["reason", "peak", "day_start", "cooling_until"]
    pd.testing.assert_frame_equal(second[cols], whole[cols].iloc[3:].reset_index(drop=True))


def test_log_checks(spark):
    log = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate([1, 2] + [2.001] * 9)], "strategy string, iteration long, sharpe double")
    f = flat_runs(log).first()
    assert f.flat_run == 9 and f.stalled
    its = spark.createDataFrame([(i, 1 if i == 5 else 0) for i in range(10)], "id long, combos_promoted long")
    assert quiet_iterations(its).first().quiet == 4
    dsr = with_running_dsr(log, ["strategy"]).orderBy("iteration").toPandas().dsr_so_far
    assert dsr[0] == 1.0 and dsr[1] == pytest.approx(2 - (1.5 + 0.5 ** 0.5 * 0.5641895835))


def test_pareto_front_keeps_equal_points(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0, 1.0), (2, 1.0, 1.0, 1.0), (3, 0.5, 1.0, 1.0), (4, 0.5, 0.5, 0.5), (5, 2.0, 3.0, 0.1)], "id long, sharpe double, max_dd double, win_rate double")
    assert sorted(r.id for r in pareto_front(df).collect()) == [1, 2, 4, 5]


def test_running_moments_of_large_values_do_not_cancel(spark, monkeypatch):
    monkeypatch.setattr(Q, "RANGE_ROWS", 40)
    g = np.random.default_rng(8)
    values = 1e6 + g.normal(0, 1e-3, 400)
    rows = [("a", i * 86_400_000_000, None if i % 9 == 4 else float(v)) for i, v in enumerate(values)] + [("b", 5, 2.0), ("b", 7, None)]
    df = spark.createDataFrame(rows, "k string, iteration long, sharpe double").repartition(4)
    got = X.running_moments(df, ["k"], "iteration", F.col("sharpe")).toPandas().sort_values(["k", "iteration"])
    own = got[got.k == "a"]
    x = pd.Series([r[2] for r in rows if r[0] == "a"], dtype=float)
    assert own["_n"].tolist() == x.notna().cumsum().tolist()
    want = x.expanding().apply(lambda v: np.var(v[~np.isnan(v)] - 1e6, ddof=1), raw=True)
    got_var = (own["_m2"] / (own["_n"] - 1)).to_numpy()
    np.testing.assert_allclose(got_var[5:], want.to_numpy()[5:], rtol=1e-6)
    assert got[got.k == "b"]["_m"].tolist() == [2.0, 2.0]
