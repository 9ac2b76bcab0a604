import numpy as np
import pandas as pd
import pytest

from conftest import walk
from tickloom.operators import structure as S
from tickloom.operators.indicators import pair_statistics
from tickloom.operators.signals import run_strategy, trend_following


def swing_flags(v, left, right):
    n = len(v)
    return np.array([left <= i < n - right and v[i] > max(v[i - left:i]) and v[i] > max(v[i + 1:i + 1 + right]) for i in range(n)])


def label(high, low, left=2, right=2):
    h, lo = high[swing_flags(high, left, right)], low[swing_flags(-low, left, right)]
    if len(h) < 2 or len(lo) < 2:
        return "range"
    if h[-1] > h[-2] and lo[-1] > lo[-2]:
        return "uptrend"
    return "downtrend" if h[-1] < h[-2] and lo[-1] < lo[-2] else "range"


def prefix_break(pdf, i, left, right):
    p = pdf.iloc[: i + 1]
    hi = np.flatnonzero(swing_flags(p.high.to_numpy(), left, right))
    lo = np.flatnonzero(swing_flags(-p.low.to_numpy(), left, right))
    best = None
    for k in range(1, i + 1):
        up, down = hi[hi < k], lo[lo < k]
        if len(up) and p.close[k] > p.high[up[-1]]:
            best = (k, "bullish", p.high[up[-1]])
        elif len(down) and p.close[k] < p.low[down[-1]]:
            best = (k, "bearish", p.low[down[-1]])
    return best


def test_swing_high_fixture(spark):
    highs = [2.1, 2.4, 2.3, 2.6, 2.9, 2.7, 2.2, 2.5, 2.35]
    pdf = pd.DataFrame({"symbol": "A", "time": pd.date_range("2024-01-01", periods=9, freq="15min"), "open": highs, "high": highs, "low": [h - 0.01 for h in highs], "close": highs, "volume": 100})
    got = S.swings(spark.createDataFrame(pdf), step_seconds=900).orderBy("time").toPandas()
    assert got.swing_high[4] and not got.swing_high[0] and not got.swing_high[8]
    with pytest.raises(ValueError):
        S.swings(spark.createDataFrame(pdf), left=0)


@pytest.mark.parametrize("left,right", [(2, 2), (1, 1), (2, 3)])
def test_break_of_structure_equals_every_prefix(spark, left, right):
    pdf = walk(90, 11)
    got = S.structure_as_of(spark.createDataFrame(pdf), left, right).orderBy("time").toPandas()
    for i in range(len(pdf)):
        want = prefix_break(pdf, i, left, right)
        row = got.iloc[i]
        if want is None:
            assert row.bos_direction is None
        else:
            assert (row.bos_pos, row.bos_direction) == want[:2] and row.bos_level == pytest.approx(want[2])


def test_higher_bias_equals_every_prefix(spark):
    pdf = walk(400, 3, step="15min")
    got = S.higher_bias(spark.createDataFrame(pdf), 3600, step_seconds=900).orderBy("time").toPandas()
    for i in range(0, 400, 7):
        htf = pdf.iloc[: i + 1].set_index("time").resample("1h").agg({"high": "max", "low": "min"}).dropna()
        h, lo = htf.high.to_numpy(), htf.low.to_numpy()
        bias = label(h, lo)
        prior = [label(h[:c], lo[:c]) for c in range(max(5, len(h) - 10), len(h))]
        opposite = {"uptrend": "downtrend", "downtrend": "uptrend"}.get(bias)
        assert got.htf_bias[i] == bias and got.htf_rows[i] == len(h)
        assert bool(got.reversal[i]) == (opposite in prior)


def test_pair_statistics_equal_the_direct_window(spark):
    g = np.random.default_rng(0)
    b = 1.2 + np.cumsum(g.normal(0, 0.001, 200))
    s = np.zeros(200)
    for i in range(1, 200):
        s[i] = 0.9 * s[i - 1] + g.normal(0, 0.0005)
    a = 0.3 + 0.8 * b + s
    pdf = pd.DataFrame({"time": pd.date_range("2024-01-01", periods=200, freq="h"), **{f"{c}_1": a for c in ("open", "close")}, "high_1": a + 0.001, "low_1": a - 0.001,
                        **{f"{c}_2": b for c in ("open", "high", "low", "close")}})
    got = pair_statistics(spark.createDataFrame(pdf)).orderBy("time").toPandas()
    for i in (59, 100, 199):
        y, x = a[i - 59:i + 1], b[i - 59:i + 1]
        beta = np.cov(x, y)[0, 1] / np.var(x, ddof=1)
        spd = y - beta * x
        lag, d = spd[:-1], np.diff(spd)
        phi = np.cov(lag, d)[0, 1] / np.var(lag, ddof=1)
        assert got.beta[i] == pytest.approx(beta) and got.zscore[i] == pytest.approx((spd[-1] - spd.mean()) / spd.std(ddof=1))
        assert got.half_life[i] == pytest.approx(-np.log(2) / np.log(1 + phi))


def test_trend_following_agrees_with_its_bias(spark):
    pdf = walk(200, 0, step="15min")
    pdf[["open", "high", "low", "close"]] += (np.arange(200) * 0.0006)[:, None]
    got = trend_following(spark.createDataFrame(pdf), 3600, step_seconds=900).toPandas()
    buys, sells = got[got.action == "BUY"], got[got.action == "SELL"]
    assert (buys.sl < buys.entry_price).all() and (buys.tp > buys.entry_price).all() and (buys.htf_bias == "uptrend").all()
    assert (sells.htf_bias == "downtrend").all()
    with pytest.raises(ValueError):
        trend_following(spark.createDataFrame(pdf), r_target=0.5)


def test_unknown_strategy_falls_back_to_the_cross(spark, bars):
    got = run_strategy("no_such", bars).select("reason").distinct().toPandas().reason.tolist()
    assert set(got) <= {"insufficient_bars", "no_cross", "fast_ema_crossed_above_slow", "fast_ema_crossed_below_slow"}
