"""Walk-forward probabilities and the mixture regime."""

import numpy as np
import pandas as pd
import pytest

from conftest import walk
from tickloom.operators import models as M

WEEK = M.REFIT_SECONDS


@pytest.fixture(scope="module")
def outcomes_pd():
    g = np.random.default_rng(3)
    n = 240
    time = pd.Timestamp("2024-01-01") + pd.to_timedelta(np.sort(g.integers(0, 60 * 86_400, n)), unit="s")
    df = pd.DataFrame({"symbol": np.where(g.random(n) < 0.9, "A", "B"), "pos": np.arange(n), "time": time, "exit_time": time + pd.to_timedelta(g.integers(3600, 9 * 86_400, n), unit="s")})
    for f in M.FEATURES:
        df[f] = g.normal(size=n)
    df["label"] = (df["ret_1"] + 0.5 * g.normal(size=n) > 0).astype(int)
    return df


def periods(df):
    return df["time"].astype("int64") // 10**3 // (WEEK * 10**6) if df["time"].dtype == "datetime64[ns]" else df["time"].astype("datetime64[us]").astype("int64") // (WEEK * 10**6)


@pytest.mark.parametrize("boosted", [False, True])
def test_later_closes_do_not_change_a_score(spark, outcomes_pd, boosted):
    df = outcomes_pd
    got = M.profit_probability(spark.createDataFrame(df), boosted=boosted).toPandas().set_index("pos")
    start = pd.to_datetime(periods(df) * WEEK, unit="s")
    closed = [(df["exit_time"] <= s).sum() for s in start]
    assert got["n_train"].sort_index().tolist() == closed
    assert (got["prob"].sort_index().notna() == [c >= M.MIN_TRAIN for c in closed]).all()
    late = df.copy()
    cut = pd.Timestamp("2024-02-08")
    late.loc[late["exit_time"] > cut, "label"] = 1 - late["label"]
    again = M.profit_probability(spark.createDataFrame(late), boosted=boosted).toPandas().set_index("pos")
    safe = df.loc[start.to_numpy() <= cut, "pos"]
    pd.testing.assert_series_equal(got.loc[safe, "prob"], again.loc[safe, "prob"])
    scored = got.dropna(subset=["prob"])
    assert ((scored["prob"] > 0.5) == (scored["label"] == 1)).mean() > 0.7
    if not boosted:
        assert scored["gradient"].max() < 1e-6


def test_a_fit_uses_the_newest_rows_up_to_its_bound(spark, outcomes_pd):
    got = M.profit_probability(spark.createDataFrame(outcomes_pd), train_rows=25).toPandas()
    start = pd.to_datetime(periods(outcomes_pd) * WEEK, unit="s")
    assert got.set_index("pos")["n_train"].sort_index().tolist() == [min(25, (outcomes_pd["exit_time"] <= s).sum()) for s in start]


def em(x, steps=M.EM_STEPS):
    w, m0, m1, v0, v1 = 0.5, x.mean(), x.mean(), max(0.25 * x.var(), 1e-18), max(2 * x.var(), 1e-18)
    share = lambda: 1 / (1 + np.exp(np.minimum(-(x - m0) ** 2 / (2 * v0) - np.log(v0) / 2 + (x - m1) ** 2 / (2 * v1) + np.log(v1) / 2, 700)) * (1 - w) / w)
    for _ in range(steps):
        r = share()
        w, m0, m1 = r.mean(), ((1 - r) * x).sum() / (1 - r).sum(), (r * x).sum() / r.sum()
        v0, v1 = ((1 - r) * (x - m0) ** 2).sum() / (1 - r).sum(), (r * (x - m1) ** 2).sum() / r.sum()
    return ((share() > 0.5) == (v1 >= v0)).astype(int)


def test_mixture_is_fitted_per_series_and_short_ones_follow_the_volatility_rule(spark):
    loud, quiet, short = walk(160, 5, "LOUD"), walk(140, 6, "QUIET"), walk(30, 7, "SHORT")
    close = 1 + (loud["close"] - 1.1) * np.where(np.arange(160) > 80, 20, 1)
    loud["close"] = close
    bars = pd.concat([loud, quiet, short], ignore_index=True)
    got = M.mixture_regime(spark.createDataFrame(bars)).toPandas()
    assert len(got) == len(bars) and got["regime"].isin([0, 1]).all()
    for name, part in (("LOUD", loud), ("QUIET", quiet)):
        x = np.log(part["close"] / part["close"].shift(1)).fillna(0.0).to_numpy()
        assert got[got["symbol"] == name].sort_values("pos")["regime"].tolist() == em(x).tolist()
    x = np.log(short["close"] / short["close"].shift(1))
    vol = x.rolling(20).std()
    assert got[got["symbol"] == "SHORT"].sort_values("pos")["regime"].tolist() == (vol > vol.median()).astype(int).tolist()
    assert {"log_return", "regime"} <= set(M.mixture_regime(spark.createDataFrame(short)).columns)
