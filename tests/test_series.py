import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.operators import indicators as I
from tickloom.operators import series as Q


def frame(spark, n=300, seed=1):
    g = np.random.default_rng(seed)
    pdf = pd.DataFrame({"k": g.choice(["a", "a", "b"], n), "t": np.arange(n), "x": g.integers(0, 40, n).astype(float)})
    pdf.loc[g.random(n) < 0.2, "x"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    return df, pdf


def test_positions_and_running_values_match_pandas(spark):
    df, pdf = frame(spark)
    bucket = F.floor(F.col("t") / 7).cast("long")
    got = Q.with_position(df, ["k"], ["t"], bucket, "pos", "total")
    got = Q.running(got, ["k"], bucket, ["t"], {"s": ("sum", F.col("x")), "m": ("max", F.col("x")), "w": ("min", F.col("x")), "l": ("last", F.col("x"))}, seq=F.col("t"))
    got = got.toPandas().sort_values("t").reset_index(drop=True)
    by = pdf.groupby("k")["x"]
    assert (got["pos"] == pdf.groupby("k").cumcount()).all() and (got["total"] == pdf.groupby("k")["t"].transform("count")).all()
    pd.testing.assert_series_equal(got["l"], by.ffill(), check_names=False)
    pd.testing.assert_series_equal(got["m"], by.cummax().groupby(pdf["k"]).ffill(), check_names=False)
    pd.testing.assert_series_equal(got["w"], by.cummin().groupby(pdf["k"]).ffill(), check_names=False)
    pd.testing.assert_series_equal(got["s"], by.cumsum().groupby(pdf["k"]).ffill(), check_names=False)


def test_asof_takes_the_last_row_at_or_before(spark):
    g = np.random.default_rng(3)
    left = pd.DataFrame({"k": 1, "at": np.sort(g.integers(0, 500, 80)), "id": np.arange(80)})
    right = pd.DataFrame({"k": 1, "at": np.sort(g.choice(500, 25, replace=False)), "v": np.arange(25)})
    got = Q.asof_last(spark.createDataFrame(left), spark.createDataFrame(right), ["k"], "at", ["v"], 16)
    got = got.select("id", F.col("hit.v").alias("v")).toPandas().sort_values("id")
    want = pd.merge_asof(left, right, on="at", by="k")
    np.testing.assert_array_equal(got["v"].to_numpy(float), want["v"].to_numpy(float))


def test_earlier_ranked_matches_brute_force_over_several_levels(spark):
    df, pdf = frame(spark, 200, 5)
    base = df.where(F.col("x").isNotNull())
    base = Q.with_position(base, ["k"], ["t"], F.floor(F.col("t") / 50).cast("long"))
    order = [F.col("x"), F.col("pos").desc()]
    less = Q.earlier_ranked(base, ["k"], order, "below", "sum", F.lit(1), "less", leaf_rows=3)
    low = Q.earlier_ranked(base, ["k"], order, "above", "min", F.col("t"), "low", leaf_rows=3).select("t", "low")
    got = less.join(low, "t").toPandas()
    for row in got.itertuples():
        past = pdf[(pdf.k == row.k) & (pdf.t < row.t)].dropna()
        assert (0 if np.isnan(row.less) else row.less) == (past.x < row.x).sum()
        higher = past[past.x >= row.x]
        assert (np.isnan(row.low) and higher.empty) or row.low == higher.t.min()


def test_decayed_means_match_the_recursion_across_blocks(spark):
    g = np.random.default_rng(9)
    n = 6000
    close = 1.1 + np.cumsum(g.normal(0, 0.0005, n))
    pdf = pd.DataFrame({"symbol": "A", "time": pd.date_range("2020-01-01", periods=n, freq="h"), "open": close, "high": close + 0.001, "low": close - 0.001, "close": close, "volume": 1})
    got = I.indicator_frame(spark.createDataFrame(pdf), emas=[2, 9, 50, 300], atrs=[14], rsis=[14]).toPandas().sort_values("time").reset_index(drop=True)
    for span in (2, 9, 50, 300):
        np.testing.assert_allclose(got[f"ema_{span}"], pdf.close.ewm(span=span, adjust=False).mean(), rtol=1e-12)
    move = pdf.close.diff()
    up, down = (m.ewm(alpha=1 / 14, adjust=False).mean() for m in (move.clip(lower=0), (-move).clip(lower=0)))
    np.testing.assert_allclose(got["rsi_14"][1:], (100 - 100 / (1 + up / down.replace(0, np.nan)))[1:], rtol=1e-9)


def walked(n, keys):
    g = np.random.default_rng(n)
    close = 1.1 + np.cumsum(g.normal(0, 0.0005, n))
    return pd.DataFrame({"symbol": g.choice(keys, n), "time": pd.date_range("2020-01-01", periods=n, freq="h"), "open": close, "high": close + 0.001, "low": close - 0.001, "close": close, "volume": 1})


@pytest.mark.parametrize("block", [16, 64])
def test_averages_are_the_same_whatever_the_block(spark, monkeypatch, block):
    monkeypatch.setattr(Q.recursive_means, "__defaults__", (3,))  # blocks to a fold: several levels of the tree
    pdf = walked(1500, ["A", "A", "B"])
    def marks(b, df):
        return df.withColumn("was", F.lag("ema_300").over(b.w))

    got = I.indicator_frame(spark.createDataFrame(pdf), emas=[2, 9, 300], atrs=[14], rsis=[14], bands=[(20, 2.0)], keep_history=3, finish=marks, block=block).toPandas()
    for key, own in pdf.groupby("symbol"):
        mine = got[got.symbol == key].sort_values("time").reset_index(drop=True)
        for span in (2, 9, 300):
            np.testing.assert_allclose(mine[f"ema_{span}"], own.close.ewm(span=span, adjust=False).mean(), rtol=1e-12)
        np.testing.assert_allclose(mine["was"][1:], own.close.ewm(span=300, adjust=False).mean()[:-1], rtol=1e-12)
        move = own.close.diff()
        up, down = (m.ewm(alpha=1 / 14, adjust=False).mean() for m in (move.clip(lower=0), (-move).clip(lower=0)))
        np.testing.assert_allclose(mine["rsi_14"][1:], (100 - 100 / (1 + up / down.replace(0, np.nan)))[1:], rtol=1e-9)


def test_nulls_keep_the_average_where_it_is(spark):
    g = np.random.default_rng(4)
    x = [None] * 70 + [None if g.random() < 0.3 else float(v) for v in g.normal(size=600)]
    x[200:350] = [None] * 150  # longer than a block
    rows = [("k", i, v) for i, v in enumerate(x)] + [("empty", i, None) for i in range(90)] + [("one", 0, 5.0)]
    df = spark.createDataFrame(rows, "k string, pos long, x double")
    for alpha in (0.1, 2 / 3, 1.0):
        got = {(r.k, r.pos): r.y for r in Q.recursive_mean(df, ["k"], "x", alpha, "y", block=32).collect()}
        y = None
        for i, v in enumerate(x):
            y = y if v is None else v if y is None else alpha * v + (1 - alpha) * y
            assert (got["k", i] is None) == (y is None) and (y is None or abs(got["k", i] - y) < 1e-12)
        assert got["one", 0] == 5.0 and all(got["empty", i] is None for i in range(90)) and len(got) == len(rows)


def test_spans_far_apart_copy_few_rows(spark, monkeypatch):
    pdf = walked(9000, ["A"])
    seen = {}

    def copies(b, df):
        seen["b"] = b
        return df

    I.indicator_frame(spark.createDataFrame(pdf), emas=[2, 300], finish=copies)
    assert seen["b"].df.count() < 1.1 * len(pdf)


def test_results_do_not_depend_on_partition_count(spark, bars):
    def run(parts):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        out = I.bollinger(bars).orderBy("symbol", "time").toPandas()
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        return out

    pd.testing.assert_frame_equal(run(1), run(8))


def test_expanding_regime_equals_the_prefix_median(spark, bars, bars_pd):
    got = I.volatility_regime(bars, mode="expanding").toPandas()
    for sym, pdf in bars_pd.groupby("symbol"):
        vol = np.log(pdf.close / pdf.close.shift(1)).rolling(20).std()
        want = (vol > vol.expanding().median()).astype(int).tolist()
        assert got[got.symbol == sym].sort_values("time")["regime"].tolist() == want


def test_range_buckets_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(Q, "RANGE_ROWS", 100)
    df = spark.range(3000).selectExpr("CASE WHEN id % 10 = 0 THEN 'b' ELSE 'a' END AS k", "id % 7 AS v", "id")
    got = Q.ranged(df, ["k"], ["v", "id"]).groupBy("_rb").count().toPandas()
    assert len(got) > 30 and got["count"].max() < 300 and got["count"].sum() == 3000
    placed = Q.with_position(Q.ranged(df, ["k"], ["v", "id"]), ["k"], ["v", "id"], F.col("_rb")).orderBy("k", "pos").toPandas()
    assert placed["pos"].tolist() == [*range(2700), *range(300)]
