"""Indicators on bars: averages, bands, ranges, oscillators, pair statistics.

Bars are (keys..., time, open, high, low, close, volume).  All windows run on
position blocks with a halo, so one symbol is spread over many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bars import newest_rows
from .series import BUCKET_ROWS, Blocks, earlier_ranked, exact_median, longest_key, pos_bucket, recursive_means, scan_block, settle, time_bucket, with_position


def placed(bars: DataFrame, keys: Sequence[str] = ("symbol",), step_seconds: int = 3600,
           total: str | None = None) -> DataFrame:
    """Bars with their row number ``pos``; left alone when they already have one."""
    if "pos" in bars.columns and (total is None or total in bars.columns):
        return bars
    return with_position(bars, keys, ["time"], time_bucket("time", step_seconds), "pos", total)


def span_alpha(n: float) -> float:
    return 2.0 / (n + 1.0)


def true_range(b: Blocks) -> Column:
    prev = F.lag("close").over(b.w)
    hi, lo = F.col("high"), F.col("low")
    return F.greatest(F.abs(hi - lo), F.abs(hi - prev), F.abs(lo - prev))


def indicator_frame(
    bars: DataFrame,
    keys: Sequence[str] = ("symbol",),
    emas: Sequence[int] = (),
    atrs: Sequence[int] = (),
    rsis: Sequence[int] = (),
    bands: Sequence[tuple[int, float]] = (),
    returns: Sequence[int] = (),
    step_seconds: int = 3600,
    keep_history: int = 0,
    finish=None,
    block: int | None = None,
) -> DataFrame:
    """All requested indicators of a bar table over one exchange.

    Columns: ema_<n>, tr, atr_<n>, rsi_<n>, bb_mid_<n>, bb_std_<n>, ret_<n>.
    ``finish`` may add window columns on the same blocks, reaching back at most
    ``keep_history`` rows.  Blocks copy only the rows that bands, lags and ``finish``
    look back on; recursive averages begin with a composed carry.
    """
    alphas = [span_alpha(n) for n in emas] + [1.0 / n for n in (*atrs, *rsis)]
    longest = longest_key(bars, keys) if alphas else 0
    bars = placed(bars, keys, step_seconds)
    lookback = max([n for n, _ in bands] + list(returns) + [2])
    b = Blocks(bars, keys, lookback + 2 + keep_history, 0, block or scan_block(alphas, keep_history))
    df = b.df
    if atrs:
        df = df.withColumn("tr", true_range(b))
    if rsis:
        move = F.col("close") - F.lag("close").over(b.w)
        df = df.withColumn("_move", move)
        df = df.withColumn("_gain", F.greatest(F.col("_move"), F.lit(0.0)) + F.lit(0.0) * F.col("_move"))
        df = df.withColumn("_loss", F.greatest(-F.col("_move"), F.lit(0.0)) + F.lit(0.0) * F.col("_move"))
    means = {f"ema_{n}": (F.col("close"), span_alpha(n)) for n in emas}
    means |= {f"atr_{n}": (F.col("tr"), 1.0 / n) for n in atrs}
    means |= {f"_{side}_{n}": (F.col(f"_{move}"), 1.0 / n) for n in rsis for side, move in (("up", "gain"), ("down", "loss"))}
    if means:
        df = recursive_means(b, df, means, keep_history, longest)
    cols = []
    for n in sorted({n for n, _ in bands}):
        frame = b.rows(-(n - 1), 0)
        cols.append(b.full(F.avg("close").over(frame), n).alias(f"bb_mid_{n}"))
        cols.append(b.full(F.stddev_pop("close").over(frame), n).alias(f"bb_std_{n}"))
    for n in returns:
        past = F.lag("close", n).over(b.w)
        cols.append(F.when(past > 0, F.ln(F.try_divide(F.col("close"), past))).alias(f"_r_{n}"))
    df = df.select("*", *cols)
    for n in rsis:
        rs = F.try_divide(F.col(f"_up_{n}"), F.col(f"_down_{n}"))
        df = df.withColumn(f"rsi_{n}", F.lit(100.0) - F.lit(100.0) / (F.lit(1.0) + rs))
    for n in returns:
        df = df.withColumn(f"ret_{n}", F.coalesce(F.col(f"_r_{n}"), F.lit(0.0)))
    if finish is not None:
        df = finish(b, df)
    helpers = [c for c in df.columns if c.startswith("_") and c != "_blk"]
    return b.owned(df).drop(*helpers)


def ema(bars: DataFrame, n: int, keys: Sequence[str] = ("symbol",), step_seconds: int = 3600) -> DataFrame:
    return indicator_frame(bars, keys, emas=[n], step_seconds=step_seconds)


def atr(bars: DataFrame, n: int = 14, keys: Sequence[str] = ("symbol",), step_seconds: int = 3600) -> DataFrame:
    return indicator_frame(bars, keys, atrs=[n], step_seconds=step_seconds)


def rsi(bars: DataFrame, n: int = 14, keys: Sequence[str] = ("symbol",), step_seconds: int = 3600) -> DataFrame:
    return indicator_frame(bars, keys, rsis=[n], step_seconds=step_seconds)


def bollinger(bars: DataFrame, n: int = 20, k: float = 2.0, keys: Sequence[str] = ("symbol",), step_seconds: int = 3600) -> DataFrame:
    df = indicator_frame(bars, keys, bands=[(n, k)], step_seconds=step_seconds)
    mid, dev = F.col(f"bb_mid_{n}"), F.col(f"bb_std_{n}")
    return df.select(*bars.columns, "pos", mid.alias("bb_mid"), (mid + F.lit(k) * dev).alias("bb_upper"),
                     (mid - F.lit(k) * dev).alias("bb_lower"))


def percent_change(df: DataFrame, value: str, keys: Sequence[str], step_seconds: int = 86400,
                   name: str = "change") -> DataFrame:
    """Relative change to the previous row of the key."""
    b = Blocks(placed(df, keys, step_seconds), keys, 1)
    prev = F.lag(value).over(b.w)
    return b.owned(b.df.withColumn(name, F.try_divide(F.col(value) - prev, prev)))


def volatility_regime(bars: DataFrame, n: int = 20, mode: str = "global", keys: Sequence[str] = ("symbol",),
                      step_seconds: int = 3600) -> DataFrame:
    """1 where rolling volatility exceeds its median, else 0.

    ``global`` compares with the median of all rows of the key; ``expanding``
    with the median of the rows so far, which does not look ahead.
    """
    b = Blocks(placed(bars, keys, step_seconds), keys, n + 2)
    df = b.df.withColumn("_lr", F.ln(F.try_divide(F.col("close"), F.lag("close").over(b.w))))
    vol = F.when(F.col("pos") >= n, F.stddev_samp("_lr").over(b.rows(-(n - 1), 0)))
    df = b.owned(df.withColumn("vol", vol)).drop("_lr")
    df = settle(df)
    if mode == "global":
        med = exact_median(df, keys, "vol", "med")
        above = F.col("vol") > F.col("med")
        return df.join(med, list(keys), "left").withColumn("regime", F.when(above, 1).otherwise(0)).drop("med")
    # above the median of m values means at least ceil(m / 2) of them are smaller
    known = with_position(df.where(F.col("vol").isNotNull()), keys, ["pos"], pos_bucket(), "_m")
    v = F.col("vol")
    # an equal earlier value must not count as smaller: it gets the higher rank
    ranked = earlier_ranked(known, keys, [v, F.col("pos").desc()], "below", "sum", F.lit(1), "_less")
    ranked = ranked.select(*keys, "pos", "_m", F.coalesce("_less", F.lit(0)).alias("_less"))
    above = F.col("_less") >= F.ceil((F.col("_m") + 1) / F.lit(2))
    out = df.join(ranked, [*keys, "pos"], "left").withColumn("regime", F.when(above, 1).otherwise(0))
    return out.drop("_m", "_less")


def current_regime(bars: DataFrame, rows: int = 200, n: int = 20, keys: Sequence[str] = ("symbol",), step_seconds: int = 3600) -> DataFrame:
    """Label of the newest bar per key from its last ``rows`` bars; unknown below 30 bars."""
    df = settle(newest_rows(bars, rows, keys, step_seconds))
    df = volatility_regime(df, n, "global", keys, step_seconds)
    last = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("bars_used"), F.max_by("regime", "pos").alias("_last"))
    label = F.when(F.col("bars_used") < 30, F.lit("unknown")).when(F.col("_last") == 1, F.lit("range")).otherwise(F.lit("trend"))
    return last.select(*keys, "bars_used", label.alias("label"))


def correlation_factor(pair: DataFrame, n: int = 50, keys: Sequence[str] = (), step_seconds: int = 3600) -> DataFrame:
    """|correlation| of percent changes of close_1 and close_2 over the last n bars."""
    b = Blocks(placed(pair, keys, step_seconds), keys, n + 1)
    df = b.df
    for leg in ("close_1", "close_2"):
        prev = F.lag(leg).over(b.w)
        df = df.withColumn(f"_ch_{leg}", F.try_divide(F.col(leg) - prev, prev))
    frame = b.rows(-(n - 2), 0)
    a, c = F.stddev_samp("_ch_close_1").over(frame), F.stddev_samp("_ch_close_2").over(frame)
    rho = F.abs(F.corr("_ch_close_1", "_ch_close_2").over(frame))
    ok = (F.col("pos") >= n - 1) & (a > 0) & (c > 0)
    out = df.withColumn("rho", F.when(ok, rho).otherwise(F.lit(0.0)))
    return b.owned(out).drop("_ch_close_1", "_ch_close_2")


def join_legs(bars: DataFrame, first: str, second: str) -> DataFrame:
    """Two symbols of one bar table, joined on time."""
    lhs = bars.where(F.col("symbol") == first)
    rhs = bars.where(F.col("symbol") == second)
    cols = ("open", "high", "low", "close")
    return lhs.select("time", *[F.col(c).alias(f"{c}_1") for c in cols]).join(
        rhs.select("time", *[F.col(c).alias(f"{c}_2") for c in cols]), "time"
    )


def pair_statistics(pair: DataFrame, hedge: int = 60, spread: int = 60, atr_n: int = 14,
                    keys: Sequence[str] = (), step_seconds: int = 3600) -> DataFrame:
    """Hedge ratio, spread z-score, half-life, Dickey-Fuller t and short ATR per row.

    The whole window uses the row's own hedge ratio, so each statistic is written
    from rolling moments of the two legs instead of a second pass per row.
    """
    atr_rows = max(atr_n * 2, 20)
    b = Blocks(placed(pair, keys, step_seconds), keys, max(hedge, spread, atr_rows) + 2)
    df = b.df
    for leg in ("1", "2"):
        df = df.withColumn(f"_l{leg}", F.lag(f"close_{leg}").over(b.w))
        df = df.withColumn(f"_d{leg}", F.col(f"close_{leg}") - F.col(f"_l{leg}"))
    hi, lo, prev = F.col("high_1"), F.col("low_1"), F.col("_l1")
    df = df.withColumn("_tr", F.greatest(F.abs(hi - lo), F.abs(hi - prev), F.abs(lo - prev)))
    hw, sw, pw = b.rows(-(hedge - 1), 0), b.rows(-(spread - 1), 0), b.rows(-(spread - 2), 0)

    r = F.lit(1.0 - 1.0 / atr_n)
    k = b.offset.cast("double")
    recent = F.sum(F.col("_tr") * F.pow(r, -k)).over(b.rows(-(atr_rows - 2), 0)) * F.pow(r, k)
    seed = F.lag(hi - lo, atr_rows - 1).over(b.w)
    short_atr = recent * F.lit(1.0 / atr_n) + seed * F.pow(r, F.lit(atr_rows - 1.0))

    c1, c2 = F.col("close_1"), F.col("close_2")
    df = df.select(
        "*",
        short_atr.alias("_atr"),
        F.covar_samp(c2, c1).over(hw).alias("_hcov"), F.var_samp(c2).over(hw).alias("_hvar"),
        F.avg(c1).over(sw).alias("_m1"), F.avg(c2).over(sw).alias("_m2"),
        F.var_samp(c1).over(sw).alias("_v1"), F.var_samp(c2).over(sw).alias("_v2"),
        F.covar_samp(c1, c2).over(sw).alias("_c12"),
        F.var_samp("_l1").over(pw).alias("_vl1"), F.var_samp("_l2").over(pw).alias("_vl2"),
        F.covar_samp("_l1", "_l2").over(pw).alias("_cl"),
        F.covar_samp("_l1", "_d1").over(pw).alias("_c11"), F.covar_samp("_l1", "_d2").over(pw).alias("_c1d2"),
        F.covar_samp("_l2", "_d1").over(pw).alias("_c2d1"), F.covar_samp("_l2", "_d2").over(pw).alias("_c22"),
        F.var_samp("_d1").over(pw).alias("_vd1"), F.var_samp("_d2").over(pw).alias("_vd2"),
        F.covar_samp("_d1", "_d2").over(pw).alias("_cd"),
    )
    beta = F.when(F.col("_hvar") > 0, F.col("_hcov") / F.nullif(F.col("_hvar"), F.lit(0.0))).otherwise(F.lit(1.0))
    df = df.withColumn("beta", beta).withColumn("spread", c1 - F.col("beta") * c2)
    be = F.col("beta")
    var = F.col("_v1") + be * be * F.col("_v2") - F.lit(2.0) * be * F.col("_c12")
    z = F.try_divide(F.col("spread") - (F.col("_m1") - be * F.col("_m2")), F.sqrt(F.greatest(var, F.lit(0.0))))
    cov_ld = F.col("_c11") - be * F.col("_c1d2") - be * F.col("_c2d1") + be * be * F.col("_c22")
    var_l = F.col("_vl1") + be * be * F.col("_vl2") - F.lit(2.0) * be * F.col("_cl")
    var_d = F.col("_vd1") + be * be * F.col("_vd2") - F.lit(2.0) * be * F.col("_cd")
    phi = F.try_divide(cov_ld, F.when(var_l > 0, var_l))
    decays = (phi < 0) & (phi > -1)
    half = F.when(decays, F.lit(-math.log(2.0)) / F.ln(F.when(decays, F.lit(1.0) + phi)))
    m = float(spread - 1)
    rss = (var_d - phi * cov_ld) * F.lit(m - 1.0) / F.lit(m - 2.0)
    df_t = F.try_divide(phi, F.sqrt(F.try_divide(rss, F.when(var_l > 0, var_l) * F.lit(m - 1.0))))
    ready = F.col("pos") >= F.lit(max(hedge, spread) - 1)
    out = df.select(
        *[c for c in pair.columns if c != "pos"], "pos", "_blk",
        F.when(F.col("pos") >= hedge - 1, be).alias("beta"),
        F.when(ready, F.col("spread")).alias("spread"),
        F.when(ready, z).alias("zscore"),
        F.when(ready, half).alias("half_life"),
        (ready & half.isNotNull()).alias("reverts"),
        F.when(ready, df_t).alias("df_t"),
        F.col("_atr").alias("atr"),
    )
    return b.owned(out)


def rolling_spread(ticks: DataFrame, n: int = 20, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Mean spread of the last n ticks per symbol in arrival order, at every tick."""
    bucket = F.floor(F.col("seq") / F.lit(BUCKET_ROWS)).cast("long")
    b = Blocks(with_position(ticks, keys, ["seq"], bucket), keys, n)
    return b.owned(b.df.withColumn("avg_spread", F.avg("spread").over(b.rows(-(n - 1), 0))))


def features(bars: DataFrame, keys: Sequence[str] = ("symbol",), step_seconds: int = 3600) -> DataFrame:
    """The seven model features of each bar; values that do not exist are 0."""
    bars = settle(placed(bars, keys, step_seconds))
    f = indicator_frame(bars, keys, emas=[12, 26], atrs=[14], rsis=[14], returns=[1, 5, 20], step_seconds=step_seconds)
    g = volatility_regime(bars, 20, "expanding", keys, step_seconds).select(*keys, "pos", "regime")
    c = F.col("close")

    def safe(x: Column) -> Column:
        return F.coalesce(F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x), F.lit(0.0))

    return f.join(g, [*keys, "pos"]).select(
        *keys, "pos", "time",
        safe(F.col("ret_1")).alias("ret_1"), safe(F.col("ret_5")).alias("ret_5"), safe(F.col("ret_20")).alias("ret_20"),
        safe(F.try_divide(F.col("atr_14"), c)).alias("atr_norm"),
        # no losses reads as relative strength 0 here; the strategy reads it as RSI 50
        safe(F.col("rsi_14") / F.lit(100.0)).alias("rsi_norm"),
        safe(F.try_divide(F.col("ema_12") - F.col("ema_26"), c)).alias("ema_spread"),
        F.col("regime").cast("double").alias("regime"),
    )
