"""Queries on indicators, structure and signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import indicators as I
from ..operators import signals as G
from ..operators import structure as S
from ..operators.series import recursive_mean
from ..sources import tables as T
from .registry import ORACLES, BARS, POS, TICKS, hourly, query, r


def decay(x: str, alpha: str, order: str = "pos") -> str:
    """Recursive average in SQL: a fold over the list of all values so far."""
    return (f"list_reduce(list({x}) OVER (PARTITION BY symbol ORDER BY {order} "
            f"ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), lambda a, v: (1.0::DOUBLE - {alpha}) * a + {alpha} * v)")


A9, A21, A12, A26, A14 = "(0.2::DOUBLE)", "(2.0::DOUBLE / 22.0)", "(2.0::DOUBLE / 13.0)", "(2.0::DOUBLE / 27.0)", "(1.0::DOUBLE / 14.0)"

TR = f"""{POS}, t AS (
  SELECT *, greatest(abs(high - low), abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr,
    close - lag(close) OVER w AS move FROM b WINDOW w AS (PARTITION BY symbol ORDER BY pos))"""
IND = f"""{TR}, u AS (SELECT *, greatest(move, 0) AS gain, greatest(-move, 0) AS loss FROM t),
i AS (
  SELECT *, {decay("close", A9)} AS ema_9, {decay("close", A21)} AS ema_21, {decay("close", A12)} AS ema_12,
    {decay("close", A26)} AS ema_26, {decay("tr", A14)} AS atr_14, avg(close) OVER w20 AS m20, stddev_pop(close) OVER w20 AS s20
  FROM u WINDOW w20 AS (PARTITION BY symbol ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
g AS (SELECT symbol, pos, {decay("gain", A14)} AS up, {decay("loss", A14)} AS down FROM u WHERE pos > 0),
f AS (SELECT i.*, CASE WHEN i.pos >= 19 THEN m20 END AS mid, CASE WHEN i.pos >= 19 THEN s20 END AS dev,
  CASE WHEN down > 0 THEN 100.0 - 100.0 / (1.0 + up / down) END AS rsi_14
  FROM i LEFT JOIN g ON i.symbol = g.symbol AND i.pos = g.pos)"""


@query("band_breaks", f"""{IND} SELECT symbol, time, close, round(mid + 2.0 * dev, 8) AS bb_upper, round(mid - 2.0 * dev, 8) AS bb_lower,
  CASE WHEN close > mid + 2.0 * dev THEN 'above' ELSE 'below' END AS side
FROM f WHERE close > mid + 2.0 * dev OR close < mid - 2.0 * dev""")
def band_breaks(spark, folder):
    b = I.bollinger(hourly(spark, folder))
    above, below = F.col("close") > F.col("bb_upper"), F.col("close") < F.col("bb_lower")
    return b.where(above | below).select(
        "symbol", "time", "close", r("bb_upper"), r("bb_lower"), F.when(above, F.lit("above")).otherwise(F.lit("below")).alias("side")
    )


@query("ema", f"{POS} SELECT symbol, time, close, round({decay('close', A9)}, 8) AS ema_9, round({decay('close', A21)}, 8) AS ema_21 FROM b")
def ema(spark, folder):
    return I.indicator_frame(hourly(spark, folder), emas=[9, 21]).select("symbol", "time", "close", r("ema_9"), r("ema_21"))


@query("wilder_average", f"{POS} SELECT symbol, time, round({decay('close', A14)}, 8) AS wilder_14 FROM b")
def wilder_average(spark, folder):
    df = recursive_mean(I.placed(hourly(spark, folder)), ["symbol"], "close", 1 / 14, "wilder_14")
    return df.select("symbol", "time", r("wilder_14"))


@query("true_range_atr", f"{TR} SELECT symbol, time, round(tr, 8) AS tr, round({decay('tr', A14)}, 8) AS atr FROM t")
def true_range_atr(spark, folder):
    return I.atr(hourly(spark, folder)).select("symbol", "time", r("tr"), r("atr_14", name="atr"))


@query("rsi", f"{IND} SELECT symbol, time, round(rsi_14, 6) AS rsi FROM f")
def rsi(spark, folder):
    return I.rsi(hourly(spark, folder)).select("symbol", "time", r("rsi_14", 6, "rsi"))


@query("bollinger", f"""{IND} SELECT symbol, time, round(mid, 8) AS bb_mid, round(mid + 2.0 * dev, 8) AS bb_upper,
  round(mid - 2.0 * dev, 8) AS bb_lower FROM f""")
def bollinger(spark, folder):
    return I.bollinger(hourly(spark, folder)).select("symbol", "time", r("bb_mid"), r("bb_upper"), r("bb_lower"))


@query("log_returns", f"""{POS} SELECT symbol, time, round(coalesce(ln(close / lag(close, 1) OVER w), 0), 8) AS ret_1,
  round(coalesce(ln(close / lag(close, 5) OVER w), 0), 8) AS ret_5, round(coalesce(ln(close / lag(close, 20) OVER w), 0), 8) AS ret_20
FROM b WINDOW w AS (PARTITION BY symbol ORDER BY pos)""")
def log_returns(spark, folder):
    df = I.indicator_frame(hourly(spark, folder), returns=[1, 5, 20])
    return df.select("symbol", "time", r("ret_1"), r("ret_5"), r("ret_20"))


@query("percent_change", f"""{POS} SELECT symbol, time, round((close - lag(close) OVER w) / lag(close) OVER w, 8) AS change
FROM b WINDOW w AS (PARTITION BY symbol ORDER BY pos)""")
def percent_change(spark, folder):
    return I.percent_change(hourly(spark, folder), "close", ["symbol"], 3600).select("symbol", "time", r("change"))


VOL = f"""{POS}, l AS (SELECT *, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY pos)) AS lr FROM b),
v AS (SELECT *, CASE WHEN pos >= 20 THEN stddev_samp(lr) OVER (PARTITION BY symbol ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) END AS vol FROM l)"""


@query("regime_global", f"""{VOL}, m AS (SELECT symbol, median(vol) AS med FROM v GROUP BY 1)
SELECT symbol, time, round(vol, 8) AS vol, coalesce(vol > med, FALSE)::BIGINT AS regime FROM v JOIN m USING (symbol)""")
def regime_global(spark, folder):
    df = I.volatility_regime(hourly(spark, folder))
    return df.select("symbol", "time", r("vol"), F.col("regime").cast("long").alias("regime"))


@query("regime_expanding", f"""{VOL}, m AS (SELECT *, median(vol) OVER (PARTITION BY symbol ORDER BY pos) AS med FROM v)
SELECT symbol, time, coalesce(vol > med, FALSE)::BIGINT AS regime FROM m""")
def regime_expanding(spark, folder):
    df = I.volatility_regime(hourly(spark, folder), mode="expanding")
    return df.select("symbol", "time", F.col("regime").cast("long").alias("regime"))


@query("current_regime", f"""{BARS}, p AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY time DESC) AS n FROM bars),
b AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY time) - 1 AS pos FROM p WHERE n <= 200),
l AS (SELECT *, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY pos)) AS lr FROM b),
v AS (SELECT *, CASE WHEN pos >= 20 THEN stddev_samp(lr) OVER (PARTITION BY symbol ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) END AS vol FROM l),
a AS (SELECT symbol, median(vol) AS med, arg_max(vol, pos) AS last_vol, count(*) AS bars_used FROM v GROUP BY 1)
SELECT symbol, bars_used, CASE WHEN bars_used < 30 THEN 'unknown' WHEN last_vol > med THEN 'range' ELSE 'trend' END AS label FROM a""")
def current_regime(spark, folder):
    return I.current_regime(hourly(spark, folder), 200)


PAIR = f"""{BARS}, p AS (
  SELECT a.time, a.open AS o1, a.high AS h1, a.low AS l1, a.close AS c1, c.close AS c2
  FROM bars a JOIN bars c ON a.time = c.time WHERE a.symbol = 'click' AND c.symbol = 'view'),
q AS (SELECT *, row_number() OVER (ORDER BY time) - 1 AS pos FROM p)"""


@query("hedge_ratio", f"""{PAIR} SELECT time, CASE WHEN pos >= 59 THEN round(CASE WHEN var_samp(c2) OVER w > 0
  THEN covar_samp(c2, c1) OVER w / var_samp(c2) OVER w ELSE 1 END, 6) END AS beta
FROM q WINDOW w AS (ORDER BY pos ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)""")
def hedge_ratio(spark, folder):
    pair = I.join_legs(hourly(spark, folder), "click", "view")
    return I.pair_statistics(pair).select("time", r("beta", 6))


# the definition itself: every row re-computes its own 60-row spread
PAIR_STATS = f"""{PAIR}, be AS (
  SELECT *, CASE WHEN var_samp(c2) OVER w > 0 THEN covar_samp(c2, c1) OVER w / var_samp(c2) OVER w ELSE 1 END AS beta
  FROM q WINDOW w AS (ORDER BY pos ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)),
sp AS (SELECT i.pos AS i, j.pos AS j, i.beta, j.c1 - i.beta * j.c2 AS s FROM be i JOIN q j ON j.pos BETWEEN i.pos - 59 AND i.pos WHERE i.pos >= 59),
ls AS (SELECT *, lag(s) OVER (PARTITION BY i ORDER BY j) AS ls FROM sp),
st AS (SELECT i, any_value(beta) AS beta, arg_max(s, j) AS spread, (arg_max(s, j) - avg(s)) / stddev_samp(s) AS z,
  covar_samp(ls, s - ls) / nullif(var_samp(ls), 0) AS phi FROM ls GROUP BY i),
hl AS (SELECT *, CASE WHEN phi < 0 AND phi > -1 THEN -ln(2.0) / ln(1.0 + phi) END AS half FROM st)"""


@query("pair_zscore", f"{PAIR_STATS} SELECT q.time, round(spread, 6) AS spread, round(z, 6) AS zscore FROM q LEFT JOIN hl ON q.pos = hl.i")
def pair_zscore(spark, folder):
    pair = I.join_legs(hourly(spark, folder), "click", "view")
    return I.pair_statistics(pair).select("time", r("spread", 6), r("zscore", 6))


@query("pair_half_life", f"""{PAIR_STATS} SELECT q.time, round(half, 6) AS half_life, half IS NOT NULL AS reverts
FROM q LEFT JOIN hl ON q.pos = hl.i""")
def pair_half_life(spark, folder):
    pair = I.join_legs(hourly(spark, folder), "click", "view")
    return I.pair_statistics(pair).select("time", r("half_life", 6), "reverts")


@query("pairs_signals", f"""{PAIR_STATS}, tr AS (
  SELECT pos, c1, h1 - l1 AS hl, greatest(h1 - l1, abs(h1 - lag(c1) OVER (ORDER BY pos)), abs(l1 - lag(c1) OVER (ORDER BY pos))) AS tr FROM q),
aw AS (SELECT i.pos AS i, list_reduce(list(CASE WHEN j.pos = i.pos - 27 THEN j.hl ELSE j.tr END ORDER BY j.pos), lambda a, v: (1.0::DOUBLE - {A14}) * a + {A14} * v) AS atr
  FROM tr i JOIN tr j ON j.pos BETWEEN i.pos - 27 AND i.pos WHERE i.pos >= 27 GROUP BY 1),
sg AS (SELECT q.time, q.c1, q.pos, atr, CASE WHEN q.pos + 1 < 62 THEN 'insufficient_bars' WHEN z IS NULL THEN 'insufficient_spread_data'
    WHEN half IS NULL OR half > 60 THEN 'half_life_too_long' WHEN z < -2 THEN 'spread_low' WHEN z > 2 THEN 'spread_high' ELSE 'no_signal' END AS reason, z
  FROM q LEFT JOIN hl ON q.pos = hl.i LEFT JOIN aw ON q.pos = aw.i)
SELECT time, reason, CASE reason WHEN 'spread_low' THEN 'BUY' WHEN 'spread_high' THEN 'SELL' ELSE 'HOLD' END AS action,
  round(CASE WHEN reason IN ('spread_low', 'spread_high') THEN least(1.0, abs(z) / 2.0) ELSE 0.0 END, 6) AS strength,
  round(CASE reason WHEN 'spread_low' THEN c1 - 1.5 * atr WHEN 'spread_high' THEN c1 + 1.5 * atr END, 8) AS sl,
  round(CASE reason WHEN 'spread_low' THEN c1 + 3.0 * atr WHEN 'spread_high' THEN c1 - 3.0 * atr END, 8) AS tp FROM sg""")
def pairs_signals(spark, folder):
    df = G.pairs_trading(hourly(spark, folder), "click", "view")
    return df.select("time", "reason", "action", r("strength", 6), r("sl"), r("tp"))


@query("pairs_stationary", f"""{PAIR_STATS}, rg AS (SELECT i, regr_slope(s - ls, ls) AS b, regr_sxx(s - ls, ls) AS sxx, regr_syy(s - ls, ls) AS syy, regr_sxy(s - ls, ls) AS sxy, regr_count(s - ls, ls) AS m FROM ls GROUP BY 1),
dt AS (SELECT i, b / sqrt((syy - sxy * sxy / sxx) / (m - 2) / sxx) AS t FROM rg),
sg AS (SELECT q.time, z, CASE WHEN q.pos + 1 < 62 THEN 'insufficient_bars' WHEN t IS NULL OR t >= -3.37 THEN 'not_cointegrated' WHEN z IS NULL THEN 'insufficient_spread_data'
    WHEN half IS NULL OR half > 60 THEN 'half_life_too_long' WHEN z < -2 THEN 'spread_low' WHEN z > 2 THEN 'spread_high' ELSE 'no_signal' END AS reason
  FROM q LEFT JOIN hl ON q.pos = hl.i LEFT JOIN dt ON q.pos = dt.i)
SELECT time, reason, CASE reason WHEN 'spread_low' THEN 'BUY' WHEN 'spread_high' THEN 'SELL' ELSE 'HOLD' END AS action, round(z, 6) AS zscore FROM sg""")
def pairs_stationary(spark, folder):
    """Pairs signals gated by the Dickey-Fuller t of the window residuals."""
    df = G.pairs_trading(hourly(spark, folder), "click", "view", require_stationary=True)
    return df.select("time", "reason", "action", r("zscore", 6))


@query("correlation_factor", f"""{PAIR}, ch AS (SELECT *, c1 / lag(c1) OVER (ORDER BY pos) - 1 AS x, c2 / lag(c2) OVER (ORDER BY pos) - 1 AS y FROM q)
SELECT time, round(CASE WHEN pos >= 49 THEN abs(corr(x, y) OVER (ORDER BY pos ROWS BETWEEN 48 PRECEDING AND CURRENT ROW)) ELSE 0 END, 6) AS rho FROM ch""")
def correlation_factor(spark, folder):
    pair = I.join_legs(hourly(spark, folder), "click", "view")
    return I.correlation_factor(pair).select("time", r("rho", 6))


@query("average_spread", f"""WITH {TICKS}, s AS (SELECT *, CASE WHEN user_id % 4 = 0 THEN (ask - bid) / 0.0001 ELSE 1.0 + user_id % 4 END AS spread FROM ticks)
SELECT seq, symbol, round(avg(spread) OVER (PARTITION BY symbol ORDER BY seq ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 6) AS avg_spread FROM s""")
def average_spread(spark, folder):
    from ..functions.money import spread_pips

    quoted = F.when(F.col("user_id") % 4 == 0, F.lit(0.0)).otherwise(F.lit(1.0) + F.col("user_id") % 4)
    t = T.ticks(spark, folder).withColumn("spread", spread_pips(quoted, F.col("bid"), F.col("ask")))
    return I.rolling_spread(t.select("symbol", "seq", "time", "spread")).select("seq", "symbol", r("avg_spread", 6))


CROSS = f"""{IND}, x AS (SELECT *, ema_9 - ema_21 AS gap, lag(ema_9 - ema_21) OVER (PARTITION BY symbol ORDER BY pos) AS prev FROM f),
y AS (SELECT *, CASE WHEN pos + 1 < 23 THEN 'HOLD' WHEN prev <= 0 AND gap > 0 THEN 'BUY' WHEN prev >= 0 AND gap < 0 THEN 'SELL' ELSE 'HOLD' END AS action FROM x)"""


@query("ema_cross_signals", f"""{CROSS} SELECT symbol, time, action, round(CASE WHEN action = 'HOLD' THEN 0 ELSE least(1.0, abs(gap) / greatest(abs(close), 1e-9) * 1000.0) END, 6) AS strength,
  round(CASE action WHEN 'BUY' THEN close - 1.5 * atr_14 WHEN 'SELL' THEN close + 1.5 * atr_14 END, 8) AS sl,
  round(CASE action WHEN 'BUY' THEN close + 3.0 * atr_14 WHEN 'SELL' THEN close - 3.0 * atr_14 END, 8) AS tp,
  CASE WHEN pos + 1 < 23 THEN 'insufficient_bars' WHEN prev <= 0 AND gap > 0 THEN 'fast_ema_crossed_above_slow'
    WHEN prev >= 0 AND gap < 0 THEN 'fast_ema_crossed_below_slow' ELSE 'no_cross' END AS reason FROM y""")
def ema_cross_signals(spark, folder):
    df = G.ema_cross(hourly(spark, folder))
    return df.select("symbol", "time", "action", r("strength", 6), r("sl"), r("tp"), "reason")


MR = f"""{IND}, x AS (SELECT *, coalesce(mid - 2.0 * dev, close) AS lo, coalesce(mid + 2.0 * dev, close) AS hi, coalesce(rsi_14, 50.0) AS rsi FROM f),
y AS (SELECT *, CASE WHEN pos + 1 < 22 THEN 'HOLD' WHEN close <= lo AND rsi < 40 THEN 'BUY' WHEN close >= hi AND rsi > 60 THEN 'SELL' ELSE 'HOLD' END AS action FROM x)"""


@query("reversion_signals", f"""{MR} SELECT symbol, time, action, round(rsi, 6) AS rsi,
  round(CASE action WHEN 'BUY' THEN least(1.0, (1.0 - rsi / 40.0) * 0.5 + 0.5) WHEN 'SELL' THEN least(1.0, (rsi / 60.0 - 1.0) * 0.5 + 0.5) ELSE 0 END, 6) AS strength,
  round(CASE action WHEN 'BUY' THEN close - 1.5 * atr_14 WHEN 'SELL' THEN close + 1.5 * atr_14 END, 8) AS sl,
  round(CASE action WHEN 'BUY' THEN close + 2.0 * atr_14 WHEN 'SELL' THEN close - 2.0 * atr_14 END, 8) AS tp FROM y""")
def reversion_signals(spark, folder):
    df = G.mean_reversion(hourly(spark, folder), low=40.0, high=60.0)
    return df.select("symbol", "time", "action", r(F.coalesce("rsi", F.lit(50.0)), 6, "rsi"), r("strength", 6), r("sl"), r("tp"))


SWING = f"""{POS}, s AS (SELECT *,
    pos >= 2 AND lead(high, 2) OVER w IS NOT NULL AND high > greatest(lag(high, 1) OVER w, lag(high, 2) OVER w) AND high > greatest(lead(high, 1) OVER w, lead(high, 2) OVER w) AS sh,
    pos >= 2 AND lead(low, 2) OVER w IS NOT NULL AND low < least(lag(low, 1) OVER w, lag(low, 2) OVER w) AND low < least(lead(low, 1) OVER w, lead(low, 2) OVER w) AS sl
  FROM b WINDOW w AS (PARTITION BY symbol ORDER BY pos))"""


@query("swings", f"{SWING} SELECT symbol, time, coalesce(sh, FALSE) AS swing_high, coalesce(sl, FALSE) AS swing_low FROM s")
def swings(spark, folder):
    return S.swings(hourly(spark, folder)).select("symbol", "time", "swing_high", "swing_low")


LAST2 = """list(high) FILTER (WHERE sh) OVER (PARTITION BY symbol ORDER BY pos) AS hs, list(low) FILTER (WHERE sl) OVER (PARTITION BY symbol ORDER BY pos) AS ls"""
TREND_CASE = """CASE WHEN len(hs) < 2 OR len(ls) < 2 THEN 'range' WHEN hs[-1] > hs[-2] AND ls[-1] > ls[-2] THEN 'uptrend'
    WHEN hs[-1] < hs[-2] AND ls[-1] < ls[-2] THEN 'downtrend' ELSE 'range' END"""


@query("trend", f"{SWING}, k AS (SELECT *, {LAST2} FROM s) SELECT symbol, time, coalesce({TREND_CASE}, 'range') AS trend FROM k")
def trend(spark, folder):
    return S.trend(hourly(spark, folder)).select("symbol", "time", "trend")


# the definition: for every prefix, the latest bar that broke the last swing before it
BOS = f"""{SWING}, lv AS (
  SELECT symbol, pos, close, last_value(CASE WHEN sh THEN high END IGNORE NULLS) OVER w AS lh,
    last_value(CASE WHEN sl THEN low END IGNORE NULLS) OVER w AS ll FROM s WINDOW w AS (PARTITION BY symbol ORDER BY pos)),
ev AS (SELECT i.symbol, i.pos AS i, k.pos AS k, k.close, m.lh, m.ll FROM lv i JOIN lv k ON i.symbol = k.symbol AND k.pos <= i.pos AND k.pos >= 1
    JOIN lv m ON m.symbol = k.symbol AND m.pos = least(k.pos - 1, i.pos - 2)),
hit AS (SELECT symbol, i, max(k) AS k FROM ev WHERE close > lh OR close < ll GROUP BY 1, 2),
bos AS (SELECT h.symbol, h.i, h.k, CASE WHEN e.close > e.lh THEN 'bullish' ELSE 'bearish' END AS d, CASE WHEN e.close > e.lh THEN e.lh ELSE e.ll END AS level
  FROM hit h JOIN ev e ON e.symbol = h.symbol AND e.i = h.i AND e.k = h.k)"""


@query("break_of_structure", f"""{BOS} SELECT b.symbol, b.time, k AS bos_pos, d AS bos_direction, level AS bos_level
FROM b LEFT JOIN bos ON b.symbol = bos.symbol AND b.pos = bos.i""")
def break_of_structure(spark, folder):
    return S.structure_as_of(hourly(spark, folder)).select("symbol", "time", "bos_pos", "bos_direction", "bos_level")


# the definition: for every bar the higher frame as it looked then, its last bucket unfinished
BIAS = f"""{POS}, hb AS (SELECT symbol, time_bucket(INTERVAL '4 hours', time) AS ht, max(high) AS high, min(low) AS low FROM bars GROUP BY 1, 2),
hk AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ht) - 1 AS k FROM hb),
bb AS (SELECT b.symbol, b.pos, k, max(b.high) OVER w AS ph, min(b.low) OVER w AS pl FROM b JOIN hk ON hk.symbol = b.symbol AND hk.ht = time_bucket(INTERVAL '4 hours', b.time)
  WINDOW w AS (PARTITION BY b.symbol, k ORDER BY b.pos)),
fr AS (SELECT bb.symbol, bb.pos, bb.k AS n, h.k AS j, CASE WHEN h.k = bb.k THEN ph ELSE h.high END AS high, CASE WHEN h.k = bb.k THEN pl ELSE h.low END AS low
  FROM bb JOIN hk h ON h.symbol = bb.symbol AND h.k <= bb.k),
fs AS (SELECT *, j >= 2 AND lead(high, 2) OVER w IS NOT NULL AND high > greatest(lag(high, 1) OVER w, lag(high, 2) OVER w) AND high > greatest(lead(high, 1) OVER w, lead(high, 2) OVER w) AS sh,
    j >= 2 AND lead(low, 2) OVER w IS NOT NULL AND low < least(lag(low, 1) OVER w, lag(low, 2) OVER w) AND low < least(lead(low, 1) OVER w, lead(low, 2) OVER w) AS sl
  FROM fr WINDOW w AS (PARTITION BY symbol, pos ORDER BY j)),
fa AS (SELECT symbol, pos, any_value(n) AS n, list(high ORDER BY j) FILTER (WHERE sh) AS hs, list(low ORDER BY j) FILTER (WHERE sl) AS ls FROM fs GROUP BY 1, 2),
bi AS (SELECT symbol, pos, n, coalesce({TREND_CASE}, 'range') AS bias FROM fa),
-- finished prefixes: the frame of the last bar of each bucket
lab AS (SELECT bi.symbol, bi.n, arg_max(bias, bi.pos) AS label FROM bi GROUP BY 1, 2),
rv AS (SELECT bi.symbol, bi.pos, bool_or(coalesce((bi.bias = 'uptrend' AND label = 'downtrend') OR (bi.bias = 'downtrend' AND label = 'uptrend'), FALSE)) AS reversal
  FROM bi LEFT JOIN lab ON lab.symbol = bi.symbol AND lab.n BETWEEN bi.n - 10 AND bi.n - 1 GROUP BY 1, 2)"""


@query("higher_bias", f"""{BIAS} SELECT b.symbol, b.time, bi.n + 1 AS htf_rows, bi.bias AS htf_bias, rv.reversal
FROM b JOIN bi ON bi.symbol = b.symbol AND bi.pos = b.pos JOIN rv ON rv.symbol = b.symbol AND rv.pos = b.pos""")
def higher_bias(spark, folder):
    return S.higher_bias(hourly(spark, folder)).select("symbol", "time", "htf_rows", "htf_bias", "reversal")


KNOWN = f"""{SWING}, lv AS (SELECT symbol, pos, last_value(CASE WHEN sh THEN high END IGNORE NULLS) OVER w AS lh,
    last_value(CASE WHEN sl THEN low END IGNORE NULLS) OVER w AS ll FROM s WINDOW w AS (PARTITION BY symbol ORDER BY pos)),
kn AS (SELECT symbol, pos, lag(lh, 2) OVER w AS kh, lag(ll, 2) OVER w AS kl FROM lv WINDOW w AS (PARTITION BY symbol ORDER BY pos))"""


@query("fib_zone", f"""{KNOWN} SELECT b.symbol, b.time,
  coalesce(kh > kl AND close >= kh - 0.786 * (kh - kl) AND close <= kh - 0.618 * (kh - kl), FALSE) AS bullish_zone,
  coalesce(kh > kl AND close >= kl + 0.618 * (kh - kl) AND close <= kl + 0.786 * (kh - kl), FALSE) AS bearish_zone
FROM b JOIN kn ON kn.symbol = b.symbol AND kn.pos = b.pos""")
def fib_zone(spark, folder):
    df = S.structure_as_of(hourly(spark, folder))
    args = (F.col("close"), F.col("known_high"), F.col("known_low"))
    return df.select("symbol", "time", S.in_zone(F.lit("bullish"), *args).alias("bullish_zone"), S.in_zone(F.lit("bearish"), *args).alias("bearish_zone"))


PIN = f"""{POS}, c AS (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY pos) AS pc, high - low AS rng, abs(close - open) AS body,
  greatest(open, close) AS top, least(open, close) AS bot FROM b),
pin AS (SELECT symbol, pos, time, rng > 0 AND body / nullif(rng, 0) <= 1.0::DOUBLE / 3.0 AND bot - low >= TAIL * greatest(body, rng * 1e-9)
    AND bot >= low + (1.0 - 1.0::DOUBLE / 3.0) * rng AND (pc IS NULL OR close > pc) AS bull,
  rng > 0 AND body / nullif(rng, 0) <= 1.0::DOUBLE / 3.0 AND high - top >= TAIL * greatest(body, rng * 1e-9)
    AND top <= high - (1.0 - 1.0::DOUBLE / 3.0) * rng AND (pc IS NULL OR close < pc) AS bear FROM c)"""


@query("pin_bars", f"{PIN.replace('TAIL', '2.0')} SELECT symbol, time, coalesce(bull, FALSE) AS pin_bull, coalesce(bear, FALSE) AS pin_bear FROM pin")
def pin_bars(spark, folder):
    return S.pin_bars(hourly(spark, folder)).select("symbol", "time", "pin_bull", "pin_bear")


def trend_sql(mode: str) -> str:
    """All parts of the trend strategy from their definitions."""
    part = lambda s, cut: s[s.index(cut):]
    extra = """WHEN NOT zone THEN 'not_in_premium_zone' WHEN NOT pin THEN 'no_pin_bar_confirmation'""" if mode == "premium" else ""
    pins = "," + part(PIN.replace("TAIL", "1.5"), " c AS (SELECT")
    return f"""{BOS}, kn AS (SELECT symbol, pos, lag(lh, 2) OVER w AS kh, lag(ll, 2) OVER w AS kl FROM lv WINDOW w AS (PARTITION BY symbol ORDER BY pos)),
{part(BIAS, "hb AS (SELECT")}{pins},
tr AS (SELECT *, greatest(abs(high - low), abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr FROM b WINDOW w AS (PARTITION BY symbol ORDER BY pos)),
atx AS (SELECT symbol, pos, {decay("tr", A14)} AS atr FROM tr),
j AS (SELECT b.*, bi.n + 1 AS hr, bi.bias, rv.reversal, bos.d, bos.level, atx.atr, kh, kl,
    CASE WHEN d = 'bullish' THEN coalesce(kl - atr, close - 1.5 * atr) ELSE coalesce(kh + atr, close + 1.5 * atr) END AS sl,
    coalesce(kh > kl AND CASE WHEN d = 'bullish' THEN close >= kh - 0.786 * (kh - kl) AND close <= kh - 0.618 * (kh - kl)
      ELSE close >= kl + 0.618 * (kh - kl) AND close <= kl + 0.786 * (kh - kl) END, FALSE) AS zone,
    coalesce(CASE WHEN d = 'bullish' THEN pin.bull ELSE pin.bear END, FALSE) AS pin
  FROM b JOIN bi ON bi.symbol = b.symbol AND bi.pos = b.pos JOIN rv ON rv.symbol = b.symbol AND rv.pos = b.pos
    JOIN atx ON atx.symbol = b.symbol AND atx.pos = b.pos JOIN kn ON kn.symbol = b.symbol AND kn.pos = b.pos
    JOIN pin ON pin.symbol = b.symbol AND pin.pos = b.pos LEFT JOIN bos ON bos.symbol = b.symbol AND bos.i = b.pos),
rs AS (SELECT *, CASE WHEN pos + 1 < 20 THEN 'insufficient_bars' WHEN hr < 8 THEN 'insufficient_htf_bars' WHEN reversal THEN 'structural_reversal_in_progress'
    WHEN bias = 'range' THEN 'htf_range_no_trade' WHEN d IS NULL THEN 'no_break_of_structure'
    WHEN NOT ((bias = 'uptrend' AND d = 'bullish') OR (bias = 'downtrend' AND d = 'bearish')) THEN 'bos_against_htf_bias' {extra}
    WHEN abs(close - sl) <= 0 THEN 'zero_risk' ELSE 'go' END AS reason FROM j)
SELECT symbol, time, CASE WHEN reason = 'go' THEN 'bos_aligned_with_htf_bias' ELSE reason END AS reason,
  CASE WHEN reason <> 'go' THEN 'HOLD' WHEN d = 'bullish' THEN 'BUY' ELSE 'SELL' END AS action,
  round(CASE WHEN reason = 'go' THEN least(1.0, abs(close - level) / greatest(abs(close), 1e-9) * 1000.0) ELSE 0 END, 6) AS strength,
  round(CASE WHEN reason = 'go' THEN sl END, 8) AS sl,
  round(CASE WHEN reason = 'go' THEN CASE WHEN d = 'bullish' THEN close + 1.5 * abs(close - sl) ELSE close - 1.5 * abs(close - sl) END END, 8) AS tp FROM rs"""


@query("trend_signals", trend_sql("standard"))
def trend_signals(spark, folder):
    return G.trend_following(hourly(spark, folder)).select("symbol", "time", "reason", "action", r("strength", 6), r("sl"), r("tp"))


@query("trend_signals_premium", trend_sql("premium"))
def trend_signals_premium(spark, folder):
    return G.trend_following(hourly(spark, folder), mode="premium").select("symbol", "time", "reason", "action", r("strength", 6), r("sl"), r("tp"))


@query("model_features", f"""{IND}, l AS (SELECT *, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY pos)) AS lr FROM f),
v AS (SELECT *, CASE WHEN pos >= 20 THEN stddev_samp(lr) OVER (PARTITION BY symbol ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) END AS vol FROM l),
m AS (SELECT *, median(vol) OVER (PARTITION BY symbol ORDER BY pos) AS med FROM v)
SELECT symbol, time, round(coalesce(lr, 0), 8) AS ret_1, round(coalesce(ln(close / lag(close, 5) OVER w), 0), 8) AS ret_5,
  round(coalesce(ln(close / lag(close, 20) OVER w), 0), 8) AS ret_20, round(atr_14 / close, 8) AS atr_norm,
  round(coalesce(rsi_14, 0) / 100.0, 8) AS rsi_norm, round((ema_12 - ema_26) / close, 8) AS ema_spread, CASE WHEN vol > med THEN 1.0 ELSE 0.0 END::DOUBLE AS regime
FROM m WINDOW w AS (PARTITION BY symbol ORDER BY pos)""")
def model_features(spark, folder):
    f = I.features(hourly(spark, folder))
    return f.select("symbol", "time", *[r(c) for c in ("ret_1", "ret_5", "ret_20", "atr_norm", "rsi_norm", "ema_spread")], "regime")


def actions_sql(name: str, query_name: str) -> str:
    return f"SELECT '{name}' AS strategy, symbol, action, count(*) AS bars FROM ({ORACLES[query_name]}) GROUP BY ALL"


@query("strategy_registry", " UNION ALL ".join([
    actions_sql("ema_crossover", "ema_cross_signals"), actions_sql("mean_reversion", "reversion_signals"),
    actions_sql("trend_following", "trend_signals"), actions_sql("no_such_name", "ema_cross_signals")]))
def strategy_registry(spark, folder):
    """Actions of each registered strategy by name on one bar table; an unknown name is the average cross."""
    bars = hourly(spark, folder)
    params = {"mean_reversion": {"low": 40.0, "high": 60.0}}
    parts = [G.run_strategy(n, bars, **params.get(n, {})).select(F.lit(n).alias("strategy"), "symbol", "action") for n in ("ema_crossover", "mean_reversion", "trend_following", "no_such_name")]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return both.groupBy("strategy", "symbol", "action").agg(F.count(F.lit(1)).alias("bars"))
