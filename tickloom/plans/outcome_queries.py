"""Queries on trade outcomes, equity and parameter sweeps."""

from __future__ import annotations

import math
import re

from pyspark.sql import functions as F

from ..operators import equity as E
from ..operators import gates as A
from ..operators import indicators as I
from ..operators import outcomes as O
from ..operators import signals as G
from ..operators import sweep as S
from ..operators.series import settle
from ..sources import tables as T
from .indicator_queries import A14, CROSS, MR, decay, trend_sql
from .registry import ORACLES, BARS, CALENDAR, POS, hourly, query, r

WARMUP = 26


def placed_bars(spark, folder):
    return settle(O.mark_positions(hourly(spark, folder)))


def cross_signals(bars):
    return G.ema_cross(bars).where((F.col("pos") >= WARMUP) & (F.col("action") != "HOLD"))


def cross_trades(spark, folder, overlap: bool = False):
    bars = placed_bars(spark, folder)
    return bars, O.label_signals(cross_signals(bars), bars, overlap=overlap)


@query("next_open_entry", f"""{POS} SELECT symbol, time, lead(time) OVER w AS entry_time, round(lead(open) OVER w + 0.00005, 8) AS buy_entry, round(lead(open) OVER w - 0.00005, 8) AS sell_entry
FROM b WINDOW w AS (PARTITION BY symbol ORDER BY pos)""")
def next_open_entry(spark, folder):
    from ..functions.money import entry_price, pip_size

    b = O.with_next_open(hourly(spark, folder))
    price = lambda side: entry_price(F.lit(side), F.col("next_open"), F.lit(1.0), pip_size(F.col("symbol")))
    return b.select("symbol", "time", F.col("next_time").alias("entry_time"), r(price("BUY"), 8, "buy_entry"), r(price("SELL"), 8, "sell_entry"))


def outcome_sql(signals: str, source: str, where: str = "action <> 'HOLD'") -> str:
    """Outcome of every signal by looking at all later bars."""
    return f"""{signals}, n AS (SELECT symbol, count(*) AS n FROM b GROUP BY 1),
sg AS (SELECT symbol, pos, time, action, CASE action WHEN 'BUY' THEN close - 1.5 * atr_14 ELSE close + 1.5 * atr_14 END AS sl,
    CASE action WHEN 'BUY' THEN close + TPM * atr_14 ELSE close - TPM * atr_14 END AS tp FROM {source} WHERE {where} AND pos >= {WARMUP}),
s AS (SELECT sg.*, n FROM sg JOIN n USING (symbol) WHERE pos <= n - 2),
tc AS (SELECT s.symbol, s.pos, min(x.pos) AS t FROM s JOIN b x ON x.symbol = s.symbol AND x.pos > s.pos AND x.pos <= n - 2
  AND ((action = 'BUY' AND (x.low <= sl OR x.high >= tp)) OR (action = 'SELL' AND (x.high >= sl OR x.low <= tp))) GROUP BY 1, 2),
ex AS (SELECT s.*, t, coalesce(t, n - 1) AS exit_pos FROM s LEFT JOIN tc ON tc.symbol = s.symbol AND tc.pos = s.pos),
oc AS (SELECT ex.*, xb.time AS exit_time, eb.time AS entry_time, eb.open + CASE action WHEN 'BUY' THEN 0.00005 ELSE -0.00005 END AS entry,
    CASE WHEN t IS NULL THEN 'end_of_series' WHEN (action = 'BUY' AND xb.low <= sl) OR (action = 'SELL' AND xb.high >= sl) THEN 'sl_hit' ELSE 'tp_hit' END AS reason, xb.close AS xc
  FROM ex JOIN b xb ON xb.symbol = ex.symbol AND xb.pos = exit_pos JOIN b eb ON eb.symbol = ex.symbol AND eb.pos = ex.pos + 1),
op AS (SELECT *, CASE reason WHEN 'sl_hit' THEN sl WHEN 'tp_hit' THEN tp ELSE xc END AS exit_price FROM oc),
o AS (SELECT *, CASE action WHEN 'BUY' THEN 1 ELSE -1 END * (exit_price - entry) / 0.0001 AS gross, 1.0 + CASE WHEN reason = 'sl_hit' THEN 0.5 ELSE 0.0 END AS cost FROM op)"""


def chosen_sql(outcomes: str) -> str:
    """Greedy chain of non-overlapping trades as a recursion."""
    return outcomes.replace("WITH ", "WITH RECURSIVE ", 1) + """,
nx AS (SELECT a.symbol, a.pos, min(z.pos) AS nxt FROM o a LEFT JOIN o z ON z.symbol = a.symbol AND z.pos >= a.exit_pos GROUP BY 1, 2),
tk AS (SELECT symbol, min(pos) AS pos FROM o GROUP BY 1 UNION ALL SELECT nx.symbol, nx.nxt FROM tk JOIN nx ON nx.symbol = tk.symbol AND nx.pos = tk.pos WHERE nx.nxt IS NOT NULL),
tr AS (SELECT o.*, gross - cost AS profit FROM o JOIN tk ON tk.symbol = o.symbol AND tk.pos = o.pos)"""


CROSS_OUT = outcome_sql(CROSS, "y").replace("TPM", "3.0")
CROSS_TRADES = chosen_sql(CROSS_OUT)
TRADE_COLS = """symbol, pos, action, reason, entry_time, exit_time, round(entry, 8) AS entry, round(exit_price, 8) AS exit, round(gross - cost, 6) AS profit,
  round(CASE WHEN abs(entry - sl) > 0 THEN abs(tp - entry) / abs(entry - sl) ELSE 0 END, 6) AS expected_rr"""


def trade_columns(t):
    return t.select("symbol", "pos", "action", "reason", "entry_time", "exit_time", r("entry"), r("exit"), r("profit", 6), r("expected_rr", 6))


@query("signal_outcomes", f"{CROSS_OUT} SELECT {TRADE_COLS} FROM o")
def signal_outcomes(spark, folder):
    return trade_columns(cross_trades(spark, folder, overlap=True)[1])


@query("bracket_trades", f"{CROSS_TRADES} SELECT {TRADE_COLS} FROM tr")
def bracket_trades(spark, folder):
    return trade_columns(cross_trades(spark, folder)[1])


TREND_START = 50


def trend_trades_sql() -> str:
    """The trend strategy's own signals, then outcomes and chain under names of their own."""
    steps = chosen_sql(outcome_sql("WITH x", "y"))
    tail = steps[steps.index("s AS (SELECT sg.*"):]
    tail = re.sub(r"\b(s|tr|n)\b", r"z_\1", tail)
    head = trend_sql("standard").replace("WITH ", "WITH RECURSIVE ", 1)
    head = head[: head.rindex("SELECT symbol, time, CASE WHEN reason = 'go'")].rstrip()
    risk = "1.5 * abs(close - sl)"
    return f"""{head}, z_n AS (SELECT symbol, count(*) AS z_n FROM b GROUP BY 1),
sg AS (SELECT symbol, pos, time, CASE WHEN d = 'bullish' THEN 'BUY' ELSE 'SELL' END AS action, sl,
    CASE WHEN d = 'bullish' THEN close + {risk} ELSE close - {risk} END AS tp FROM rs WHERE reason = 'go' AND pos >= {TREND_START}),
{tail} SELECT {TRADE_COLS} FROM z_tr"""


@query("trend_trades", trend_trades_sql())
def trend_trades(spark, folder):
    bars = placed_bars(spark, folder)
    s = G.trend_following(bars).where((F.col("pos") >= TREND_START) & (F.col("action") != "HOLD"))
    return trade_columns(O.label_signals(settle(s), bars))


GATED = f"""{MR}, {CALENDAR}, vv AS (SELECT *, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY pos)) AS lr FROM b),
vw AS (SELECT *, CASE WHEN pos >= 20 THEN stddev_samp(lr) OVER (PARTITION BY symbol ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) END AS vol FROM vv),
vm AS (SELECT symbol, median(vol) AS med FROM vw GROUP BY 1),
gy AS (SELECT y.* FROM y JOIN vw ON vw.symbol = y.symbol AND vw.pos = y.pos JOIN vm ON vm.symbol = y.symbol WHERE NOT coalesce(vol > med, FALSE)
  AND ((hour(y.time) >= 7 AND hour(y.time) < 16) OR (hour(y.time) >= 12 AND hour(y.time) < 21))
  AND NOT EXISTS (SELECT 1 FROM calendar c WHERE abs(epoch_us(y.time) - epoch_us(c.time)) <= 1800000000 AND contains(upper(y.symbol), c.currency)))"""


@query("gated_trades", f"{chosen_sql(outcome_sql(GATED, 'gy').replace('TPM', '2.0'))} SELECT {TRADE_COLS} FROM tr")
def gated_trades(spark, folder):
    """Reversion trades entered only in session, away from news and in the trend regime."""
    bars = placed_bars(spark, folder)
    s = G.mean_reversion(bars, low=40.0, high=60.0).where((F.col("pos") >= WARMUP) & (F.col("action") != "HOLD"))
    s = s.join(I.volatility_regime(bars).select("symbol", "pos", "regime"), ["symbol", "pos"])
    s = A.regime_gate(s.withColumn("strategy", F.lit("mean_reversion")), {"mean_reversion": [0]})
    s = A.entry_gates(s, ["london", "new_york"], T.calendar(spark, folder), 30)
    return trade_columns(O.label_signals(settle(s), bars))


@query("atr_sized_trades", f"""{CROSS_TRADES} SELECT tr.symbol, tr.pos, round(greatest(0.01, round(round(least(10000.0 * 0.01 / (atr_14 * 1.5 / 0.0001 * 10.0) * 0.25, 10.0) / 0.01) * 0.01, 2)), 2) AS volume
FROM tr JOIN y ON y.symbol = tr.symbol AND y.pos = tr.pos""")
def atr_sized_trades(spark, folder):
    bars = placed_bars(spark, folder)
    t = O.label_signals(cross_signals(bars), bars, volume=O.atr_volume(F.col("atr")))
    return t.select("symbol", "pos", r("volume", 2))


CURVE = f"""{CROSS_TRADES}, cm AS (SELECT symbol, pos, exit_pos, action, entry, sum(profit) OVER w AS aft, sum(profit) OVER w - profit AS bef FROM tr WINDOW w AS (PARTITION BY symbol ORDER BY pos)),
bb AS (SELECT b.symbol, b.pos, b.time, b.close, n FROM b JOIN n USING (symbol) WHERE b.pos >= {WARMUP}),
cv AS (SELECT bb.symbol, bb.pos, bb.time, n, cm.exit_pos, CASE WHEN cm.pos IS NULL THEN 10000.0 WHEN bb.pos < cm.exit_pos
    THEN 10000.0 + bef + CASE cm.action WHEN 'BUY' THEN 1 ELSE -1 END * (bb.close - cm.entry) / 0.0001 ELSE 10000.0 + aft END AS equity
  FROM bb ASOF LEFT JOIN cm ON bb.symbol = cm.symbol AND bb.pos >= cm.pos),
curve AS (SELECT * FROM cv WHERE pos < n - 1 OR exit_pos = n - 1)"""


@query("equity_curve", f"{CURVE} SELECT symbol, time, pos, round(equity, 6) AS equity FROM curve")
def equity_curve(spark, folder):
    bars, t = cross_trades(spark, folder)
    return O.equity_curve(t, bars, warmup=WARMUP).select("symbol", "time", "pos", r("equity", 6))


DAILY = f"""{CURVE}, de AS (SELECT symbol, time::DATE AS day, arg_max(equity, pos) AS e FROM curve GROUP BY 1, 2),
sp AS (SELECT symbol, min(day) AS a, max(day) AS z FROM de GROUP BY 1),
cal AS (SELECT symbol, unnest(generate_series(a::TIMESTAMP, z::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day FROM sp),
fd AS (SELECT cal.symbol, cal.day, last_value(e IGNORE NULLS) OVER (PARTITION BY cal.symbol ORDER BY cal.day) AS equity FROM cal LEFT JOIN de ON de.symbol = cal.symbol AND de.day = cal.day)"""


@query("daily_equity", f"{DAILY} SELECT symbol, day, round(equity, 6) AS equity FROM fd")
def daily_equity(spark, folder):
    bars, t = cross_trades(spark, folder)
    return E.daily_equity(O.equity_curve(t, bars, warmup=WARMUP)).select("symbol", "day", r("equity", 6))


@query("equity_statistics", f"""{DAILY}, rt AS (SELECT *, equity / lag(equity) OVER (PARTITION BY symbol ORDER BY day) - 1 AS r FROM fd),
ss AS (SELECT symbol, avg(r) AS m, stddev_samp(r) AS s, stddev_samp(CASE WHEN r < 0 THEN r END) AS ds FROM rt GROUP BY 1),
pk AS (SELECT *, max(equity) OVER (PARTITION BY symbol ORDER BY pos) AS peak FROM curve), dd AS (SELECT symbol, max((peak - equity) / peak) AS dd FROM pk GROUP BY 1),
f AS (SELECT symbol, coalesce(m / nullif(s, 0) * sqrt(252.0), 0) AS sharpe, coalesce(m / nullif(ds, 0) * sqrt(252.0), 0) AS sortino, greatest(dd, 0) AS dd FROM ss JOIN dd USING (symbol))
SELECT symbol, round(sharpe, 6) AS sharpe, round(sortino, 6) AS sortino, round(dd, 8) AS max_drawdown, round(CASE WHEN sharpe > 0 AND dd > 0 THEN sharpe / dd ELSE 0 END, 4) AS calmar FROM f""".replace("f AS (SELECT symbol, coalesce", "fin AS (SELECT symbol, coalesce").replace("AS calmar FROM f", "AS calmar FROM fin"))
def equity_statistics(spark, folder):
    bars, t = cross_trades(spark, folder)
    s = E.equity_statistics(O.equity_curve(t, bars, warmup=WARMUP))
    return s.select("symbol", r("sharpe", 6), r("sortino", 6), r("max_drawdown", 8), r("calmar", 4))


@query("day_start_equity", f"""{CURVE}, fb AS (SELECT symbol, time::DATE AS day, min(pos) AS pos FROM curve GROUP BY 1, 2)
SELECT fb.symbol, day, round(10000.0 + coalesce(sum(profit), 0), 6) AS day_start FROM fb LEFT JOIN tr ON tr.symbol = fb.symbol AND tr.exit_pos < fb.pos GROUP BY 1, 2""")
def day_start_equity(spark, folder):
    bars, t = cross_trades(spark, folder)
    return E.day_start_equity(O.equity_curve(t, bars, warmup=WARMUP), t).select("symbol", "day", r("day_start", 6))


@query("meta_labels", f"""{CROSS_TRADES} SELECT symbol, pos, CASE WHEN profit > 0 THEN 1 ELSE 0 END::BIGINT AS label FROM tr""")
def meta_labels(spark, folder):
    _, t = cross_trades(spark, folder)
    return t.select("symbol", "pos", F.when(F.col("profit") > 0, 1).otherwise(0).cast("long").alias("label"))


SPACE = {"ema_fast": [5, 9], "ema_slow": [13, 21], "atr_multiplier": [1.5, 2.5]}
FOLDS, EMBARGO = 5, 24


def sweep_sql(strategy: str = "ema_crossover") -> str:
    """Every parameter set on every fold from the definitions, in one statement."""
    per_fold = lambda sql: sql.replace("PARTITION BY symbol", "PARTITION BY symbol, fold")
    if strategy == "trend_following":
        signals, stops = trend_sets_sql()
        return sweep_tail(signals, str(TREND_START), "", per_fold, stops)
    if strategy == "mean_reversion":
        signals, ready, target = reversion_sql(per_fold), "greatest(bn, rn, 14) + 5", "2.0"
    else:
        signals, ready, target = cross_sql(per_fold), "greatest(s, 14) + 5", "3.0"
    return sweep_tail(signals, ready, target, per_fold)


REVERSION_SPACE = {"bb_period": [15, 20], "bb_std": [1.5, 2.0], "rsi_period": [7, 14], "rsi_os": [40.0], "rsi_ob": [60.0], "atr_multiplier": [1.5]}


def reversion_sql(per_fold) -> str:
    sets = S.grid(REVERSION_SPACE)
    bands, osc = sorted({p["bb_period"] for p in sets}), sorted({p["rsi_period"] for p in sets})
    cols = ", ".join(f"CASE WHEN pos >= {n - 1} THEN avg(close) OVER b{n} END AS m{n}, CASE WHEN pos >= {n - 1} THEN stddev_pop(close) OVER b{n} END AS d{n}" for n in bands)
    windows = ", ".join(f"b{n} AS (PARTITION BY symbol, fold ORDER BY pos ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in bands)
    ups = ", ".join(per_fold(f"{decay('greatest(move, 0)', f'(1.0::DOUBLE / {n}.0)')} AS u{n}, {decay('greatest(-move, 0)', f'(1.0::DOUBLE / {n}.0)')} AS w{n}") for n in osc)
    values = ", ".join(f"({p['param_id']}, {p['bb_period']}, {p['bb_std']}::DOUBLE, {p['rsi_period']}, {p['atr_multiplier']}::DOUBLE)" for p in sets)
    pick = lambda k, c, ns: f"CASE {k} " + " ".join(f"WHEN {n} THEN {c}{n}" for n in ns) + " END"
    return f"""i1 AS (SELECT *, {cols} FROM i0 WINDOW {windows}),
mv AS (SELECT *, close - lag(close) OVER (PARTITION BY symbol, fold ORDER BY pos) AS move FROM b),
os AS (SELECT symbol, fold, pos, {ups} FROM mv WHERE pos > 0),
ps(param_id, bn, k, rn, m) AS (VALUES {values}),
g0 AS (SELECT i1.*, ps.*, {pick('bn', 'm', bands)} AS mid, {pick('bn', 'd', bands)} AS dev, {pick('rn', 'u', osc)} AS up, {pick('rn', 'w', osc)} AS dn
  FROM i1 LEFT JOIN os USING (symbol, fold, pos), ps),
g1 AS (SELECT *, coalesce(CASE WHEN dn > 0 THEN 100.0 - 100.0 / (1.0 + up / dn) END, 50.0) AS rsi, coalesce(mid - k * dev, close) AS lo, coalesce(mid + k * dev, close) AS hi FROM g0),
sg AS (SELECT symbol, fold, param_id, pos, n, close, atr, m, CASE WHEN close <= lo AND rsi < 40 THEN 'BUY' ELSE 'SELL' END AS action FROM g1
  WHERE pos >= greatest(bn, rn, 14) + 5 AND pos <= n - 2 AND ((close <= lo AND rsi < 40) OR (close >= hi AND rsi > 60))),"""


def cross_sql(per_fold) -> str:
    sets = S.grid(SPACE)
    spans = sorted({p[k] for p in sets for k in ("ema_fast", "ema_slow")})
    emas = ", ".join(per_fold(f"{decay('close', f'(2.0::DOUBLE / {n + 1}.0)')} AS e{n}") for n in spans)
    values = ", ".join(f"({p['param_id']}, {p['ema_fast']}, {p['ema_slow']}, {p['atr_multiplier']}::DOUBLE)" for p in sets)
    pick = lambda k: "CASE " + k + " " + " ".join(f"WHEN {n} THEN e{n}" for n in spans) + " END"
    return f"""i1 AS (SELECT *, {emas} FROM i0),
ps(param_id, f, s, m) AS (VALUES {values}),
g0 AS (SELECT i1.*, ps.*, {pick('f')} - {pick('s')} AS gap FROM i1, ps),
g1 AS (SELECT *, lag(gap) OVER (PARTITION BY symbol, fold, param_id ORDER BY pos) AS prev FROM g0),
sg AS (SELECT symbol, fold, param_id, pos, n, close, atr, m, CASE WHEN prev <= 0 AND gap > 0 THEN 'BUY' ELSE 'SELL' END AS action FROM g1
  WHERE pos >= greatest(s, 14) + 5 AND pos <= n - 2 AND ((prev <= 0 AND gap > 0) OR (prev >= 0 AND gap < 0))),"""


TREND_SPACE = {"tp_r_multiple": [1.5, 2.5], "sl_atr_buffer": [1.0, 0.5], "reversal_lookback": [10]}


def trend_sets_sql() -> tuple[str, str]:
    """The trend strategy's setups on every fold, each fold a symbol of its own there, and the stops of every set."""
    inner = trend_sql("standard").replace(BARS, "WITH bars AS (SELECT name AS symbol, time, open, high, low, close, volume FROM fb0)", 1)
    inner = inner[: inner.rindex("SELECT symbol, time, CASE WHEN reason = 'go'")] + "SELECT symbol AS name, pos, d, kh, kl, atr FROM rs WHERE reason IN ('go', 'zero_risk')"
    values = ", ".join(f"({p['param_id']}, {p['tp_r_multiple']}::DOUBLE, {p['sl_atr_buffer']}::DOUBLE)" for p in S.grid(TREND_SPACE))
    signals = f"""fb0 AS MATERIALIZED (SELECT *, symbol || '#' || fold AS name FROM b),
setups AS MATERIALIZED ({inner}),
ps(param_id, rm, bf) AS (VALUES {values}),
sg AS (SELECT fb0.symbol, fold, param_id, fb0.pos, n, close, rm, CASE WHEN d = 'bullish' THEN 'BUY' ELSE 'SELL' END AS action,
    CASE WHEN d = 'bullish' THEN coalesce(kl - bf * t.atr, close - 1.5 * t.atr) ELSE coalesce(kh + bf * t.atr, close + 1.5 * t.atr) END AS sl
  FROM setups t JOIN fb0 ON fb0.name = t.name AND fb0.pos = t.pos, ps WHERE fb0.pos >= {TREND_START} AND fb0.pos <= n - 2),"""
    stops = """s AS (SELECT *, CASE action WHEN 'BUY' THEN close + rm * abs(close - sl) ELSE close - rm * abs(close - sl) END AS tp FROM sg WHERE abs(close - sl) > 0),"""
    return signals, stops


def sweep_tail(signals: str, ready: str, target: str, per_fold, stops: str | None = None) -> str:
    stops = stops or f"""s AS (SELECT *, CASE action WHEN 'BUY' THEN close - m * atr ELSE close + m * atr END AS sl, CASE action WHEN 'BUY' THEN close + {target} * atr ELSE close - {target} * atr END AS tp FROM sg),"""
    head = f"""{BARS.replace("WITH ", "WITH RECURSIVE ", 1)}, gp AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY time) - 1 AS gpos, count(*) OVER (PARTITION BY symbol) AS gn FROM bars),
gf AS (SELECT *, CASE WHEN gn >= {FOLDS * (2 * EMBARGO + 2)} THEN least(gpos // (gn // {FOLDS}), {FOLDS - 1}) WHEN gpos >= floor(gn * (1 - 1.0::DOUBLE / {FOLDS})) THEN 0 END AS fold FROM gp),
b AS (SELECT *, row_number() OVER (PARTITION BY symbol, fold ORDER BY time) - 1 AS pos, count(*) OVER (PARTITION BY symbol, fold) AS n FROM gf WHERE fold IS NOT NULL),
t0 AS (SELECT *, greatest(abs(high - low), abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr FROM b WINDOW w AS (PARTITION BY symbol, fold ORDER BY pos)),
i0 AS (SELECT *, {per_fold(decay('tr', A14))} AS atr FROM t0),
{signals}
{stops}
tc AS (SELECT s.symbol, s.fold, s.param_id, s.pos, min(x.pos) AS t FROM s JOIN b x ON x.symbol = s.symbol AND x.fold = s.fold AND x.pos > s.pos AND x.pos <= s.n - 2
  AND ((action = 'BUY' AND (x.low <= sl OR x.high >= tp)) OR (action = 'SELL' AND (x.high >= sl OR x.low <= tp))) GROUP BY 1, 2, 3, 4),
ex AS (SELECT s.*, t, coalesce(t, n - 1) AS exit_pos FROM s LEFT JOIN tc USING (symbol, fold, param_id, pos)),
oc AS (SELECT ex.*, eb.open + CASE action WHEN 'BUY' THEN 0.00005 ELSE -0.00005 END AS entry, (action = 'BUY' AND xb.low <= sl) OR (action = 'SELL' AND xb.high >= sl) AS stop, xb.close AS xc
  FROM ex JOIN b xb ON xb.symbol = ex.symbol AND xb.fold = ex.fold AND xb.pos = exit_pos JOIN b eb ON eb.symbol = ex.symbol AND eb.fold = ex.fold AND eb.pos = ex.pos + 1),
o AS (SELECT *, CASE action WHEN 'BUY' THEN 1 ELSE -1 END * (CASE WHEN t IS NULL THEN xc WHEN stop THEN sl ELSE tp END - entry) / 0.0001 - 1.0 - CASE WHEN t IS NOT NULL AND stop THEN 0.5 ELSE 0 END AS profit FROM oc),
nx AS (SELECT a.symbol, a.fold, a.param_id, a.pos, min(z.pos) AS nxt FROM o a LEFT JOIN o z ON z.symbol = a.symbol AND z.fold = a.fold AND z.param_id = a.param_id AND z.pos >= a.exit_pos GROUP BY 1, 2, 3, 4),
tk AS (SELECT symbol, fold, param_id, min(pos) AS pos FROM o GROUP BY 1, 2, 3 UNION ALL SELECT nx.symbol, nx.fold, nx.param_id, nx.nxt FROM tk JOIN nx USING (symbol, fold, param_id, pos) WHERE nx.nxt IS NOT NULL),
tr AS (SELECT o.* FROM o JOIN tk USING (symbol, fold, param_id, pos)),
cm AS (SELECT symbol, fold, param_id, pos, exit_pos, action, entry, sum(profit) OVER w AS aft, sum(profit) OVER w - profit AS bef FROM tr WINDOW w AS (PARTITION BY symbol, fold, param_id ORDER BY pos)),
bb AS (SELECT b.symbol, b.fold, ps.param_id, b.pos, b.time, b.close, b.n FROM b, ps WHERE b.pos >= {ready} AND n >= {ready} + 2),
cv AS (SELECT bb.*, cm.exit_pos, CASE WHEN cm.pos IS NULL THEN 10000.0 WHEN bb.pos < cm.exit_pos THEN 10000.0 + bef + CASE cm.action WHEN 'BUY' THEN 1 ELSE -1 END * (bb.close - cm.entry) / 0.0001 ELSE 10000.0 + aft END AS equity
  FROM bb ASOF LEFT JOIN cm ON bb.symbol = cm.symbol AND bb.fold = cm.fold AND bb.param_id = cm.param_id AND bb.pos >= cm.pos),
curve AS (SELECT * FROM cv WHERE pos < n - 1 OR exit_pos = n - 1),
de AS (SELECT symbol, fold, param_id, time::DATE AS day, arg_max(equity, pos) AS e FROM curve GROUP BY 1, 2, 3, 4),
sp AS (SELECT symbol, fold, param_id, min(day) AS a, max(day) AS z FROM de GROUP BY 1, 2, 3),
cal AS (SELECT symbol, fold, param_id, unnest(generate_series(a::TIMESTAMP, z::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day FROM sp),
fd AS (SELECT cal.*, last_value(e IGNORE NULLS) OVER (PARTITION BY symbol, fold, param_id ORDER BY cal.day) AS equity FROM cal LEFT JOIN de USING (symbol, fold, param_id, day)),
rt AS (SELECT *, equity / lag(equity) OVER (PARTITION BY symbol, fold, param_id ORDER BY day) - 1 AS r FROM fd),
ss AS (SELECT symbol, fold, param_id, CASE WHEN stddev_samp(r) > 1e-15 THEN avg(r) / stddev_samp(r) * {math.sqrt(252)!r} ELSE 0 END AS sharpe,
  CASE WHEN count(*) FILTER (WHERE r < 0) >= 2 AND stddev_samp(r) FILTER (WHERE r < 0) > 0 THEN avg(r) / stddev_samp(r) FILTER (WHERE r < 0) * {math.sqrt(252)!r} ELSE 0 END AS sortino FROM rt GROUP BY 1, 2, 3),
pk AS (SELECT *, max(equity) OVER (PARTITION BY symbol, fold, param_id ORDER BY pos) AS peak FROM curve),
dd AS (SELECT symbol, fold, param_id, max((peak - equity) / peak) AS dd, any_value(n) AS n FROM pk GROUP BY 1, 2, 3),
tw AS (SELECT symbol, fold, param_id, count(*) AS trades, count(*) FILTER (WHERE profit > 0) AS wins FROM tr GROUP BY 1, 2, 3),
sz AS (SELECT symbol, fold, count(*) AS bars FROM b GROUP BY 1, 2),
cell AS (SELECT symbol, fold, param_id, bars, coalesce(sharpe, 0) AS sharpe, coalesce(sortino, 0) AS sortino, coalesce(dd, 0) AS max_drawdown, CASE WHEN sharpe > 0 AND dd > 0 THEN sharpe / dd ELSE 0 END AS calmar,
  coalesce(wins / trades, 0) AS win_rate, coalesce(trades, 0) AS trades FROM (SELECT symbol, fold, param_id, bars FROM sz, ps) LEFT JOIN ss USING (symbol, fold, param_id)
  LEFT JOIN dd USING (symbol, fold, param_id) LEFT JOIN tw USING (symbol, fold, param_id))"""
    return head


CELLS = sweep_sql()


def sweep_parts(spark, folder):
    params = S.grid(SPACE)
    series = settle(S.folds_of(hourly(spark, folder), FOLDS, EMBARGO))
    keys = ["symbol", "fold"]
    sig = S.grid_signals(series, "ema_crossover", params, keys)
    trades = O.label_signals(settle(sig), series, keys, ["param_id"])
    return S.fold_scores(trades, series, params, "ema_crossover", keys)


@query("sweep_fold_scores", f"""{CELLS} SELECT symbol, fold, param_id::BIGINT AS param_id, bars, round(sharpe, 6) AS sharpe, round(sortino, 6) AS sortino, round(max_drawdown, 8) AS max_drawdown,
  round(calmar, 4) AS calmar, round(win_rate, 6) AS win_rate, trades FROM cell""")
def sweep_fold_scores(spark, folder):
    c = sweep_parts(spark, folder)
    return c.select("symbol", "fold", "param_id", "bars", r("sharpe", 6), r("sortino", 6), r("max_drawdown", 8), r("calmar", 4), r("win_rate", 6), "trades")


@query("sweep_fold_summary", f"""{CELLS} SELECT symbol, param_id::BIGINT AS param_id, round(avg(sharpe), 6) AS sharpe, round(avg(sortino), 6) AS sortino, round(avg(win_rate), 6) AS win_rate,
  round(max(max_drawdown), 8) AS max_drawdown, sum(trades)::BIGINT AS trades, count(*) AS n_folds FROM cell WHERE bars >= 50 GROUP BY 1, 2""")
def sweep_fold_summary(spark, folder):
    c = E.fold_summary(sweep_parts(spark, folder), ["symbol", "param_id"])
    return c.select("symbol", "param_id", r("sharpe", 6), r("sortino", 6), r("win_rate", 6), r("max_drawdown", 8), "trades", "n_folds")


def board_sql(cells: str, floor: float) -> str:
    return f"""{cells}, ag AS (SELECT symbol, param_id, avg(sharpe) AS sharpe, avg(win_rate) AS win_rate, max(max_drawdown) AS dd, sum(trades) AS trades FROM cell WHERE bars >= 50 GROUP BY 1, 2),
bd AS (SELECT param_id, avg(sharpe) AS sharpe, avg(win_rate) AS win_rate, max(dd) AS max_dd, bool_and(sharpe > 1.5 AND dd < 0.05 AND win_rate > {floor}) AS guard_pass, sum(trades)::BIGINT AS trades FROM ag GROUP BY 1),
pl AS (SELECT count(*)::DOUBLE AS n, avg(sharpe) AS m, stddev_samp(sharpe) AS sd FROM bd)
SELECT param_id::BIGINT AS param_id, round(sharpe, 6) AS sharpe, round(win_rate, 6) AS win_rate, round(max_dd, 8) AS max_dd, guard_pass, trades,
  round(sharpe - (m + sd * (sqrt(2 * ln(n)) - (ln(ln(n)) + {math.log(4 * math.pi)!r}) / (2 * sqrt(2 * ln(n))))), 6) AS dsr FROM bd, pl"""


@query("sweep_scoreboard", board_sql(CELLS, 0.3))
def sweep_scoreboard(spark, folder):
    b = S.sweep(hourly(spark, folder), "ema_crossover", S.grid(SPACE), FOLDS, EMBARGO)
    return b.select("param_id", r("sharpe", 6), r("win_rate", 6), r("max_dd", 8), "guard_pass", "trades", r("dsr", 6))


@query("sweep_reversion", board_sql(sweep_sql("mean_reversion"), 0.5))
def sweep_reversion(spark, folder):
    b = S.sweep(hourly(spark, folder), "mean_reversion", S.grid(REVERSION_SPACE), FOLDS, EMBARGO)
    return b.select("param_id", r("sharpe", 6), r("win_rate", 6), r("max_dd", 8), "guard_pass", "trades", r("dsr", 6))


@query("sweep_trend", board_sql(sweep_sql("trend_following"), 0.3))
def sweep_trend(spark, folder):
    b = S.sweep(hourly(spark, folder), "trend_following", S.grid(TREND_SPACE), FOLDS, EMBARGO)
    return b.select("param_id", r("sharpe", 6), r("win_rate", 6), r("max_dd", 8), "guard_pass", "trades", r("dsr", 6))


def pairs_trades_sql() -> str:
    """The pair's signals as they are defined, then outcomes and chain on the bars that both legs have."""
    head = ORACLES["pairs_signals"]
    head = head[: head.rindex("SELECT time, reason, CASE reason")].rstrip().replace("sg AS (SELECT q.time", "px AS (SELECT q.time", 1)
    head = head.replace(" tr AS (", " ptr AS (").replace("FROM tr i JOIN tr j", "FROM ptr i JOIN ptr j").replace("st AS (", "pst AS (").replace("FROM st)", "FROM pst)")
    steps = chosen_sql(outcome_sql("WITH x", "y"))
    return f"""{head.replace("WITH ", "WITH RECURSIVE ", 1)},
b AS MATERIALIZED (SELECT 'click' AS symbol, row_number() OVER (ORDER BY x.time) - 1 AS pos, x.time, x.open, x.high, x.low, x.close FROM bars x JOIN bars z ON z.time = x.time AND z.symbol = 'view' WHERE x.symbol = 'click'),
n AS (SELECT symbol, count(*) AS n FROM b GROUP BY 1),
sg AS (SELECT 'click' AS symbol, pos, time, CASE reason WHEN 'spread_low' THEN 'BUY' ELSE 'SELL' END AS action, CASE reason WHEN 'spread_low' THEN c1 - 1.5 * atr ELSE c1 + 1.5 * atr END AS sl,
  CASE reason WHEN 'spread_low' THEN c1 + 3.0 * atr ELSE c1 - 3.0 * atr END AS tp FROM px WHERE reason IN ('spread_low', 'spread_high') AND pos >= 62),
{steps[steps.index("s AS (SELECT sg.*"):]} SELECT {TRADE_COLS} FROM tr"""


@query("pairs_trades", pairs_trades_sql())
def pairs_trades(spark, folder):
    """Outcomes of the pair's signals on its first leg, one position at a time."""
    return trade_columns(O.pairs_trades(hourly(spark, folder), "click", "view"))
