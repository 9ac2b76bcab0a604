"""Queries on trade journals, order checks, sizing and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import money, scores, sizing
from ..operators import joins as J
from ..operators import trades as R
from ..sources import tables as T
from .registry import TICKS, TRADES, TRIALS, query, r

W = f"WITH {TRADES}, c AS (SELECT * FROM trades WHERE close_time IS NOT NULL)"
SQRT = "sqrt(252.0)"


@query("open_closed_split", f"WITH {TRADES} SELECT ticket, symbol, type, profit, CASE WHEN close_time IS NULL THEN 'open' ELSE 'closed' END AS state FROM trades")
def open_closed_split(spark, folder):
    t = T.trades(spark, folder)
    cols = ("ticket", "symbol", "type", "profit")
    return R.open_trades(t).select(*cols, F.lit("open").alias("state")).unionByName(R.closed_trades(t).select(*cols, F.lit("closed").alias("state")))


@query("trade_listing", f"{W} SELECT ticket, symbol, type, profit, close_time FROM c WHERE type = 'BUY' AND symbol = '2-HIGH' ORDER BY close_time DESC, ticket DESC LIMIT 100")
def trade_listing(spark, folder):
    return R.list_trades(T.trades(spark, folder), "buy", "2-high", 100).select("ticket", "symbol", "type", "profit", "close_time")


@query("recent_trades", f"WITH {TRADES} SELECT ticket, symbol, open_time FROM trades WHERE open_time >= TIMESTAMP '2001-08-01' - INTERVAL 28 DAY")
def recent_trades(spark, folder):
    return R.recent(T.trades(spark, folder), 28, "2001-08-01 00:00:00").select("ticket", "symbol", "open_time")


@query("order_validation", f"""WITH {TRADES} SELECT ticket, CASE WHEN sl = 0 THEN 'sl_required' WHEN ticket % 13 - 1 <= 0 THEN 'volume_must_be_positive'
  WHEN ticket % 13 - 1 > 10 THEN 'volume>10.0' ELSE 'ok' END AS reason FROM trades""")
def order_validation(spark, folder):
    t = T.trades(spark, folder)
    return t.select("ticket", sizing.order_check(F.col("sl"), (F.col("ticket") % 13 - 1).cast("double")).alias("reason"))


@query("loss_alerts", f"WITH {TRADES} SELECT ticket, symbol, profit FROM trades WHERE profit < -200")
def loss_alerts(spark, folder):
    return R.loss_alerts(T.trades(spark, folder), 200.0).select("ticket", "symbol", "profit")


@query("r_proxy", f"{W} SELECT ticket, round(CASE WHEN sl <> 0 AND abs(open_price - sl) > 0 THEN profit / abs(open_price - sl) END, 4) AS r FROM c")
def r_proxy(spark, folder):
    t = R.closed_trades(T.trades(spark, folder))
    return t.select("ticket", r(money.r_proxy(F.col("profit"), F.col("open_price"), F.col("sl")), 4, "r"))


@query("equity_series", f"""{W}, e AS (SELECT ticket, close_time, profit, sum(profit) OVER (ORDER BY close_time, ticket) AS equity FROM c),
p AS (SELECT *, max(equity) OVER (ORDER BY close_time, ticket) AS peak FROM e)
SELECT ticket, close_time, round(equity, 2) AS equity, round(peak, 2) AS peak, round(greatest((peak - equity) / greatest(abs(peak), 1.0), 0.0), 6) AS drawdown FROM p""")
def equity_series(spark, folder):
    e = R.equity_series(T.trades(spark, folder))
    return e.select("ticket", "close_time", r("equity", 2), r("peak", 2), r("drawdown", 6))


@query("loss_streaks", f"""{W}, g AS (SELECT *, sum(CASE WHEN profit >= 0 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY close_time, ticket) AS grp FROM c)
SELECT symbol, ticket, sum(CASE WHEN profit < 0 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, grp ORDER BY close_time, ticket)::BIGINT AS streak FROM g""")
def loss_streaks(spark, folder):
    return R.loss_streaks(T.trades(spark, folder), ["symbol"]).select("symbol", "ticket", "streak")


@query("max_loss_streak", f"""{W}, g AS (SELECT *, sum(CASE WHEN profit >= 0 THEN 1 ELSE 0 END) OVER (ORDER BY close_time, ticket) AS grp FROM c),
s AS (SELECT *, sum(CASE WHEN profit < 0 THEN 1 ELSE 0 END) OVER (PARTITION BY grp ORDER BY close_time, ticket)::BIGINT AS streak FROM g)
SELECT max(streak) AS max_streak, arg_max(streak, (close_time, ticket)) AS current_streak FROM s""")
def max_loss_streak(spark, folder):
    return R.max_loss_streak(T.trades(spark, folder))


def stats_sql(keys: str) -> str:
    k, g = (f"{keys}, ", f"GROUP BY {keys}") if keys else ("", "")
    part = f"PARTITION BY {keys}" if keys else ""
    return f"""{W}, e AS (SELECT *, sum(profit) OVER ({part} ORDER BY close_time, ticket) AS eq FROM c),
p AS (SELECT *, max(eq) OVER ({part} ORDER BY close_time, ticket) AS pk FROM e),
d AS (SELECT {k} close_time::DATE AS dt, sum(profit) AS dp FROM c GROUP BY {k} dt),
sh AS (SELECT {k} avg(dp) / stddev_samp(dp) * {SQRT} AS sharpe FROM d {g}),
a AS (SELECT {k} count(*) AS n, count(*) FILTER (WHERE profit > 0) AS w, avg(profit) FILTER (WHERE profit > 0) AS aw, avg(-profit) FILTER (WHERE profit < 0) AS al,
  sum(profit) FILTER (WHERE profit > 0) AS sw, sum(-profit) FILTER (WHERE profit < 0) AS sl,
  max((pk - eq) / CASE WHEN abs(pk) > 1e-9 THEN abs(pk) ELSE 1 END) AS dd FROM p {g})
SELECT {k} n AS trade_count, round(sharpe, 6) AS sharpe, round(dd, 6) AS max_drawdown, round(w / n, 6) AS win_rate, round(sw / sl, 6) AS profit_factor, FALSE AS no_losses,
  round(aw / al, 6) AS payoff_ratio, round(w / n * aw - (1 - w / n) * al, 6) AS expectancy, round((w / n * aw - (1 - w / n) * al) / al, 6) AS avg_r_multiple
FROM a {"JOIN sh USING (" + keys + ")" if keys else "CROSS JOIN sh"}"""


STATS = ("sharpe", "max_drawdown", "win_rate", "profit_factor", "payoff_ratio", "expectancy", "avg_r_multiple")


@query("trade_statistics", stats_sql(""))
def trade_statistics(spark, folder):
    return R.statistics(T.trades(spark, folder)).select("trade_count", "no_losses", *[r(c, 6) for c in STATS])


@query("trade_statistics_by_symbol", stats_sql("symbol"))
def trade_statistics_by_symbol(spark, folder):
    return R.statistics(T.trades(spark, folder), ["symbol"]).select("symbol", "trade_count", "no_losses", *[r(c, 6) for c in STATS])


@query("daily_sharpe", f"""WITH {TRADES}, d AS (SELECT symbol, coalesce(close_time, open_time)::DATE AS dt, sum(coalesce(profit, 0)) AS dp FROM trades GROUP BY 1, 2)
SELECT symbol, count(*) AS days, round(avg(dp) / stddev_samp(dp) * {SQRT}, 6) AS sharpe FROM d GROUP BY 1""")
def daily_sharpe(spark, folder):
    return R.daily_sharpe(T.trades(spark, folder), ["symbol"]).select("symbol", "days", r("sharpe", 6))


@query("trade_review", f"""{W}, a AS (SELECT count(*) AS n, sum(profit) AS pnl, count(*) FILTER (WHERE profit > 0) AS w, avg(profit) FILTER (WHERE profit > 0) AS aw,
  avg(profit) FILTER (WHERE profit < 0) AS al, sum(profit) FILTER (WHERE profit > 0) AS sw, sum(-profit) FILTER (WHERE profit < 0) AS sl, max(profit) AS mx, min(profit) AS mn,
  avg(CASE WHEN abs(open_price - sl) > 0 THEN abs(tp - open_price) / abs(open_price - sl) END) AS rr FROM c)
SELECT n AS trades, round(w / n, 6) AS win_rate, round(pnl, 2) AS total_pnl, round(sw / sl, 6) AS profit_factor, round(w / n * aw + (1 - w / n) * al, 6) AS expectancy,
  round(aw, 6) AS avg_win, round(al, 6) AS avg_loss, round(abs(aw / al), 6) AS realised_rr, mx AS largest_win, mn AS largest_loss, round(rr, 6) AS avg_expected_rr FROM a""")
def trade_review(spark, folder):
    v = R.review(T.trades(spark, folder))
    cols = ("win_rate", "profit_factor", "expectancy", "avg_win", "avg_loss", "realised_rr", "avg_expected_rr")
    return v.select("trades", r("total_pnl", 2), "largest_win", "largest_loss", *[r(c, 6) for c in cols])


@query("trade_breakdown", f"""{W}, t AS (SELECT *, hour(open_time) AS h FROM c), u AS (
  SELECT 'weekday' AS "by", dayname(open_time) AS value, profit FROM t UNION ALL SELECT 'symbol', symbol, profit FROM t UNION ALL
  SELECT 'session', CASE WHEN h >= 7 AND h < 16 THEN 'London' WHEN h >= 12 AND h < 21 THEN 'New York' WHEN h < 9 THEN 'Tokyo' WHEN h >= 22 THEN 'Sydney' ELSE 'Off-session' END, profit FROM t)
SELECT "by", value, count(*) AS trades, round(avg(CASE WHEN profit > 0 THEN 1.0 ELSE 0.0 END), 6) AS win_rate, round(sum(profit), 2) AS pnl FROM u GROUP BY 1, 2""")
def trade_breakdown(spark, folder):
    return R.breakdown(T.trades(spark, folder)).select("by", "value", "trades", r("win_rate", 6), r("pnl", 2))


@query("trade_extremes", f"""{W}, a AS (SELECT 'worst' AS list, row_number() OVER (ORDER BY profit, ticket) AS rank, * FROM c QUALIFY rank <= 5),
b AS (SELECT 'best' AS list, row_number() OVER (ORDER BY profit DESC, ticket) AS rank, * FROM c QUALIFY rank <= 5),
n AS (SELECT 'newest' AS list, row_number() OVER (ORDER BY close_time DESC, ticket DESC) AS rank, * FROM c QUALIFY rank <= 10),
u AS (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM n)
SELECT list, rank, ticket, symbol, type, profit, open_time, close_time FROM u""")
def trade_extremes(spark, folder):
    return R.extremes(T.trades(spark, folder))


@query("kelly_at_entry", f"""WITH {TRADES}, ev AS (SELECT close_time AS t, 0 AS side, ticket, profit AS p FROM trades WHERE close_time IS NOT NULL
  UNION ALL SELECT open_time, 1, ticket, NULL FROM trades),
s AS (SELECT *, count(p) OVER w AS n, count(CASE WHEN p > 0 THEN 1 END) OVER w AS w_n, count(CASE WHEN p < 0 THEN 1 END) OVER w AS l_n,
  sum(CASE WHEN p > 0 THEN p END) OVER w AS sw, sum(CASE WHEN p < 0 THEN -p END) OVER w AS sl FROM ev WINDOW w AS (ORDER BY t, side, ticket)),
k AS (SELECT *, (sw / w_n) / (sl / l_n) AS b, w_n / n AS wr FROM s WHERE side = 1)
SELECT ticket, t AS open_time, n AS history, round(CASE WHEN n < 30 THEN 0.25 WHEN w_n = 0 THEN 0 WHEN l_n = 0 THEN 0.25
  ELSE least(0.25, greatest(0.0, 0.5 * (b * wr - (1 - wr)) / b)) END, 8) AS kelly FROM k""")
def kelly_at_entry(spark, folder):
    return R.kelly_at_entry(T.trades(spark, folder)).select("ticket", "open_time", "history", r("kelly"))


@query("circuit_breakers", f"""{W}, e AS (SELECT *, 10000 + sum(profit) OVER (ORDER BY close_time, ticket) AS equity, close_time::DATE AS d FROM c),
p AS (SELECT *, greatest(10000.0, max(equity) OVER (ORDER BY close_time, ticket)) AS peak, sum(CASE WHEN profit >= 0 THEN 1 ELSE 0 END) OVER (ORDER BY close_time, ticket) AS grp FROM e),
dy AS (SELECT d, sum(profit) AS dp FROM e GROUP BY 1), ds AS (SELECT d, 10000 + coalesce(sum(dp) OVER (ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS day_start FROM dy),
s AS (SELECT p.*, day_start, sum(CASE WHEN profit < 0 THEN 1 ELSE 0 END) OVER (PARTITION BY grp ORDER BY close_time, ticket)::BIGINT AS streak FROM p JOIN ds USING (d))
SELECT ticket, close_time, round(equity, 2) AS equity, round(peak, 2) AS peak, round(day_start, 2) AS day_start, streak,
  CASE WHEN peak > 0 AND (peak - equity) / peak >= 0.2 THEN 'trailing_dd_halt' WHEN streak >= 5 THEN 'consecutive_losses'
    WHEN day_start > 0 AND (equity - day_start) / day_start <= -0.02 THEN 'daily_loss_limit' ELSE 'ok' END AS reason FROM s""")
def circuit_breakers(spark, folder):
    b = R.breakers(T.trades(spark, folder))
    return b.select("ticket", "close_time", r("equity", 2), r("peak", 2), r("day_start", 2), "streak", "reason")


@query("log_delta", f"""WITH {TRADES}, a AS (SELECT count(*) AS n, count(close_time) AS c, sum(profit) AS p, max(open_time) AS last FROM trades)
SELECT n AS trade_count, n - 100 AS delta, list_filter([CASE WHEN NOT p >= 0 THEN 'losing' END, CASE WHEN NOT c < n THEN 'nothing_open' END, CASE WHEN NOT last >= TIMESTAMP '1998-01-01' THEN 'bot_not_running' END,
  CASE WHEN NOT c * 2 >= n THEN 'mostly_open' END], lambda x: x IS NOT NULL) AS alerts FROM a""")
def log_delta(spark, folder):
    t = T.trades(spark, folder)
    checks = {"losing": F.sum("profit") >= 0, "nothing_open": F.count("close_time") < F.count(F.lit(1)), "bot_not_running": F.max("open_time") >= F.lit("1998-01-01").cast("timestamp"),
              "mostly_open": F.count("close_time") * 2 >= F.count(F.lit(1))}
    return R.log_delta(t, 100, checks)


JPY = "CASE WHEN symbol IN ('1-URGENT', '5-LOW') THEN 'USDJPY' ELSE symbol END"


def with_jpy(spark, folder):
    sym = F.when(F.col("symbol").isin("1-URGENT", "5-LOW"), F.lit("USDJPY")).otherwise(F.col("symbol"))
    return R.closed_trades(T.trades(spark, folder)).withColumn("symbol", sym)


@query("gross_pnl", f"""{W} SELECT ticket, round((CASE WHEN type = 'SELL' THEN -1 ELSE 1 END) * (close_price - open_price) / (CASE WHEN {JPY} = 'USDJPY' THEN 0.01 ELSE 0.0001 END) * 10 * 0.1, 6) AS gross FROM c""")
def gross_pnl(spark, folder):
    t = with_jpy(spark, folder)
    g = money.gross_pnl(F.col("type"), F.col("open_price"), F.col("close_price"), F.col("volume"), money.pip_size(F.col("symbol")))
    return t.select("ticket", r(g, 6, "gross"))


@query("trade_costs", f"""{W}, s AS (SELECT ticket, {JPY} AS symbol, profit < 0 AS stop FROM c),
k AS (SELECT *, CASE symbol WHEN '2-HIGH' THEN 0.8 WHEN 'USDJPY' THEN 1.5 ELSE 1.0 END AS sp, CASE symbol WHEN '2-HIGH' THEN 0.5 ELSE 0.7 END AS sl, CASE symbol WHEN '2-HIGH' THEN 3.5 ELSE 0.0 END AS co FROM s)
SELECT ticket, symbol, round((sp * 10 * 0.1)::DOUBLE + CASE WHEN stop THEN sl * 10 * 0.1 ELSE 0 END + 2 * co * 0.1, 6) AS cost FROM k""")
def trade_costs(spark, folder):
    """Own cost row for one symbol, a default row without spread for the others."""
    costs = spark.createDataFrame(
        [("2-HIGH", 0.8, None, 3.5), ("default", None, 0.7, None)],
        "symbol string, spread_pips double, slippage_pips double, commission_per_lot double",
    )
    t = J.with_costs(with_jpy(spark, folder), costs)
    cost = money.trade_cost(F.col("volume"), F.col("profit") < 0, F.col("spread_pips"), F.col("slippage_pips"), F.col("commission_per_lot"))
    return t.select("ticket", "symbol", r(cost, 6, "cost"))


@query("paper_pnl", f"""{W} SELECT ticket, round((CASE WHEN type = 'SELL' THEN -1 ELSE 1 END) * (close_price - open_price) / 0.0001 * 10 * 0.1, 2) AS pnl FROM c""")
def paper_pnl(spark, folder):
    t = R.closed_trades(T.trades(spark, folder))
    return t.select("ticket", money.paper_pnl(F.col("type"), F.col("volume"), F.col("open_price"), F.col("close_price")).alias("pnl"))


SIZE_IN = "SELECT o_orderkey AS ticket, o_totalprice / 10.0 AS balance, (o_custkey % 50) / 20000.0 AS atr, (o_custkey % 4) / 12.0 AS kelly, (o_custkey % 3) / 3.0 AS rho FROM orders"


@query("position_size", f"""WITH s AS ({SIZE_IN}), l AS (SELECT *, least(balance * 0.01 / (atr * 1.5 / 0.0001 * 10.0) * kelly * greatest(0.0, 1.0 - rho), 10.0) AS lots FROM s)
SELECT ticket, CASE WHEN balance <= 0 OR atr <= 0 THEN 0.01 ELSE greatest(0.01, round(round(lots / 0.01) * 0.01, 2)) END::DOUBLE AS lots FROM l""")
def position_size(spark, folder):
    o = T.table(spark, folder, "orders")
    s = o.select(F.col("o_orderkey").alias("ticket"), (F.col("o_totalprice") / F.lit(10.0)).alias("balance"), (F.col("o_custkey") % 50 / F.lit(20000.0)).alias("atr"),
                 (F.col("o_custkey") % 4 / F.lit(12.0)).alias("kelly"), (F.col("o_custkey") % 3 / F.lit(3.0)).alias("rho"))
    return s.select("ticket", sizing.position_size(F.col("balance"), F.col("atr"), F.col("kelly"), F.col("rho")).alias("lots"))


@query("drawdown_factors", """WITH s AS (SELECT o_orderkey AS ticket, 500000.0 AS peak, o_totalprice AS equity FROM orders), d AS (SELECT *, greatest(0.0, (peak - equity) / peak) AS dd FROM s)
SELECT ticket, CASE WHEN dd >= 0.2 THEN 0.0 WHEN dd >= 0.15 THEN 0.5 WHEN dd >= 0.1 THEN 0.7 ELSE 1.0 END::DOUBLE AS size_factor,
  CASE WHEN dd >= 0.2 THEN 0.0 WHEN dd >= 0.15 THEN 0.25 WHEN dd >= 0.1 THEN 0.5 ELSE 1.0 END::DOUBLE AS preservation FROM d""")
def drawdown_factors(spark, folder):
    o = T.table(spark, folder, "orders")
    peak, equity = F.lit(500000.0), F.col("o_totalprice")
    return o.select(F.col("o_orderkey").alias("ticket"), sizing.drawdown_size_factor(peak, equity).alias("size_factor"), sizing.preservation_factor(peak, equity).alias("preservation"))


@query("expected_rr", f"WITH {TRADES} SELECT ticket, round(CASE WHEN abs(open_price - sl) > 0 THEN abs(tp - open_price) / abs(open_price - sl) ELSE 0 END, 6) AS rr FROM trades")
def expected_rr(spark, folder):
    return T.trades(spark, folder).select("ticket", r(money.expected_rr(F.col("open_price"), F.col("sl"), F.col("tp")), 6, "rr"))


POSITIONS = f"""WITH {TICKS}, p AS (SELECT event_id AS ticket, event_type AS symbol, CASE WHEN event_id % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side, 1.0 + (event_id % 100) / 10000.0 AS open_price,
  CASE WHEN event_id % 5 = 0 THEN 0.0 ELSE 1.0 + (event_id % 100) / 10000.0 + 0.0035 END AS tp, 0.01 * (1 + event_id % 30) AS volume FROM events),
l AS (SELECT symbol, arg_max(bid, seq) AS bid, arg_max(ask, seq) AS ask FROM ticks GROUP BY 1)"""


@query("target_actions", f"""{POSITIONS} SELECT ticket, CASE WHEN side = 'BUY' THEN round(open_price + 0.0001, 5) ELSE round(open_price - 0.0001, 5) END AS new_sl,
  tp <> 0 AND ((side = 'BUY' AND bid >= tp) OR (side = 'SELL' AND ask <= tp)) AS reached FROM p JOIN l USING (symbol)""")
def target_actions(spark, folder):
    """Break-even stop and first-target touch of positions against the latest tick."""
    t = T.ticks(spark, folder)
    entry = F.lit(1.0) + F.col("seq") % 100 / F.lit(10000.0)
    pos = t.select(F.col("seq").alias("ticket"), "symbol", F.when(F.col("seq") % 2 == 0, F.lit("BUY")).otherwise(F.lit("SELL")).alias("side"),
                   entry.alias("open_price"), F.when(F.col("seq") % 5 == 0, F.lit(0.0)).otherwise(entry + F.lit(0.0035)).alias("tp"))
    last = t.groupBy("symbol").agg(F.max_by("bid", "seq").alias("bid"), F.max_by("ask", "seq").alias("ask"))
    j = pos.join(last, "symbol")
    return j.select("ticket", money.break_even_stop(F.col("side"), F.col("open_price")).alias("new_sl"),
                    money.target_reached(F.col("side"), F.col("tp"), F.col("bid"), F.col("ask")).alias("reached"))


@query("partial_close", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, round(l_quantity * 0.3, 2) AS closed, round(l_quantity - round(l_quantity * 0.3, 2), 2) AS remaining FROM lineitem""")
def partial_close(spark, folder):
    li = T.table(spark, folder, "lineitem")
    v = F.col("l_quantity")
    return li.select("l_orderkey", F.col("l_linenumber"), "l_partkey", "l_suppkey", "l_extendedprice",
                     money.closed_volume(v, 0.3).alias("closed"), money.remaining_volume(v, 0.3).alias("remaining"))


ERF = """(1.0 - ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * exp(-x * x))"""


@query("probabilistic_sharpe", f"""WITH {TRIALS}, z AS (SELECT sr_id, sharpe * sqrt(greatest(trades - 1, 0)) / sqrt(1.0 + 0.5 * sharpe * sharpe) AS z, trades FROM trials),
e AS (SELECT *, abs(z) / sqrt(2.0) AS x, 1.0 / (1.0 + 0.3275911 * abs(z) / sqrt(2.0)) AS t FROM z)
SELECT sr_id, round(CASE WHEN trades < 2 THEN 0.0 ELSE 0.5 * (1.0 + CASE WHEN z < 0 THEN -1 ELSE 1 END * {ERF}) END, 6) AS psr FROM e""")
def probabilistic_sharpe(spark, folder):
    t = T.trials(spark, folder)
    return t.select("sr_id", r(scores.probabilistic_sharpe(F.col("sharpe"), F.col("trades")), 6, "psr"))


@query("journal_metrics", f"""SELECT trade_count, no_losses, {", ".join(STATS)}, round(CASE WHEN trade_count < 2 THEN 0.0 ELSE 0.5 * (1.0 + CASE WHEN z < 0 THEN -1 ELSE 1 END * {ERF}) END, 5) AS dsr
FROM (SELECT *, abs(z) / sqrt(2.0) AS x, 1.0 / (1.0 + 0.3275911 * abs(z) / sqrt(2.0)) AS t
  FROM (SELECT *, sharpe * sqrt(greatest(trade_count - 1, 0)) / sqrt(1.0 + 0.5 * sharpe * sharpe) AS z FROM ({stats_sql("")})))""")
def journal_metrics(spark, folder):
    """The closed trades of one journal with the probability of their Sharpe."""
    m = R.journal_metrics(T.trades(spark, folder))
    return m.select("trade_count", "no_losses", *[r(c, 6) for c in STATS], r("dsr", 5))
