"""Queries on trials, runs, iterations and position snapshots."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import scores
from ..operators import experiments as X
from ..operators import joins as J
from ..operators import positions as P
from ..operators.bars import first_by_key
from ..sources import tables as T
from .registry import ITERATIONS, RUNS, SNAPSHOTS, SWEEP_LOG, TICKS, TRIALS, query, r

E_MAX = f"(sqrt(2 * ln(n)) - (ln(ln(n)) + {math.log(4 * math.pi)!r}) / (2 * sqrt(2 * ln(n))))"
DSR = f"""WITH {TRIALS}, a AS (SELECT count(*)::DOUBLE AS n, avg(sharpe) AS m, stddev_samp(sharpe) AS s FROM trials),
d AS (SELECT t.*, sharpe - (m + s * {E_MAX}) AS dsr FROM trials t, a)"""


@query("deflated_sharpe", f"{DSR} SELECT sr_id, round(sharpe, 6) AS sharpe, round(dsr, 6) AS dsr FROM d")
def deflated_sharpe(spark, folder):
    return X.with_global_dsr(T.trials(spark, folder)).select("sr_id", r("sharpe", 6), r("dsr", 6))


@query("deflated_sharpe_running", f"""WITH {SWEEP_LOG}, a AS (SELECT *, count(*) OVER w AS n, avg(sharpe) OVER w AS m, stddev_samp(sharpe) OVER w AS s
  FROM log WINDOW w AS (PARTITION BY strategy ORDER BY iteration))
SELECT iteration, strategy, round(CASE WHEN n < 2 OR s < 1e-7 THEN sharpe WHEN n = 2 THEN sharpe - (m + s * 0.5641895835) ELSE sharpe - (m + s * {E_MAX.replace("ln(n)", "ln(greatest(n, 3))")}) END, 6) AS dsr_so_far FROM a""")
def deflated_sharpe_running(spark, folder):
    d = X.with_running_dsr(T.sweep_log(spark, folder), ["strategy"])
    return d.select("iteration", "strategy", r("dsr_so_far", 6))


@query("trial_ranking", f"{DSR} SELECT sr_id, mapped_type, round(dsr, 6) AS dsr, row_number() OVER (ORDER BY dsr DESC, sr_id) AS rank FROM d")
def trial_ranking(spark, folder):
    return X.ranked(X.with_global_dsr(T.trials(spark, folder))).select("sr_id", "mapped_type", r("dsr", 6), "rank")


@query("trial_titles", f"""WITH {TRIALS}, b AS (SELECT DISTINCT p_brand AS slug, 'Book ' || p_brand AS title FROM part WHERE p_brand < 'Brand#2')
SELECT sr_id, book_slug, coalesce(title, book_slug) AS title FROM trials LEFT JOIN b ON slug = book_slug""")
def trial_titles(spark, folder):
    t = T.trials(spark, folder)
    titles = t.where(F.col("book_slug") < "Brand#2").select("book_slug", F.concat(F.lit("Book "), F.col("book_slug")).alias("title")).distinct()
    return J.lookup_title(t, titles).select("sr_id", "book_slug", "title")


@query("trial_clusters", f"{DSR} SELECT mapped_type, sr_id, row_number() OVER (PARTITION BY mapped_type ORDER BY dsr DESC, sr_id) AS rank_in_type, count(*) OVER (PARTITION BY mapped_type) AS members FROM d")
def trial_clusters(spark, folder):
    return X.clusters(X.with_global_dsr(T.trials(spark, folder))).select("mapped_type", "sr_id", "rank_in_type", "members")


@query("best_trials", f"{DSR} SELECT sr_id, round(dsr, 6) AS dsr FROM d ORDER BY d.dsr DESC, sr_id LIMIT 15")
def best_trials(spark, folder):
    return X.best_trials(X.with_global_dsr(T.trials(spark, folder))).select("sr_id", r("dsr", 6))


@query("trial_summary", f"WITH {TRIALS} SELECT count(*) AS total, count(*) FILTER (WHERE guard = 'PASS') AS validated FROM trials")
def trial_summary(spark, folder):
    return X.trial_summary(T.trials(spark, folder))


def units(spark, folder):
    t = T.trials(spark, folder)
    n = t.groupBy("book_slug").agg(F.max("trades").alias("m"), F.count(F.lit(1)).alias("n"))
    status = F.when(F.col("n") % 4 == 0, F.lit("running")).when(F.col("n") % 4 == 1, F.lit("complete")).when(F.col("n") % 4 == 2, F.lit("failed")).otherwise(F.lit("complete_no_strategies"))
    return n.select("book_slug", status.alias("status"))


UNITS = f"""WITH {TRIALS}, u AS (SELECT book_slug, CASE count(*) % 4 WHEN 0 THEN 'running' WHEN 1 THEN 'complete' WHEN 2 THEN 'failed' ELSE 'complete_no_strategies' END AS status FROM trials GROUP BY 1)"""


@query("unit_status", f"{UNITS} SELECT status, count(*) AS units, status <> 'running' AS terminal FROM u GROUP BY 1")
def unit_status(spark, folder):
    return X.unit_status(units(spark, folder))


@query("pending_units", f"{UNITS} SELECT book_slug, status FROM u WHERE status = 'running'")
def pending_units(spark, folder):
    return X.pending_units(units(spark, folder))


RI = f"WITH {RUNS}, {ITERATIONS}, j AS (SELECT r.*, i.timestamp AS ts FROM runs r JOIN iterations i ON r.iteration_id = i.id)"


@query("mean_sharpe_around", f"""{RI} SELECT (SELECT round(avg(sharpe), 6) FROM j WHERE ts < TIMESTAMP '1998-06-01') AS mean_before,
  (SELECT round(avg(sharpe), 6) FROM j WHERE ts > TIMESTAMP '1998-06-01') AS mean_after""")
def mean_sharpe_around(spark, folder):
    m = X.mean_sharpe_around(T.runs(spark, folder), T.iterations(spark, folder), "1998-06-01")
    return m.select(r("mean_before", 6), r("mean_after", 6))


@query("mean_sharpe_nearest", f"""{RI}, b AS (SELECT sharpe FROM j WHERE ts < TIMESTAMP '1998-06-01' ORDER BY iteration_id DESC, id DESC LIMIT 8),
a AS (SELECT sharpe FROM j WHERE ts > TIMESTAMP '1998-06-01' ORDER BY iteration_id, id LIMIT 8)
SELECT (SELECT round(avg(sharpe), 6) FROM b) AS mean_before, (SELECT round(avg(sharpe), 6) FROM a) AS mean_after""")
def mean_sharpe_nearest(spark, folder):
    m = X.mean_sharpe_around(T.runs(spark, folder), T.iterations(spark, folder), "1998-06-01", 8)
    return m.select(r("mean_before", 6), r("mean_after", 6))


@query("runs_with_iterations", f"{RI} SELECT id, iteration_id, symbol, sharpe, ts AS timestamp FROM j WHERE ts < TIMESTAMP '1996-01-01' ORDER BY id DESC LIMIT 500")
def runs_with_iterations(spark, folder):
    i = T.iterations(spark, folder).select(F.col("id").alias("iteration_id"), "timestamp")
    j = T.runs(spark, folder).join(i, "iteration_id").where(F.col("timestamp") < F.lit("1996-01-01").cast("timestamp"))
    return j.orderBy(F.desc("id")).limit(500).select("id", "iteration_id", "symbol", "sharpe", "timestamp")


@query("nearest_runs", f"""{RI} SELECT symbol, timeframe, strategy, arg_max(sharpe, (iteration_id, id)) FILTER (WHERE ts < TIMESTAMP '1998-06-01') AS before,
  arg_min(sharpe, (iteration_id, id)) FILTER (WHERE ts > TIMESTAMP '1998-06-01') AS after,
  coalesce(arg_min(sharpe, (iteration_id, id)) FILTER (WHERE ts > TIMESTAMP '1998-06-01') > arg_max(sharpe, (iteration_id, id)) FILTER (WHERE ts < TIMESTAMP '1998-06-01'), FALSE) AS improved
FROM j GROUP BY 1, 2, 3""")
def nearest_runs(spark, folder):
    return X.nearest_runs(T.runs(spark, folder), T.iterations(spark, folder), "1998-06-01")


@query("latest_runs", f"WITH {RUNS} SELECT symbol, timeframe, strategy, id, sharpe, row_number() OVER (PARTITION BY symbol, timeframe, strategy ORDER BY id DESC) AS recency FROM runs QUALIFY recency <= 5")
def latest_runs(spark, folder):
    return X.last_rows(T.runs(spark, folder), X.COMBO, "id", 5).select(*X.COMBO, "id", "sharpe", "recency")


@query("last_promoted", f"WITH {RUNS} SELECT symbol, timeframe, strategy, max(id) AS id FROM runs WHERE promoted = 1 GROUP BY 1, 2, 3")
def last_promoted(spark, folder):
    return X.last_promoted(T.runs(spark, folder)).select(*X.COMBO, "id")


@query("quiet_iterations", f"""WITH {ITERATIONS}, l AS (SELECT *, row_number() OVER (ORDER BY id DESC) AS n FROM iterations QUALIFY n <= 30)
SELECT coalesce(min(n) FILTER (WHERE combos_promoted <> 0) - 1, count(*)) AS quiet FROM l""")
def quiet_iterations(spark, folder):
    return X.quiet_iterations(T.iterations(spark, folder))


@query("degrading_combos", f"""WITH {RUNS}, l AS (SELECT *, row_number() OVER (PARTITION BY symbol, timeframe, strategy ORDER BY id DESC) AS n FROM runs QUALIFY n <= 5),
a AS (SELECT symbol, timeframe, strategy, list(dsr ORDER BY n) AS d, avg(dsr) AS m FROM l WHERE dsr IS NOT NULL GROUP BY 1, 2, 3)
SELECT symbol, timeframe, strategy, d[1] AS latest, round(m, 6) AS trailing_mean, coalesce(len(d) >= 3 AND d[1] < d[2] AND d[2] < d[3] AND d[1] < m - 0.5, FALSE) AS degrading FROM a""")
def degrading_combos(spark, folder):
    return X.degrading(T.runs(spark, folder)).select(*X.COMBO, "latest", r("trailing_mean", 6), "degrading")


@query("repeated_pairs", f"""WITH {SWEEP_LOG}, l AS (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY iteration DESC) AS n FROM log QUALIFY n <= 20)
SELECT strategy, param, new_val, count(*) AS times FROM l GROUP BY 1, 2, 3 HAVING count(*) >= 3""")
def repeated_pairs(spark, folder):
    return X.repeated_pairs(T.sweep_log(spark, folder))


@query("flat_runs", f"""WITH {SWEEP_LOG}, l AS (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY iteration) AS n, abs(sharpe - lag(sharpe) OVER (PARTITION BY strategy ORDER BY iteration)) AS d FROM log)
SELECT strategy, max(n) - max(CASE WHEN d >= 0.01 OR d IS NULL THEN n END) AS flat_run, max(n) - max(CASE WHEN d >= 0.01 OR d IS NULL THEN n END) >= 8 AS stalled FROM l GROUP BY 1""")
def flat_runs(spark, folder):
    return X.flat_runs(T.sweep_log(spark, folder))


@query("daily_attempts", f"WITH {TICKS} SELECT time::DATE AS utc_date, count(*) AS attempts FROM ticks GROUP BY 1")
def daily_attempts(spark, folder):
    return X.daily_attempts(T.ticks(spark, folder))


@query("cooldowns", f"""WITH {TICKS} SELECT symbol AS cause, max(time) AS last_time, epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(max(time)) >= 1200000000 AS ready FROM ticks GROUP BY 1""")
def cooldowns(spark, folder):
    return X.cooldowns(T.ticks(spark, folder).withColumnRenamed("symbol", "cause"), "2024-01-31 00:00:00", 1200)


@query("false_halts", """SELECT o_orderkey AS account, o_totalprice / 20.0 AS peak_equity, 1700000000.0::DOUBLE + o_custkey AS cooling_off_until, 9700.0 + (o_custkey % 500) AS equity FROM orders
WHERE o_totalprice / 20.0 > 10500 AND 1700000000.0::DOUBLE + o_custkey > 1700000700.0 AND 9700.0 + (o_custkey % 500) BETWEEN 9800 AND 10100""".replace("9700.0 +", "9700.0::DOUBLE +"))
def false_halts(spark, folder):
    o = T.table(spark, folder, "orders")
    acc = o.select(F.col("o_orderkey").alias("account"), (F.col("o_totalprice") / F.lit(20.0)).alias("peak_equity"),
                   (F.lit(1700000000.0) + F.col("o_custkey")).alias("cooling_off_until"), (F.lit(9700.0) + F.col("o_custkey") % 500).alias("equity"))
    return X.false_halts(acc, 1700000700.0)


@query("new_regressions", """WITH f AS (SELECT event_id, 'cycle_' || (user_id % 4) AS regression_type, CASE WHEN user_id % 3 <> 0 THEN 'combo_' || (user_id % 30) END AS combo_slug FROM events WHERE event_type = 'error'),
o AS (SELECT 'cycle_' || (user_id % 4) AS t, CASE WHEN user_id % 3 <> 0 THEN 'combo_' || (user_id % 30) END AS c FROM events WHERE event_type = 'view' AND value > 150)
SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM o WHERE t = regression_type AND c IS NOT DISTINCT FROM combo_slug)""")
def new_regressions(spark, folder):
    ev = T.table(spark, folder, "events")
    kind = F.concat(F.lit("cycle_"), (F.col("user_id") % 4).cast("string")).alias("regression_type")
    combo = F.when(F.col("user_id") % 3 != 0, F.concat(F.lit("combo_"), (F.col("user_id") % 30).cast("string"))).alias("combo_slug")
    found = ev.where(F.col("event_type") == "error").select("event_id", kind, combo)
    status = F.when(F.col("value") > 150, F.lit("detected")).otherwise(F.lit("merged")).alias("status")
    known = ev.where(F.col("event_type") == "view").select(kind, combo, status)
    return X.not_already_open(found, known)


@query("keep_or_rollback", f"""WITH {SWEEP_LOG}, b AS (SELECT strategy, arg_min(sharpe, iteration) AS bs, arg_min(win_rate, iteration) AS bw FROM log GROUP BY 1)
SELECT iteration, strategy, CASE WHEN max_dd < 5 OR (sharpe > bs AND win_rate >= bw) THEN 'keep' ELSE 'rollback' END AS verdict FROM log JOIN b USING (strategy)""")
def keep_or_rollback(spark, folder):
    log = T.sweep_log(spark, folder)
    base = log.groupBy("strategy").agg(F.min_by("sharpe", "iteration").alias("base_sharpe"), F.min_by("win_rate", "iteration").alias("base_win_rate"))
    return X.decide(log.withColumn("guard_pass", F.col("max_dd") < 5), base).select("iteration", "strategy", "verdict")


@query("guard_and_promotion", f"""{DSR} SELECT sr_id, sharpe > 1.5 AND max_dd / 100.0 < 0.05 AND win_rate / 100.0 > (CASE WHEN mapped_type = 'SMALL' THEN 0.5 ELSE 0.3 END) AS guard_pass,
  list_filter([CASE WHEN sharpe > 1.5 THEN NULL ELSE 'sharpe' END, CASE WHEN max_dd / 100.0 < 0.05 THEN NULL ELSE 'drawdown' END,
    CASE WHEN win_rate / 100.0 > (CASE WHEN mapped_type = 'SMALL' THEN 0.5 ELSE 0.3 END) THEN NULL ELSE 'win_rate' END], lambda x: x IS NOT NULL) AS failed,
  dsr > 0 AND guard = 'PASS' AS promotable, CASE WHEN dsr > 0.5 THEN 'high' WHEN dsr > 0 THEN 'moderate' ELSE 'noise' END AS confidence FROM d""")
def guard_and_promotion(spark, folder):
    t = X.with_global_dsr(T.trials(spark, folder))
    kind = F.when(F.col("mapped_type") == "SMALL", F.lit("mean_reversion")).otherwise(F.lit("ema_crossover"))
    failed = scores.guard_reasons(F.col("sharpe"), F.col("max_dd") / F.lit(100.0), F.col("win_rate") / F.lit(100.0), win_floor=scores.win_floor_for(kind))
    return t.select("sr_id", (F.size(failed) == 0).alias("guard_pass"), failed.alias("failed"),
                    scores.promotable(F.col("dsr"), F.col("guard"), F.lit(None).cast("string")).alias("promotable"), scores.confidence(F.col("dsr")).alias("confidence"))


CURRENT = "p AS (SELECT p_partkey AS param, p_size::DOUBLE AS old, 0.5::DOUBLE AS step, 3.0::DOUBLE AS lo, 48.0::DOUBLE AS hi FROM part)"


@query("parameter_neighbours", f"""WITH {CURRENT}, m AS (SELECT * FROM (VALUES (0, 1.0), (1, -1.0), (2, 2.0), (3, -2.0), (4, 3.0), (5, -3.0), (6, 5.0), (7, -5.0)) t(priority, k)),
c AS (SELECT param, old, priority, round(greatest(lo, least(hi, old + k::DOUBLE * step)), 4) AS value FROM p, m),
g AS (SELECT param, old, value, min(priority)::BIGINT AS priority FROM c WHERE value <> old GROUP BY 1, 2, 3),
v AS (SELECT DISTINCT l_partkey AS param, l_quantity AS value FROM lineitem)
SELECT * FROM g WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.param = g.param AND v.value = g.value)""")
def parameter_neighbours(spark, folder):
    p = T.table(spark, folder, "part").select(F.col("p_partkey").alias("param"), F.col("p_size").cast("double").alias("old"),
                                              F.lit(0.5).alias("step"), F.lit(3.0).alias("lo"), F.lit(48.0).alias("hi"))
    visited = T.table(spark, folder, "lineitem").select(F.col("l_partkey").alias("param"), F.col("l_quantity").alias("value"))
    return J.without_visited(X.neighbours(p), visited)


@query("grid_positions", f"""WITH {CURRENT} SELECT param, greatest(0, least(90, round((old - lo) / step)))::BIGINT AS idx, lo + greatest(0, least(90, round((old - lo) / step))) * step AS value FROM p""")
def grid_positions(spark, folder):
    p = T.table(spark, folder, "part").select(F.col("p_partkey").alias("param"), F.col("p_size").cast("double").alias("old"))
    lo, hi, step = F.lit(3.0), F.lit(48.0), F.lit(0.5)
    idx = X.grid_index(lo, hi, step, F.col("old"))
    return p.select("param", idx.alias("idx"), X.grid_value(lo, step, idx).alias("value"))


@query("pareto_front", f"""WITH {TRIALS} SELECT sr_id FROM trials t WHERE NOT EXISTS (SELECT 1 FROM trials o WHERE o.sharpe >= t.sharpe AND o.max_dd <= t.max_dd AND o.win_rate >= t.win_rate
  AND (o.sharpe > t.sharpe OR o.max_dd < t.max_dd OR o.win_rate > t.win_rate))""")
def pareto_front(spark, folder):
    return X.pareto_front(T.trials(spark, folder)).select("sr_id")


@query("across_symbols", f"""WITH {RUNS} SELECT iteration_id, round(avg(sharpe), 6) AS sharpe, round(avg(promoted), 6) AS win_rate, max(-sharpe) AS max_dd, bool_and(guard = 'PASS') AS guard_pass FROM runs GROUP BY 1""")
def across_symbols(spark, folder):
    res = T.runs(spark, folder).select("iteration_id", "sharpe", F.col("promoted").alias("win_rate"), (-F.col("sharpe")).alias("max_dd"), (F.col("guard") == "PASS").alias("guard_pass"))
    a = X.across_symbols(res, ["iteration_id"])
    return a.select("iteration_id", r("sharpe", 6), r("win_rate", 6), "max_dd", "guard_pass")


@query("strategy_challenge", f"""WITH {RUNS}, a AS (SELECT symbol, avg(sharpe) FILTER (WHERE strategy = 'ema_crossover') AS c, avg(sharpe) FILTER (WHERE strategy = 'mean_reversion') AS h FROM runs GROUP BY 1)
SELECT symbol, round(c, 6) AS current_sharpe, round(h, 6) AS challenger_sharpe, CASE WHEN h > c * 1.1 THEN 'mean_reversion' ELSE 'ema_crossover' END AS strategy FROM a""")
def strategy_challenge(spark, folder):
    c = X.challenge(T.runs(spark, folder), "ema_crossover", "mean_reversion")
    return c.select("symbol", r("current_sharpe", 6), r("challenger_sharpe", 6), "strategy")


@query("combo_grid", f"""WITH {RUNS} SELECT s.symbol, t.timeframe, g.strategy FROM (SELECT DISTINCT symbol FROM runs) s, (SELECT DISTINCT timeframe FROM runs) t, (SELECT DISTINCT strategy FROM runs) g""")
def combo_grid(spark, folder):
    runs = T.runs(spark, folder)
    # timeframes and strategies are short fixed lists
    return J.combos(runs.select("symbol").distinct(), runs.select("timeframe").distinct(), runs.select("strategy").distinct())


POS_EV = f"""WITH {SNAPSHOTS}, pn AS (SELECT poll, row_number() OVER (ORDER BY poll) AS no FROM (SELECT DISTINCT poll FROM snaps)),
l AS (SELECT s.*, no, lag(no) OVER w AS pno, lag(sl) OVER w AS psl, lag(tp) OVER w AS ptp, lag(volume) OVER w AS pv FROM snaps s JOIN pn USING (poll) WINDOW w AS (PARTITION BY ticket ORDER BY no)),
e AS (SELECT *, CASE WHEN pno = no - 1 THEN FALSE ELSE TRUE END AS fresh, (CASE WHEN sl <> psl THEN ['sl'] ELSE [] END || CASE WHEN tp <> ptp THEN ['tp'] ELSE [] END || CASE WHEN volume <> pv THEN ['volume'] ELSE [] END) AS ch FROM l),
ev AS (SELECT poll, ticket, symbol, CASE WHEN fresh THEN 'opened' ELSE 'modified' END AS event, sl, tp, volume, CASE WHEN fresh THEN [] ELSE ch END AS changes FROM e WHERE fresh OR len(ch) > 0)"""


@query("position_changes", f"{POS_EV} SELECT * FROM ev")
def position_changes(spark, folder):
    return P.position_events(T.position_snapshots(spark, folder))


CLOSED = """cl AS (SELECT user_id AS ticket, date_trunc('hour', min(ts)) AS poll, arg_min(event_type, (ts, event_id)) AS symbol, arg_min(1.0 + value / 10000.0, (ts, event_id)) AS close_price,
  arg_min(50.0 - value, (ts, event_id)) AS profit, arg_min(CASE WHEN value < 50 THEN 'tp' ELSE 'sl' END, (ts, event_id)) AS reason FROM events WHERE event_type = 'purchase' GROUP BY 1)"""


def all_position_events(spark, folder):
    """Opened and modified events of the polls, and the first close of each ticket."""
    return P.with_closes(P.position_events(T.position_snapshots(spark, folder)), T.closed_records(spark, folder))


@query("position_event_counts", f"""{POS_EV}, {CLOSED} SELECT poll, count(*) FILTER (WHERE event = 'opened') AS opened, count(*) FILTER (WHERE event = 'modified') AS modified,
  count(*) FILTER (WHERE event = 'closed') AS closed FROM (SELECT poll, event FROM ev UNION ALL SELECT poll, 'closed' FROM cl) GROUP BY 1""")
def position_event_counts(spark, folder):
    return P.event_counts(all_position_events(spark, folder))


@query("first_closes", "SELECT user_id AS ticket, arg_min(ts, ts) AS poll, arg_min(value, ts) AS profit FROM events WHERE event_type = 'purchase' GROUP BY 1")
def first_closes(spark, folder):
    ev = T.table(spark, folder, "events").where(F.col("event_type") == "purchase")
    return P.first_closes(ev.select(F.col("user_id").alias("ticket"), F.col("ts").cast("timestamp").alias("poll"), F.col("value").alias("profit")))


@query("candidate_dedup", f"""WITH c AS (SELECT o_orderkey AS seq, '  ' || CASE WHEN o_custkey % 2 = 0 THEN upper(o_orderpriority) ELSE lower(o_orderpriority) END || ' ' || (o_custkey % 400) AS name, o_custkey % 6 AS n FROM orders)
SELECT lower(trim(name)) AS key, arg_min(seq, (-n, seq)) AS seq, max(n) AS n_params FROM c GROUP BY 1""")
def candidate_dedup(spark, folder):
    """Candidates with the same trimmed lower-case name: most parameters, then first."""
    o = T.table(spark, folder, "orders")
    raw = F.when(F.col("o_custkey") % 2 == 0, F.upper("o_orderpriority")).otherwise(F.lower("o_orderpriority"))
    name = F.concat(F.lit("  "), raw, F.lit(" "), (F.col("o_custkey") % 400).cast("string"))
    c = o.select(F.lower(F.trim(name)).alias("key"), F.col("o_orderkey").alias("seq"), (F.col("o_custkey") % 6).alias("n_params"))
    return first_by_key(c, ["key"], [-F.col("n_params"), "seq"])
