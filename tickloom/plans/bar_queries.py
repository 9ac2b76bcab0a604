"""Queries on bars: building, merging, paging, filters, joins of legs and news."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clock, money
from ..operators import bars as B
from ..operators import joins as J
from ..operators.series import settle
from ..sources import tables as T
from .registry import BARS, CALENDAR, POS, TICKS, bars_sql, hourly, query, r

OHLCV = "symbol, time, open, high, low, close, volume"


@query("bars_from_ticks", f"{BARS} SELECT {OHLCV} FROM bars")
def bars_from_ticks(spark, folder):
    return T.bars(spark, folder)


def snapshot_ticks(spark, folder):
    """Ticks that carry the running bar; every seventh user quotes none."""
    base = F.lit(1.0) + F.floor("value") / F.lit(10000.0)
    return T.ticks(spark, folder).select(
        "symbol", "time", "seq",
        F.when(F.col("user_id") % 7 != 0, base).alias("h1_open"),
        (base + F.lit(0.0002)).alias("h1_high"), (base - F.lit(0.0002)).alias("h1_low"), base.alias("h1_close"),
        (F.col("seq") % 3).alias("volume"),
    )


@query("bars_from_snapshots", f"""WITH {TICKS}, s AS (
  SELECT symbol, time, seq, CASE WHEN user_id % 7 <> 0 THEN 1.0 + floor(value) / 10000.0 END AS o,
         1.0 + floor(value) / 10000.0 + 0.0002 AS h, 1.0 + floor(value) / 10000.0 - 0.0002 AS l,
         1.0 + floor(value) / 10000.0 AS c, seq % 3 AS v FROM ticks)
SELECT symbol, time_bucket(INTERVAL '1 hour', time) AS time, round(arg_min(o, seq), 5) AS open, round(max(h), 5) AS high,
       round(min(l), 5) AS low, round(arg_max(c, seq), 5) AS close,
       coalesce(arg_max(v, seq) FILTER (WHERE v <> 0), 0)::BIGINT AS volume
FROM s WHERE o IS NOT NULL GROUP BY 1, 2""")
def bars_from_snapshots(spark, folder):
    return B.snapshots_to_bars(snapshot_ticks(spark, folder))


@query("bars_resampled", f"""{BARS}
SELECT symbol, time_bucket(INTERVAL '4 hours', time) AS time, arg_min(open, time) AS open, max(high) AS high,
       min(low) AS low, arg_max(close, time) AS close, sum(volume)::BIGINT AS volume FROM bars GROUP BY 1, 2""")
def bars_resampled(spark, folder):
    return B.resample(T.bars(spark, folder), 14400)


@query("bars_coerced", f"""WITH {TICKS}, e AS (
  SELECT symbol, epoch_us(time) // 60000000 * 60 AS t, price, seq FROM ticks)
SELECT symbol, make_timestamp(t * 1000000) AS time, arg_min(price, seq) AS open, arg_min(price, seq) AS high,
       arg_min(price, seq) AS low, arg_min(price, seq) AS close, arg_min(seq, seq) AS volume FROM e GROUP BY symbol, t""")
def bars_coerced(spark, folder):
    minute = F.floor(F.unix_seconds("time") / F.lit(60)) * F.lit(60)
    raw = T.ticks(spark, folder).select(
        "symbol", minute.alias("time"), *[F.col("price").alias(c) for c in ("open", "high", "low", "close")],
        F.col("seq").alias("volume"), "seq",
    )
    return B.coerce_bars(raw, keys=["symbol"], order=["seq"])


@query("download_normalised", f"""{BARS}
SELECT symbol, time, open, high, low, close, CASE WHEN volume > 2 THEN volume ELSE 0 END AS volume FROM bars""")
def download_normalised(spark, folder):
    b = T.bars(spark, folder)
    raw = b.select("symbol", F.col("time").alias("Date"), *[F.col(c).alias(c.capitalize()) for c in ("open", "high", "low", "close")],
                   F.when(F.col("volume") > 2, F.col("volume")).alias("Volume"))
    return B.normalise_download(raw, "Date", ["symbol"])


@query("times_unique", f"""{BARS} SELECT symbol, count(*) AS n_rows, count(DISTINCT time) AS n_times,
  count(*) = count(DISTINCT time) AS is_unique FROM bars GROUP BY symbol""")
def times_unique(spark, folder):
    return B.unique_times(T.bars(spark, folder))


@query("tick_times_unique", f"""WITH {TICKS}, m AS (SELECT symbol, date_trunc('minute', time) AS time FROM ticks)
SELECT symbol, count(*) AS n_rows, count(DISTINCT time) AS n_times, count(*) = count(DISTINCT time) AS is_unique
FROM m GROUP BY symbol""")
def tick_times_unique(spark, folder):
    return B.unique_times(T.ticks(spark, folder).withColumn("time", F.date_trunc("minute", "time")))


@query("cache_accepted", f"{BARS} SELECT symbol, count(*) AS n_rows, count(*) >= 500 AS accepted FROM bars GROUP BY symbol")
def cache_accepted(spark, folder):
    return B.enough_rows(T.bars(spark, folder), 1000)


def stored_and_fetched(spark, folder):
    """Two overlapping pages of one history; the fetched one quotes higher closes."""
    stored = B.ticks_to_bars(T.ticks(spark, folder, end="2024-01-20"))
    fetched = B.ticks_to_bars(T.ticks(spark, folder, start="2024-01-10")).withColumn("close", F.col("close") + F.lit(1.0))
    return stored, fetched


PAGES = f"""{BARS}, stored AS (SELECT * FROM bars WHERE time < TIMESTAMP '2024-01-20'),
fetched AS (SELECT symbol, time, open, high, low, close + 1.0 AS close, volume FROM bars WHERE time >= TIMESTAMP '2024-01-10')"""


@query("merge_stored_wins", f"""{PAGES} SELECT * FROM stored UNION ALL
SELECT f.* FROM fetched f WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.symbol = f.symbol AND s.time = f.time)""")
def merge_stored_wins(spark, folder):
    return B.merge_stored_wins(*stored_and_fetched(spark, folder))


@query("upsert_incoming_wins", f"""{PAGES} SELECT * FROM fetched UNION ALL
SELECT s.* FROM stored s WHERE NOT EXISTS (SELECT 1 FROM fetched f WHERE s.symbol = f.symbol AND s.time = f.time)""")
def upsert_incoming_wins(spark, folder):
    return B.upsert_incoming_wins(*stored_and_fetched(spark, folder))


@query("union_of_pages", f"{PAGES} SELECT * FROM stored UNION ALL SELECT * FROM fetched")
def union_of_pages(spark, folder):
    return B.union_pages(*stored_and_fetched(spark, folder))


@query("backfill_stats", f"""{PAGES}, c AS (
  SELECT coalesce(s.symbol, f.symbol) AS symbol, count(s.time) AS b, count(f.time) AS n, count(*) AS a
  FROM stored s FULL JOIN fetched f ON s.symbol = f.symbol AND s.time = f.time GROUP BY 1)
SELECT symbol, CASE WHEN b >= 430 THEN 'noop' ELSE 'fetched' END AS status, b AS cached_before,
  CASE WHEN b >= 430 THEN 0 ELSE n END AS fetched, CASE WHEN b >= 430 THEN b ELSE a END AS cached_after,
  CASE WHEN b >= 430 THEN 0 ELSE a - b END AS added FROM c""")
def backfill_stats(spark, folder):
    return B.backfill_stats(*stored_and_fetched(spark, folder), target=430)


@query("shrink_guard", f"""{PAGES}, n AS (SELECT symbol, count(*) AS n_new FROM fetched GROUP BY 1),
o AS (SELECT symbol, count(*) AS n_stored FROM stored GROUP BY 1)
SELECT n.symbol, n_new, coalesce(n_stored, 0) AS n_stored, n_new >= coalesce(n_stored, 0) AS accepted
FROM n LEFT JOIN o ON n.symbol = o.symbol""")
def shrink_guard(spark, folder):
    stored, fetched = stored_and_fetched(spark, folder)
    return B.allowed_shrink(stored, fetched, ["symbol"])


@query("batch_ingest", f"""WITH {TICKS}, m AS (
  SELECT symbol, user_id AS batch_id, time_bucket(INTERVAL '15 minutes', time) AS t, arg_max(price, seq) AS c, count(*) AS v
  FROM ticks GROUP BY 1, 2, 3), k AS (
  SELECT symbol, t, arg_max(c, batch_id) AS c, arg_max(v, batch_id) AS v FROM m WHERE symbol <> 'error' GROUP BY 1, 2), p AS (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY t DESC) AS n FROM k)
SELECT symbol, 'M15' AS tf, t AS time, c AS open, c AS high, c AS low, c AS close, v AS volume FROM p WHERE n <= 5000""")
def batch_ingest(spark, folder):
    slot = clock.floor_time(F.col("time"), 900)
    bars = T.ticks(spark, folder).groupBy("symbol", "user_id", slot.alias("t")).agg(
        F.max_by("price", "seq").alias("c"), F.count(F.lit(1)).alias("v")
    )
    bar = F.struct(F.unix_seconds("t").alias("time"), *[F.col("c").alias(x) for x in ("open", "high", "low", "close")], F.col("v").alias("volume"))
    # a batch is one day of one source, so its array holds at most 96 bars
    day = F.to_date("t").alias("day")
    batches = bars.groupBy("symbol", F.col("user_id").alias("batch_id"), day).agg(F.collect_list(bar).alias("bars")).withColumn(
        "timeframe", F.when(F.col("symbol") == "error", F.lit("X9")).otherwise(F.lit("m15"))
    )
    return B.ingest_batches(batches)


@query("history_page", f"""{BARS}, p AS (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY time DESC) AS n, count(*) OVER (PARTITION BY symbol) AS total_available
  FROM bars WHERE time <= TIMESTAMP '2024-01-25 12:00:00')
SELECT {OHLCV}, total_available FROM p WHERE n > 30 AND n <= 130""")
def history_page(spark, folder):
    return B.history_page(hourly(spark, folder), rows=100, offset=30, until="2024-01-25 12:00:00")


@query("newest_bars", f"""{BARS}, p AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY time DESC) AS n FROM bars)
SELECT {OHLCV} FROM p WHERE n <= 200""")
def newest_bars(spark, folder):
    return B.newest_rows(hourly(spark, folder), 200, ["symbol"], 3600)


@query("history_cap", f"""WITH {TICKS}, {bars_sql(60, "m1")}, {bars_sql(86400, "d1")}, {bars_sql(900, "m15")}, a AS (
  SELECT *, 'M1' AS tf, 20000 AS k FROM m1 UNION ALL SELECT *, 'M15', 5000 FROM m15 UNION ALL SELECT *, 'D1', 500 FROM d1), p AS (
  SELECT *, row_number() OVER (PARTITION BY symbol, tf ORDER BY time DESC) AS n FROM a)
SELECT {OHLCV}, tf FROM p WHERE n <= k""")
def history_cap(spark, folder):
    t = T.ticks(spark, folder)
    frames = [B.ticks_to_bars(t, clock.TIMEFRAME_SECONDS[tf]).withColumn("tf", F.lit(tf)) for tf in ("M1", "M15", "D1")]
    return B.cap_history(settle(B.union_pages(*frames)))


@query("tail_holdout", f"""{POS}, n AS (SELECT symbol, count(*) AS k FROM b GROUP BY 1)
SELECT {OHLCV} FROM b JOIN n USING (symbol) WHERE pos >= floor(k * 0.7::DOUBLE)""")
def tail_holdout(spark, folder):
    return B.tail_holdout(hourly(spark, folder), 0.7)


# below 5 * (2 * 24 + 2) rows there is one fold: the last fifth
FOLD_N = f"""{POS}, n AS (SELECT symbol, count(*) AS n_rows, count(*) < 250 AS small, floor(count(*) * (1 - 1.0::DOUBLE / 5))::BIGINT AS cut, count(*) // 5 AS size FROM b GROUP BY 1)"""


@query("fold_assignment", f"""{FOLD_N}, f AS (SELECT symbol, time, pos, n_rows, small, cut, size, CASE WHEN NOT small THEN least(pos // size, 4) WHEN pos >= cut THEN 0 END AS fold FROM b JOIN n USING (symbol))
SELECT symbol, time, pos, n_rows, fold::BIGINT AS fold, (CASE WHEN small THEN cut ELSE fold * size END)::BIGINT AS test_start,
  (CASE WHEN small OR fold = 4 THEN n_rows ELSE (fold + 1) * size END)::BIGINT AS test_end FROM f""")
def fold_assignment(spark, folder):
    cols = ("symbol", "time", "pos", "n_rows", "fold", "test_start", "test_end")
    return B.fold_bars(hourly(spark, folder), 5, 24).select(*cols)


@query("fold_bounds", f"""{FOLD_N}, f AS (SELECT symbol, n_rows, small, k AS fold, CASE WHEN small THEN cut ELSE k * size END AS s, CASE WHEN small OR k = 4 THEN n_rows ELSE (k + 1) * size END AS e
  FROM n, range(5) t(k) WHERE k = 0 OR NOT small)
SELECT symbol, fold::BIGINT AS fold, s::BIGINT AS test_start, e::BIGINT AS test_end, greatest(s - 24, 0)::BIGINT AS train_until,
  (CASE WHEN small THEN n_rows ELSE least(n_rows, e + 24) END)::BIGINT AS train_from FROM f""")
def fold_bounds(spark, folder):
    return B.fold_bounds(T.bars(spark, folder), 5, 24)


@query("session_filter", f"""{BARS} SELECT symbol, time, close FROM bars
WHERE (hour(time) >= 7 AND hour(time) < 16) OR (hour(time) >= 22 OR hour(time) < 7) OR (hour(time) >= 19 AND hour(time) < 20)""")
def session_filter(spark, folder):
    b = T.bars(spark, folder)
    return b.where(clock.in_session(F.col("time"), ["London", "sydney", "mars"], [(19, 20)])).select("symbol", "time", "close")


@query("session_labels", """SELECT event_id, CASE WHEN hour(ts) >= 7 AND hour(ts) < 16 THEN 'London'
  WHEN hour(ts) >= 12 AND hour(ts) < 21 THEN 'New York' WHEN hour(ts) < 9 THEN 'Tokyo'
  WHEN hour(ts) >= 22 OR hour(ts) < 7 THEN 'Sydney' ELSE 'Off-session' END AS session FROM events""")
def session_labels(spark, folder):
    return T.ticks(spark, folder).select(F.col("seq").alias("event_id"), clock.session_label(F.col("time")).alias("session"))


@query("market_open", """SELECT event_id, CASE isodow(ts) WHEN 6 THEN FALSE WHEN 7 THEN hour(ts) >= 22
  WHEN 5 THEN hour(ts) < 21 ELSE TRUE END AS is_open FROM events""")
def market_open(spark, folder):
    return T.ticks(spark, folder).select(F.col("seq").alias("event_id"), clock.market_open(F.col("time")).alias("is_open"))


@query("news_blackout", f"""{BARS}, {CALENDAR} SELECT symbol, time, close FROM bars b WHERE NOT EXISTS (
  SELECT 1 FROM calendar c WHERE abs(epoch_us(b.time) - epoch_us(c.time)) <= 1800000000 AND contains(upper(b.symbol), c.currency))""")
def news_blackout(spark, folder):
    return J.news_blackout(T.bars(spark, folder), T.calendar(spark, folder), 30).select("symbol", "time", "close")


@query("pair_legs", f"""{BARS} SELECT a.time, a.close AS close_1, c.close AS close_2, a.close - c.close AS gap
FROM bars a JOIN bars c ON a.time = c.time WHERE a.symbol = 'click' AND c.symbol = 'view'""")
def pair_legs(spark, folder):
    from ..operators.indicators import join_legs

    return join_legs(T.bars(spark, folder), "click", "view").select("time", "close_1", "close_2", (F.col("close_1") - F.col("close_2")).alias("gap"))


@query("order_quotes", f"""WITH {TICKS}, q AS (
  SELECT symbol, time, seq, CASE WHEN user_id % 11 = 0 THEN 0.0 ELSE bid END AS bid, ask FROM ticks),
o AS (SELECT event_id * 2 AS order_id, event_type AS symbol, ts + INTERVAL 2 SECOND AS time FROM events
  UNION ALL SELECT event_id * 2 + 1, event_type, ts + INTERVAL 30 SECOND FROM events),
h AS (SELECT order_id, max(seq) AS seq FROM o JOIN q ON o.symbol = q.symbol AND q.time <= o.time
  AND q.time >= o.time - INTERVAL 5 SECOND AND q.bid <> 0 AND q.ask <> 0 GROUP BY 1)
SELECT o.order_id, o.symbol, q.bid, q.ask, h.seq IS NULL AS stale FROM o LEFT JOIN h USING (order_id) LEFT JOIN q ON h.seq = q.seq""")
def order_quotes(spark, folder):
    t = T.ticks(spark, folder)
    orders = t.select((F.col("seq") * 2).alias("order_id"), "symbol", (F.col("time") + F.expr("interval 2 seconds")).alias("time")).unionByName(
        t.select((F.col("seq") * 2 + 1).alias("order_id"), "symbol", (F.col("time") + F.expr("interval 30 seconds")).alias("time"))
    )
    quotes = t.withColumn("bid", F.when(F.col("user_id") % 11 == 0, F.lit(0.0)).otherwise(F.col("bid")))
    return J.latest_quote(orders, quotes, "order_id", 5).select("order_id", "symbol", "bid", "ask", "stale")


@query("htf_bars_asof", f"""{BARS}, h AS (
  SELECT symbol, time_bucket(INTERVAL '4 hours', time) AS time, max(high) AS high, min(low) AS low, arg_max(close, time) AS close
  FROM bars GROUP BY 1, 2), l AS (
  SELECT symbol, time, lag(close) OVER (PARTITION BY symbol ORDER BY time) AS prev_close,
         lag(high) OVER (PARTITION BY symbol ORDER BY time) AS prev_high FROM h)
SELECT b.symbol, b.time, b.close, l.prev_close AS htf_close, l.prev_high AS htf_high
FROM bars b JOIN l ON b.symbol = l.symbol AND l.time = time_bucket(INTERVAL '4 hours', b.time)""")
def htf_bars_asof(spark, folder):
    return J.with_finished_higher_bar(hourly(spark, folder), 14400).select("symbol", "time", "close", "htf_close", "htf_high")


@query("tick_mid_spread", f"""WITH {TICKS} SELECT seq, symbol, (bid + ask) / 2.0 AS mid,
  round(CASE WHEN user_id % 4 = 0 THEN (ask - bid) / 0.0001 ELSE 1.0 + user_id % 4 END, 6) AS spread FROM ticks""")
def tick_mid_spread(spark, folder):
    quoted = F.when(F.col("user_id") % 4 == 0, F.lit(0.0)).otherwise(F.lit(1.0) + F.col("user_id") % 4)
    return T.ticks(spark, folder).select(
        "seq", "symbol", money.mid(F.col("bid"), F.col("ask")).alias("mid"),
        r(money.spread_pips(quoted, F.col("bid"), F.col("ask")), 6, "spread"),
    )
