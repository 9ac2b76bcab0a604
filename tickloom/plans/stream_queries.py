"""Streaming operators run over the event table as a stream, until it is drained."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.positions import event_counts
from ..operators.series import settle
from ..session import shared_dir
from ..sources import files
from ..sources import tables as T
from ..streaming import keyed as K
from ..streaming import live as L
from .registry import SNAPSHOTS, TICKS, bars_sql, query, r


BATCHES = 4
FILES = 4  # of each span of time, so that no task writes a span alone


def spans_of(spark, folder):
    """Span of time (0 to ``BATCHES`` - 1) of an event's time in microseconds, and the events."""
    ev = T.table(spark, folder, "events")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    low, high = ev.agg(F.min(at), F.max(at)).first()  # two numbers
    return F.floor((at - F.lit(low or 0)) / F.lit(((high or 0) - (low or 0)) // BATCHES + 1)), ev


def ticks_of(raw):
    price = F.lit(1.0) + F.col("value") / F.lit(10000.0)
    return raw.select(
        F.col("event_type").alias("symbol"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("time"),
        price.alias("price"), price.alias("bid"), (price + F.lit(0.0001)).alias("ask"), "user_id", "value",
    )


def as_stream(df, path, files=FILES):
    """A stream of the files below a folder, ``files`` of them a micro-batch, oldest first."""
    return df.sparkSession.readStream.schema(df.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files).parquet(path)


def event_stream(spark, folder):
    """The events in order of time, one of ``BATCHES`` equal spans of time per micro-batch."""
    span, ev = spans_of(spark, folder)
    path = f"{scratch(spark)}/events"
    for k in range(BATCHES):
        ev.where(span == k).repartition(FILES).write.parquet(f"{path}/b{k}")
    return ticks_of(as_stream(ev, path))


def scratch(spark) -> str:
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


SEALED = f"WITH {TICKS}, {bars_sql()}, w AS (SELECT max(time) - INTERVAL 10 MINUTE AS wm FROM ticks)"


@query("stream_sealed_bars", f"{SEALED} SELECT symbol, time, open, high, low, close, volume FROM bars, w WHERE time + INTERVAL 1 HOUR <= wm")
def stream_sealed_bars(spark, folder):
    return L.drain(L.bar_stream(event_stream(spark, folder)), spark, scratch(spark))


@query("stream_bar_history", f"WITH {TICKS}, {bars_sql(900)} SELECT symbol, 'M15' AS tf, time, open, high, low, close, volume FROM bars")
def stream_bar_history(spark, folder):
    """Open and sealed bars flushed to a stored history in update mode."""
    path = scratch(spark)
    L.drain_with(L.bar_stream(event_stream(spark, folder), 900), L.history_sink(f"{path}/history", "M15"), path, "update")
    return files.load_bars(spark, f"{path}/history")


CHANGES = f"""{SNAPSHOTS}, l AS (SELECT *, lag(poll) OVER w AS pp, lag(sl) OVER w AS psl, lag(tp) OVER w AS ptp, lag(volume) OVER w AS pv
  FROM snaps WINDOW w AS (PARTITION BY ticket ORDER BY poll)),
e AS (SELECT *, coalesce(pp = poll - INTERVAL 1 HOUR, FALSE) AS known, (CASE WHEN sl <> psl THEN ['sl'] ELSE [] END || CASE WHEN tp <> ptp THEN ['tp'] ELSE [] END || CASE WHEN volume <> pv THEN ['volume'] ELSE [] END) AS ch FROM l),
changed AS (SELECT poll, ticket, symbol, CASE WHEN known THEN 'modified' ELSE 'opened' END AS event, sl, tp, volume, CASE WHEN known THEN ch ELSE [] END AS changes FROM e WHERE NOT known OR len(ch) > 0)"""
CLOSES = """closes AS (SELECT user_id AS ticket, min(ts) AS time, arg_min(event_id, (ts, event_id)) AS seq, arg_min(50.0 - value, (ts, event_id)) AS profit FROM events WHERE event_type = 'purchase' GROUP BY 1)"""
EVENTS = f"""{CHANGES}, {CLOSES}, told AS (SELECT poll, ticket, symbol, event, sl, tp, volume, changes, NULL::DOUBLE AS profit FROM changed
  UNION ALL SELECT time, ticket, 'purchase', 'closed', NULL, NULL, NULL, [], profit FROM closes)"""


def snapshot_stream(spark, folder):
    """Hourly snapshots in order of time, ``BATCHES`` spans of days."""
    snaps = settle(T.position_snapshots(spark, folder))  # grouped once, not for every span
    path = f"{scratch(spark)}/snaps"
    low, high = snaps.agg(F.min("poll"), F.max("poll")).select(F.unix_seconds("min(poll)"), F.unix_seconds("max(poll)")).first()  # two numbers
    width = ((high or 0) - (low or 0)) // BATCHES + 1
    for k in range(BATCHES):
        snaps.where(F.floor((F.unix_seconds("poll") - F.lit(low or 0)) / F.lit(width)) == k).repartition(FILES).write.parquet(f"{path}/b{k}")
    return as_stream(snaps, path)


def closed_stream(spark, folder):
    """A closed record for every purchase."""
    return event_stream(spark, folder).where(F.col("symbol") == "purchase").select(F.col("user_id").alias("ticket"), "symbol", "time", "seq", (F.lit(50.0) - F.col("value")).alias("profit"))


@query("stream_position_changes", f"WITH {CHANGES} SELECT * FROM changed")
def stream_position_changes(spark, folder):
    """Opened and modified positions, the last snapshot of each ticket kept as state."""
    told = K.position_stream(snapshot_stream(spark, folder)).select("poll", "ticket", "symbol", "event", "sl", "tp", "volume", "changes")
    return L.drain(told, spark, scratch(spark))


def position_events(spark, folder):
    closed = closed_stream(spark, folder).withColumnRenamed("time", "poll")
    return L.drain(K.position_stream(snapshot_stream(spark, folder), closed), spark, scratch(spark))


@query("stream_position_events", f"WITH {EVENTS} SELECT * FROM told")
def stream_position_events(spark, folder):
    """Opened, modified and closed positions from two streams; a ticket's close is told once."""
    return position_events(spark, folder).select("poll", "ticket", "symbol", "event", "sl", "tp", "volume", "changes", "profit")


@query("stream_event_counts", f"""WITH {EVENTS} SELECT date_trunc('hour', poll) AS poll, count(*) FILTER (event = 'opened') AS opened, count(*) FILTER (event = 'modified') AS modified,
  count(*) FILTER (event = 'closed') AS closed FROM told GROUP BY 1""")
def stream_event_counts(spark, folder):
    return event_counts(position_events(spark, folder).withColumn("poll", F.date_trunc("hour", "poll")))


@query("stream_first_closes", f"WITH {CLOSES} SELECT * FROM closes")
def stream_first_closes(spark, folder):
    closed = closed_stream(spark, folder).drop("symbol")
    return L.drain(K.first_close_stream(closed, ["time", "seq"]), spark, scratch(spark))


@query("stream_loss_alerts", "SELECT event_id AS seq, user_id AS ticket, 50.0 - value AS profit FROM events WHERE event_type = 'purchase' AND 50.0 - value < -100")
def stream_loss_alerts(spark, folder):
    closed = event_stream(spark, folder).where(F.col("symbol") == "purchase").select("seq", F.col("user_id").alias("ticket"), (F.lit(50.0) - F.col("value")).alias("profit"))
    return L.drain(L.loss_alert_stream(closed, 100.0), spark, scratch(spark))


@query("stream_order_quotes", f"""WITH {TICKS}, o AS (SELECT event_id * 2 AS order_id, event_type AS symbol, ts + INTERVAL 2 SECOND AS time FROM events
  UNION ALL SELECT event_id * 2 + 1, event_type, ts + INTERVAL 30 SECOND FROM events),
o2 AS (SELECT * FROM o WHERE 10 * floor(epoch(time) / 10) + 10 <= (SELECT epoch(max(time)) - 60 FROM ticks)),
h AS (SELECT order_id, arg_max(seq, (q.time, q.seq)) AS seq FROM o2 JOIN ticks q ON o2.symbol = q.symbol AND q.time <= o2.time AND q.time >= o2.time - INTERVAL 5 SECOND GROUP BY 1)
SELECT o2.order_id, o2.symbol, q.bid, q.ask, h.seq IS NULL AS stale FROM o2 LEFT JOIN h USING (order_id) LEFT JOIN ticks q ON h.seq = q.seq""")
def stream_order_quotes(spark, folder):
    """Every order whose slot of ten seconds the watermark, a minute behind, has passed."""
    t = event_stream(spark, folder)
    shifts = F.explode(F.array(F.struct(F.lit(0).alias("k"), F.lit(2).alias("s")), F.struct(F.lit(1).alias("k"), F.lit(30).alias("s")))).alias("_x")
    orders = t.select("seq", "symbol", "time", shifts).select(
        (F.col("seq") * 2 + F.col("_x.k")).alias("order_id"), "symbol", F.timestamp_micros(F.unix_micros("time") + F.col("_x.s") * 1_000_000).alias("order_time"))
    return L.drain(K.quote_stream(orders, event_stream(spark, folder)), spark, scratch(spark)).drop("order_time")


@query("stream_late_rows", f"""WITH {TICKS}, lim AS (SELECT epoch_us(min(time)) AS low, (epoch_us(max(time)) - epoch_us(min(time))) // {BATCHES} + 1 AS width FROM ticks),
d AS (SELECT symbol, seq, time, price, (epoch_us(time) - low) // width + CASE WHEN seq % 50 = 7 THEN 1 ELSE 0 END AS sent, time_bucket(INTERVAL '1 hour', time) AS bar FROM ticks, lim),
m AS (SELECT sent + 1 AS sent, max(max(time)) OVER (ORDER BY sent) - INTERVAL 10 MINUTE AS mark FROM d GROUP BY sent)
SELECT symbol, bar, seq, time, price FROM d JOIN m USING (sent) WHERE bar + INTERVAL 1 HOUR <= mark""")
def stream_late_rows(spark, folder):
    """Ticks that come a span of time late and miss their bars; the stream is stopped and started after each span."""
    span, ev = spans_of(spark, folder)
    sent = span + F.when(F.col("event_id") % 50 == 7, F.lit(1)).otherwise(F.lit(0))
    path = scratch(spark)
    ev.limit(0).write.parquet(f"{path}/in/none")
    late = K.late_stream(ticks_of(as_stream(ev, f"{path}/in", 1_000_000)))
    for k in range(BATCHES + 1):
        ev.where(sent == k).repartition(FILES).write.parquet(f"{path}/in/b{k}")
        out = L.drain(late, spark, path)
    return out


@query("stream_average_spread", f"""WITH {TICKS}, s AS (SELECT *, 1.0 + user_id % 4 AS spread FROM ticks)
SELECT seq, symbol, round(avg(spread) OVER (PARTITION BY symbol ORDER BY seq ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 6) AS avg_spread FROM s""")
def stream_average_spread(spark, folder):
    path = scratch(spark)
    t = event_stream(spark, folder).select("symbol", "seq", "time", (F.lit(1.0) + F.col("user_id") % 4).alias("spread"))
    L.drain_with(t, L.spread_sink(f"{path}/spread", f"{path}/tail"), path)
    return spark.read.parquet(f"{path}/spread").select("seq", "symbol", r("avg_spread", 6))


@query("stream_account_monitor", """WITH RECURSIVE s AS (SELECT user_id AS account, ts AS time, event_id AS seq, 10000.0 + 100.0 * (value - 50.0) / 10.0 AS equity, user_id % 7 AS streak, event_type <> 'error' AS fresh FROM events),
f AS (SELECT *, max(equity) OVER (PARTITION BY account ORDER BY time) AS peak, first_value(equity) OVER (PARTITION BY account, time::DATE ORDER BY time) AS day_start FROM s WHERE fresh),
v AS (SELECT account, time, CASE WHEN (peak - equity) / peak >= 0.2 THEN 'trailing_dd_halt' WHEN streak >= 5 THEN 'consecutive_losses' WHEN (equity - day_start) / day_start <= -0.02 THEN 'daily_loss_limit' ELSE 'ok' END AS reason,
  round(peak, 6) AS peak, round(day_start, 6) AS day_start FROM f),
hl AS (SELECT account, time FROM v WHERE reason = 'consecutive_losses'),
nx AS (SELECT a.account, a.time, min(z.time) AS nxt FROM hl a LEFT JOIN hl z ON z.account = a.account AND z.time >= a.time + INTERVAL 24 HOUR GROUP BY 1, 2),
ch AS (SELECT account, min(time) AS time FROM hl GROUP BY 1 UNION ALL SELECT nx.account, nx.nxt FROM ch JOIN nx ON nx.account = ch.account AND nx.time = ch.time WHERE nx.nxt IS NOT NULL)
SELECT v.account, v.time, reason, peak, day_start, ch.time + INTERVAL 24 HOUR AS cooling_until FROM v LEFT JOIN ch ON ch.account = v.account AND v.time >= ch.time AND v.time < ch.time + INTERVAL 24 HOUR""")
def stream_account_monitor(spark, folder):
    s = event_stream(spark, folder).select(
        F.col("user_id").alias("account"), "time", (F.lit(10000.0) + F.lit(100.0) * (F.col("value") - F.lit(50.0)) / F.lit(10.0)).alias("equity"),
        (F.col("user_id") % 7).alias("streak"), (F.col("symbol") != "error").alias("fresh"))
    path = scratch(spark)
    L.drain_with(s, L.account_sink(f"{path}/verdicts", f"{path}/state"), path)
    out = spark.read.parquet(f"{path}/verdicts")
    return out.where(F.col("reason") != "skipped").select("account", "time", "reason", r("peak", 6), r("day_start", 6), "cooling_until")


@query("stream_target_actions", f"""WITH {TICKS}, p AS (SELECT event_id AS ticket, event_type AS symbol, CASE WHEN event_id % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side, 1.0 + (event_id % 100) / 10000.0 AS e, ts FROM events),
b AS (SELECT seq AS ticket, max(bid) OVER w AS bid, min(ask) OVER w AS ask FROM ticks WINDOW w AS (PARTITION BY symbol ORDER BY time RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT ticket, symbol, 0.5::DOUBLE AS close_fraction, round(CASE side WHEN 'BUY' THEN e + 0.0001 ELSE e - 0.0001 END, 5) AS new_sl FROM p JOIN b USING (ticket)
WHERE (side = 'BUY' AND bid >= e + 0.0295) OR (side = 'SELL' AND ask <= e - 0.0035)""")
def stream_target_actions(spark, folder):
    path = scratch(spark)
    e = F.lit(1.0) + F.col("seq") % 100 / F.lit(10000.0)
    side = F.when(F.col("seq") % 2 == 0, F.lit("BUY")).otherwise(F.lit("SELL"))
    tp = F.when(side == "BUY", e + F.lit(0.0295)).otherwise(e - F.lit(0.0035))
    positions = T.ticks(spark, folder).select(F.col("seq").alias("ticket"), "symbol", side.alias("side"), e.alias("open_price"), tp.alias("tp"), F.col("time").alias("open_time"))
    L.drain_with(event_stream(spark, folder), L.target_sink(positions, f"{path}/actions", f"{path}/fired"), path)
    return spark.read.parquet(f"{path}/actions").select("ticket", "symbol", "close_fraction", "new_sl")


@query("stream_connections", f"""WITH {TICKS}, g AS (SELECT symbol, time, CASE WHEN lag(time) OVER w IS NULL OR time >= lag(time) OVER w + INTERVAL 600 SECOND THEN 1 ELSE 0 END AS s FROM ticks WINDOW w AS (PARTITION BY symbol ORDER BY time)),
k AS (SELECT *, sum(s) OVER (PARTITION BY symbol ORDER BY time) AS n FROM g)
SELECT symbol AS source, min(time) AS connected_at, max(time) + INTERVAL 600 SECOND AS lost_at, count(*) AS beats FROM k GROUP BY symbol, n
HAVING max(time) + INTERVAL 600 SECOND <= (SELECT max(time) - INTERVAL 1 MINUTE FROM ticks)""")
def stream_connections(spark, folder):
    beats = event_stream(spark, folder).select(F.col("symbol").alias("source"), "time")
    return L.drain(L.connection_stream(beats, 600), spark, scratch(spark))


@query("stream_connection_events", f"""WITH {TICKS}, g AS (SELECT symbol, time, CASE WHEN lag(time) OVER w IS NULL OR time >= lag(time) OVER w + INTERVAL 600 SECOND THEN 1 ELSE 0 END AS s FROM ticks WINDOW w AS (PARTITION BY symbol ORDER BY time)),
k AS (SELECT *, sum(s) OVER (PARTITION BY symbol ORDER BY time) AS n FROM g),
i AS (SELECT symbol, min(time) AS first, max(time) AS last, count(*) AS beats, lead(min(time)) OVER (PARTITION BY symbol ORDER BY n) AS next FROM k GROUP BY symbol, n)
SELECT symbol AS source, 'back' AS event, first AS at, NULL::BIGINT AS beats FROM i
UNION ALL SELECT symbol, 'lost', last + INTERVAL 600 SECOND, beats FROM i WHERE next IS NOT NULL OR last + INTERVAL 600 SECOND <= (SELECT max(time) - INTERVAL 1 MINUTE FROM ticks)""")
def stream_connection_events(spark, folder):
    """Sources lost and back, by a timer on each source's last beat."""
    beats = event_stream(spark, folder).select(F.col("symbol").alias("source"), "time")
    return L.drain(K.connection_events(beats, 600), spark, scratch(spark))


@query("connected_sources", f"WITH {TICKS} SELECT symbol AS source, max(time) AS last_beat, epoch_us(TIMESTAMP '2024-01-31') - epoch_us(max(time)) <= 1200000000 AS connected FROM ticks GROUP BY 1")
def connected_sources(spark, folder):
    return L.connected(T.ticks(spark, folder).withColumnRenamed("symbol", "source"), "2024-01-31 00:00:00", 1200)
