"""Queries that write a file in its native form and read it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clock
from ..operators import experiments as X
from ..operators import trades as R
from ..sources import files
from ..sources import tables as T
from ..sources.markdown import MarkdownTree
from .experiment_queries import CLOSED, DSR, POS_EV, all_position_events
from .registry import BARS, TICKS, TRADES, TRIALS, bars_sql, query, r
from .stream_queries import scratch


@query("bar_store", f"""{BARS}, p AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY time DESC) AS n FROM bars WHERE symbol = 'view')
SELECT symbol, 'H1' AS tf, time, open, high, low, close, volume FROM p WHERE n <= 300""")
def bar_store(spark, folder):
    """Partitioned bar table: written once, read back for one symbol, newest rows only."""
    path = scratch(spark)
    files.write_bars(T.bars(spark, folder).withColumn("tf", F.lit("H1")), path)
    return files.load_bars(spark, path, "view", "H1", 300)


@query("bar_store_shrink_guard", f"""WITH {TICKS}, {bars_sql()}, n AS (SELECT * FROM bars WHERE symbol <> 'click' OR time >= TIMESTAMP '2024-01-15')
SELECT symbol, 'H1' AS tf, count(*) AS n_rows, round(sum(close), 6) AS closes FROM (
  SELECT symbol, close + 1.0 AS close FROM bars WHERE symbol <> 'click' UNION ALL SELECT symbol, close FROM bars WHERE symbol = 'click') GROUP BY 1""")
def bar_store_shrink_guard(spark, folder):
    """A shorter rewrite of one symbol is refused, the others are replaced."""
    path = scratch(spark)
    b = T.bars(spark, folder).withColumn("tf", F.lit("H1"))
    files.write_bars(b, path)
    shorter = b.where((F.col("symbol") != "click") | (F.col("time") >= F.lit("2024-01-15").cast("timestamp")))
    files.write_if_not_smaller(shorter.withColumn("close", F.col("close") + F.lit(1.0)), path)
    out = files.load_bars(spark, path).groupBy("symbol", "tf").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("close").alias("closes"))
    return out.select("symbol", "tf", "n_rows", r("closes", 6))


@query("trade_journal", f"""WITH {TRADES} SELECT ticket, symbol, type, volume, open_price, open_time, NULL::DOUBLE AS close_price, NULL::TIMESTAMP AS close_time, NULL::DOUBLE AS profit, sl, tp FROM trades
UNION ALL SELECT ticket, symbol, type, volume, open_price, open_time, close_price, close_time, profit, sl, tp FROM trades WHERE close_time IS NOT NULL""")
def trade_journal(spark, folder):
    """Open rows appended first, closed rows of the same tickets after, then read as a journal."""
    path = scratch(spark)
    t = T.trades(spark, folder)
    gone = {c: F.lit(None).cast(dict(t.dtypes)[c]) for c in ("close_price", "close_time", "profit")}
    files.append_trades(t.withColumns(gone), path)
    files.append_trades(R.closed_trades(t), path)
    return files.read_trades(spark, path)


@query("trial_log", f"""{DSR} SELECT sr_id, book_slug, strategy_name, mapped_type, round(sharpe, 6) AS sharpe, max_dd, win_rate::DOUBLE AS win_rate, guard, trades FROM d""")
def trial_log(spark, folder):
    path = scratch(spark)
    t = T.trials(spark, folder).withColumn("timestamp", F.lit("2024-01-01T00:00:00Z"))
    target = files.append_trials(t.select(*[f.name for f in files.TRIAL_SCHEMA]), path)
    back = files.read_trials(spark, target)
    return back.select("sr_id", "book_slug", "strategy_name", "mapped_type", r("sharpe", 6), "max_dd", "win_rate", "guard", "trades")


@query("news_calendar", """SELECT date_trunc('second', ts) AS time, CASE user_id % 3 WHEN 0 THEN '' ELSE upper(event_type) END AS currency FROM events WHERE user_id % 5 <> 0 AND event_id % 4 <> 0""")
def news_calendar(spark, folder):
    """A calendar file with low-impact and unreadable rows, which are dropped."""
    path = scratch(spark)
    ev = T.table(spark, folder, "events")
    text = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    ev.select(
        F.when(F.col("event_id") % 4 == 0, F.lit("not a time")).otherwise(text).alias("time"),
        F.when(F.col("user_id") % 5 == 0, F.lit("Low")).otherwise(F.lit("HIGH")).alias("impact"),
        F.when(F.col("user_id") % 3 != 0, F.col("event_type")).alias("currency"), F.lit("release").alias("event"),
    ).write.option("header", True).csv(path)
    return files.read_calendar(spark, path).select("time", "currency")


@query("position_event_log", f"""{POS_EV}, {CLOSED} SELECT ticket, symbol, event, sl, tp, volume, changes, NULL::DOUBLE AS close_price, NULL::DOUBLE AS profit, NULL::VARCHAR AS reason FROM ev
UNION ALL SELECT ticket, symbol, 'closed', NULL, NULL, NULL, []::VARCHAR[], round(close_price, 8), round(profit, 8), reason FROM cl""")
def position_event_log(spark, folder):
    path = scratch(spark)
    e = all_position_events(spark, folder).withColumn("ts", F.col("poll"))
    files.write_position_events(e, path)
    schema = "ts string, event string, ticket long, symbol string, side string, volume double, sl double, tp double, close_price double, profit double, reason string, changes array<string>"
    return spark.read.schema(schema).json(path).select("ticket", "symbol", "event", "sl", "tp", "volume", "changes", r("close_price"), r("profit"), "reason")


@query("summary_file", f"WITH {TRIALS} SELECT count(*) AS total, count(*) FILTER (WHERE guard = 'PASS') AS validated FROM trials")
def summary_file(spark, folder):
    path = scratch(spark)
    files.save_summary(X.trial_summary(T.trials(spark, folder)), path)
    return files.load_summary(spark, path, "total long, validated long")


@query("time_functions", """SELECT event_id, date_trunc('second', ts) AS parsed, dayname(ts) AS weekday, ts::DATE AS utc_date,
  CASE user_id % 4 WHEN 0 THEN 900 WHEN 1 THEN 3600 WHEN 2 THEN 86400 END::BIGINT AS tf_seconds FROM events""")
def time_functions(spark, folder):
    t = T.ticks(spark, folder)
    iso = F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    k = F.col("user_id") % 4
    tf = F.when(k == 0, F.lit("m15")).when(k == 1, F.lit("H1")).when(k == 2, F.lit("D1")).otherwise(F.lit("X1"))
    return t.select(F.col("seq").alias("event_id"), clock.parse_time(iso).alias("parsed"), clock.day_name(F.col("time")).alias("weekday"),
                    clock.utc_date(F.col("time")).alias("utc_date"), clock.timeframe_seconds(tf).alias("tf_seconds"))




@query("corpus_scan", "SELECT 'p' || (page_id % 5) || '/' || page_id || '.md' AS path, html AS text FROM pages")
def corpus_scan(spark, folder):
    """Pages written as a tree of Markdown files, one a page, and read back without the folders' notes."""
    spark.dataSource.register(MarkdownTree)
    pages = T.table(spark, folder, "pages")
    top = F.concat(F.lit("p"), F.col("page_id") % 5)
    docs = pages.select(F.concat(top, F.lit("/"), F.col("page_id"), F.lit(".md")).alias("path"), F.col("html").alias("text"))
    notes = pages.select(F.concat(top, F.lit("/_meta.md")).alias("path"), F.lit("a note").alias("text")).distinct()
    path = scratch(spark)
    docs.unionByName(notes).write.format("markdown").mode("append").save(path)
    return spark.read.format("markdown").load(path)
