"""The market model read from parquet tables: ticks, bars, trades, calendar, trials.

Timestamps are stored without a zone and mean UTC.  They become zoned timestamps
here, in one place, and go back without a zone in ``plain_times``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.bars import ticks_to_bars


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{folder}/{name}.parquet")


def plain_times(df: DataFrame) -> DataFrame:
    """Zoned timestamps back to plain ones for output."""
    return df.select(*[
        F.col(f.name).cast("timestamp_ntz").alias(f.name) if f.dataType.typeName() == "timestamp" else F.col(f.name)
        for f in df.schema
    ])


def ticks(spark: SparkSession, folder: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Ticks from ``start`` to before ``end``; the bounds are compared before the cast, so they reach the scan."""
    ev = table(spark, folder, "events")
    if start is not None:
        ev = ev.where(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        ev = ev.where(F.col("ts") < F.lit(end).cast("timestamp_ntz"))
    price = F.lit(1.0) + F.col("value") / F.lit(10000.0)
    return ev.select(
        F.col("event_type").alias("symbol"),
        F.col("event_id").alias("seq"),
        F.col("ts").cast("timestamp").alias("time"),
        price.alias("price"),
        price.alias("bid"),
        (price + F.lit(0.0001)).alias("ask"),
        "user_id",
        "value",
    )


def bars(spark: SparkSession, folder: str, seconds: int = 3600) -> DataFrame:
    return ticks_to_bars(ticks(spark, folder), seconds)


def trades(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders")
    opened = F.col("o_orderdate").cast("timestamp")
    is_open = F.col("o_orderstatus") == "O"
    closed = F.timestamp_seconds(F.unix_seconds(opened) + (F.col("o_orderkey") % 72) * 3600)
    profit = F.floor((F.col("o_totalprice") - F.lit(250000.0)) / F.lit(10.0)) / F.lit(100.0)
    entry = F.lit(1.0) + F.col("o_custkey") / F.lit(100000.0)
    return o.select(
        F.col("o_orderkey").alias("ticket"),
        F.col("o_orderpriority").alias("symbol"),
        F.when(F.col("o_custkey") % 2 == 0, F.lit("BUY")).otherwise(F.lit("SELL")).alias("type"),
        F.lit(0.1).alias("volume"),
        entry.alias("open_price"),
        opened.alias("open_time"),
        F.when(~is_open, entry + F.lit(0.001)).alias("close_price"),
        F.when(~is_open, closed).alias("close_time"),
        F.when(~is_open, profit).alias("profit"),
        F.when(F.col("o_orderkey") % 10 == 0, F.lit(0.0)).otherwise(entry - F.lit(0.002)).alias("sl"),
        (entry + F.lit(0.004)).alias("tp"),
    )


def calendar(spark: SparkSession, folder: str) -> DataFrame:
    """High-impact news: large error events, one third of them without a currency."""
    ev = table(spark, folder, "events").where((F.col("event_type") == "error") & (F.col("value") > 200))
    kind = F.col("user_id") % 3
    return ev.select(
        F.col("ts").cast("timestamp").alias("time"),
        F.lit("High").alias("impact"),
        F.when(kind == 0, F.lit("")).when(kind == 1, F.lit("CLI")).otherwise(F.lit("VIE")).alias("currency"),
        F.col("event_id").alias("event"),
    )


def trials(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "part")
    sharpe = (F.col("p_retailprice") - F.lit(950.0)) / F.lit(20.0)
    return p.select(
        F.col("p_partkey").alias("sr_id"),
        F.col("p_brand").alias("book_slug"),
        F.col("p_name").alias("strategy_name"),
        F.col("p_type").alias("mapped_type"),
        sharpe.alias("sharpe"),
        (F.col("p_size") / F.lit(10.0)).alias("max_dd"),
        (F.lit(20.0) + F.col("p_size")).alias("win_rate"),
        F.when((F.col("p_size") > 10) & (sharpe > 0), F.lit("PASS")).otherwise(F.lit("FAIL")).alias("guard"),
        (F.col("p_partkey") % 97).cast("long").alias("trades"),
    )


def position_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """One snapshot per ticket and polled hour: the last value of that hour is the stop."""
    ev = table(spark, folder, "events")
    poll = F.date_trunc("hour", F.col("ts").cast("timestamp"))
    return ev.groupBy(F.col("user_id").alias("ticket"), poll.alias("poll")).agg(
        F.max_by("event_type", "event_id").alias("symbol"),
        F.max_by("value", "event_id").alias("sl"),
        F.max_by(F.floor(F.col("value") / 50), "event_id").cast("double").alias("tp"),
        F.when(F.count(F.lit(1)) > 1, F.lit(0.2)).otherwise(F.lit(0.1)).alias("volume"),
    )


def closed_records(spark: SparkSession, folder: str) -> DataFrame:
    """Every purchase read as a closed record of its ticket, reported at the poll of its hour."""
    ev = table(spark, folder, "events").where(F.col("event_type") == "purchase")
    at = F.struct("ts", "event_id")
    value = F.col("value")
    rows = ev.select(
        F.col("user_id").alias("ticket"), F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("poll"), F.col("event_type").alias("symbol"), (F.lit(1.0) + value / F.lit(10000.0)).alias("close_price"),
        (F.lit(50.0) - value).alias("profit"), F.when(value < 50, F.lit("tp")).otherwise(F.lit("sl")).alias("reason"), at.alias("_at"))
    # of the records of one poll the first reported one is kept
    first = rows.groupBy("ticket", "poll").agg(F.min_by(F.struct("symbol", "close_price", "profit", "reason"), "_at").alias("_r"))
    return first.select("ticket", "poll", "_r.*")


def _score(step: float) -> Column:
    return F.floor((F.col("o_totalprice") - F.lit(250000.0)) / F.lit(1000.0 * step)) * F.lit(step) / F.lit(100.0)


def _day_number() -> Column:
    return F.datediff(F.col("o_orderdate"), F.lit("1995-01-01").cast("date")).cast("long")


def sweep_log(spark: SparkSession, folder: str) -> DataFrame:
    """Parameter-change log: one row per order, one strategy per priority."""
    o = table(spark, folder, "orders")
    return o.select(
        F.col("o_orderkey").alias("iteration"),
        F.concat(F.lit("param_"), (F.col("o_custkey") % 3).cast("string")).alias("param"),
        (F.col("o_custkey") % 5).cast("double").alias("old_val"),
        (F.col("o_custkey") % 4).cast("double").alias("new_val"),
        _score(50.0).alias("sharpe"),
        (_score(1.0) - F.lit(0.5)).alias("dsr"),
        (F.col("o_custkey") % 100).cast("double").alias("max_dd"),
        (F.col("o_custkey") % 90).cast("double").alias("win_rate"),
        F.when(F.col("o_orderstatus") == "F", F.lit("keep")).otherwise(F.lit("rollback")).alias("decision"),
        F.col("o_orderpriority").alias("strategy"),
        F.col("o_orderdate").cast("timestamp").alias("timestamp"),
    )


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """Search runs: one per order, grouped into one iteration per order day."""
    o = table(spark, folder, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"),
        _day_number().alias("iteration_id"),
        F.col("o_orderpriority").alias("symbol"),
        F.when(F.col("o_orderstatus") == "F", F.lit("H1")).otherwise(F.lit("M15")).alias("timeframe"),
        F.when(F.col("o_custkey") % 2 == 0, F.lit("mean_reversion")).otherwise(F.lit("ema_crossover")).alias("strategy"),
        _score(1.0).alias("sharpe"),
        F.when(F.col("o_custkey") % 7 != 0, _score(1.0) - F.lit(0.5)).alias("dsr"),
        F.when(F.col("o_totalprice") > 300000, F.lit("PASS")).otherwise(F.lit("FAIL")).alias("guard"),
        F.when(F.col("o_totalprice") > 480000, F.lit(1)).otherwise(F.lit(0)).cast("long").alias("promoted"),
    )


def iterations(spark: SparkSession, folder: str) -> DataFrame:
    """Supervisor iterations: one per order day."""
    o = table(spark, folder, "orders")
    return o.groupBy(_day_number().alias("id")).agg(
        F.min("o_orderdate").cast("timestamp").alias("timestamp"),
        F.sum(F.when(F.col("o_totalprice") > 480000, 1).otherwise(0)).cast("long").alias("combos_promoted"),
    )
