"""Registered queries and, where SQL can say it, the same query as plain SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.series import settle
from ..sources import tables as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return T.plain_times(fn(spark, folder))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def r(col: str | Column, places: int = 8, name: str | None = None) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c, places).alias(name or col)


def hourly(spark: SparkSession, folder: str) -> DataFrame:
    """Hour bars, settled because the ordered operators read them twice."""
    return settle(T.bars(spark, folder, 3600))


# The same model in SQL, for the oracles.
TICKS = """ticks AS (
  SELECT event_type AS symbol, event_id AS seq, ts AS time, 1.0 + value / 10000.0 AS price,
         1.0 + value / 10000.0 AS bid, (1.0 + value / 10000.0) + 0.0001 AS ask, user_id, value
  FROM events)"""


def bars_sql(seconds: int = 3600, name: str = "bars") -> str:
    return f"""{name} AS (
  SELECT symbol, time_bucket(INTERVAL '{seconds} seconds', time) AS time, arg_min(price, seq) AS open,
         max(price) AS high, min(price) AS low, arg_max(price, seq) AS close, count(*) AS volume
  FROM ticks GROUP BY 1, 2)"""


PLACED = "b AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY time) - 1 AS pos FROM bars)"
BARS = f"WITH {TICKS}, {bars_sql()}"
POS = f"{BARS}, {PLACED}"

TRADES = """trades AS (
  SELECT o_orderkey AS ticket, o_orderpriority AS symbol,
         CASE WHEN o_custkey % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS type, 0.1::DOUBLE AS volume,
         1.0 + o_custkey / 100000.0 AS open_price, o_orderdate AS open_time,
         CASE WHEN o_orderstatus <> 'O' THEN (1.0 + o_custkey / 100000.0) + 0.001 END AS close_price,
         CASE WHEN o_orderstatus <> 'O' THEN o_orderdate + to_hours(o_orderkey % 72) END AS close_time,
         CASE WHEN o_orderstatus <> 'O' THEN floor((o_totalprice - 250000.0) / 10.0) / 100.0 END AS profit,
         CASE WHEN o_orderkey % 10 = 0 THEN 0.0 ELSE (1.0 + o_custkey / 100000.0) - 0.002 END::DOUBLE AS sl,
         ((1.0 + o_custkey / 100000.0) + 0.004)::DOUBLE AS tp
  FROM orders)"""

TRIALS = """trials AS (
  SELECT p_partkey AS sr_id, p_brand AS book_slug, p_name AS strategy_name, p_type AS mapped_type,
         (p_retailprice - 950.0) / 20.0 AS sharpe, p_size / 10.0 AS max_dd, 20.0 + p_size AS win_rate,
         CASE WHEN p_size > 10 AND (p_retailprice - 950.0) / 20.0 > 0 THEN 'PASS' ELSE 'FAIL' END AS guard,
         p_partkey % 97 AS trades
  FROM part)"""

CALENDAR = """calendar AS (
  SELECT ts AS time, CASE user_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'CLI' ELSE 'VIE' END AS currency, event_id AS event
  FROM events WHERE event_type = 'error' AND value > 200)"""

_SCORE1 = "floor((o_totalprice - 250000.0) / 1000.0) * 1.0 / 100.0"
SWEEP_LOG = f"""log AS (
  SELECT o_orderkey AS iteration, 'param_' || (o_custkey % 3) AS param, (o_custkey % 5)::DOUBLE AS old_val,
         (o_custkey % 4)::DOUBLE AS new_val, floor((o_totalprice - 250000.0) / 50000.0) * 50.0 / 100.0 AS sharpe,
         {_SCORE1} - 0.5 AS dsr, (o_custkey % 100)::DOUBLE AS max_dd, (o_custkey % 90)::DOUBLE AS win_rate,
         CASE WHEN o_orderstatus = 'F' THEN 'keep' ELSE 'rollback' END AS decision,
         o_orderpriority AS strategy, o_orderdate AS timestamp
  FROM orders)"""
RUNS = f"""runs AS (
  SELECT o_orderkey AS id, date_diff('day', DATE '1995-01-01', o_orderdate::DATE) AS iteration_id,
         o_orderpriority AS symbol, CASE WHEN o_orderstatus = 'F' THEN 'H1' ELSE 'M15' END AS timeframe,
         CASE WHEN o_custkey % 2 = 0 THEN 'mean_reversion' ELSE 'ema_crossover' END AS strategy,
         {_SCORE1} AS sharpe, CASE WHEN o_custkey % 7 <> 0 THEN {_SCORE1} - 0.5 END AS dsr,
         CASE WHEN o_totalprice > 300000 THEN 'PASS' ELSE 'FAIL' END AS guard,
         CASE WHEN o_totalprice > 480000 THEN 1 ELSE 0 END AS promoted
  FROM orders)"""
ITERATIONS = """iterations AS (
  SELECT date_diff('day', DATE '1995-01-01', o_orderdate::DATE) AS id, min(o_orderdate) AS timestamp,
         sum(CASE WHEN o_totalprice > 480000 THEN 1 ELSE 0 END)::BIGINT AS combos_promoted
  FROM orders GROUP BY 1)"""
SNAPSHOTS = """snaps AS (
  SELECT user_id AS ticket, date_trunc('hour', ts) AS poll, arg_max(event_type, event_id) AS symbol,
         arg_max(value, event_id) AS sl, arg_max(floor(value / 50), event_id)::DOUBLE AS tp,
         CASE WHEN count(*) > 1 THEN 0.2 ELSE 0.1 END::DOUBLE AS volume
  FROM events GROUP BY 1, 2)"""
