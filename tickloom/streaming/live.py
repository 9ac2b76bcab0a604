"""Structured Streaming operators: bars, positions, quotes, accounts, heartbeats."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.money import break_even_stop, target_reached
from ..operators.accounts import STATE_SCHEMA, account_state, account_verdicts
from ..operators.bars import cap_history, upsert_incoming_wins
from ..operators.experiments import last_rows
from ..operators.indicators import rolling_spread
from ..operators.series import running, settle
from ..sources.files import load_bars, write_if_not_smaller

FLUSH_EVERY = "30 seconds"
TICK_SCHEMA = "symbol string, seq long, time timestamp, spread double"


def bar_stream(ticks: DataFrame, seconds: int = 3600, lateness: str = "10 minutes") -> DataFrame:
    """Bars of a tick stream (symbol, time, price, seq).

    In append mode a bar appears once it is sealed by the watermark; in update
    mode open bars appear as they change.  Ticks behind the watermark are dropped;
    ``keyed.late_stream`` returns them.
    """
    w = F.window("time", f"{seconds} seconds")
    return (
        ticks.withWatermark("time", lateness)
        .groupBy("symbol", w.alias("w"))
        .agg(
            F.min_by("price", "seq").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
            F.max_by("price", "seq").alias("close"), F.count(F.lit(1)).alias("volume"),
        )
        .select("symbol", F.col("w.start").alias("time"), "open", "high", "low", "close", "volume")
    )


def _previous(spark: SparkSession, state: str, batch_id: int, schema: str) -> DataFrame:
    if batch_id == 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{state}/b{batch_id - 1}")


def loss_alert_stream(closed: DataFrame, usd: float) -> DataFrame:
    return closed.where(F.col("profit") < F.lit(-usd))


def spread_sink(out: str, state: str, n: int = 20) -> Callable[[DataFrame, int], None]:
    """foreachBatch writer of the mean spread over the last n ticks per symbol.

    The state is a table with the last n ticks of each symbol, one folder per
    batch; a repeated batch reads the same earlier state and overwrites its own
    output, so restarts do not double rows.
    """
    cols = ("symbol", "seq", "time", "spread")

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = batch.select(*cols)
        past = _previous(spark, state, batch_id, TICK_SCHEMA)
        both = settle(past.withColumn("_new", F.lit(False)).unionByName(fresh.withColumn("_new", F.lit(True))))
        done = rolling_spread(both, n).where("_new").select("symbol", "seq", "avg_spread")
        done.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        last_rows(both, ["symbol"], "seq", n).select(*cols).write.mode("overwrite").parquet(f"{state}/b{batch_id}")

    return write


def history_sink(path: str, tf: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch writer of changed bars: incoming wins, capped, and never fewer rows than stored."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = settle(batch.withColumn("tf", F.lit(tf)))
        touched = fresh.select("symbol", "tf").distinct()
        stored = load_bars(spark, path).where(F.col("tf") == tf).join(touched, ["symbol", "tf"], "left_semi")
        merged = upsert_incoming_wins(stored, fresh, ["symbol", "tf", "time"])
        write_if_not_smaller(cap_history(settle(merged)), path)

    return write


def start_history(bars: DataFrame, path: str, tf: str, checkpoint: str):
    """Keep a bar history up to date: changed bars are flushed every 30 seconds."""
    return bars.writeStream.outputMode("update").foreachBatch(history_sink(path, tf)).option("checkpointLocation", checkpoint).trigger(
        processingTime=FLUSH_EVERY).start()


def account_sink(out: str, state: str, cooling_hours: float = 24.0) -> Callable[[DataFrame, int], None]:
    """foreachBatch writer of breaker verdicts; the state is one row per account and batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        past = _previous(batch.sparkSession, state, batch_id, STATE_SCHEMA)
        v = settle(account_verdicts(batch, past, cooling_hours))
        v.drop("cooling_from", "day", "fresh").write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        account_state(v, past).write.mode("overwrite").parquet(f"{state}/b{batch_id}")

    return write


def target_touches(ticks: DataFrame, positions: DataFrame, slot_seconds: int = 60) -> DataFrame:
    """Positions whose first target some tick of the batch touched at or after ``open_time``, with their action.

    Time is cut into slots.  A position needs the best quotes of its own slot from its
    opening on, and those of all later slots, which shrink to one row per symbol and
    slot first.  Both are running values backwards in time, so no pairs are built.
    """
    slot = lambda c: F.floor(F.unix_seconds(c) / F.lit(slot_seconds)).cast("long")
    t = ticks.select("symbol", F.unix_micros("time").alias("_t"), slot("time").alias("_slot"), "bid", "ask")
    later = t.groupBy("symbol", "_slot").agg(F.max("bid").alias("bid"), F.min("ask").alias("ask"))
    p = positions.withColumns({"_t": F.unix_micros("open_time"), "_slot": slot("open_time")})
    asked = p.select("ticket", "symbol", "_t", "_slot")
    back = Window.partitionBy("symbol", "_slot").orderBy(F.desc("_t"), F.col("ticket").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    own = t.unionByName(asked, allowMissingColumns=True).withColumns({"_b": F.max("bid").over(back), "_a": F.min("ask").over(back)}).where("ticket is not null").select("ticket", "_b", "_a")
    # slots after the own one: running values over the slots of the batch, newest first
    marks = later.withColumn("_is", F.lit(0)).unionByName(asked.select("ticket", "symbol", "_slot", F.lit(1).alias("_is")), allowMissingColumns=True)
    flip = marks.withColumn("_back", -F.col("_slot"))
    run = running(settle(flip), ["symbol"], F.floor(F.col("_back") / F.lit(1440)).cast("long"), ["_back", F.desc("_is")], {"_lb": ("max", F.col("bid")), "_la": ("min", F.col("ask"))})
    after = run.where("_is = 1").select("ticket", "_lb", "_la")
    j = p.join(own, "ticket").join(after, "ticket")
    hit = j.where(F.coalesce(target_reached(F.col("side"), F.col("tp"), F.greatest("_b", "_lb"), F.least("_a", "_la")), F.lit(False)))
    return hit.select("ticket", "symbol", F.lit(0.5).alias("close_fraction"), break_even_stop(F.col("side"), F.col("open_price")).alias("new_sl"))


def target_sink(positions: DataFrame, out: str, state: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch writer of partial-close and break-even actions, once per ticket.

    The state is the fired tickets among ``positions``, one folder per batch.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        fired = _previous(batch.sparkSession, state, batch_id, "ticket long")
        waiting = positions.join(fired, "ticket", "left_anti")
        hits = settle(target_touches(batch, waiting))
        hits.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        kept = fired.join(positions.select("ticket"), "ticket", "left_semi").unionByName(hits.select("ticket"))
        kept.write.mode("overwrite").parquet(f"{state}/b{batch_id}")

    return write


def connection_stream(beats: DataFrame, limit_seconds: int = 15, lateness: str = "1 minute") -> DataFrame:
    """Connected spans per source: a span ends ``limit`` after its last heartbeat."""
    w = F.session_window("time", f"{limit_seconds} seconds")
    g = beats.withWatermark("time", lateness).groupBy("source", w.alias("w")).agg(F.count(F.lit(1)).alias("beats"))
    return g.select("source", F.col("w.start").alias("connected_at"), F.col("w.end").alias("lost_at"), "beats")


def connected(beats: DataFrame, as_of, limit_seconds: int = 15) -> DataFrame:
    """Whether each source's last heartbeat is recent enough."""
    last = beats.groupBy("source").agg(F.max("time").alias("last_beat"))
    age = F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros("last_beat")
    return last.withColumn("connected", age <= F.lit(limit_seconds * 1_000_000))


STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_partitions(spark: SparkSession):
    """State stores on disk; they are not merged at run time, so size them by the cores there are."""
    wanted = {"spark.sql.shuffle.partitions": str(spark.sparkContext.defaultParallelism), "spark.sql.streaming.stateStore.providerClass": STATE_STORE}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def drain(stream: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    """Run an append stream over what is there and read back what it wrote."""
    with state_partitions(spark):
        q = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/checkpoint").option(
            "path", f"{folder}/out").trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def drain_with(stream: DataFrame, writer: Callable[[DataFrame, int], None], folder: str, mode: str = "append") -> None:
    """Run a stream through a foreachBatch writer over what is there."""
    with state_partitions(stream.sparkSession):
        q = stream.writeStream.outputMode(mode).foreachBatch(writer).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()
