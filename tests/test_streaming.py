import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import walk
from tickloom.operators.bars import ticks_to_bars
from tickloom.operators.indicators import rolling_spread
from tickloom.operators.positions import event_counts, position_events, with_closes
from tickloom.sources.files import load_bars
from tickloom.streaming import keyed as K
from tickloom.streaming import live as L


def as_stream(spark, folder, parts):
    """One file per micro-batch."""
    for i, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(f"{folder}/in/p{i}")
    return spark.readStream.schema(parts[0].schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


@pytest.fixture()
def ticks(spark):
    pdf = walk(400, 5, step="7min").assign(seq=range(400))
    return spark.createDataFrame(pdf.rename(columns={"close": "price"})[["symbol", "time", "price", "seq"]]).withColumn("spread", F.col("seq") % 5 + 0.5)


def halves(df):
    return [df.where("seq < 150"), df.where("seq >= 150 and seq < 151"), df.where("seq >= 151")]


def test_sealed_bars_equal_batch_bars(spark, tmp_path, ticks):
    got = L.drain(L.bar_stream(as_stream(spark, tmp_path, halves(ticks))), spark, str(tmp_path / "run")).orderBy("time").toPandas()
    want = ticks_to_bars(ticks).orderBy("time").toPandas()
    assert 0 < len(want) - len(got) <= 2
    pd.testing.assert_frame_equal(got, want.iloc[: len(got)][got.columns.tolist()])


def in_turn(spark, folder, parts, make):
    """Each part is written, then the same query is started again on what is new."""
    parts[0].limit(0).write.mode("append").parquet(f"{folder}/in")
    stream = make(spark.readStream.schema(parts[0].schema).parquet(f"{folder}/in"))
    seen = []
    for part in parts:
        part.repartition(3).write.mode("append").parquet(f"{folder}/in")
        seen.append(L.drain(stream, spark, str(folder)).count())
    return L.drain(stream, spark, str(folder)), seen


def test_late_ticks_are_returned_with_their_bar(spark, tmp_path, ticks):
    late = ticks.where("seq in (0, 1, 9, 380)")
    parts = [ticks.where("seq < 300 and seq not in (0, 1, 9)"), ticks.where("seq >= 300 and seq <> 380"), late]
    got, seen = in_turn(spark, tmp_path, parts, K.late_stream)
    rows = got.orderBy("seq").collect()
    assert [r.seq for r in rows] == [0, 1, 9, 380] and seen == [0, 0, 4]
    assert all(r.bar == r.time.replace(minute=0, second=0, microsecond=0) for r in rows)
    bars, _ = in_turn(spark, tmp_path / "bars", parts, L.bar_stream)
    missing = ticks_to_bars(ticks).select("time", F.col("volume").alias("all")).join(bars, "time").where("all <> volume").agg(F.sum(F.col("all") - F.col("volume"))).first()[0]
    assert missing == 4


def test_spread_sink_carries_its_tail(spark, tmp_path, ticks):
    t = ticks.select("symbol", "seq", "time", "spread")
    out = str(tmp_path / "out")
    L.drain_with(as_stream(spark, tmp_path, halves(t)), L.spread_sink(out, str(tmp_path / "state"), 20), str(tmp_path / "run"))
    got = spark.read.parquet(out).orderBy("seq").toPandas()
    want = rolling_spread(t, 20).orderBy("seq").toPandas()
    assert got.avg_spread.tolist() == pytest.approx(want.avg_spread.tolist())


def state_rows(stream, folder):
    """Most rows that the stream's state held at a time."""
    with L.state_partitions(stream.sparkSession):
        q = stream.writeStream.format("noop").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    return max(o.numRowsTotal for p in q.recentProgress for o in p.stateOperators)


def snapshots(spark):
    polls = pd.date_range("2024-01-01", periods=12, freq="h").to_pydatetime()
    rows = [(1, p, "A", 1.0 + (i > 2), 2.0, 0.1) for i, p in enumerate(polls) if i != 4] + [(2, p, "B", 1.0, 2.0, 0.1 + 0.1 * (i % 2)) for i, p in enumerate(polls)]
    rows += [(3, p, "C", None if i % 3 else 1.0, 2.0, 0.1) for i, p in enumerate(polls) if i > 6]
    return spark.createDataFrame(rows, "ticket long, poll timestamp, symbol string, sl double, tp double, volume double")


def cut_at(df, hours):
    """Parts of the table between the hours of its day."""
    h = F.hour("poll")
    return [df.where((h >= a) & (h < b)) for a, b in zip([0, *hours], [*hours, 24])]


def test_position_events_equal_the_batch_form_after_restarts(spark, tmp_path):
    df = snapshots(spark)
    closed = spark.createDataFrame(
        [(1, "2024-01-01 05:30:00", "A", 7.0), (1, "2024-01-01 05:10:00", "A", 6.0), (1, "2024-01-01 09:00:00", "A", 5.0), (2, "2024-01-01 11:00:00", "B", None)],
        "ticket long, at string, symbol string, profit double").withColumn("poll", F.col("at").cast("timestamp")).drop("at")
    df_parts, closed_parts = cut_at(df, [3, 4, 8]), cut_at(closed, [3, 4, 8])
    both = [a.withColumn("profit", F.lit(None).cast("double")).withColumn("shut", F.lit(False)).unionByName(b.withColumn("shut", F.lit(True)), allowMissingColumns=True) for a, b in zip(df_parts, closed_parts)]
    got, seen = in_turn(spark, tmp_path, both, lambda s: K.position_stream(s.where("not shut"), s.where("shut")))
    want = with_closes(position_events(df, 3600), closed)
    cols = ["ticket", "poll", "event", "changes", "sl", "profit"]
    by = lambda t: sorted((tuple(r) for r in t.select(cols).collect()), key=str)
    assert by(got) == by(want)
    assert seen == sorted(seen) and 0 < seen[0] < seen[-1] == got.count() and len(seen) == 4
    counts = event_counts(got).agg(*[F.sum(k) for k in ("opened", "modified", "closed")]).first()
    assert tuple(counts) == (4, 14, 2)
    assert got.where("event = 'closed' and ticket = 1").first().profit == 6.0


def test_an_older_snapshot_changes_nothing(spark, tmp_path):
    df = snapshots(spark).where("ticket = 2")
    got, _ = in_turn(spark, tmp_path, [df.where(F.hour("poll") >= 6), df.where(F.hour("poll") < 6)], K.position_stream)
    assert got.count() == 6 and got.agg(F.min(F.hour("poll"))).first()[0] == 6


def test_first_close_of_each_ticket_over_restarts(spark, tmp_path):
    rows = [(t, f"2024-01-01 0{h}:00:00", 10 * h + t) for h in range(6) for t in range(5) if t <= h] + [(0, "2024-01-01 00:00:00", -1)]
    df = spark.createDataFrame(rows, "ticket long, at string, seq long").withColumn("poll", F.col("at").cast("timestamp")).drop("at")
    got, seen = in_turn(spark, tmp_path, cut_at(df, [2, 3, 4]), lambda s: K.first_close_stream(s, ["poll", "seq"]))
    assert [tuple(r) for r in got.select("ticket", "seq").orderBy("ticket").collect()] == [(0, -1), (1, 11), (2, 22), (3, 33), (4, 44)]
    assert seen == [2, 3, 4, 5]


def test_many_tickets_share_a_key(spark, tmp_path):
    rows = [(t, f"2024-01-01 0{h}:00:00", 1.0 + ((t or 0) % 2) * h) for t in [None, *range(3000)] for h in range(2)]
    df = spark.createDataFrame(rows, "ticket long, at string, sl double").select("ticket", F.col("at").cast("timestamp").alias("poll"), F.lit("A").alias("symbol"), "sl", F.lit(2.0).alias("tp"), F.lit(0.1).alias("volume"))
    df.write.parquet(str(tmp_path / "in"))
    assert state_rows(K.position_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))), tmp_path) < 3000
    got, seen = in_turn(spark, tmp_path / "few", [df.where("hour(poll) = 0"), df.where("hour(poll) = 1")], lambda s: K.position_stream(s, s.where("ticket % 3 = 0"), buckets=4))
    by = {(r.event, r.ticket is None, tuple(r.changes)): r["count"] for r in got.groupBy("event", "ticket", "changes").count().groupBy("event", F.expr("if(ticket is null, null, 1)").alias("ticket"), "changes").agg(F.sum("count").alias("count")).collect()}
    assert by == {("opened", False, ()): 3000, ("opened", True, ()): 1, ("modified", False, ("sl",)): 1500, ("closed", False, ()): 1000}
    assert seen == [4001, 5501]


def test_quotes_answer_orders_when_the_watermark_passes(spark, tmp_path):
    start = pd.Timestamp("2024-01-01")
    quotes = [("A", start + pd.Timedelta(seconds=s), i, 1.0 + i, 1.1 + i) for i, s in enumerate([0, 3, 9.5, 9.5, 30, 61, 200, 400])] + [("B", start + pd.Timedelta(seconds=31), 50, 0.0, 5.0)]
    orders = [(k, "A", start + pd.Timedelta(seconds=s)) for k, s in enumerate([0, 2.9, 8, 8.1, 12, 14.5, 14.6, 35, 35.1, 66, 390])] + [(99, "B", start + pd.Timedelta(seconds=32)), (100, "A", start - pd.Timedelta(seconds=1))]
    q = spark.createDataFrame(pd.DataFrame(quotes, columns=["symbol", "time", "seq", "bid", "ask"]))
    o = spark.createDataFrame(pd.DataFrame(orders, columns=["order_id", "symbol", "order_time"]))
    both = q.unionByName(o.withColumn("time", F.col("order_time")), allowMissingColumns=True)
    parts = [both.where(F.col("time") < F.lit(str(start + pd.Timedelta(seconds=c)))) for c in (10, 40, 100)]
    cuts = [parts[0], parts[1].subtract(parts[0]), parts[2].subtract(parts[1]), both.subtract(parts[2])]
    got, seen = in_turn(spark, tmp_path, cuts, lambda s: K.quote_stream(s.where("order_id is not null").select("order_id", "symbol", "order_time"), s.where("order_id is null").select("symbol", "time", "seq", "bid", "ask")))
    want = {}
    for k, symbol, at in orders:
        near = [(t, seq, bid) for sym, t, seq, bid, ask in quotes if sym == symbol and bid and ask and at - pd.Timedelta(seconds=5) <= t <= at]
        want[k] = max(near)[2] if near else None
    want.pop(10)  # its slot ends at 400 s, the watermark stands at 330 s
    assert {r.order_id: r.bid for r in got.collect()} == want and want[4] == 4.0
    assert {r.order_id for r in got.where("stale").collect()} == {k for k, v in want.items() if v is None}
    assert seen[0] == 0 and seen[-1] == len(want)


def test_quotes_of_many_slots_share_a_key(spark, tmp_path):
    start = pd.Timestamp("2024-01-01")
    df = spark.createDataFrame(pd.DataFrame([("A", start + pd.Timedelta(seconds=20 * k), k, 1.0, 2.0) for k in range(500)], columns=["symbol", "time", "seq", "bid", "ask"]))
    df.write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    orders = s.select(F.col("seq").alias("order_id"), "symbol", F.col("time").alias("order_time"))
    assert state_rows(K.quote_stream(orders, s), tmp_path) < 50
    few, _ = in_turn(spark, tmp_path / "few", [df.where("seq < 200"), df.where("seq >= 200")], lambda s: K.quote_stream(s.select(F.col("seq").alias("order_id"), "symbol", F.col("time").alias("order_time")), s, slots=30))
    assert few.where("not stale and bid = 1.0").count() == few.count() == few.select("order_id").distinct().count() == 496


def test_silent_sources_are_reported(spark, tmp_path):
    start = pd.Timestamp("2024-01-01")
    beats = [("a", s) for s in range(0, 400, 5)] + [("b", s) for s in [0, 5, 12, 40, 41, 56, 70.5]] + [("c", 0), ("c", 390)]
    df = spark.createDataFrame(pd.DataFrame([(n, start + pd.Timedelta(seconds=s), s) for n, s in beats], columns=["source", "time", "s"]))
    got, seen = in_turn(spark, tmp_path, [df.where(f"s >= {a} and s < {b}") for a, b in ((0, 30), (30, 60), (60, 150), (150, 500))], lambda s: K.connection_events(s.select("source", "time"), 15))
    at = lambda x: start + pd.Timedelta(seconds=x)
    mine = {(r.source, r.event, pd.Timestamp(r.at), r.beats) for r in got.collect()}
    assert mine == {("a", "back", at(0), None), ("b", "back", at(0), None), ("b", "lost", at(27), 3), ("b", "back", at(40), None), ("b", "lost", at(56), 2), ("b", "back", at(56), None),
                    ("b", "lost", at(85.5), 2), ("c", "back", at(0), None), ("c", "lost", at(15), 1), ("c", "back", at(390), None)}
    assert got.count() == len(mine) and ("b", "lost", at(85.5), 2) in {(r.source, r.event, pd.Timestamp(r.at), r.beats) for r in got.collect()} and seen[2] >= 8


def test_history_sink_ends_with_all_bars(spark, tmp_path, ticks):
    path = str(tmp_path / "hist")
    L.drain_with(L.bar_stream(as_stream(spark, tmp_path, halves(ticks))), L.history_sink(path, "H1"), str(tmp_path / "run"), "update")
    got = load_bars(spark, path).orderBy("time").toPandas()
    want = ticks_to_bars(ticks).orderBy("time").toPandas()
    assert got.close.tolist() == want.close.tolist() and got.volume.tolist() == want.volume.tolist()


def test_targets_fire_once_per_ticket(spark, tmp_path, ticks):
    t = ticks.select("symbol", "seq", "time", (F.col("price")).alias("bid"), (F.col("price") + 0.0001).alias("ask"))
    rows = [(1, "EURUSD", "BUY", 1.09, 1.0), (2, "EURUSD", "BUY", 1.09, 9.0), (3, "EURUSD", "SELL", 1.2, 0.0)]
    late = [(4, "EURUSD", "BUY", 1.09, 1.0)]  # opened when the last tick has passed
    pos = spark.createDataFrame(rows + late, "ticket long, symbol string, side string, open_price double, tp double")
    pos = pos.withColumn("open_time", F.when(F.col("ticket") == 4, F.lit("2030-01-01")).otherwise("2020-01-01").cast("timestamp"))
    out = str(tmp_path / "acts")
    L.drain_with(as_stream(spark, tmp_path, halves(t)), L.target_sink(pos, out, str(tmp_path / "fired")), str(tmp_path / "run"))
    assert [(r.ticket, r.new_sl) for r in spark.read.parquet(out).collect()] == [(1, 1.0901)]
