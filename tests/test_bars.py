import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.operators import bars as B
from tickloom.operators import joins as J
from tickloom.sources import files

SCHEMA = "symbol string, tf string, time timestamp, open double, high double, low double, close double, volume long"


def rows(spark, closes, start="2024-01-01", symbol="EURUSD", tf="H1"):
    t = pd.date_range(start, periods=len(closes), freq="h")
    return spark.createDataFrame([(symbol, tf, x.to_pydatetime(), c, c, c, c, 1) for x, c in zip(t, map(float, closes))], SCHEMA)


def closes(df):
    return [r.close for r in df.orderBy("time").collect()]


def test_merge_and_upsert(spark):
    a, b = rows(spark, [1, 2, 3]), rows(spark, [9, 8, 7], "2024-01-01 01:00")
    assert closes(B.merge_stored_wins(a, b)) == [1, 2, 3, 7]
    assert closes(B.upsert_incoming_wins(a, b)) == [1, 9, 8, 7]
    assert closes(B.merge_stored_wins(a.limit(0), b)) == [9, 8, 7]


def test_last_duplicate_of_a_batch_wins(spark):
    bar = "struct<time:long,open:double,high:double,low:double,close:double,volume:long>"
    one = lambda c: {"time": 3600, "open": c, "high": c, "low": c, "close": c, "volume": 1}
    df = spark.createDataFrame([("EURUSD", "h1", 1, [one(1.0), one(2.0)]), ("EURUSD", "Z9", 1, [one(5.0)])], f"symbol string, timeframe string, batch_id long, bars array<{bar}>")
    got = B.ingest_batches(df).collect()
    assert [(r.tf, r.close) for r in got] == [("H1", 2.0)]


def test_coerce_rejects_missing_columns_and_reads_epochs(spark):
    with pytest.raises(B.SchemaMismatch):
        B.coerce_bars(spark.createDataFrame([(1, 1.0)], "time long, open double"))
    df = spark.createDataFrame([(3600, 1.0, 1.0, 1.0, 1.0, 5), (3600, 2.0, 2.0, 2.0, 2.0, 6), (0, 3.0, 3.0, 3.0, 3.0, 7)], "time long, open double, high double, low double, close double, volume int")
    got = B.coerce_bars(df.withColumn("seq", F.col("volume")), order=["seq"]).orderBy("time").collect()
    assert [(r.time.hour, r.close) for r in got] == [(0, 3.0), (1, 1.0)]


def test_folds_cover_every_row_once(spark):
    df = rows(spark, range(1000))
    f = B.fold_bars(df, 5, 10).toPandas()
    assert f.fold.value_counts().tolist() == [200] * 5
    bounds = B.fold_bounds(df, 5, 10, ["symbol"]).orderBy("fold").collect()
    assert [(b.test_start, b.test_end, b.train_until, b.train_from) for b in bounds][2] == (400, 600, 390, 610)
    small = B.fold_bars(rows(spark, range(50)), 10, 5).toPandas()
    assert small.fold.dropna().unique().tolist() == [0] and small.fold.notna().sum() == 5
    one = B.fold_bounds(rows(spark, range(50)), 10, 5, ["symbol"]).collect()
    assert [(b.test_start, b.test_end, b.train_until) for b in one] == [(45, 50, 40)]


def test_pages_and_holdout(spark):
    df = rows(spark, range(100))
    page = B.history_page(df, 10, 5)
    assert closes(page) == list(range(85, 95)) and page.first().total_available == 100
    assert closes(B.tail_holdout(df, 0.9)) == list(range(90, 100))
    assert B.tail_holdout(df, 0).count() == 100 and B.history_page(df, 10, 500).count() == 0


def test_news_buffer_cases(spark):
    cal = spark.createDataFrame([("2024-01-05 14:00:00", "GBP")], "t string, currency string").select(F.col("t").cast("timestamp").alias("time"), "currency")
    times = ["13:29", "13:45", "14:00", "14:29", "14:31"]
    df = spark.createDataFrame([(s, f"2024-01-05 {t}:00") for t in times for s in ("GBPUSD", "EURUSD")], "symbol string, t string").select("symbol", F.col("t").cast("timestamp").alias("time"))
    open_ = J.news_blackout(df, cal, 30).toPandas()
    assert open_[open_.symbol == "GBPUSD"].time.dt.strftime("%H:%M").tolist() == ["13:29", "14:31"]
    assert len(open_[open_.symbol == "EURUSD"]) == 5


def test_bar_table_round_trip_and_guards(spark, tmp_path):
    path = str(tmp_path / "bars")
    assert files.load_bars(spark, path).count() == 0
    files.write_bars(rows(spark, [1, 2, 3]).unionByName(rows(spark, [5], symbol="GBPUSD")), path)
    files.write_bars(rows(spark, [7, 8], symbol="GBPUSD"), path)
    assert closes(files.load_bars(spark, path, "EURUSD", "H1", 2)) == [2, 3]
    verdict = files.write_if_not_smaller(rows(spark, [0, 0]), path).first()
    assert not verdict.accepted and closes(files.load_bars(spark, path, "EURUSD")) == [1, 2, 3]
    with pytest.raises(B.SchemaMismatch):
        files.write_bars(rows(spark, [1]).unionByName(rows(spark, [2])), path)


def test_text_sources(spark, tmp_path):
    (tmp_path / "t.csv").write_text("ticket,symbol,type,close_time,profit,extra\n1,EURUSD,BUY,2026-01-01T00:00:00Z,1.5,x\n2,EURUSD,BUY,,,y\n3,a,b,c,d,e,f,g\n")
    got = files.read_trades(spark, str(tmp_path / "t.csv")).orderBy("ticket").collect()
    assert [(r.ticket, r.profit) for r in got] == [(1, 1.5), (2, None)] and "extra" not in got[0].asDict()
    assert files.read_trades(spark, str(tmp_path / "none.csv")).count() == 0
    (tmp_path / "l.tsv").write_text("sr_id\tbook_slug\tstrategy_name\tmapped_type\tsharpe\tmax_dd\twin_rate\tguard\ttrades\n1\tb\ts\tm\t0.5\t1\t2\tPASS\t3\nx\tb\ts\tm\t0.5\t1\t2\tPASS\t3\n")
    assert [r.sr_id for r in files.read_trials(spark, str(tmp_path / "l.tsv")).collect()] == [1]
    log = str(tmp_path / "log")
    first = spark.createDataFrame([(1, 2.0)], "a long, b double")
    assert files.append_trials(first, log) == log and files.append_trials(first, log) == log
    assert files.append_trials(first.withColumn("c", F.lit(1)), log) == f"{log}.v2"
    (tmp_path / "c.csv").write_text("time,impact,currency\n2026-01-01T10:00:00Z,high,usd\nbad,High,usd\n2026-01-01T10:00:00Z,Low,eur\n")
    assert [(r.currency, r.time.hour) for r in files.read_calendar(spark, str(tmp_path / "c.csv")).collect()] == [("USD", 10)]
    (tmp_path / "kb" / "sub").mkdir(parents=True)
    (tmp_path / "kb" / "a.md").write_text("# A\ntext\n")
    (tmp_path / "kb" / "sub" / "b.md").write_text("# B\n\nmore\n")
    (tmp_path / "kb" / "_meta.md").write_text("skip")
    assert sorted(r.text for r in files.read_corpus(spark, str(tmp_path / "kb")).collect()) == ["# A\ntext\n", "# B\n\nmore\n"]
