import pytest
from pyspark.sql import functions as F

from tickloom.sources import files
from tickloom.sources.store import BarStore


def bars(spark, n, symbol="EURUSD", first=0, close=1.0):
    return spark.range(first, first + n).select(
        F.lit(symbol).alias("symbol"), F.lit("M1").alias("tf"), F.timestamp_seconds(F.col("id") * 60).alias("time"), *[F.lit(close).alias(c) for c in ("open", "high", "low")],
        F.col("id").cast("double").alias("close"), F.lit(1).cast("long").alias("volume"))


@pytest.fixture()
def many_files(spark):
    """Range partitions of about a hundred rows."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "10")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_a_kill_between_data_and_manifest_leaves_the_old_version(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "bars")
    files.write_bars(bars(spark, 50).unionByName(bars(spark, 7, "A/B c%d")), path)
    before = sorted(map(tuple, files.load_bars(spark, path).collect()))

    def killed(self, manifest, number):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(BarStore, "_publish", killed)
        with pytest.raises(KeyboardInterrupt):
            files.write_bars(bars(spark, 60, close=9.0), path)
    # a manifest that Spark began but never committed
    manifest = tmp_path / "bars" / "manifests" / "000000002"
    manifest.mkdir()
    assert BarStore(spark, path).versions() == [1] and sorted(map(tuple, files.load_bars(spark, path).collect())) == before
    assert {r.symbol: r.n_stored for r in BarStore(spark, path).counts().collect()} == {"EURUSD": 50, "A/B c%d": 7}
    manifest.rmdir()
    files.write_bars(bars(spark, 60, close=9.0), path)
    assert files.load_bars(spark, path, "EURUSD").where("open = 9.0").count() == 60 and files.load_bars(spark, path, "A/B c%d").count() == 7


def test_pages_open_only_the_files_they_need(spark, tmp_path, many_files):
    store = BarStore(spark, str(tmp_path / "bars"))
    store.replace(bars(spark, 1000).unionByName(bars(spark, 30, "GBPUSD")))
    whole = store.load("EURUSD", "M1")
    assert len(whole.inputFiles()) >= 8 and whole.count() == 1000
    for rows, offset, until in ((5, 0, None), (120, 310, None), (10, 995, None), (7, 3, "1970-01-01 08:20:30"), (3, 1, "1970-01-01 00:00:30"), (5, 0, "1969-01-01"), (5000, 0, None)):
        page = store.page(rows, offset, until, "EURUSD", "M1")
        got = sorted((r.close for r in page.collect()), reverse=True)
        last = 999 if until is None else {"1970-01-01 08:20:30": 500, "1970-01-01 00:00:30": 0, "1969-01-01": -1}[until]
        have = list(range(last, -1, -1))
        assert got == have[offset : offset + rows]
        assert all(r.total_available == len(have) for r in page.collect())
        if rows < 200 and got:
            assert len([f for f in page.inputFiles() if "data" in f]) <= 4
    both = store.page(4, 1)
    assert {(r.symbol, r.total_available) for r in both.collect()} == {("EURUSD", 1000), ("GBPUSD", 30)} and both.count() == 8


def test_the_guard_counts_in_the_manifest_and_replaces_all_at_once(spark, tmp_path):
    path = str(tmp_path / "bars")
    files.write_bars(bars(spark, 50).unionByName(bars(spark, 20, "GBPUSD")), path)
    verdict = {r.symbol: r.accepted for r in files.write_if_not_smaller(bars(spark, 49).unionByName(bars(spark, 20, "GBPUSD", close=3.0)), path).collect()}
    assert verdict == {"EURUSD": False, "GBPUSD": True}
    store = BarStore(spark, path)
    assert store.versions() == [1, 2] and store.load("GBPUSD").where("open = 3.0").count() == 20 and store.load("GBPUSD", version=1).where("open = 3.0").count() == 0
    assert files.write_if_not_smaller(bars(spark, 1), path).first().accepted is False and store.load().count() == 70
    files.write_bars(bars(spark, 51), path)
    kept = sorted(map(tuple, store.load().collect()))
    store.drop_older(1)
    assert len(store.versions()) == 1 and sorted(map(tuple, store.load().collect())) == kept


def test_an_empty_store_has_nothing(spark, tmp_path):
    store = BarStore(spark, str(tmp_path / "none"))
    assert store.versions() == [] and store.load().count() == 0 and store.page(5).count() == 0 and store.counts().count() == 0
