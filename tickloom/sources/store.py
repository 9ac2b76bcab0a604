"""A bar table in versions: new data first, then the list of files that makes it the table.

Layout: ``data/version=<id>/symbol=<s>/tf=<t>/`` holds files sorted by time, ``manifests/<n>/``
one row per file (symbol, tf, file, rows, low, high).  A version is the newest manifest that
Spark has committed; what a killed writer leaves is in no manifest and never read.  Counts,
guards and pages are answered from the manifest, and a page opens only the files it needs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.bars import BAR_COLUMNS, newest_rows

MANIFEST = "symbol string, tf string, file string, rows long, low timestamp, high timestamp"
STORED = "time timestamp, open double, high double, low double, close double, volume long, version string, symbol string, tf string"
KEYS = ["symbol", "tf"]


class BarStore:
    """One writer at a time; readers see the version that was newest when they asked."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def versions(self) -> list[int]:
        """Numbers of the committed manifests."""
        fs, place = self._fs(f"{self.path}/manifests/*/_SUCCESS")
        return sorted(int(s.getPath().getParent().getName()) for s in fs.globStatus(place) or [])

    def manifest(self, version: int | None = None) -> DataFrame:
        """The files of a version, the newest by default."""
        if version is None:
            found = self.versions()
            if not found:
                return self.spark.createDataFrame([], MANIFEST)
            version = found[-1]
        return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifests/{version:09d}")

    def counts(self, version: int | None = None) -> DataFrame:
        """Rows per symbol and timeframe, without reading a bar."""
        return self.manifest(version).groupBy(*KEYS).agg(F.sum("rows").alias("n_stored"))

    def _rows(self, files: list[str]) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], STORED).select(*KEYS, *BAR_COLUMNS)
        base = f"{self.path}/data"
        return self.spark.read.schema(STORED).option("basePath", base).parquet(*[f"{base}/{f}" for f in files]).select(*KEYS, *BAR_COLUMNS)

    def _wanted(self, symbol: str | None, tf: str | None, version: int | None) -> DataFrame:
        m = self.manifest(version)
        m = m if symbol is None else m.where(F.col("symbol") == symbol)
        return m if tf is None else m.where(F.col("tf") == tf)

    def load(self, symbol: str | None = None, tf: str | None = None, version: int | None = None) -> DataFrame:
        """All bars of a version, or those of a symbol and timeframe."""
        return self._rows([r.file for r in self._wanted(symbol, tf, version).select("file").collect()])

    def page(self, rows: int, offset: int = 0, until=None, symbol: str | None = None, tf: str | None = None, step_seconds: int = 60) -> DataFrame:
        """Per symbol and timeframe the newest ``rows`` bars up to ``until`` after skipping ``offset``, and ``total_available``.

        Files hold disjoint times, so their row counts tell where the page lies.  Only a
        file that ``until`` cuts has to be counted.
        """
        m = self._wanted(symbol, tf, None)
        limit = F.lit(until).cast("timestamp")
        cut = F.lit(False) if until is None else F.col("high") > limit
        m = m if until is None else m.where(F.col("low") <= limit)
        newer = Window.partitionBy(*KEYS).orderBy(F.desc("high")).rowsBetween(Window.unboundedPreceding, -1)
        whole = F.when(cut, F.lit(0)).otherwise(F.col("rows"))
        m = m.select("*", cut.alias("cut"), F.coalesce(F.sum(whole).over(newer), F.lit(0)).alias("least"),
                     F.coalesce(F.sum("rows").over(newer), F.lit(0)).alias("most"), F.sum(whole).over(Window.partitionBy(*KEYS)).alias("sure"))
        # a file is skipped if the rows before it surely fill the page, or if it surely ends before the page
        needed = F.col("cut") | ((F.col("least") < offset + rows) & (F.col("most") + F.col("rows") > offset))
        files = [r.file for r in m.where(needed).select("file").collect()]
        opened = self._rows(files)
        opened = opened if until is None else opened.where(F.col("time") <= limit)
        skipped = m.where(~needed).groupBy(*KEYS).agg(F.sum(F.when(F.col("most") + F.col("rows") <= offset, F.col("rows"))).alias("_gone"))
        sure = m.groupBy(*KEYS).agg(F.max("sure").alias("_sure"))
        if until is None:
            parts = sure.withColumn("total_available", F.col("_sure"))
        else:
            cut_files = [r.file for r in m.where("cut").select("file").collect()]
            counted = self._rows(cut_files).where(F.col("time") <= limit).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_c"))
            parts = sure.join(counted, KEYS, "left").withColumn("total_available", F.col("_sure") + F.coalesce("_c", F.lit(0)))
        parts = parts.join(skipped, KEYS, "left").select(*KEYS, "total_available", F.coalesce("_gone", F.lit(0)).alias("_gone"))
        newest = newest_rows(opened, offset + rows, KEYS, step_seconds).join(F.broadcast(parts), KEYS)  # one row per series of the page
        at = F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.desc("time")))  # at most offset + rows of a series
        return newest.withColumn("_at", at + F.col("_gone")).where((F.col("_at") > offset) & (F.col("_at") <= offset + rows)).select(*KEYS, *BAR_COLUMNS, "total_available")

    def replace(self, df: DataFrame) -> int:
        """Make the rows of ``df`` (settled) the bars of its symbols and timeframes; others stay.  The new version."""
        found = self.versions()
        number, name = (found[-1] + 1 if found else 1), uuid.uuid4().hex
        base = f"{self.path}/data/version={name}"
        out = df.select(*KEYS, *BAR_COLUMNS).repartitionByRange(*KEYS, "time").sortWithinPartitions(*KEYS, "time")  # each file a range of time
        out.write.partitionBy(*KEYS).parquet(base)
        fresh = self._written(name)
        kept = self.manifest(found[-1]).join(fresh.select(*KEYS).distinct(), KEYS, "left_anti") if found else None
        return self._publish(fresh if kept is None else kept.select(*fresh.columns).unionByName(fresh), number)

    def _written(self, name: str) -> DataFrame:
        """Manifest rows of the files of a data folder, from the files themselves."""
        fs, place = self._fs(f"{self.path}/data/version={name}/symbol=*")
        if not fs.globStatus(place):
            return self.spark.createDataFrame([], MANIFEST)
        read = self.spark.read.schema(STORED).option("basePath", f"{self.path}/data").parquet(f"{self.path}/data/version={name}")
        per_file = read.groupBy(*KEYS, F.col("_metadata.file_path").alias("_p")).agg(F.count(F.lit(1)).alias("rows"), F.min("time").alias("low"), F.max("time").alias("high"))
        decoded = F.regexp_extract(F.url_decode(F.replace(F.col("_p"), F.lit("+"), F.lit("%2B"))), r".*/data/(version=.*)$", 1)
        return per_file.select(*KEYS, decoded.alias("file"), "rows", "low", "high")

    def _publish(self, manifest: DataFrame, number: int) -> int:
        """Write the manifest; its commit is what makes the version the table."""
        manifest.coalesce(1).write.parquet(f"{self.path}/manifests/{number:09d}")  # one row per file; a second writer of the number fails
        return number

    def drop_older(self, keep: int = 2) -> None:
        """Remove all but the newest versions, and data that none of those uses."""
        found = self.versions()
        old, new = found[:-keep], found[-keep:]
        used = {r[0].split("/")[0] for v in new for r in self.manifest(v).select("file").distinct().collect()}
        gone = {r[0].split("/")[0] for v in old for r in self.manifest(v).select("file").distinct().collect()} - used
        for place in [*[f"manifests/{v:09d}" for v in old], *[f"data/{v}" for v in sorted(gone)]]:
            fs, p = self._fs(f"{self.path}/{place}")
            fs.delete(p, True)
