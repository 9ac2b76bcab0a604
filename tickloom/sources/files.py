"""Files: bar tables, trade journals, trial logs, calendars, event logs, text corpora."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.clock import TIMEFRAME_SECONDS, parse_time
from ..operators.bars import BAR_COLUMNS, SchemaMismatch, allowed_shrink, unique_times
from ..operators.series import settle
from .store import BarStore

TRADE_SCHEMA = T.StructType([
    T.StructField("ticket", T.LongType()), T.StructField("symbol", T.StringType()), T.StructField("type", T.StringType()),
    T.StructField("volume", T.DoubleType()), T.StructField("open_price", T.DoubleType()), T.StructField("open_time", T.TimestampType()),
    T.StructField("close_price", T.DoubleType()), T.StructField("close_time", T.TimestampType()), T.StructField("profit", T.DoubleType()),
    T.StructField("sl", T.DoubleType()), T.StructField("tp", T.DoubleType()),
])
TRIAL_SCHEMA = T.StructType([
    T.StructField("sr_id", T.LongType()), T.StructField("book_slug", T.StringType()), T.StructField("strategy_name", T.StringType()),
    T.StructField("mapped_type", T.StringType()), T.StructField("sharpe", T.DoubleType()), T.StructField("max_dd", T.DoubleType()),
    T.StructField("win_rate", T.DoubleType()), T.StructField("guard", T.StringType()), T.StructField("trades", T.LongType()),
    T.StructField("timestamp", T.StringType()),
])
SWEEP_SCHEMA = T.StructType([
    T.StructField("iteration", T.LongType()), T.StructField("param", T.StringType()), T.StructField("old_val", T.DoubleType()),
    T.StructField("new_val", T.DoubleType()), T.StructField("sharpe", T.DoubleType()), T.StructField("dsr", T.DoubleType()),
    T.StructField("max_dd", T.DoubleType()), T.StructField("win_rate", T.DoubleType()), T.StructField("decision", T.StringType()),
    T.StructField("strategy", T.StringType()), T.StructField("timestamp", T.TimestampType()),
])
EVENT_FIELDS = ("ts", "event", "ticket", "symbol", "side", "volume", "sl", "tp", "open_price", "open_time", "close_price", "profit", "reason")


def _empty(spark: SparkSession, schema) -> DataFrame:
    return spark.createDataFrame([], schema)


def _existing(read) -> DataFrame | None:
    """The table, or None when its path does not exist."""
    try:
        return read()
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" in str(exc) or "UNABLE_TO_INFER_SCHEMA" in str(exc):
            return None
        raise


def load_bars(spark: SparkSession, path: str, symbol: str | None = None, tf: str | None = None, bars: int | None = None) -> DataFrame:
    """Stored bars of the newest version; ``bars`` keeps the newest rows and opens only the files that hold them."""
    store = BarStore(spark, path)
    if bars is None:
        return store.load(symbol, tf)
    return store.page(bars, 0, None, symbol, tf, TIMEFRAME_SECONDS.get(tf or "M1", 60)).drop("total_available")


def write_bars(df: DataFrame, path: str) -> None:
    """Replace the symbols and timeframes of a bar table in one step; duplicate times are rejected."""
    df = settle(df)
    bad = unique_times(df, ["symbol", "tf"]).where(~F.col("is_unique")).limit(1).count()
    if bad:
        raise SchemaMismatch("duplicate times in a bar table")
    BarStore(df.sparkSession, path).replace(df)


def write_if_not_smaller(df: DataFrame, path: str) -> DataFrame:
    """Replace only symbols and timeframes that do not lose rows; returns what was decided for each.

    Stored rows are counted in the manifest, and all that is replaced changes at once.
    """
    df = settle(df)
    store = BarStore(df.sparkSession, path)
    verdict = settle(allowed_shrink(store.counts(), df))
    store.replace(df.join(verdict.where("accepted").select("symbol", "tf"), ["symbol", "tf"], "left_semi"))
    return verdict


def _typed(raw: DataFrame, schema: T.StructType) -> DataFrame:
    """Header-keyed text columns to the schema: unknown ones dropped, absent ones null."""
    cols = []
    for f in schema:
        if f.name not in raw.columns:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
        elif isinstance(f.dataType, T.TimestampType):
            cols.append(parse_time(F.nullif(F.col(f.name), F.lit(""))).alias(f.name))
        elif isinstance(f.dataType, T.StringType):
            cols.append(F.col(f.name))
        else:
            cols.append(F.trim(F.col(f.name)).try_cast(f.dataType).alias(f.name))
    return raw.select(*cols)


def _read_delimited(spark: SparkSession, path: str, schema: T.StructType, sep: str) -> DataFrame:
    # rows with too many fields are only seen as malformed when all fields are parsed
    raw = _existing(lambda: spark.read.option("header", True).option("sep", sep).option("mode", "DROPMALFORMED").option(
        "columnPruning", False).csv(path))
    return _empty(spark, schema) if raw is None else _typed(raw, schema)


def read_trades(spark: SparkSession, path: str) -> DataFrame:
    """Trade journal: canonical columns, bad rows skipped, a missing file is empty."""
    return _read_delimited(spark, path, TRADE_SCHEMA, ",")


def append_trades(df: DataFrame, path: str) -> None:
    """Append rows; an open row and its later closed row share the ticket."""
    cols = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in TRADE_SCHEMA]
    out = df.select(*cols)
    for c in ("open_time", "close_time"):
        out = out.withColumn(c, F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    out.write.mode("append").option("header", True).csv(path)


def read_trials(spark: SparkSession, path: str) -> DataFrame:
    """Trial log; rows whose numbers cannot be read are dropped."""
    df = _read_delimited(spark, path, TRIAL_SCHEMA, "\t")
    return df.dropna(subset=["sr_id", "sharpe", "max_dd", "win_rate", "trades"])


def read_sweep_log(spark: SparkSession, path: str) -> DataFrame:
    return _read_delimited(spark, path, SWEEP_SCHEMA, "\t")


def append_trials(df: DataFrame, path: str) -> str:
    """Append to a tab-separated log; a log with other columns is left alone and a new one begun."""
    spark, version, target = df.sparkSession, 1, path
    while True:
        old = _existing(lambda: spark.read.option("header", True).option("sep", "\t").csv(target))
        if old is None or old.columns == df.columns:
            df.write.mode("append").option("header", True).option("sep", "\t").csv(target)
            return target
        version += 1
        target = f"{path}.v{version}"


def read_calendar(spark: SparkSession, path: str) -> DataFrame:
    """High-impact events with readable times; without time and impact columns there are none."""
    schema = "time timestamp, impact string, currency string, event string"
    raw = _existing(lambda: spark.read.option("header", True).option("mode", "DROPMALFORMED").option("columnPruning", False).csv(path))
    if raw is None or not {"time", "impact"} <= set(raw.columns):
        return _empty(spark, schema)
    text = lambda c: F.col(c) if c in raw.columns else F.lit(None).cast("string")
    df = raw.where(F.lower("impact") == "high").select(
        parse_time(F.col("time")).alias("time"), "impact", F.upper(F.coalesce(text("currency"), F.lit(""))).alias("currency"), text("event").alias("event")
    )
    return df.where(F.col("time").isNotNull())


def event_record(df: DataFrame) -> DataFrame:
    """The thirteen fields of a position event, and the changes of a modification."""
    cols = [F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in EVENT_FIELDS]
    extra = [F.col("changes")] if "changes" in df.columns else []
    return df.select(*cols, *extra)


def write_position_events(df: DataFrame, path: str) -> None:
    event_record(df).write.mode("append").option("ignoreNullFields", False).json(path)


def save_summary(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def load_summary(spark: SparkSession, path: str, schema=None) -> DataFrame:
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.json(path)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Every Markdown file under a folder except ``_meta.md``: path and whole text."""
    df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(path, wholetext=True)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    return df.where(name != "_meta.md").select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
