"""Account snapshots: running peak, day start, breaker verdicts, cooling-off."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sizing
from .outcomes import one_at_a_time
from .series import asof_last, ranged, running, settle

STATE_SCHEMA = "account long, peak double, day date, day_start double, cooling_from timestamp"


def account_verdicts(snapshots: DataFrame, state: DataFrame, cooling_hours: float = 24.0) -> DataFrame:
    """Breaker verdict per snapshot (account, time, equity, streak, fresh), given earlier state.

    The peak only rises, the day starts at the first fresh snapshot of the date,
    and cooling off starts at a halt for a loss streak and lasts ``cooling_hours``;
    the first such halt at or after its end starts the next.  Peaks go on being
    tracked meanwhile.  Snapshots that are not fresh change nothing and are not judged.
    """
    s = ranged(snapshots.withColumn("day", F.to_date("time")), ["account"], ["time"])
    seen = F.when(F.col("fresh"), F.col("equity"))
    run = running(s, ["account"], F.col("_rb"), ["time"], {"_peak": ("max", seen)})
    first = s.where("fresh").groupBy("account", "day").agg(F.min_by("equity", "time").alias("_first"))
    old = state.select("account", F.col("peak").alias("_p0"), F.col("day").alias("_d0"), F.col("day_start").alias("_s0"), F.col("cooling_from").alias("_c0"))
    x = run.join(first, ["account", "day"], "left").join(old, "account", "left").drop("_c0")
    x = x.withColumn("peak", F.greatest("_peak", "_p0"))
    x = x.withColumn("day_start", F.when(F.col("_d0") == F.col("day"), F.col("_s0")).otherwise(F.col("_first")))
    verdict = sizing.breaker(F.col("equity"), F.col("peak"), F.col("day_start"), F.col("streak"))
    x = settle(x.withColumn("reason", F.when(F.col("fresh"), verdict).otherwise(F.lit("skipped"))))
    length = int(cooling_hours * 3_600_000_000)
    halts = x.where(F.col("reason") == "consecutive_losses").select("account", F.unix_micros("time").alias("_at"))
    known = state.where(F.col("cooling_from").isNotNull()).select("account", F.unix_micros("cooling_from").alias("_at"))
    spans = halts.unionByName(known).distinct().withColumn("_end", F.col("_at") + F.lit(length))
    wide = 16 * 3_600_000_000  # microseconds in a bucket
    spans = settle(one_at_a_time(settle(spans), ["account"], "_at", "_end", width=wide).withColumn("_from", F.col("_at")))
    x = asof_last(x.withColumn("_at", F.unix_micros("time")), spans, ["account"], "_at", ["_from", "_end"], wide, "_span").drop("_at")
    cooling = F.unix_micros("time") < F.col("_span._end")
    return x.select(
        "account", "time", "equity", "peak", "day_start", "reason",
        F.when(cooling, F.timestamp_micros("_span._end")).alias("cooling_until"), F.timestamp_micros("_span._from").alias("cooling_from"), "day", "fresh",
    )


def account_state(verdicts: DataFrame, state: DataFrame) -> DataFrame:
    """The state after the verdicts: one row per account."""
    new = verdicts.groupBy("account").agg(
        F.max("peak").alias("peak"), F.max(F.when(F.col("fresh"), F.col("day"))).alias("day"),
        F.max_by("day_start", F.when(F.col("fresh"), F.col("time"))).alias("day_start"), F.max("cooling_from").alias("cooling_from"),
    )
    idle = state.join(new.select("account"), "account", "left_anti")
    return new.unionByName(idle.select(*new.columns))
