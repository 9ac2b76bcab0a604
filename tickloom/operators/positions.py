"""Polled position snapshots: what opened, changed or closed between two polls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .series import Blocks, settle, with_position

WATCHED = ("sl", "tp", "volume")


def position_events(snapshots: DataFrame, poll_seconds: int | None = None) -> DataFrame:
    """Opened and modified events of (ticket, poll, symbol, sl, tp, volume) snapshots.

    A ticket missing from the previous poll counts as opened again when it returns.
    The previous poll is the one before in the table, or with ``poll_seconds`` any
    poll at most that long ago (when the table does not hold all polls).
    """
    df = settle(snapshots)
    day = F.floor(F.unix_seconds("poll") / F.lit(86_400)).cast("long")
    if poll_seconds is None:
        numbered = with_position(df.select("poll").distinct(), [], ["poll"], day, "_no")
        df = settle(df.join(numbered, "poll"))
        step, reach = F.col("_no"), 1
    else:
        step, reach = F.unix_seconds("poll"), poll_seconds
    b = Blocks(with_position(df, ["ticket"], ["poll"], day), ["ticket"], 1)
    x = b.df.withColumn("_gap", step - F.lag(step).over(b.w))
    x = x.select("*", *[F.lag(c).over(b.w).alias(f"_p_{c}") for c in WATCHED])
    x = b.owned(x)
    known = F.coalesce(F.col("_gap") <= reach, F.lit(False))
    changes = F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"_p_{c}")), F.lit(c)) for c in WATCHED]))
    x = x.withColumn("changes", F.when(known, changes).otherwise(F.array().cast("array<string>")))
    event = F.when(~known, F.lit("opened")).when(F.size("changes") > 0, F.lit("modified"))
    x = x.withColumn("event", event).where(F.col("event").isNotNull())
    kept = [c for c in snapshots.columns if c not in ("ticket", "poll", "symbol", *WATCHED)]
    return x.select("poll", "ticket", "symbol", "event", *WATCHED, "changes", *kept)


CLOSE_FIELDS = ("close_price", "profit", "reason")


def with_closes(events: DataFrame, closed: DataFrame) -> DataFrame:
    """The events and a ``closed`` event for the first closed record of each ticket.

    ``closed`` has ticket, poll, symbol and what is known of sl, tp, volume, close_price,
    profit and reason.  Opened and modified events carry no close fields.
    """
    first = first_closes(closed).withColumn("event", F.lit("closed")).withColumn("changes", F.array().cast("array<string>"))
    types = {**dict.fromkeys(WATCHED, "double"), "close_price": "double", "profit": "double", "reason": "string"}
    for c, kind in types.items():
        if c not in first.columns:
            first = first.withColumn(c, F.lit(None).cast(kind))
        if c not in events.columns:
            events = events.withColumn(c, F.lit(None).cast(kind))
    return events.unionByName(first.select(*events.columns))


def event_counts(events: DataFrame) -> DataFrame:
    """Events per poll and kind."""
    return events.groupBy("poll").agg(*[
        F.count_if(F.col("event") == k).alias(k) for k in ("opened", "modified", "closed")
    ])


def first_closes(closed: DataFrame, order: str | Column = "poll") -> DataFrame:
    """The first closed record of each ticket."""
    rest = [c for c in closed.columns if c != "ticket"]
    best = closed.groupBy("ticket").agg(F.min_by(F.struct(*rest), order).alias("_row"))
    return best.select("ticket", "_row.*").select(*closed.columns)
