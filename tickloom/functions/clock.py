"""Time columns: sessions, market hours, timeframes, parsing. All times are UTC."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Session hours in UTC, start inclusive, end exclusive.
SESSION_HOURS = {
    "sydney": (22, 7),
    "tokyo": (0, 9),
    "london": (7, 16),
    "new_york": (12, 21),
}
# The order in which a report labels overlapping sessions.
SESSION_LABELS = (
    ("London", "london"),
    ("New York", "new_york"),
    ("Tokyo", "tokyo"),
    ("Sydney", "sydney"),
)
# Seconds per timeframe, and bars kept per timeframe.
TIMEFRAME_SECONDS = {"M1": 60, "M5": 300, "M15": 900, "M30": 1800, "H1": 3600, "H4": 14400, "D1": 86400}
TIMEFRAME_KEEP = {"M1": 20000, "M5": 10000, "M15": 5000, "M30": 2000, "H1": 2000, "H4": 1000, "D1": 500}


def hour_between(hour: Column, start: int, end: int) -> Column:
    """start <= hour < end; a range that ends before it starts wraps midnight."""
    if start < end:
        return (hour >= start) & (hour < end)
    return (hour >= start) | (hour < end)


def in_session(
    time: Column,
    names: Sequence[str] | None = None,
    custom: Iterable[tuple[int, int]] = (),
    enabled: bool = True,
) -> Column:
    """True where the hour lies in any chosen session; no usable range passes all."""
    chosen = list(SESSION_HOURS) if names is None else names
    wanted = [n.lower().replace(" ", "_") for n in chosen]
    ranges = [SESSION_HOURS[n] for n in wanted if n in SESSION_HOURS]
    ranges += [(int(a), int(b)) for a, b in custom]
    if not enabled or not ranges:
        return F.lit(True)
    test = F.lit(False)
    for start, end in ranges:
        test = test | hour_between(F.hour(time), start, end)
    return F.coalesce(test, F.lit(True))


def session_label(time: Column) -> Column:
    """First matching session name, or ``Off-session``."""
    out = None
    for label, key in SESSION_LABELS:
        hit = hour_between(F.hour(time), *SESSION_HOURS[key])
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    return out.otherwise(F.lit("Off-session"))


def market_open(time: Column) -> Column:
    """Sunday 22:00 to Friday 21:00 UTC."""
    day, hour = F.weekday(time), F.hour(time)  # Monday is 0
    return (
        F.when(day == 5, F.lit(False))
        .when(day == 6, hour >= 22)
        .when(day == 4, hour < 21)
        .otherwise(F.lit(True))
    )


def timeframe_seconds(tf: Column, default: int | None = None) -> Column:
    """Seconds of a timeframe name, null (or ``default``) when unknown."""
    out = F.lit(default).cast("long")
    for name, seconds in TIMEFRAME_SECONDS.items():
        out = F.when(F.upper(tf) == name, F.lit(seconds).cast("long")).otherwise(out)
    return out


def timeframe_keep(tf: Column) -> Column:
    """How many newest bars are kept for a timeframe; 1000 when unknown."""
    out = F.lit(1000)
    for name, rows in TIMEFRAME_KEEP.items():
        out = F.when(F.upper(tf) == name, F.lit(rows)).otherwise(out)
    return out


def parse_time(text: Column) -> Column:
    """ISO-8601 text, with ``Z`` or an offset, to a timestamp; null when unreadable."""
    return F.try_to_timestamp(F.trim(text))


def day_name(time: Column) -> Column:
    return F.date_format(time, "EEEE")


def utc_date(time: Column) -> Column:
    return F.to_date(time)


def floor_time(time: Column, seconds: int) -> Column:
    """Start of the grid slot that holds ``time``."""
    return F.timestamp_seconds(F.floor(F.unix_seconds(time) / F.lit(seconds)) * F.lit(seconds))


def cooled_down(now: Column, last: Column, seconds: Column | int) -> Column:
    """True when nothing happened yet or at least ``seconds`` have passed."""
    wait = F.lit(seconds) if isinstance(seconds, int) else seconds
    return F.coalesce(F.unix_seconds(now) - F.unix_seconds(last) >= wait, F.lit(True))
