"""Streaming operators that keep state of their own per key, in a state store.

Each takes streams and returns a stream; the state lives in Spark's checkpoint, so a
query that is started again goes on where it stopped and neither repeats nor loses an
event.  State is forgotten by timers on the stream's own time, so a replay gives the
same events.  Start them under ``live.state_partitions``, which also picks the RocksDB store.

A key's rows of one micro-batch meet in one task, and every key costs some calls to the
store.  The keys are chosen so that both stay few: tickets are dealt by hash into
buckets, quotes and orders are cut into spans of time, beats are merged into spans
before they are shuffled, and ticks are keyed by their bar.  Many rows of a key are kept
as one packed array each time they come.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.positions import WATCHED

DAY_MS = 86_400_000
KEEP_SECONDS = 2 * 86_400        # a ticket's last snapshot
KEEP_CLOSED_SECONDS = 30 * 86_400
BUCKETS = 256                    # of tickets
NO_TICKET = -1                   # the bucket of rows without a ticket
SLOT_SECONDS = 10
SLOTS = 2160                     # of one symbol in one key: a call to the store costs more than many rows

_CLOSE = ("close_price", "profit", "reason")
EVENT_SCHEMA = ("poll timestamp, ticket long, symbol string, event string, sl double, tp double, volume double, changes array<string>, "
                "close_price double, profit double, reason string")


def _micros(times: pd.Series) -> np.ndarray:
    return times.astype("datetime64[us]").astype("int64").to_numpy()


def _time(micros: int) -> pd.Timestamp:
    return pd.Timestamp(int(micros), unit="us")


def _packed(dtype: np.dtype, *columns) -> np.ndarray:
    out = np.empty(len(columns[0]), dtype)
    for name, column in zip(dtype.names, columns):
        out[name] = column
    return out


def _clocked(rows: DataFrame, time: str, lateness: str = "0 seconds") -> DataFrame:
    """Keep a watermark on the rows' time without letting Spark drop late rows: it stands on a copy that is dropped at once."""
    return rows.withColumn("_clock", F.col(time)).withWatermark("_clock", lateness).drop("_clock")


_LAST = np.dtype([("ticket", "<i8"), ("at", "<i8"), *[(c, "<f8") for c in WATCHED]])
_CLOSED = np.dtype([("ticket", "<i8"), ("at", "<i8")])


def _held(state, dtype: np.dtype) -> np.ndarray:
    """The packed array that a state holds, or none of its rows."""
    return np.frombuffer(state.get()[0], dtype) if state.exists() else np.zeros(0, dtype)


def _merged(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Both in order of ticket, new rows in place of old ones; each is in that order."""
    both = np.concatenate([old[~np.isin(old["ticket"], new["ticket"])], new])
    return both[np.argsort(both["ticket"], kind="stable")]


def _place(sorted_: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each asked ticket is there, and where."""
    if not len(sorted_):
        return np.zeros(len(asked), bool), np.zeros(len(asked), np.int64)
    at = np.minimum(np.searchsorted(sorted_["ticket"], asked), len(sorted_) - 1)
    return sorted_["ticket"][at] == asked, at


class _Positions(StatefulProcessor):
    """Last snapshot of each ticket of a bucket, and the tickets whose close has been reported."""

    def __init__(self, poll_seconds: int, keep_seconds: int, keep_closed_seconds: int) -> None:
        self.reach = poll_seconds * 1_000_000
        self.keep, self.keep_closed = 1000 * keep_seconds, 1000 * keep_closed_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "rows binary")
        self.closed = handle.getValueState("closed", "rows binary")
        self.due = handle.getValueState("due", "ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        df = pd.concat(list(rows), ignore_index=True)
        df["at"] = _micros(df["poll"])
        df = df.sort_values(["ticket", "at"], kind="stable")
        ends, out = [], []
        for part, changed in ((df[~df["is_close"]], self._snapshots), (df[df["is_close"]], self._closes)):
            if len(part):
                told, end = changed(part)
                ends += end
                out += [told] if len(told) else []
        was = self.due.get()[0] if self.due.exists() else None
        if ends and (was is None or min(ends) < was):  # while there is state there is one timer
            if was is not None:
                self.handle.deleteTimer(was)
            self._wait(min(ends))
        for told in out:
            yield self._shaped(told, key[0])

    def _wait(self, due: int) -> None:
        self.due.update((due,))
        self.handle.registerTimer(due)

    def _snapshots(self, df: pd.DataFrame) -> tuple[pd.DataFrame, list[int]]:
        old = _held(self.last, _LAST)
        known, place = _place(old, df["ticket"].to_numpy())
        fresh = ~known
        fresh[known] = df["at"].to_numpy()[known] > old["at"][place[known]]
        df = df[fresh & ~df.duplicated(["ticket", "at"]).to_numpy()]  # a snapshot that is not newer than the last one tells nothing
        if df.empty:
            return df, []
        now = _packed(_LAST, df["ticket"], df["at"], *[df[c].astype("float64") for c in WATCHED])
        was = np.empty_like(now)
        was[1:] = now[:-1]
        first = np.concatenate([[True], now["ticket"][1:] != now["ticket"][:-1]])
        has, place = _place(old, now["ticket"][first])
        was[np.flatnonzero(first)[has]] = old[place[has]]
        seen = ~first
        seen[np.flatnonzero(first)[has]] = True
        seen &= was["at"] >= now["at"] - self.reach
        other = {c: seen & (now[c] != was[c]) & ~(np.isnan(now[c]) & np.isnan(was[c])) for c in WATCHED}
        tell = ~seen | np.logical_or.reduce(list(other.values()))
        df = df.assign(event=np.where(seen, "modified", "opened"), changes=[[c for c, x in zip(WATCHED, row) if x] for row in zip(*other.values())])
        newest = now[np.append(first[1:], True)]
        self.last.update((_merged(old, newest).tobytes(),))
        return df[tell], [int(newest["at"].min()) // 1000 + self.keep]

    def _closes(self, df: pd.DataFrame) -> tuple[pd.DataFrame, list[int]]:
        old = _held(self.closed, _CLOSED)
        df = df.drop_duplicates("ticket")
        df = df[~_place(old, df["ticket"].to_numpy())[0]]
        if df.empty:
            return df, []
        new = _packed(_CLOSED, df["ticket"], df["at"])
        self.closed.update((_merged(old, new).tobytes(),))
        return df.assign(event="closed", changes=[[] for _ in range(len(df))]), [int(new["at"].min()) // 1000 + self.keep_closed]

    @staticmethod
    def _shaped(told: pd.DataFrame, bucket: int) -> pd.DataFrame:
        ticket = told["ticket"].astype("Int64")
        if bucket == NO_TICKET:
            ticket[:] = pd.NA
        shut = told["is_close"].to_numpy()
        return pd.DataFrame({
            "poll": told["poll"], "ticket": ticket, "symbol": told["symbol"], "event": told["event"], **{c: told[c].astype("float64") for c in WATCHED}, "changes": told["changes"],
            **{c: told[c].where(shut, None).astype(kind) for c, kind in zip(_CLOSE, ("float64", "float64", object))}})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, ends = timerValues.getCurrentWatermarkInMs(), []
        for state, dtype, keep in ((self.last, _LAST, self.keep), (self.closed, _CLOSED, self.keep_closed)):
            held = _held(state, dtype)
            end = held["at"] // 1000 + keep
            if (end <= now).any():
                held, end = held[end > now], end[end > now]
                state.update((held.tobytes(),)) if len(held) else state.clear()
            if len(end):
                ends.append(int(end.min()))
        if ends:
            self._wait(min(ends))
        else:
            self.due.clear()
        yield from ()

    def close(self) -> None:
        pass


def position_stream(snapshots: DataFrame, closed: DataFrame | None = None, poll_seconds: int = 3600, keep_seconds: int = KEEP_SECONDS,
                    keep_closed_seconds: int = KEEP_CLOSED_SECONDS, buckets: int = BUCKETS) -> DataFrame:
    """Opened, modified and closed events of streams of position snapshots and closed records.

    ``snapshots`` has ticket, poll, symbol, sl, tp and volume; ``closed`` has ticket, poll,
    symbol and what is known of the others, close_price, profit and reason.  A ticket
    not seen at any poll of the last ``poll_seconds`` opens again.  The first closed
    record of a ticket is reported, later ones are not.  When the stream's time has gone
    ``keep_seconds`` beyond a ticket's last snapshot it is forgotten, its close after
    ``keep_closed_seconds``.  Rows may be late by any time up to that.

    Tickets are dealt by hash into ``buckets``, the keys of the state: a bucket's rows of
    a micro-batch and the open tickets it remembers must fit one task.
    """
    kinds = {"ticket": "long", "poll": "timestamp", "symbol": "string", **dict.fromkeys(WATCHED, "double"), "close_price": "double", "profit": "double", "reason": "string"}

    def shaped(df: DataFrame, is_close: bool) -> DataFrame:
        return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()], F.lit(is_close).alias("is_close"))

    rows = shaped(snapshots, False)
    if closed is not None:
        rows = rows.unionByName(shaped(closed, True))
    bucket = F.when(F.col("ticket").isNull(), F.lit(NO_TICKET)).otherwise(F.pmod(F.xxhash64("ticket"), F.lit(buckets))).cast("long")
    rows = _clocked(rows, "poll").withColumns({"bucket": bucket, "ticket": F.coalesce("ticket", F.lit(0).cast("long"))})
    return rows.groupBy("bucket").transformWithStateInPandas(_Positions(poll_seconds, keep_seconds, keep_closed_seconds), EVENT_SCHEMA, "Append", "EventTime")


class _FirstRow(StatefulProcessor):
    """Whether a row of the key has been passed on."""

    def __init__(self, time: str, order: list[str], columns: list[str], keep_seconds: int) -> None:
        self.time, self.order, self.columns, self.keep = time, order, columns, 1000 * keep_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "yes boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known, best = self.seen.exists(), None
        for part in rows:  # one row is kept of each part
            if not known:
                best = (part if best is None else pd.concat([best, part])).sort_values(self.order, kind="stable").head(1)
        if best is not None:
            self.seen.update((True,))
            self.handle.registerTimer(int(_micros(best[self.time])[0]) // 1000 + self.keep)
            yield best[self.columns]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.seen.clear()
        yield from ()

    def close(self) -> None:
        pass


def first_close_stream(closed: DataFrame, order: list[str], key: str = "ticket", keep_seconds: int = KEEP_CLOSED_SECONDS) -> DataFrame:
    """The first row of each key in the stream; of the rows of one micro-batch, the first by ``order``.

    ``order`` begins with the row's time.  A key is forgotten when the stream's time has
    gone ``keep_seconds`` beyond its first row.
    """
    processor = _FirstRow(order[0], order, closed.columns, keep_seconds)
    return _clocked(closed, order[0]).groupBy(key).transformWithStateInPandas(processor, closed.schema, "Append", "EventTime")


QUOTE_SCHEMA = "order_id long, symbol string, order_time timestamp, bid double, ask double, stale boolean"


_QUOTE = np.dtype([("at", "<i8"), ("seq", "<i8"), ("bid", "<f8"), ("ask", "<f8")])
_ORDER = np.dtype([("at", "<i8"), ("order_id", "<i8")])


def _unpacked(state, dtype: np.dtype) -> np.ndarray:
    """The rows of a list of packed arrays."""
    parts = [np.frombuffer(x[0], dtype) for x in state.get()] if state.exists() else []
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


class _Quotes(StatefulProcessor):
    """Quotes and waiting orders of one symbol and span of slots; a slot's orders are answered when the watermark passes it."""

    def __init__(self, ttl_seconds: int, slot_seconds: int, slots: int) -> None:
        self.ttl, self.slot, self.slots = ttl_seconds * 1_000_000, slot_seconds * 1_000_000, slots

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.quotes = handle.getListState("quotes", "rows binary")
        self.orders = handle.getListState("orders", "rows binary")
        self.due = handle.getValueState("due", "ms long")

    def _end(self, key) -> int:
        return (int(key[1]) + 1) * self.slots * self.slot // 1000

    def _slot_ends(self, at: np.ndarray) -> np.ndarray:
        return (at // self.slot + 1) * self.slot // 1000

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        due = self._end(key)
        for part in rows:
            at = _micros(part["time"])
            is_order = part["order_id"].notna().to_numpy()
            if is_order.any():
                asked = _packed(_ORDER, at[is_order], part["order_id"][is_order].astype("int64").to_numpy())
                due = min(due, int(self._slot_ends(asked["at"]).min()))
                self.orders.appendValue((asked.tobytes(),))
            if not is_order.all():
                q = part[~is_order]
                self.quotes.appendValue((_packed(_QUOTE, at[~is_order], q["seq"].astype("int64").to_numpy(), q["bid"].to_numpy(), q["ask"].to_numpy()).tobytes(),))
        was = self.due.get()[0] if self.due.exists() else None
        if was is None or due < was:
            if was is not None:
                self.handle.deleteTimer(was)
            self._wait(due)
        yield from ()

    def _wait(self, due: int) -> None:
        self.due.update((due,))
        self.handle.registerTimer(due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        orders, quotes = _unpacked(self.orders, _ORDER), _unpacked(self.quotes, _QUOTE)
        ends = self._slot_ends(orders["at"])
        asked, waiting = orders[ends <= now], orders[ends > now]
        self.orders.clear()
        if now >= self._end(key) and not len(waiting):
            self.quotes.clear()
            self.due.clear()
        else:
            kept = quotes[quotes["at"] >= now * 1000 // self.slot * self.slot - self.ttl]  # later orders look no further back
            self.quotes.clear()
            if len(kept):
                self.quotes.appendValue((kept.tobytes(),))
            if len(waiting):
                self.orders.appendValue((waiting.tobytes(),))
            self._wait(int(min(self._end(key), ends[ends > now].min(initial=self._end(key)))))
        if len(asked):
            yield self._answers(key[0], asked, quotes)

    def _answers(self, symbol, asked: np.ndarray, quotes: np.ndarray) -> pd.DataFrame:
        quotes = quotes[np.lexsort((quotes["ask"], quotes["bid"], quotes["seq"], quotes["at"]))]
        k = np.searchsorted(quotes["at"], asked["at"], "right") - 1
        good = k >= 0
        good[good] = asked["at"][good] - quotes["at"][k[good]] <= self.ttl
        found = {c: np.full(len(asked), np.nan) for c in ("bid", "ask")}
        for c, column in found.items():
            column[good] = quotes[c][k[good]]
        return pd.DataFrame({"order_id": asked["order_id"], "symbol": symbol, "order_time": asked["at"].astype("datetime64[us]"), **found, "stale": ~good})

    def close(self) -> None:
        pass


def quote_stream(orders: DataFrame, quotes: DataFrame, ttl_seconds: int = 5, lateness: str = "1 minute", slot_seconds: int = SLOT_SECONDS, slots: int = SLOTS) -> DataFrame:
    """The latest usable quote of each order, by (time, seq), not older than the limit; none means stale.

    ``orders`` has order_id, symbol and order_time, ``quotes`` symbol, time, seq, bid and
    ask.  Both are kept per symbol and span of ``slots`` slots, quotes of a span's last
    ``ttl_seconds`` also in the next span.  A timer at the end of the first slot with
    waiting orders answers all slots that the watermark, the lesser of both streams, has
    passed: one sorted pass, no pairs.
    """
    width = max(slot_seconds, ttl_seconds)
    span = lambda c: F.floor(F.unix_seconds(c) / F.lit(width * slots)).cast("long")
    good = quotes.where((F.col("bid") != 0) & (F.col("ask") != 0)).withWatermark("time", lateness)
    own, late = span(F.col("time")), span(F.timestamp_micros(F.unix_micros("time") + F.lit(ttl_seconds * 1_000_000)))
    told = good.select("symbol", F.explode(F.array_distinct(F.array(own, late))).alias("span"), "time", F.col("seq").cast("long").alias("seq"), "bid", "ask", F.lit(None).cast("long").alias("order_id"))
    asked = orders.withWatermark("order_time", lateness).select("symbol", span(F.col("order_time")).alias("span"), F.col("order_time").alias("time"), F.lit(None).cast("long").alias("seq"),
                                                                F.lit(None).cast("double").alias("bid"), F.lit(None).cast("double").alias("ask"), "order_id")
    return told.union(asked).groupBy("symbol", "span").transformWithStateInPandas(_Quotes(ttl_seconds, width, slots), QUOTE_SCHEMA, "Append", "EventTime")


CONNECTION_SCHEMA = "source string, event string, at timestamp, beats long"


def beat_spans(limit_seconds: int):
    """Beats (source, time) of a batch merged into spans without a gap of the limit: fewer rows, the same spans."""
    limit = limit_seconds * 1_000_000

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            df = pd.DataFrame({"source": part["source"], "at": _micros(part["time"])}).dropna().sort_values(["source", "at"], ignore_index=True)
            if df.empty:
                continue
            new = (df["source"] != df["source"].shift()) | (df["at"].diff() >= limit)
            g = df.groupby(new.cumsum())
            yield pd.DataFrame({"source": g["source"].first(), "first": g["at"].min(), "last": g["at"].max(), "beats": g.size()})

    return run


class _Connection(StatefulProcessor):
    """The running span of a source; a timer ends it when no beat comes."""

    def __init__(self, limit_seconds: int) -> None:
        self.limit = limit_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.span = handle.getValueState("span", "last long, beats long")

    def _ends(self, last: int) -> int:
        return -(-(last + self.limit) // 1000)  # timers count milliseconds

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        spans = sorted(s for part in rows for s in zip(part["first"].tolist(), part["last"].tolist(), part["beats"].tolist()))
        was = self.span.get() if self.span.exists() else None
        cur, out = was, []
        for first, last, beats in spans:
            if cur is not None and first < cur[0] + self.limit:
                cur = (max(cur[0], last), cur[1] + beats)
                continue
            if cur is not None:
                out.append((key[0], "lost", _time(cur[0] + self.limit), cur[1]))
            out.append((key[0], "back", _time(first), None))
            cur = (last, beats)
        if was is not None and was[0] != cur[0]:
            self.handle.deleteTimer(self._ends(was[0]))
        self.handle.registerTimer(self._ends(cur[0]))
        self.span.update((int(cur[0]), int(cur[1])))
        if out:
            yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.span.exists():
            last, beats = self.span.get()
            if self._ends(last) <= expiredTimerInfo.getExpiryTimeInMs():
                self.span.clear()
                yield self._frame([(key[0], "lost", _time(last + self.limit), beats)])

    @staticmethod
    def _frame(out: list) -> pd.DataFrame:
        return pd.DataFrame(out, columns=["source", "event", "at", "beats"]).astype({"beats": "Int64"})

    def close(self) -> None:
        pass


def connection_events(beats: DataFrame, limit_seconds: int = 15, lateness: str = "1 minute") -> DataFrame:
    """``back`` and ``lost`` events of each source of a stream of beats (source, time).

    A source is lost ``limit_seconds`` after its last beat: as soon as the watermark has
    passed that moment, whether or not the source ever beats again, or when its next
    beat shows the gap.  ``lost`` carries the beats of the span that ended.
    """
    marked = beats.select(F.col("source").cast("string").alias("source"), "time").withWatermark("time", lateness)
    spans = marked.mapInPandas(beat_spans(limit_seconds), "source string, first long, last long, beats long")
    return spans.groupBy("source").transformWithStateInPandas(_Connection(limit_seconds), CONNECTION_SCHEMA, "Append", "EventTime")


LATE_SCHEMA = "symbol string, bar timestamp, seq long, time timestamp, price double"


class _Late(StatefulProcessor):
    """Whether the watermark has sealed a bar."""

    def __init__(self, seconds: int) -> None:
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sealed = handle.getValueState("sealed", "yes boolean")

    def _end(self, key) -> int:
        return 1000 * (int(key[1]) + self.seconds)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        end, state = self._end(key), self.sealed.get() if self.sealed.exists() else None
        late = state[0] if state is not None else end <= timerValues.getCurrentWatermarkInMs()
        for part in rows:
            if late and len(part):
                out = part[["symbol", "seq", "time", "price"]].copy()
                out.insert(1, "bar", _time(1_000_000 * int(key[1])))
                yield out
        if state is None and not late:
            self.sealed.update((False,))
            self.handle.registerTimer(end)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if expiredTimerInfo.getExpiryTimeInMs() <= self._end(key):
            self.sealed.update((True,))
            self.handle.registerTimer(self._end(key) + DAY_MS)
        else:
            self.sealed.clear()  # by now any row of the bar is behind the watermark
        yield from ()

    def close(self) -> None:
        pass


def late_stream(ticks: DataFrame, seconds: int = 3600, lateness: str = "10 minutes") -> DataFrame:
    """The ticks (symbol, time, seq, price) that come after their bar was sealed, with the start of the bar they miss.

    Beside ``live.bar_stream`` with the same ``seconds`` and ``lateness``: what it drops,
    this returns.
    """
    bar = F.floor(F.unix_seconds("time") / F.lit(seconds)).cast("long") * F.lit(seconds)
    rows = _clocked(ticks, "time", lateness).select("symbol", bar.alias("bar"), F.col("seq").cast("long").alias("seq"), "time", F.col("price").cast("double").alias("price"))
    return rows.groupBy("symbol", "bar").transformWithStateInPandas(_Late(seconds), LATE_SCHEMA, "Append", "EventTime")
