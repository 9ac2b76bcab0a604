"""From signals to trades: entries, first touch of stop or target, one position at a time.

Differences from an event loop that feeds equity back: size is fixed (or taken
from the starting equity), and circuit breakers are reported, not applied.  So
trade counts differ wherever a breaker would have stopped new entries.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import money, sizing
from .indicators import join_legs, placed
from .series import Blocks, asof_last, pos_bucket, running, settle, with_position
from .signals import PAIR_ROWS, pairs_signal

FAN = 128           # children per node of the touch tree
ISLAND_ROWS = 2048  # islands up to this size are folded as one array


def with_next_open(bars: DataFrame, keys: Sequence[str] = ("symbol",), step_seconds: int = 3600) -> DataFrame:
    """Bars with the next bar's open and time."""
    b = Blocks(placed(bars, keys, step_seconds), keys, 0, 1)
    return b.owned(b.df.withColumn("next_open", F.lead("open").over(b.w)).withColumn("next_time", F.lead("time").over(b.w)))


def _levels(bars: DataFrame, keys: list[str]) -> list[DataFrame]:
    """Touch tree: per node the low and high of up to FAN children, from bars upwards."""
    longest = bars.agg(F.max("pos")).first()[0] or 0  # one number: it sets the height
    child = bars.select(*keys, F.col("pos").alias("_id"), F.col("low").alias("lo"), F.col("high").alias("hi"))
    out, span = [], 1
    while True:
        node = F.floor(F.col("_id") / F.lit(FAN)).cast("long").alias("_node")
        i = (F.col("_id") % FAN).cast("int").alias("i")
        level = child.groupBy(*keys, node).agg(
            F.array_sort(F.collect_list(F.struct(i, "lo", "hi"))).alias("_kids"),  # at most FAN
            F.min("lo").alias("lo"), F.max("hi").alias("hi"),
        )
        out.append(level.select(*keys, "_node", "_kids"))
        span *= FAN
        if span > longest:
            return out
        child = level.select(*keys, F.col("_node").alias("_id"), "lo", "hi")


def first_touch(points: DataFrame, bars: DataFrame, keys: Sequence[str], start: str, down: str, up: str,
                name: str = "touch_pos") -> DataFrame:
    """Position of the first bar at or after ``start`` with low <= down or high >= up.

    A point searches its own node, then the later siblings one level higher and so
    on; once a sibling qualifies it goes down again.  Every step is an equi-join on
    (key, node) with at most FAN children, however far away the touch is.
    ``bars`` needs dense positions from 0.
    """
    keys = list(keys)
    levels = _levels(settle(bars.select(*keys, "pos", "low", "high")), keys)
    cols = points.columns
    cur = points.withColumn("_at", F.col(start)).withColumn("_found", F.lit(None).cast("long")).withColumn("_lvl", F.lit(-1))
    # a search that is over gets its own negative node: it joins nothing and spreads evenly
    idle = -F.lit(1).cast("long") - F.abs(F.xxhash64(*[F.col(c) for c in (*keys, start, down, up)]) % 1_000_003)

    def search(df: DataFrame, k: int, active: Column, first: Column) -> DataFrame:
        df = df.withColumn("_node", F.when(active, F.floor(F.col("_at") / F.lit(FAN)).cast("long")).otherwise(idle))
        df = df.withColumn("_first", first)
        df = df.join(levels[k], [*keys, "_node"], "left")
        hit = F.array_position(F.transform("_kids", lambda x: (x["i"] >= F.col("_first")) & (
            (x["lo"] <= F.col(down)) | (x["hi"] >= F.col(up)))), True)
        return df.withColumn("_hit", F.when(hit > 0, F.col("_node") * F.lit(FAN) + hit - F.lit(1)))

    for k in range(len(levels)):
        step = F.lit(0) if k == 0 else F.lit(1)
        cur = search(cur, k, F.col("_found").isNull(), (F.col("_at") % FAN) + step)
        ok = F.col("_hit").isNotNull()
        cur = cur.select(
            *cols,
            F.when(F.col("_found").isNull() & ok, F.lit(k)).otherwise(F.col("_lvl")).alias("_lvl"),
            F.coalesce("_found", "_hit").alias("_found"),
            F.when(F.col("_found").isNull(), F.floor(F.col("_at") / F.lit(FAN)).cast("long")).otherwise(F.col("_at")).alias("_at"),
        )
    for k in reversed(range(len(levels) - 1)):
        below = F.col("_lvl") > k
        cur = cur.withColumn("_at", F.when(below, F.col("_found") * F.lit(FAN)).otherwise(F.col("_at")))
        cur = search(cur, k, below, F.lit(0))
        cur = cur.select(*cols, "_lvl", "_at", F.when(below, F.col("_hit")).otherwise(F.col("_found")).alias("_found"))
    return cur.select(*cols, F.col("_found").alias(name))


def one_at_a_time(spans: DataFrame, keys: Sequence[str], start: str = "pos", end: str = "exit_pos",
                  island_rows: int = ISLAND_ROWS, width: int = 65_536) -> DataFrame:
    """Greedy choice of spans per key: a span is taken when the last taken one has ended.

    Spans are cut into islands where all earlier spans have ended, which makes
    islands independent.  Small islands are folded in place; in larger ones the
    successor chain is followed by pointer doubling, so no task holds a key.
    ``width`` is the part of the start's axis that one bucket takes.
    """
    keys = list(keys)
    bucket = F.floor(F.col(start) / F.lit(width)).cast("long")
    df = settle(running(spans, keys, bucket, [start], {"_busy": ("max", F.col(end))}, inclusive=False))
    fresh = F.when(F.coalesce(F.col(start) >= F.col("_busy"), F.lit(True)), F.col(start))
    df = settle(running(df.withColumn("_fresh", fresh).drop("_busy"), keys, bucket, [start], {"_island": ("max", F.col("_fresh"))}).drop("_fresh"))
    group = [*keys, "_island"]
    sizes = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    big = sizes.where(F.col("_n") > island_rows)
    largest = sizes.agg(F.max("_n")).first()[0] or 0  # one number
    small = df if largest <= island_rows else df.join(big.select(*group), group, "left_anti")
    pair = F.struct(F.col(start).alias("s"), F.col(end).alias("e"))
    folded = small.groupBy(*group).agg(F.array_sort(F.collect_list(pair)).alias("_a"))  # at most island_rows
    zero = F.struct(F.lit(-1).cast("long").alias("free"), F.array().cast("array<bigint>").alias("taken"))
    chosen = F.aggregate(
        "_a", zero,
        lambda acc, x: F.when(x["s"] >= acc["free"], F.struct(
            x["e"].alias("free"), F.concat(acc["taken"], F.array(x["s"])).alias("taken"))).otherwise(acc),
        lambda acc: acc["taken"],
    )
    picks = folded.select(*keys, F.explode(chosen).alias(start))
    if largest > island_rows:
        picks = picks.unionByName(_follow_chains(df.join(big.select(*group), group), keys, start, end, largest, width))
    return df.drop("_island").join(picks, [*keys, start], "left_semi")


def _follow_chains(df: DataFrame, keys: list[str], start: str, end: str, longest: int, width: int) -> DataFrame:
    """Starts of the spans on each island's chain, by doubling the successor pointer."""
    group = [*keys, "_island"]
    starts = settle(df.select(*group, F.col(start).alias("_s"), F.col(end).alias("_e")))
    # successor: the first start at or after the end, looked up backwards in time
    flip = lambda c: -F.col(c)
    ends = starts.select(*group, "_s", flip("_e").alias("_key"))
    ahead = starts.select(*group, F.col("_s").alias("_next"), flip("_s").alias("_key"))
    jump = asof_last(ends, ahead, group, "_key", ["_next"], width).select(*group, "_s", F.col("hit._next").alias("_to"))
    jump = settle(jump.where(F.col("_to").isNotNull()))
    reached = starts.select(*group, F.col("_island").alias("_s")).distinct()
    steps = 1
    while True:
        nxt = reached.join(jump, [*group, "_s"]).select(*group, F.col("_to").alias("_s"))
        reached = settle(reached.unionByName(nxt).distinct())
        if steps >= longest:
            return reached.select(*keys, F.col("_s").alias(start))
        hop = jump.select(*group, F.col("_s").alias("_to"), F.col("_to").alias("_to2"))
        jump = settle(jump.join(hop, [*group, "_to"]).select(*group, "_s", F.col("_to2").alias("_to")))
        steps *= 2


def label_signals(
    signals: DataFrame,
    bars: DataFrame,
    keys: Sequence[str] = ("symbol",),
    extra: Sequence[str] = (),
    volume: Column | float = 0.1,
    spread_pips: Column | float = 1.0,
    slippage_pips: float = 0.5,
    commission: float = 0.0,
    overlap: bool = False,
) -> DataFrame:
    """Trades of the signals: entry at the next open, exit at the first touch, profit after costs.

    ``bars`` carries keys, pos, n_rows, time, open, high, low, close; ``signals``
    carries keys, ``extra`` keys, pos, action, sl, tp and n_rows.  A stop wins a
    tie with the target; what is still open ends at the last close.  The last bar
    is never tested.  ``overlap`` keeps every signal's outcome.
    """
    keys, extra = list(keys), list(extra)
    sig = F.col("action").isin("BUY", "SELL") & F.col("sl").isNotNull() & F.col("tp").isNotNull()
    s = signals.where(sig & (F.col("pos") <= F.col("n_rows") - 2))
    buy = F.col("action") == "BUY"
    s = s.withColumn("_start", F.col("pos") + F.lit(1))
    s = s.withColumn("_down", F.when(buy, F.col("sl")).otherwise(F.col("tp")))
    s = s.withColumn("_up", F.when(buy, F.col("tp")).otherwise(F.col("sl")))
    tested = bars.where(F.col("pos") <= F.col("n_rows") - 2)
    s = first_touch(s, tested, keys, "_start", "_down", "_up").drop("_start", "_down", "_up")
    s = s.withColumn("exit_pos", F.coalesce("touch_pos", F.col("n_rows") - 1))
    last = bars.select(*keys, F.col("pos").alias("exit_pos"), F.col("time").alias("exit_time"),
                       F.col("low").alias("_lo"), F.col("high").alias("_hi"), F.col("close").alias("_cl"))
    first = bars.select(*keys, (F.col("pos") - 1).alias("pos"), F.col("open").alias("_open"), F.col("time").alias("entry_time"))
    t = s.join(last, [*keys, "exit_pos"]).join(first, [*keys, "pos"])
    stopped = F.col("touch_pos").isNotNull() & F.when(buy, F.col("_lo") <= F.col("sl")).otherwise(F.col("_hi") >= F.col("sl"))
    t = t.withColumn("reason", F.when(F.col("touch_pos").isNull(), F.lit("end_of_series")).when(stopped, F.lit("sl_hit")).otherwise(F.lit("tp_hit")))
    r = F.col("reason")
    pip = money.pip_size(F.col("symbol"))
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    t = t.withColumn("entry", money.entry_price(F.col("action"), F.col("_open"), lit(spread_pips), pip))
    t = t.withColumn("exit", F.when(r == "sl_hit", F.col("sl")).when(r == "tp_hit", F.col("tp")).otherwise(F.col("_cl")))
    t = t.withColumn("volume", lit(volume))
    t = t.withColumn("gross", money.gross_pnl(F.col("action"), F.col("entry"), F.col("exit"), F.col("volume"), pip))
    t = t.withColumn("cost", money.trade_cost(F.col("volume"), r == "sl_hit", lit(spread_pips), lit(slippage_pips), lit(commission)))
    t = t.withColumn("profit", F.col("gross") - F.col("cost"))
    t = t.withColumn("expected_rr", money.expected_rr(F.col("entry"), F.col("sl"), F.col("tp")))
    t = settle(t.drop("touch_pos", "_lo", "_hi", "_cl", "_open"))
    return t if overlap else one_at_a_time(t, [*keys, *extra])


def pairs_trades(bars: DataFrame, first: str, second: str, overlap: bool = False, step_seconds: int = 3600, **params) -> DataFrame:
    """Trades on the first leg from the spread of two symbols: entry, exit and costs as for any signal.

    The series is the bars that both legs have.  Signals count from the first row with
    full windows and two more on.
    """
    keys = ["symbol"]
    pair = settle(mark_positions(join_legs(bars, first, second).withColumn("symbol", F.lit(first)), keys, step_seconds))
    signals = pairs_signal(pair, keys=keys, step_seconds=step_seconds, **params)
    warmup = max(params.get("spread", PAIR_ROWS), params.get("hedge", PAIR_ROWS)) + 2
    leg = pair.select("symbol", "pos", "n_rows", "time", *[F.col(f"{c}_1").alias(c) for c in ("open", "high", "low", "close")])
    chosen = signals.where((F.col("action") != "HOLD") & (F.col("pos") >= warmup)).select("symbol", "pos", "n_rows", "time", "action", "strength", "sl", "tp", "atr")
    return label_signals(settle(chosen), leg, keys, overlap=overlap)


def atr_volume(atr: Column, balance: float = 10_000.0, kelly: float = sizing.KELLY_DEFAULT) -> Column:
    """Volume from the starting equity and the signal's ATR."""
    return sizing.position_size(F.lit(balance), atr, F.lit(kelly), F.lit(0.0))


def equity_points(trades: DataFrame, bars: DataFrame, keys: Sequence[str] = ("symbol",), extra: Sequence[str] = (),
                  start: float = 10_000.0, block: int = 128) -> DataFrame:
    """Marked equity at every bar on which a position is open or closes.

    On all other bars equity stays what it was, so they add nothing to drawdown
    and are left out.  Trades meet bars on position blocks.  A position counts
    from its signal bar on, marked at that bar's close.
    """
    keys, extra = list(keys), list(extra)
    t = running(settle(trades), [*keys, *extra], pos_bucket(), ["pos"], {"_after": ("sum", F.col("profit"))})
    t = t.select(*keys, *extra, "pos", "exit_pos", "action", "entry", "volume", "_after", (F.col("_after") - F.col("profit")).alias("_before"))
    edge = lambda c: F.floor(F.col(c) / F.lit(block)).cast("long")
    t = t.withColumn("_blk", F.explode(F.sequence(edge("pos"), edge("exit_pos")))).withColumnRenamed("pos", "_open_pos")
    b = bars.select(*keys, "pos", "time", "close").withColumn("_blk", edge("pos"))
    j = t.join(b, [*keys, "_blk"]).where(F.col("pos").between(F.col("_open_pos"), F.col("exit_pos")))
    floating = money.gross_pnl(F.col("action"), F.col("entry"), F.col("close"), F.col("volume"), money.pip_size(F.col("symbol")))
    equity = F.lit(start) + F.when(F.col("pos") < F.col("exit_pos"), F.col("_before") + floating).otherwise(F.col("_after"))
    j = j.withColumn("equity", equity)
    # a bar that closes one trade and opens the next is marked with the open one
    held = F.when(F.col("pos") < F.col("exit_pos"), F.lit(1)).otherwise(F.lit(0))
    return j.groupBy(*keys, *extra, "pos").agg(
        F.max_by("equity", held).alias("equity"), F.min("time").alias("time"),
    )


def equity_curve(trades: DataFrame, bars: DataFrame, keys: Sequence[str] = ("symbol",), warmup: int = 0,
                 start: float = 10_000.0) -> DataFrame:
    """Equity at every bar from ``warmup`` to the last but one, and at the last when a trade ends there."""
    keys = list(keys)
    pts = settle(equity_points(trades, bars, keys, (), start).select(*keys, "pos", F.col("equity").alias("_e")))
    base = bars.where(F.col("pos") >= warmup).join(pts, [*keys, "pos"], "left")
    out = running(settle(base), keys, pos_bucket(), ["pos"], {"_last": ("last", F.col("_e"))}, seq=F.col("pos"))
    seen = (F.col("pos") < F.col("n_rows") - 1) | F.col("_e").isNotNull()
    return out.where(seen).select(*keys, "pos", "time", F.coalesce("_last", F.lit(start)).alias("equity"))


def mark_positions(bars: DataFrame, keys: Sequence[str] = ("symbol",), step_seconds: int = 3600) -> DataFrame:
    return with_position(bars, keys, ["time"], F.floor(F.unix_seconds("time") / F.lit(step_seconds * 65_536)).cast("long"), "pos", "n_rows")
