"""Joins over time: news windows, latest quotes, finished higher bars, cost and grid lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import money
from .bars import resample
from .indicators import placed
from .series import Blocks, by_rows, settle


def news_blackout(bars: DataFrame, calendar: DataFrame, minutes: int = 30, blocked: bool = False) -> DataFrame:
    """Bars with no high-impact event of their currency within ``minutes`` (or only those with one).

    Which currencies concern a symbol is settled once, for distinct symbols and
    currencies.  Time is cut into slots as wide as the buffer.  An event in a bar's own
    slot is always near; of the slot before only the latest event can matter, of the slot
    after only the earliest.  So the calendar shrinks to one row per symbol and slot, and
    bars meet it on both.  A blank symbol is concerned by every event.
    """
    width = minutes * 60_000_000
    slot = lambda c: F.floor(c / F.lit(width)).cast("long")
    at = F.unix_micros("time")
    told = calendar.select(F.upper("currency").alias("_cur"), slot(at).alias("_slot"), at.alias("_ev")).groupBy("_cur", "_slot").agg(F.min("_ev").alias("_lo"), F.max("_ev").alias("_hi"))
    symbols, currencies = bars.select(F.col("symbol").alias("_sym")).distinct(), calendar.select(F.upper("currency").alias("_cur")).distinct()
    concerned = symbols.join(currencies, (F.col("_sym") == "") | F.upper("_sym").contains(F.col("_cur")))
    places = F.array(*[F.struct((F.col("_slot") + k).alias("_slot"), F.lit(k == 0).alias("_own"), F.when(F.lit(k == 1), F.col("_hi")).alias("_before"), F.when(F.lit(k == -1), F.col("_lo")).alias("_after")) for k in (-1, 0, 1)])
    ev = told.join(concerned, "_cur").select("_sym", F.explode(places).alias("_p")).groupBy("_sym", "_p._slot").agg(
        F.max("_p._own").alias("_own"), F.max("_p._before").alias("_before"), F.min("_p._after").alias("_after"))
    probe = bars.withColumn("_slot", slot(at))
    t = F.unix_micros(probe["time"])
    close = ev["_own"] | F.coalesce(t - ev["_before"] <= width, F.lit(False)) | F.coalesce(ev["_after"] - t <= width, F.lit(False))
    near = (probe["symbol"] == ev["_sym"]) & (probe["_slot"] == ev["_slot"]) & close
    return probe.join(ev, near, "left_semi" if blocked else "left_anti").drop("_slot")


def latest_quote(orders: DataFrame, quotes: DataFrame, order_id: str, ttl_seconds: int = 5) -> DataFrame:
    """Latest usable quote of the order's symbol not older than the limit; else ``stale``.

    Time is cut into slots as long as the limit.  An order needs the quotes of its
    own slot and the last one of the slot before, which is handed on as one row.
    Orders and quotes of a slot are sorted together, so no pairs are built and a
    busy symbol is spread over its slots.
    """
    width = ttl_seconds * 1_000_000
    slot = lambda c: F.floor(F.col(c) / F.lit(width)).cast("long")
    quote = F.struct(F.col("_t").alias("t"), "seq", "bid", "ask")
    good = quotes.where((F.col("bid") != 0) & (F.col("ask") != 0)).withColumn("_t", F.unix_micros("time"))
    good = good.select("symbol", slot("_t").alias("_slot"), "_t", "seq", quote.alias("_q"))
    handed = good.groupBy("symbol", "_slot").agg(F.max("_q").alias("_q")).select(
        "symbol", (F.col("_slot") + 1).alias("_slot"), F.col("_q.t").alias("_t"), F.col("_q.seq").alias("seq"), "_q"
    )
    asked = orders.select(order_id, "symbol", F.unix_micros("time").alias("_t")).withColumn("_slot", slot("_t"))
    both = good.unionByName(handed).withColumn("_side", F.lit(0)).unionByName(asked.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy("symbol", "_slot").orderBy("_t", "_side", "seq").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("_last", F.last("_q", ignorenulls=True).over(w)).where(F.col("_side") == 1)
    fresh = F.col("_last.t") >= F.col("_t") - F.lit(width)
    found = seen.select(order_id, F.when(fresh, F.col("_last.bid")).alias("bid"), F.when(fresh, F.col("_last.ask")).alias("ask"))
    return orders.join(found, order_id, "left").withColumn("stale", F.col("bid").isNull())


def with_finished_higher_bar(bars: DataFrame, seconds: int, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Each bar with the last finished bar of the higher timeframe, by equality on its bucket."""
    keys = list(keys)
    htf = settle(resample(bars, seconds, keys))
    b = Blocks(placed(htf, keys, seconds), keys, 1)
    prev = [F.lag(c).over(b.w).alias(f"htf_{c}") for c in ("open", "high", "low", "close")]
    h = b.owned(b.df.select("*", *prev)).select(*keys, F.col("time").alias("_htf"), *[f"htf_{c}" for c in ("open", "high", "low", "close")])
    slot = F.timestamp_seconds(F.floor(F.unix_seconds("time") / F.lit(seconds)) * F.lit(seconds))
    return bars.withColumn("_htf", slot).join(h, [*keys, "_htf"], "left").drop("_htf")


def with_costs(trades: DataFrame, costs: DataFrame) -> DataFrame:
    """Spread, slippage and commission of each symbol: own row, default row, built-in default."""
    sym = F.col("symbol")
    fallback = costs.where(sym == "default").agg(
        *[F.max(c).alias(f"_d_{c}") for c in ("spread_pips", "slippage_pips", "commission_per_lot")]
    )
    joined = trades.join(costs.where(sym != "default"), "symbol", "left").crossJoin(F.broadcast(fallback))
    own = joined["spread_pips"].isNotNull() | joined["slippage_pips"].isNotNull() | joined["commission_per_lot"].isNotNull()

    def pick(c: str, default):
        return F.coalesce(F.when(own, F.col(c)).otherwise(F.col(f"_d_{c}")), default)

    return joined.select(
        *trades.columns,
        pick("spread_pips", money.default_spread(sym)).alias("spread_pips"),
        pick("slippage_pips", F.lit(money.DEFAULT_SLIPPAGE)).alias("slippage_pips"),
        pick("commission_per_lot", F.lit(0.0)).alias("commission_per_lot"),
    )


def lookup_title(rows: DataFrame, titles: DataFrame, slug: str = "book_slug") -> DataFrame:
    """Title per slug, the slug itself when there is none."""
    return rows.join(titles, slug, "left").withColumn("title", F.coalesce("title", F.col(slug)))


def combos(symbols: DataFrame, timeframes: DataFrame, strategies: DataFrame) -> DataFrame:
    """Every symbol, timeframe and strategy together."""
    return symbols.crossJoin(timeframes).crossJoin(strategies)


def without_visited(candidates: DataFrame, visited: DataFrame) -> DataFrame:
    """Candidates whose (param, value) is not among the visited ones.

    Both are cut by that pair into as many partitions as their rows need, so a task's
    memory does not follow the input.  The pair is one text: it is exact, and Spark
    joins on it as it was cut.
    """
    spot = F.concat(F.col("param").cast("string"), F.lit(" "), (F.col("value") + F.lit(0.0)).cast("string")).alias("_spot")  # 0.0 and -0.0 are one value
    rows = visited.count() + candidates.count()  # a number
    left, right = (by_rows(df, ["_spot"], rows=rows) for df in (candidates.select("*", spot), visited.select(spot)))
    return left.join(right, "_spot", "left_anti").select("param", "value", *[c for c in candidates.columns if c not in ("param", "value")])
