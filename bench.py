"""Headline queries at one scale; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose the
tables and cores.  Each query runs to a full result: its own checkpoints, then a
count of its rows through the noop sink.
"""

from __future__ import annotations

import json
import os
import time

from tickloom.operators import indicators as I
from tickloom.operators import signals as G
from tickloom.operators import structure as X
from tickloom.operators import sweep as S
from tickloom.operators.series import settle
from tickloom.plans import QUERIES
from tickloom.plans.registry import hourly
from tickloom.session import local_session
from tickloom.sources import tables as T

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINE = (
    "bars_from_ticks", "band_breaks", "ema_cross_signals", "reversion_signals", "trend_signals", "pairs_signals", "news_blackout", "order_quotes",
    "average_spread", "bracket_trades", "equity_statistics", "trade_statistics", "trade_breakdown", "circuit_breakers", "kelly_at_entry",
    "trial_ranking", "pareto_front", "position_changes", "upsert_incoming_wins", "sweep_scoreboard", "page_chunks", "stream_sealed_bars",
)
# a sweep of the size one search run makes: 48 parameter sets, 5 folds, 5 symbols
SEARCH = {"ema_fast": [5, 8, 9, 12], "ema_slow": [13, 18, 21, 26], "atr_multiplier": [1.5, 2.0, 2.5]}


MINUTES = 60  # bars whose number grows with the ticks, unlike hour bars of a fixed month


def minute_bars(spark):
    return settle(T.bars(spark, FOLDER, MINUTES))


def timed(fn) -> float:
    start = time.perf_counter()
    fn().write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    spark = local_session(CPUS, int(CPUS) if CPUS.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["bars_from_ticks"](spark, FOLDER).write.format("noop").mode("overwrite").save()  # start-up is not measured
    times = {name: timed(lambda n=name: QUERIES[n](spark, FOLDER)) for name in HEADLINE}
    bars = minute_bars(spark)
    times["minute_bands"] = timed(lambda: I.bollinger(bars, step_seconds=MINUTES))
    times["minute_cross_signals"] = timed(lambda: G.ema_cross(bars, step_seconds=MINUTES))
    times["minute_swings"] = timed(lambda: X.swings(bars, step_seconds=MINUTES))
    sets = S.grid(SEARCH)
    times["sweep_48_sets"] = timed(lambda: S.sweep(hourly(spark, FOLDER), "ema_crossover", sets, 5, 24))
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"), "sec_per_parameter_set": round(times["sweep_48_sets"] / len(sets), 3),
    }))


if __name__ == "__main__":
    main()
