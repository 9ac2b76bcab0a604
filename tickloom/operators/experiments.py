"""Experiment logs: trials, runs, iterations, decisions and their summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores
from .series import Blocks, by_rows, earlier_ranked, ranged, settle, with_position

COMBO = ("symbol", "timeframe", "strategy")
# Thresholds of the log checks.
REPEAT_WINDOW, REPEAT_LIMIT = 20, 3
FLAT_DELTA, FLAT_LIMIT = 0.01, 8
WINNER_MARGIN = 1.10


def last_rows(df: DataFrame, keys: Sequence[str], order: str, k: int, rank: str = "recency") -> DataFrame:
    """The newest k rows per key, numbered from the newest.

    A bounded row_number filter is cut on the map side before the exchange, so a
    key with many rows sends k rows per task, not all of them.
    """
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return df.withColumn(rank, F.row_number().over(w).cast("long")).where(F.col(rank) <= k)


def with_global_dsr(trials: DataFrame, sharpe: str = "sharpe", keys: Sequence[str] = ()) -> DataFrame:
    """Deflated Sharpe of each trial against the whole pool; only finite trials count."""
    x = scores.finite(F.col(sharpe))
    pool = trials.groupBy(*keys).agg(F.count(x).alias("_n"), F.avg(x).alias("_m"), F.stddev_samp(x).alias("_s"))
    joined = trials.join(pool, list(keys)) if keys else trials.crossJoin(F.broadcast(pool))  # one row
    return joined.withColumn("dsr", scores.deflated_sharpe(F.col(sharpe), F.col("_n"), F.col("_m"), F.col("_s"))).drop("_n", "_m", "_s")


def running_moments(log: DataFrame, keys: Sequence[str], order: str, x: Column) -> DataFrame:
    """Add _n, _m and _m2: count, mean and sum of squared deviations of ``x`` up to each row.

    Values are taken relative to the first one of their range bucket, and the moments of
    the buckets before are merged in by the pairwise update, so large means do not cancel.
    Nulls count nothing.  Keys must not be null.
    """
    keys = list(keys)
    df = ranged(log.withColumn("_x", x), keys, [order])
    seen = Window.partitionBy(*keys, "_rb").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_d", F.col("_x") - F.first("_x", ignorenulls=True).over(seen))
    df = df.select("*", F.count("_d").over(seen).alias("_ln"), F.sum("_d").over(seen).alias("_s"), F.sum(F.col("_d") * F.col("_d")).over(seen).alias("_q"),
                   F.first("_x", ignorenulls=True).over(seen).alias("_p"))
    df = df.withColumn("_lm", F.col("_p") + F.try_divide("_s", "_ln")).withColumn("_lm2", F.greatest(F.col("_q") - F.try_divide(F.col("_s") * F.col("_s"), F.col("_ln")), F.lit(0.0)))
    last = df.groupBy(*keys, "_rb").agg(F.max_by(F.struct("_ln", "_lm", "_lm2"), "_ln").alias("_t")).where(F.col("_t._ln") > 0).select(*keys, "_rb", "_t.*")
    all_buckets = df.select(*keys, "_rb").distinct().join(last, [*keys, "_rb"], "left")
    past = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_rb").rowsBetween(Window.unboundedPreceding, -1)
    # one entry per bucket of up to RANGE_ROWS rows
    table = all_buckets.select(*keys, "_rb", F.collect_list(F.struct("_ln", "_lm", "_lm2")).over(past).alias("_b"))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("m"), F.lit(0.0).alias("q"))
    merged = F.aggregate(F.filter("_b", lambda b: b["_ln"].isNotNull()), start, lambda a, b: _merged(a["n"], a["m"], a["q"], b["_ln"], b["_lm"], b["_lm2"]))
    carry = table.select(*keys, "_rb", merged.alias("_c"))
    both = df.join(carry, [*keys, "_rb"])
    full = _merged(F.col("_c.n"), F.col("_c.m"), F.col("_c.q"), F.col("_ln"), F.coalesce("_lm", F.lit(0.0)), F.coalesce("_lm2", F.lit(0.0)))
    return both.withColumn("_f", full).select(*log.columns, F.col("_f.n").alias("_n"), F.when(F.col("_f.n") > 0, F.col("_f.m")).alias("_m"), F.when(F.col("_f.n") > 0, F.col("_f.q")).alias("_m2"))


def _merged(n: Column, m: Column, q: Column, n2: Column, m2: Column, q2: Column) -> Column:
    """Moments (count, mean, squared deviations) of two sets of values together."""
    both, gap = n + n2, m2 - m
    share = F.when(both > 0, n2 / both).otherwise(F.lit(0.0))
    return F.struct(both.cast("long").alias("n"), (m + gap * share).alias("m"), (q + q2 + gap * gap * n * share).alias("q"))


def with_running_dsr(log: DataFrame, keys: Sequence[str] = (), order: str = "iteration", sharpe: str = "sharpe") -> DataFrame:
    """Deflated Sharpe of each iteration against the trials up to it."""
    df = running_moments(log, keys, order, scores.finite(F.col(sharpe)))
    var = F.when(F.col("_n") > 1, F.col("_m2") / (F.col("_n") - 1))
    std = F.sqrt(F.when(var > 1e-14, var).otherwise(F.lit(0.0)))
    return df.withColumn("dsr_so_far", scores.deflated_sharpe(F.col(sharpe), F.col("_n"), F.col("_m"), std)).drop("_n", "_m", "_m2")


def ranked(trials: DataFrame, keys: Sequence[str] = (), score: str = "dsr", tie: str = "sr_id", name: str = "rank") -> DataFrame:
    """Rank by score, highest first, numbered without one global sort in a task."""
    order = [F.desc(score), F.asc(tie)]
    df = with_position(ranged(trials, keys, order), keys, order, F.col("_rb"), "_p")
    return df.withColumn(name, F.col("_p") + F.lit(1)).drop("_p", "_rb")


def clusters(trials: DataFrame, by: str = "mapped_type") -> DataFrame:
    """Members of each type in score order with the size of their type; types without members are absent."""
    sizes = trials.groupBy(by).agg(F.count(F.lit(1)).alias("members"))
    return ranked(trials, [by], name="rank_in_type").join(sizes, by)


def best_trials(trials: DataFrame, n: int = 15, score: str = "dsr", tie: str = "sr_id") -> DataFrame:
    return trials.orderBy(F.desc(score), F.asc(tie)).limit(n)


def trial_summary(trials: DataFrame) -> DataFrame:
    return trials.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("guard") == "PASS").alias("validated"))


def unit_status(units: DataFrame) -> DataFrame:
    """Units per status and whether that status is final."""
    final = F.col("status").isin("complete", "complete_no_strategies", "failed")
    return units.groupBy("status").agg(F.count(F.lit(1)).alias("units")).withColumn("terminal", final)


def pending_units(units: DataFrame) -> DataFrame:
    return units.where(~F.col("status").isin("complete", "complete_no_strategies", "failed"))


def mean_sharpe_around(runs: DataFrame, iterations: DataFrame, at, n: int | None = None) -> DataFrame:
    """Mean Sharpe of runs whose iteration lies before and after a time.

    With ``n`` only the n nearest runs on each side count.
    """
    when = F.lit(at).cast("timestamp")
    joined = runs.select("id", "iteration_id", "sharpe").join(
        iterations.select(F.col("id").alias("iteration_id"), F.col("timestamp").alias("_ts")), "iteration_id"
    )
    before, after = joined.where(F.col("_ts") < when), joined.where(F.col("_ts") > when)
    if n is not None:
        before = before.orderBy(F.desc("iteration_id"), F.desc("id")).limit(n)
        after = after.orderBy(F.asc("iteration_id"), F.asc("id")).limit(n)
    return before.agg(F.avg("sharpe").alias("mean_before")).crossJoin(after.agg(F.avg("sharpe").alias("mean_after")))


def nearest_runs(runs: DataFrame, iterations: DataFrame, at, keys: Sequence[str] = COMBO) -> DataFrame:
    """Per combo the Sharpe of the last run before and the first run after a time."""
    when = F.lit(at).cast("timestamp")
    joined = runs.select("id", "iteration_id", "sharpe", *keys).join(
        iterations.select(F.col("id").alias("iteration_id"), F.col("timestamp").alias("_ts")), "iteration_id"
    )
    order = F.struct("iteration_id", "id")
    near = joined.groupBy(*keys).agg(
        F.max_by("sharpe", F.when(F.col("_ts") < when, order)).alias("before"),
        F.min_by("sharpe", F.when(F.col("_ts") > when, order)).alias("after"),
    )
    both = F.col("before").isNotNull() & F.col("after").isNotNull()
    return near.withColumn("improved", both & (F.coalesce("after", F.lit(0.0)) > F.coalesce("before", F.lit(0.0))))


def last_promoted(runs: DataFrame, keys: Sequence[str] = COMBO) -> DataFrame:
    return last_rows(runs.where(F.col("promoted") == 1), keys, "id", 1).drop("recency")


def quiet_iterations(iterations: DataFrame, within: int = 30) -> DataFrame:
    """Iterations since the last promotion, among the newest ``within``."""
    new = iterations.orderBy(F.desc("id")).limit(within)
    rows = new.agg(F.sort_array(F.collect_list(F.struct(F.col("id"), F.col("combos_promoted").alias("k"))), asc=False).alias("a"))  # at most ``within`` rows
    hit = F.array_position(F.transform("a", lambda x: x["k"] != 0), True)
    return rows.select(F.when(hit > 0, hit - 1).otherwise(F.size("a")).cast("long").alias("quiet"))


def degrading(runs: DataFrame, keys: Sequence[str] = COMBO, k: int = 5, margin: float = 0.5) -> DataFrame:
    """Combos whose last three scores fall strictly and whose newest lies well below the recent mean."""
    new = last_rows(runs, keys, "id", k).where(F.col("dsr").isNotNull())
    arr = new.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("recency", "dsr"))).alias("a"))  # at most k rows per combo
    d = [F.get("a", F.lit(i))["dsr"] for i in range(3)]
    mean = F.aggregate("a", F.lit(0.0), lambda acc, x: acc + x["dsr"]) / F.size("a")
    falling = (F.size("a") >= 3) & (d[0] < d[1]) & (d[1] < d[2])
    return arr.select(*keys, d[0].alias("latest"), mean.alias("trailing_mean"),
                      F.coalesce(falling & (d[0] < mean - F.lit(margin)), F.lit(False)).alias("degrading"))


def repeated_pairs(log: DataFrame, keys: Sequence[str] = ("strategy",), order: str = "iteration") -> DataFrame:
    """(param, value) pairs tried three times or more among the newest rows of a log."""
    new = last_rows(log, keys, order, REPEAT_WINDOW)
    return new.groupBy(*keys, "param", "new_val").agg(F.count(F.lit(1)).alias("times")).where(F.col("times") >= REPEAT_LIMIT)


def flat_runs(log: DataFrame, keys: Sequence[str] = ("strategy",), order: str = "iteration") -> DataFrame:
    """Length of the trailing run of nearly equal scores, and whether it is a stall."""
    df = ranged(log.where(F.col("sharpe").isNotNull()).select(*keys, order, "sharpe"), keys, [order])
    b = Blocks(with_position(df, keys, [order], F.col("_rb")), keys, 1)
    moved = F.coalesce(F.abs(F.col("sharpe") - F.lag("sharpe").over(b.w)) >= FLAT_DELTA, F.lit(True))
    x = b.owned(b.df.withColumn("_moved", moved))
    out = x.groupBy(*keys).agg((F.max("pos") - F.max(F.when(F.col("_moved"), F.col("pos")))).alias("flat_run"))
    return out.withColumn("stalled", F.col("flat_run") >= FLAT_LIMIT)


def daily_attempts(events: DataFrame, time: str = "time") -> DataFrame:
    return events.groupBy(F.to_date(time).alias("utc_date")).agg(F.count(F.lit(1)).alias("attempts"))


def cooldowns(log: DataFrame, now, seconds: int, cause: str = "cause", time: str = "time") -> DataFrame:
    """Last event per cause and whether its cooldown has passed."""
    last = log.groupBy(cause).agg(F.max(time).alias("last_time"))
    gap = F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros("last_time")
    return last.withColumn("ready", gap >= F.lit(seconds * 1_000_000))


def false_halts(accounts: DataFrame, now_epoch: float, peak_floor: float = 10_500.0, low: float = 9_800.0, high: float = 10_100.0) -> DataFrame:
    """Accounts still cooling off whose equity is near the fallback value below a high peak."""
    return accounts.where(
        (F.col("peak_equity") > peak_floor) & (F.col("cooling_off_until") > F.lit(now_epoch)) & F.col("equity").between(low, high)
    )


def not_already_open(found: DataFrame, events: DataFrame) -> DataFrame:
    """Detected types without an open event of the same type and combo; a missing combo equals a missing one."""
    still = events.where(~F.col("status").isin("merged", "closed")).select(
        F.col("regression_type").alias("_t"), F.col("combo_slug").alias("_c")
    ).distinct()
    same = (F.col("regression_type") == F.col("_t")) & F.col("combo_slug").eqNullSafe(F.col("_c"))
    return found.join(still, same, "left_anti")


def decide(log: DataFrame, baselines: DataFrame, keys: Sequence[str] = ("strategy",)) -> DataFrame:
    """Keep or roll back each trial against the baseline of its key."""
    j = log.join(baselines, list(keys))
    verdict = scores.keep_or_rollback(F.col("guard_pass"), F.col("sharpe"), F.col("base_sharpe"), F.col("win_rate"), F.col("base_win_rate"))
    return j.withColumn("verdict", verdict)


def neighbours(current: DataFrame) -> DataFrame:
    """Untried values around each parameter: one step up and down, then 2, 3 and 5 steps.

    Values are clamped to the range, rounded to 4 places and differ from the current one.
    """
    steps = [(m, d) for m in (1, 2, 3, 5) for d in (1, -1)]
    moves = F.array(*[F.struct(F.lit(i).cast("long").alias("priority"), F.lit(float(m * d)).alias("by")) for i, (m, d) in enumerate(steps)])
    x = by_rows(current, ["param"], len(steps)).withColumn("_m", F.explode(moves))  # grouped below within these partitions
    value = F.bround(F.greatest(F.col("lo"), F.least(F.col("hi"), F.col("old") + F.col("_m.by") * F.col("step"))), 4)
    out = x.select("param", "old", F.col("_m.priority").alias("priority"), value.alias("value")).where(F.col("value") != F.col("old"))
    return out.groupBy("param", "old", "value").agg(F.min("priority").alias("priority"))


def grid_value(lo: Column, step: Column, index: Column) -> Column:
    return lo + index * step


def grid_index(lo: Column, hi: Column, step: Column, value: Column) -> Column:
    last = F.greatest(F.lit(1), F.bround((hi - lo) / step).cast("long"))
    return F.greatest(F.lit(0), F.least(last, F.bround((value - lo) / step).cast("long")))


def _local_front(batches):
    """Points of each batch that no other point of their part of it beats."""
    for pdf in batches:
        for at in range(0, len(pdf), 1000):
            part = pdf.iloc[at : at + 1000]
            a, c, d = (part[n].to_numpy() for n in "acd")
            as_good = (a[:, None] >= a) & (c[:, None] >= c) & (d[:, None] <= d)
            better = as_good & ((a[:, None] > a) | (c[:, None] > c) | (d[:, None] < d))
            yield part[~better.any(axis=0)]


def pareto_front(trials: DataFrame, up: tuple[str, str] = ("sharpe", "win_rate"), down: str = "max_dd") -> DataFrame:
    """Trials no other trial beats: first ``up`` high, ``down`` low, second ``up`` high.

    In the order (first up, second up, down) every dominating point comes earlier,
    so a point survives when no earlier point with at least its second value has
    a ``down`` as small: a ranked running minimum instead of comparing all pairs.
    """
    a, c = up
    points = trials.select(*[F.col(x).cast("double").alias(n) for x, n in ((a, "a"), (c, "c"), (down, "d"))]).distinct()
    # most points lose against one of their own partition already
    points = settle(points.mapInPandas(_local_front, "a double, c double, d double"))
    order = [F.desc("a"), F.desc("c"), F.asc("d")]
    placed = with_position(ranged(points, [], order), [], order, F.col("_rb")).drop("_rb")
    best = earlier_ranked(placed, [], [F.col("c"), F.col("pos").desc()], "above", "min", F.col("d"), "_low")
    front = best.where(F.col("_low").isNull() | (F.col("_low") > F.col("d"))).select("a", "c", "d")
    same = (F.col(a) == F.col("a")) & (F.col(c) == F.col("c")) & (F.col(down) == F.col("d"))
    return trials.join(front, same, "left_semi")


def across_symbols(results: DataFrame, keys: Sequence[str] = ("param_id",)) -> DataFrame:
    """Mean Sharpe and win rate, worst drawdown and whether every symbol passed."""
    return results.groupBy(*keys).agg(
        F.avg("sharpe").alias("sharpe"), F.avg("win_rate").alias("win_rate"), F.max("max_dd").alias("max_dd"),
        F.bool_and("guard_pass").alias("guard_pass"),
    )


def challenge(runs: DataFrame, current: str, challenger: str, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """The strategy to go on with: the challenger only when it is more than 10 % better."""
    a = runs.groupBy(*keys).agg(
        F.avg(F.when(F.col("strategy") == current, F.col("sharpe"))).alias("current_sharpe"),
        F.avg(F.when(F.col("strategy") == challenger, F.col("sharpe"))).alias("challenger_sharpe"),
    )
    wins = F.col("challenger_sharpe") > F.col("current_sharpe") * F.lit(WINNER_MARGIN)
    return a.withColumn("strategy", F.when(F.coalesce(wins, F.lit(False)), F.lit(challenger)).otherwise(F.lit(current)))


