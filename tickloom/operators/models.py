"""Models on labelled signals and returns.

Walk-forward fits follow the calendar, not the number of rows: a signal is scored
by the model refitted at the start of its own period, on outcomes closed by then.
All fits are independent, so they run side by side, each in a task that holds at
most ``train_rows`` rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .indicators import placed, volatility_regime
from .series import Blocks, asof_last, ranged, settle, with_position

FEATURES = ("ret_1", "ret_5", "ret_20", "atr_norm", "rsi_norm", "ema_spread", "regime")
# Acceptance threshold and training minimum.
THRESHOLD, MIN_TRAIN = 0.55, 20
REFIT_SECONDS = 7 * 86_400  # one week
TRAIN_ROWS = 5_000          # newest closed outcomes one fit may use
TREES, DEPTH, LEARNING_RATE = 50, 3, 0.1
EM_STEPS = 10
MODEL = "refit long, n_train long, n_classes long, gradient double, weights array<double>"


def period_of(time: str | Column, seconds: int) -> Column:
    """Number of the period a time lies in; its start is the refit that may score the time."""
    micros = F.unix_micros(F.col(time) if isinstance(time, str) else time)
    return F.floor(micros / F.lit(seconds * 1_000_000)).cast("long")


def _available_from(time: str, seconds: int) -> Column:
    """First period whose start is at or after the time."""
    return F.ceil(F.unix_micros(time) / F.lit(seconds * 1_000_000)).cast("long")


def refit_plan(labelled: DataFrame, refit_seconds: int = REFIT_SECONDS, train_rows: int = TRAIN_ROWS,
               order: Sequence[str] = ("exit_time", "symbol", "pos")) -> tuple[DataFrame, DataFrame]:
    """The outcomes numbered by their close (``seq``), and each refit with the range of numbers it may use."""
    rows = settle(with_position(ranged(labelled, [], list(order)), [], list(order), F.col("_rb"), "seq").drop("_rb"))
    closed = rows.groupBy(_available_from("exit_time", refit_seconds).alias("refit")).agg((F.max("seq") + 1).alias("_end"))
    wanted = settle(rows.select(period_of("time", refit_seconds).alias("refit")).distinct())
    plan = asof_last(wanted, settle(closed), [], "refit", ["_end"], name="_hit")
    end = F.coalesce(F.col("_hit._end"), F.lit(0)).cast("long")
    return rows, settle(plan.select("refit", F.greatest(end - F.lit(train_rows), F.lit(0)).alias("first"), end.alias("end")))


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 100) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression with penalty |w|^2 / 2, by Newton steps; and the gradient's size."""
    x = np.hstack([x, np.ones((len(x), 1))])
    keep = np.append(np.ones(x.shape[1] - 1), 0.0)
    w = np.zeros(x.shape[1])
    value = lambda w: np.logaddexp(0, x @ w).sum() - y @ (x @ w) + 0.5 * (keep * w) @ w
    for _ in range(steps):
        p = 0.5 * (1 + np.tanh(0.5 * (x @ w)))
        grad = x.T @ (p - y) + keep * w
        if np.abs(grad).max() < 1e-9:
            break
        step = np.linalg.solve((x.T * np.maximum(p * (1 - p), 1e-12)) @ x + np.diag(keep) + 1e-12 * np.eye(len(w)), grad)
        size = 1.0
        while size > 1e-6 and value(w - size * step) > value(w):
            size /= 2
        w = w - size * step
    p = 0.5 * (1 + np.tanh(0.5 * (x @ w)))
    return w, float(np.abs(x.T @ (p - y) + keep * w).max())


def _tree(x: np.ndarray, g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A regression tree of depth ``DEPTH`` on residuals g: (feature, threshold, value) per node of a full binary tree."""
    nodes = np.zeros((2 ** (DEPTH + 1) - 1, 3))
    nodes[:, 0] = -1
    todo = [(0, np.arange(len(g)), 0)]
    while todo:
        at, rows, depth = todo.pop()
        total = g[rows].sum()
        nodes[at, 2] = total / max(h[rows].sum(), 1e-12)
        best = (1e-12, -1, 0.0)
        if depth < DEPTH and len(rows) > 1:
            for f in range(x.shape[1]):
                by = rows[np.argsort(x[rows, f], kind="stable")]
                v, left = x[by, f], np.cumsum(g[by])[:-1]
                n = np.arange(1, len(by))
                gain = np.where(v[1:] > v[:-1], (left / n - (total - left) / (len(by) - n)) ** 2 * n * (len(by) - n) / len(by), 0.0)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], f, (v[k] + v[k + 1]) / 2)
        if best[1] >= 0:
            nodes[at, :2] = best[1:]
            low = x[rows, best[1]] <= best[2]
            todo += [(2 * at + 1, rows[low], depth + 1), (2 * at + 2, rows[~low], depth + 1)]
    return nodes


def _leaf(nodes: np.ndarray, x: np.ndarray) -> np.ndarray:
    at = np.zeros(len(x), int)
    for _ in range(DEPTH):
        f = nodes[at, 0].astype(int)
        low = x[np.arange(len(x)), np.maximum(f, 0)] <= nodes[at, 1]
        at = np.where(f < 0, at, np.where(low, 2 * at + 1, 2 * at + 2))
    return nodes[at, 2]


def boosted_trees(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Gradient-boosted trees for the logistic loss: the start value, then all trees' nodes in a row."""
    start = float(np.log(y.mean() / (1 - y.mean())))
    score, trees = np.full(len(y), start), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        trees.append(_tree(x, y - p, p * (1 - p)))
        score += LEARNING_RATE * _leaf(trees[-1], x)
    return np.concatenate([[start], np.array(trees).ravel()])


def boosted_score(weights: np.ndarray, x: np.ndarray) -> np.ndarray:
    trees = weights[1:].reshape(-1, 2 ** (DEPTH + 1) - 1, 3)
    return 1 / (1 + np.exp(-(weights[0] + LEARNING_RATE * sum(_leaf(t, x) for t in trees))))


def _score_column(weights: pd.Series, x: pd.Series) -> pd.Series:
    out = np.full(len(x), np.nan)
    groups: dict[bytes, list[int]] = {}
    for i, w in enumerate(weights):
        if w is not None:
            groups.setdefault(np.asarray(w).tobytes(), []).append(i)
    for raw, rows in groups.items():
        out[rows] = boosted_score(np.frombuffer(raw), np.stack([np.asarray(x.iloc[i]) for i in rows]))
    return pd.Series(out).astype(object).where(~np.isnan(out), None)


def profit_probability(labelled: DataFrame, refit_seconds: int = REFIT_SECONDS, train_rows: int = TRAIN_ROWS, min_train: int = MIN_TRAIN,
                       boosted: bool = False, features: Sequence[str] = FEATURES) -> DataFrame:
    """Outcomes with the probability of profit known when their signal was given.

    ``labelled`` has symbol, pos, time (of the signal), exit_time, label and the
    features.  A signal uses the refit at the start of its period, and that refit
    the newest ``train_rows`` outcomes with exit_time at or before it.  Fewer than
    ``min_train`` of them, or one class only, give no model and a null ``prob``.
    Adds seq, refit, n_train, n_classes, gradient (of a logistic fit) and prob.
    """
    names = list(features)
    rows, plan = refit_plan(labelled, refit_seconds, train_rows)
    rows = settle(rows.withColumns({"_x": F.array(*[F.col(c).cast("double") for c in names]), "refit": period_of("time", refit_seconds)}))
    block = lambda c: F.floor(c / F.lit(train_rows)).cast("long")
    spread = plan.where("end > first").withColumn("_block", F.explode(F.sequence(block(F.col("first")), block(F.col("end") - 1))))  # two blocks at most
    used = rows.select("seq", "_x", "label", block(F.col("seq")).alias("_block")).join(spread, "_block").where("seq >= first AND seq < end")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        x, y = np.stack(pdf["_x"].to_numpy()), pdf["label"].to_numpy(float)
        n, classes, gradient, weights = len(y), len(np.unique(y)), None, None
        if n >= min_train and classes == 2:
            if boosted:
                weights = boosted_trees(x, y)
            else:
                weights, gradient = logistic(x, y)
        return pd.DataFrame({"refit": [pdf["refit"].iloc[0]], "n_train": [n], "n_classes": [classes], "gradient": [gradient], "weights": [None if weights is None else weights.tolist()]})

    fitted = settle(used.select("refit", "seq", "_x", "label").groupBy("refit").applyInPandas(fit, MODEL))
    both = rows.join(fitted, "refit", "left")
    if boosted:
        prob = F.pandas_udf(_score_column, "double")("weights", "_x")
    else:
        terms = F.zip_with(F.slice("weights", 1, len(names)), "_x", lambda a, b: a * b)
        prob = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.aggregate(terms, F.lit(0.0), lambda a, b: a + b) + F.element_at("weights", -1))))
    out = both.withColumn("prob", F.when(F.col("weights").isNotNull(), prob)).drop("_x", "weights")
    return out.withColumns({"n_train": F.coalesce("n_train", F.lit(0)), "n_classes": F.coalesce("n_classes", F.lit(0))})


def meta_filter(signals: DataFrame, threshold: float = THRESHOLD, prob: str = "prob") -> DataFrame:
    """Turn entries below the threshold into holds; without a model they pass unchanged."""
    p = F.col(prob)
    drop = (F.col("action") != "HOLD") & (p < threshold)
    trained = (F.col("action") != "HOLD") & p.isNotNull()
    return signals.withColumns({
        "reason": F.when(drop, F.format_string("meta_filtered p=%.2f", p)).otherwise(F.col("reason")),
        "strength": F.when(trained, p).otherwise(F.col("strength")),
        "action": F.when(drop, F.lit("HOLD")).otherwise(F.col("action")),
    })


def mixture_regime(bars: DataFrame, n: int = 20, symbol: str | None = None, keys: Sequence[str] = ("symbol",), steps: int = EM_STEPS,
                   step_seconds: int = 3600) -> DataFrame:
    """Two-state regime per series from a Gaussian mixture on log returns; the wider component is 1.

    The mixture is fitted by ``steps`` rounds of expectation and maximisation as
    grouped sums: five numbers per series go back to its rows each round.  A series
    below 2 * n rows follows the volatility rule.  There is no smoothing over time,
    so labels differ from those of a hidden Markov model.  Columns: those of
    ``bars``, pos, log_return and regime, whichever rule a series follows.
    """
    keys = list(keys)
    if symbol is not None:
        bars = bars.where(F.col("symbol") == symbol)
    b = Blocks(settle(placed(bars, keys, step_seconds)), keys, 1)
    lr = F.coalesce(F.ln(F.try_divide(F.col("close"), F.lag("close").over(b.w))), F.lit(0.0))
    base = settle(b.owned(b.df.withColumn("log_return", lr)))
    cols = base.columns
    counts = settle(base.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.avg("log_return").alias("_m0"), F.var_pop("log_return").alias("_v")))
    long = base.join(counts.where(F.col("_n") >= 2 * n).select(*keys), keys, "left_semi")
    floor = F.lit(1e-18)
    par = settle(counts.where(F.col("_n") >= 2 * n).select(
        *keys, F.lit(0.5).alias("_w"), F.col("_m0"), F.col("_m0").alias("_m1"), F.greatest(F.col("_v") * 0.25, floor).alias("_v0"), F.greatest(F.col("_v") * 2.0, floor).alias("_v1")))
    x = F.col("log_return")

    def share() -> Column:
        """Weight of the second component in a row."""
        d = lambda m, v: -(x - F.col(m)) * (x - F.col(m)) / (F.col(v) * 2.0) - F.ln(v) / 2.0
        return F.lit(1.0) / (F.lit(1.0) + F.exp(F.least(d("_m0", "_v0") - d("_m1", "_v1"), F.lit(700.0))) * (F.lit(1.0) - F.col("_w")) / F.col("_w"))

    for _ in range(steps):
        r = long.join(par, keys).withColumn("_r", share())
        sums = r.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("n"), F.sum("_r").alias("s1"), F.sum(F.col("_r") * x).alias("a1"), F.sum(x).alias("a"),
            F.sum(F.col("_r") * (x - F.col("_m1")) * (x - F.col("_m1"))).alias("q1"), F.sum((F.lit(1.0) - F.col("_r")) * (x - F.col("_m0")) * (x - F.col("_m0"))).alias("q0"))
        old = sums.join(par, keys)
        n1, n0 = F.greatest("s1", F.lit(1e-9)), F.greatest(F.col("n") - F.col("s1"), F.lit(1e-9))
        m1, m0 = F.col("a1") / n1, (F.col("a") - F.col("a1")) / n0
        # spread around the new mean, from the sums around the old one
        v1 = F.col("q1") / n1 - (m1 - F.col("_m1")) * (m1 - F.col("_m1"))
        v0 = F.col("q0") / n0 - (m0 - F.col("_m0")) * (m0 - F.col("_m0"))
        par = settle(old.select(*keys, F.least(F.greatest(F.col("s1") / F.col("n"), F.lit(1e-9)), F.lit(1 - 1e-9)).alias("_w"),
                                m0.alias("_m0"), m1.alias("_m1"), F.greatest(v0, floor).alias("_v0"), F.greatest(v1, floor).alias("_v1")))
    second = (share() > 0.5) == (F.col("_v1") >= F.col("_v0"))
    out = long.join(par, keys).withColumn("regime", F.when(second, 1).otherwise(0)).select(*cols, "regime")
    short = settle(base.join(counts.where(F.col("_n") < 2 * n).select(*keys), keys, "left_semi"))
    ruled = volatility_regime(short.drop("log_return", "pos"), n, "global", keys, step_seconds).select(*keys, "pos", "regime")
    return out.unionByName(short.join(ruled, [*keys, "pos"]).select(*cols, "regime"))
