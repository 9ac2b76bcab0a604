"""Queries on fitted models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import indicators as I
from ..operators import models as M
from ..operators import outcomes as O
from ..operators.series import settle
from .outcome_queries import CROSS_OUT, cross_signals, placed_bars
from .registry import POS, hourly, query, r

WEEK = M.REFIT_SECONDS * 1_000_000
# each signal with its refit, and what had closed by then
PLAN = f"""{CROSS_OUT}, lab AS (SELECT symbol, pos, time, action, exit_time, CASE WHEN gross - cost > 0 THEN 1 ELSE 0 END AS label, epoch_us(time) // {WEEK} AS refit FROM o),
tr AS (SELECT refit, count(exit_time) AS n, count(DISTINCT label) AS k FROM (SELECT r.refit, l.exit_time, l.label
  FROM (SELECT DISTINCT refit FROM lab) r LEFT JOIN lab l ON epoch_us(l.exit_time) <= r.refit * {WEEK}) GROUP BY 1)"""
SCORED = f"n >= {M.MIN_TRAIN} AND k = 2"


def labelled(spark, folder):
    """Outcomes of all cross signals with the features of their signal bar."""
    bars = placed_bars(spark, folder)
    t = O.label_signals(cross_signals(bars), bars, overlap=True)
    f = I.features(bars).drop("time")
    return settle(t.join(f, ["symbol", "pos"]).withColumn("label", F.when(F.col("profit") > 0, 1).otherwise(0)))


def facts(spark, folder, boosted: bool):
    """What must hold of every filtered signal: when it is scored, and that only weak ones are held."""
    p = M.profit_probability(labelled(spark, folder), boosted=boosted)
    s = M.meta_filter(p.withColumn("was", F.col("action")))
    weak = F.coalesce(F.col("prob") < M.THRESHOLD, F.lit(False))
    held = ((F.col("action") == "HOLD") == weak) & (weak | (F.col("action") == F.col("was")))
    sure = F.col("prob").isNull() | ((F.col("strength") == F.col("prob")) & F.col("prob").between(0, 1))
    return s.select("symbol", "pos", F.col("prob").isNotNull().alias("scored"), held.alias("held_when_weak"), sure.alias("strength_is_prob"),
                    (F.coalesce("gradient", F.lit(0.0)) < 1e-6).alias("at_optimum"))


@query("meta_refit_plan", f"""{PLAN} SELECT symbol, pos, refit, CASE WHEN n > 0 THEN n ELSE 0 END AS n_train, CASE WHEN n > 0 THEN k ELSE 0 END AS n_classes, {SCORED} AS scored FROM lab JOIN tr USING (refit)""")
def meta_refit_plan(spark, folder):
    """The refit each signal uses and the outcomes closed by then; nothing later takes part."""
    p = M.profit_probability(labelled(spark, folder), train_rows=1_000_000)
    return p.select("symbol", "pos", "refit", "n_train", "n_classes", F.col("prob").isNotNull().alias("scored"))


FACTS = f"{PLAN} SELECT symbol, pos, {SCORED} AS scored, TRUE AS held_when_weak, TRUE AS strength_is_prob, TRUE AS at_optimum FROM lab JOIN tr USING (refit)"


@query("meta_filtered_signals", FACTS)
def meta_filtered_signals(spark, folder):
    return facts(spark, folder, False)


@query("meta_filtered_boosted", FACTS)
def meta_filtered_boosted(spark, folder):
    return facts(spark, folder, True)


@query("meta_filter_rule", f"""{CROSS_OUT}, p AS (SELECT symbol, pos, action, CASE WHEN pos % 10 = 3 THEN NULL ELSE (pos % 100) / 100.0::DOUBLE END AS prob FROM o)
SELECT symbol, pos, CASE WHEN prob < 0.55 THEN 'HOLD' ELSE action END AS action, CASE WHEN prob < 0.55 THEN 'meta_filtered p=' || printf('%.2f', prob) ELSE 'cross' END AS reason, coalesce(prob, 0.5)::DOUBLE AS strength FROM p""")
def meta_filter_rule(spark, folder):
    """The filter alone, on a probability that is given."""
    bars = placed_bars(spark, folder)
    t = O.label_signals(cross_signals(bars), bars, overlap=True)
    prob = F.when(F.col("pos") % 10 != 3, (F.col("pos") % 100) / F.lit(100.0))
    s = M.meta_filter(t.select("symbol", "pos", "action", F.lit("cross").alias("reason"), F.lit(0.5).alias("strength"), prob.alias("prob")))
    return s.select("symbol", "pos", "action", "reason", "strength")


def mixture_sql(n: int = 20, steps: int = M.EM_STEPS) -> str:
    """The same rounds, one statement each."""
    d = lambda m, v: f"(-(lr - {m}) * (lr - {m}) / ({v} * 2.0) - ln({v}) / 2.0)"
    share = f"(1.0 / (1.0 + exp(least({d('m0', 'v0')} - {d('m1', 'v1')}, 700.0)) * (1.0 - w) / w))"
    parts = [f"""{POS}, x AS (SELECT symbol, time, pos, coalesce(ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY pos)), 0.0) AS lr, count(*) OVER (PARTITION BY symbol) AS n FROM b),
p0 AS (SELECT symbol, 0.5::DOUBLE AS w, avg(lr) AS m0, avg(lr) AS m1, greatest(var_pop(lr) * 0.25, 1e-18) AS v0, greatest(var_pop(lr) * 2.0, 1e-18) AS v1 FROM x WHERE n >= {2 * n} GROUP BY 1)"""]
    for k in range(steps):
        parts.append(f"""s{k} AS (SELECT symbol, any_value(w) AS w, any_value(m0) AS m0, any_value(m1) AS m1, count(*) AS n, sum(r) AS s1, sum(r * lr) AS a1, sum(lr) AS a,
  sum(r * (lr - m1) * (lr - m1)) AS q1, sum((1.0 - r) * (lr - m0) * (lr - m0)) AS q0 FROM (SELECT *, {share} AS r FROM x JOIN p{k} USING (symbol)) GROUP BY 1),
t{k} AS (SELECT *, a1 / greatest(s1, 1e-9) AS n1, (a - a1) / greatest(n - s1, 1e-9) AS n0 FROM s{k}),
p{k + 1} AS MATERIALIZED (SELECT symbol, least(greatest(s1 / n, 1e-9), 1 - 1e-9) AS w, n0 AS m0, n1 AS m1, greatest(q0 / greatest(n - s1, 1e-9) - (n0 - m0) * (n0 - m0), 1e-18) AS v0,
  greatest(q1 / greatest(s1, 1e-9) - (n1 - m1) * (n1 - m1), 1e-18) AS v1 FROM t{k})""")
    parts.append(f"""vol AS (SELECT symbol, pos, CASE WHEN pos >= {n} THEN stddev_samp(CASE WHEN pos > 0 THEN lr END) OVER (PARTITION BY symbol ORDER BY pos ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) END AS vol FROM x WHERE n < {2 * n})""")
    return ",\n".join(parts) + f""" SELECT symbol, time, round(lr, 8) AS log_return, (({share} > 0.5) = (v1 >= v0))::BIGINT AS regime FROM x JOIN p{steps} USING (symbol)
UNION ALL SELECT x.symbol, x.time, round(lr, 8), coalesce(vol > (SELECT median(vol) FROM vol m WHERE m.symbol = x.symbol), FALSE)::BIGINT FROM x JOIN vol USING (symbol, pos)"""


@query("mixture_regime", mixture_sql())
def mixture_regime(spark, folder):
    m = M.mixture_regime(hourly(spark, folder))
    return m.select("symbol", "time", r("log_return"), F.col("regime").cast("long").alias("regime"))
