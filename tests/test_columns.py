import math

import pytest
from pyspark.sql import functions as F

from tickloom.functions import clock, money, scores, sizing, words
from tickloom.operators import structure as S


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def test_costs_match_published_cases(spark):
    lit = F.lit
    row = one(
        spark,
        plain=money.trade_cost(lit(1.0), lit(False), lit(1.0), lit(0.5), lit(0.0)),
        stop=money.trade_cost(lit(1.0), lit(True), lit(1.0), lit(0.5), lit(0.0)),
        commission=money.trade_cost(lit(1.0), lit(False), lit(0.0), lit(0.0), lit(3.5)),
        jpy=money.gross_pnl(lit("SELL"), lit(150.10), lit(150.00), lit(1.0), money.pip_size(lit("usdjpy"))),
    )
    assert row.plain == pytest.approx(10.0) and row.stop == pytest.approx(15.0)
    assert row.commission == pytest.approx(7.0) and row.jpy == pytest.approx(100.0)


def test_kelly_cases(spark):
    k = lambda n, w, l, sw, sl, f: sizing.kelly_multiplier(*[F.lit(x) for x in (n, w, l, sw, sl)], fraction=f)
    row = one(spark, few=k(10, 5, 5, 10.0, 10.0, 0.25), cap=k(30, 28, 2, 2800.0, 2.0, 0.1), lost=k(30, 0, 30, 0.0, 30.0, 0.25), won=k(30, 30, 0, 30.0, 0.0, 0.25))
    assert (row.few, row.cap, row.lost, row.won) == (0.25, 0.1, 0.0, 0.25)


@pytest.mark.parametrize("equity,size,keep", [(100, 1, 1), (90, 0.7, 0.5), (85, 0.5, 0.25), (80, 0, 0)])
def test_drawdown_tiers(spark, equity, size, keep):
    row = one(spark, a=sizing.drawdown_size_factor(F.lit(100.0), F.lit(float(equity))), b=sizing.preservation_factor(F.lit(100.0), F.lit(float(equity))))
    assert (row.a, row.b) == (size, keep)


def test_position_size_rounds_half_even_and_has_a_floor(spark):
    size = lambda b, a: sizing.position_size(F.lit(b), F.lit(a), F.lit(0.25), F.lit(0.0))
    row = one(spark, poor=size(0.0, 0.001), flat=size(10000.0, 0.0), usual=size(10000.0, 0.001), huge=size(1e9, 0.001))
    assert (row.poor, row.flat, row.huge) == (0.01, 0.01, 10.0)
    assert row.usual == pytest.approx(0.17)


def test_sessions_and_market_hours(spark):
    times = ["2024-01-05 20:59:00", "2024-01-05 21:00:00", "2024-01-06 12:00:00", "2024-01-07 21:59:00", "2024-01-07 22:00:00", "2024-01-08 06:59:00", "2024-01-08 07:00:00"]
    df = spark.createDataFrame([(t,) for t in times], "t string").select(F.col("t").cast("timestamp").alias("t"))
    got = df.select(clock.market_open(F.col("t")).alias("o"), clock.session_label(F.col("t")).alias("s"), clock.in_session(F.col("t"), ["sydney"]).alias("y"),
                    clock.in_session(F.col("t"), ["nowhere"]).alias("n")).collect()
    assert [g.o for g in got] == [True, False, False, False, True, True, True]
    assert [g.s for g in got] == ["New York", "Off-session", "London", "Off-session", "Sydney", "Tokyo", "London"]
    assert [g.y for g in got] == [False, False, False, False, True, True, False]
    assert all(g.n for g in got)


def test_deflated_and_probabilistic_sharpe(spark):
    d = lambda n, s: scores.deflated_sharpe(F.lit(1.0), F.lit(n), F.lit(0.5), F.lit(s))
    row = one(spark, alone=d(1, 0.0), flat=d(9, 0.0), two=d(2, 0.1), ten=d(10, 0.1), many=d(1000, 0.1),
              psr=scores.probabilistic_sharpe(F.lit(0.5), F.lit(20)), single=scores.probabilistic_sharpe(F.lit(0.5), F.lit(1)),
              skewed=scores.probabilistic_sharpe(F.lit(2.0), F.lit(20), F.lit(10.0), F.lit(3.0)))
    assert row.alone == 1.0 and row.flat == 1.0
    assert row.two == pytest.approx(0.5 - 0.05641895835)
    assert row.two > row.ten > row.many
    z = 0.5 * math.sqrt(19) / math.sqrt(1 + 0.5 * 0.25)
    assert row.psr == pytest.approx(0.5 * (1 + math.erf(z / math.sqrt(2))), abs=2e-7)
    assert row.single == 0.0 and row.skewed == 0.0


def test_text_columns(spark):
    fence = "`" * 3
    row = one(
        spark,
        slug=words.slug(F.lit("  Héllo -- World! ")), empty=words.slug(F.lit("!!!")),
        body=words.strip_fence(F.lit(f"{fence}json\n{{\"a\": 1}}\n{fence}")),
        trend=words.classify_strategy(F.lit("Donchian channel breakout")), cross=words.classify_strategy(F.lit("MA cross breakout")),
        other=words.classify_strategy(F.lit("nothing known")),
        line=words.engine_line(F.lit("x\nSHARPE -0.5000\nGUARD PASS drawdown=2.50% win_rate=55.0% bars=100 trades=7")),
        ema=words.strategy_params("ema_crossover", F.create_map(F.lit("Fast"), F.lit("30"), F.lit("slow"), F.lit("20"))),
    )
    assert row.slug == "héllo-world" and row.empty == "strategy" and row.body == '{"a": 1}'
    assert (row.trend, row.cross, row.other) == ("trend_following", "ema_crossover", "mean_reversion")
    assert (row.line.sharpe, row.line.guard_pass, row.line.win_rate, row.line.max_dd, row.line.bars, row.line.trades) == (-0.5, True, 55.0, 2.5, 100, 7)
    assert (row.ema.ema_fast, row.ema.ema_slow) == (9.0, 21.0)


def pin(spark, bar, direction, prior=None):
    df = spark.createDataFrame([tuple(map(float, bar))], "open double, high double, low double, close double")
    return df.select(S.pin_bar(direction, F.lit(prior).cast("double")).alias("p")).first().p


def test_pin_bar_cases(spark):
    bull = (99.5, 100, 0, 99)
    assert pin(spark, bull, "bullish") and not pin(spark, bull, "bullish", 99.5) and pin(spark, bull, "bullish", 98.0)
    for bar in ((50, 100, 0, 50), (0, 100, 0, 100)):
        assert not pin(spark, bar, "bullish") and not pin(spark, bar, "bearish")
    with pytest.raises(ValueError):
        S.pin_bar("sideways", F.lit(None))
