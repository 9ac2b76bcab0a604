"""Text columns: slugs, metric lines, strategy classification, parameter names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns per strategy family, tried in this order.
FAMILY_PATTERNS = (
    ("pairs_trading", (
        r"\bspread\b", r"\bcointegrat", r"\bhedge\s+ratio", r"\bpair[s]?\s+trad",
        r"\brelative\s+value", r"\bz[-\s]?score", r"\bstat[\.\s]?arb",
    )),
    ("ema_crossover", (
        r"\bcross(?:over|ing)?\b", r"\bma\s+cross", r"\bmoving\s+average\s+cross",
        r"\bema\s+\d+\s*[/x]\s*\d+", r"\bsma\s+\d+\s*[/x]\s*\d+",
    )),
    ("trend_following", (
        r"\bbreakout\b", r"\bswing\s+(?:high|low|point)", r"\bhigher\s+high",
        r"\blower\s+low", r"\bmarket\s+structure", r"\btrend[\s-]+follow",
        r"\bbreak\s+of\s+structure\b", r"\bdonchian\b", r"\bchannel\s+breakout\b",
    )),
)
DEFAULT_FAMILY = "mean_reversion"

# Parameter aliases, the first present alias wins.
PARAM_ALIASES = {
    "ema_fast": ("fast", "short_ma", "fast_period", "fast_ema", "fast_ma"),
    "ema_slow": ("slow", "long_ma", "slow_period", "slow_ema", "slow_ma"),
    "atr_period": ("atr_period", "atr_window"),
    "atr_sl_multiplier": ("sl_mult", "stop_atr", "sl_atr", "atr_sl"),
    "atr_tp_multiplier": ("tp_mult", "tp_atr", "atr_tp"),
    "bb_period": ("bb_period", "bollinger_period", "band_period"),
    "bb_std": ("bb_std", "bollinger_std", "band_std", "std_dev"),
    "rsi_period": ("rsi_period", "rsi_window"),
    "rsi_oversold": ("rsi_oversold", "oversold", "rsi_lower"),
    "rsi_overbought": ("rsi_overbought", "overbought", "rsi_upper"),
    "entry_zscore": ("zscore", "z_score", "entry_zscore", "entry_z"),
    "spread_window": ("spread_window", "lookback"),
    "tp_r_multiple": ("r_multiple", "rr", "risk_reward"),
}
# Default parameters per strategy family.
FAMILY_DEFAULTS = {
    "ema_crossover": {"ema_fast": 9.0, "ema_slow": 21.0, "atr_period": 14.0,
                      "atr_sl_multiplier": 1.5, "atr_tp_multiplier": 3.0},
    "mean_reversion": {"bb_period": 20.0, "bb_std": 2.0, "rsi_period": 14.0, "rsi_oversold": 30.0,
                       "rsi_overbought": 70.0, "atr_sl_multiplier": 1.5, "atr_tp_multiplier": 2.0},
    "trend_following": {"htf_resample_rule": "4h", "swing_left": 2.0, "swing_right": 2.0, "tp_r_multiple": 1.5, "atr_period": 14.0,
                        "atr_sl_multiplier": 1.5, "sl_atr_buffer": 1.0, "reversal_lookback": 10.0, "mode": "standard"},
    "pairs_trading": {"symbol1": "EURUSD", "symbol2": "GBPUSD", "entry_zscore": 2.0, "spread_window": 60.0, "hedge_window": 60.0,
                      "atr_sl_multiplier": 1.5},
}


def slug(name: Column, default: str = "strategy", width: int = 60) -> Column:
    """Lower case, runs of other characters to one dash, trimmed, cut to ``width``."""
    dashed = F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]+", "-")
    cut = F.substring(F.trim(dashed, F.lit("-")), 1, width)
    return F.coalesce(F.nullif(cut, F.lit("")), F.lit(default))


def classify_strategy(text: Column) -> Column:
    """Strategy family of a description: the first family with a matching pattern."""
    low, out = F.lower(text), None
    for family, patterns in FAMILY_PATTERNS:
        hit = low.rlike("|".join(patterns))
        out = F.when(hit, F.lit(family)) if out is None else out.when(hit, F.lit(family))
    return out.otherwise(F.lit(DEFAULT_FAMILY))


# What an engine report says, by field.
REPORT_PATTERNS = {
    "sharpe": r"(?m)^SHARPE\s+(-?[0-9.]+)",
    "guard": r"(?m)^GUARD\s+(PASS|FAIL)",
    "win_rate": r"win_rate=([0-9.]+)%",
    "drawdown": r"drawdown=([0-9.]+)%",
    "bars": r"bars=([0-9]+)",
    "trades": r"trades=([0-9]+)",
}


def engine_line(text: Column) -> Column:
    """Struct of the numbers in an engine report."""
    def found(name: str) -> Column:
        return F.regexp_extract(text, REPORT_PATTERNS[name], 1)

    def number(name: str, kind: str) -> Column:
        return F.nullif(found(name), F.lit("")).try_cast(kind)

    return F.struct(
        number("sharpe", "double").alias("sharpe"),
        (found("guard") == "PASS").alias("guard_pass"),
        F.coalesce(number("win_rate", "double"), F.lit(0.0)).alias("win_rate"),
        F.coalesce(number("drawdown", "double"), F.lit(0.0)).alias("max_dd"),
        F.coalesce(number("bars", "long"), F.lit(0)).cast("long").alias("bars"),
        F.coalesce(number("trades", "long"), F.lit(0)).cast("long").alias("trades"),
    )


def normal_keys(params: Column) -> Column:
    """Map keys to lower case with underscores; the last of two equal keys wins."""
    def clean(key: Column) -> Column:
        return F.translate(F.lower(key), " -", "__")

    entries = F.transform(F.map_entries(params), lambda e: F.struct(clean(e["key"]).alias("k"), e["value"].alias("v")))
    kept = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda o: o["k"] == e["k"]))
    return F.map_from_entries(kept)


def numeric_text(value: Column) -> Column:
    """A number written as text, a trailing percent sign allowed; else null."""
    return F.rtrim(F.trim(value), F.lit("%")).try_cast("double")


def strategy_params(family: str, params: Column, normal: bool = False) -> Column:
    """Struct of the family's parameters: aliases applied over defaults, then reset rules.

    A parameter without aliases keeps its default.  A value that is no number also
    leaves the default; ``rejected`` names such parameters.  Keys already in their
    normal form (``normal``) are looked up as they are.
    """
    known = params if normal else normal_keys(params)
    cols, refused = {}, []
    for name, default in FAMILY_DEFAULTS[family].items():
        if name not in PARAM_ALIASES:
            cols[name] = F.lit(default)
            continue
        found = F.coalesce(*[known[a] for a in PARAM_ALIASES[name]])
        cols[name] = F.coalesce(numeric_text(found), F.lit(default))
        refused.append(F.when(found.isNotNull() & numeric_text(found).isNull(), F.lit(name)))
    if family == "ema_crossover":
        crossed = cols["ema_fast"] >= cols["ema_slow"]
        fast, slow = FAMILY_DEFAULTS[family]["ema_fast"], FAMILY_DEFAULTS[family]["ema_slow"]
        cols["ema_fast"], cols["ema_slow"] = (
            F.when(crossed, F.lit(fast)).otherwise(cols["ema_fast"]),
            F.when(crossed, F.lit(slow)).otherwise(cols["ema_slow"]),
        )
    if family == "mean_reversion":
        low, high = cols["rsi_oversold"], cols["rsi_overbought"]
        cols["rsi_oversold"] = F.when((low > 0) & (low < 50), low).otherwise(F.lit(30.0))
        cols["rsi_overbought"] = F.when((high > 50) & (high < 100), high).otherwise(F.lit(70.0))
    rejected = F.array_compact(F.array(*refused))
    return F.struct(*[c.alias(n) for n, c in cols.items()], rejected.alias("rejected"))


def strip_fence(text: Column) -> Column:
    """Drop a leading and a trailing code-fence line."""
    body = F.trim(text)
    fence = "`" * 3
    opened = F.regexp_replace(body, rf"\A{fence}[^\n]*\n?", "")
    closed = F.regexp_replace(opened, rf"(\A|\n){fence}[^\n]*\z", "")
    return F.when(body.startswith(fence), closed).otherwise(body)
