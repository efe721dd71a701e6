"""False-move verdicts: reversal candles after a breakout or breakdown, against the weekly and daily RSI."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.config import Settings
from barloom.functions.windows import full
from barloom.operators import candles
from barloom.operators.indicators import with_rsi
from barloom.operators.timeframes import resample

C = F.col


def zone(value: Column, bullish_min: float, bearish_max: float) -> Column:
    return F.when(value >= bullish_min, "bullish").when(value < bearish_max, "bearish").when(value.isNotNull(), "neutral")


def direction(weekly: Column, daily: Column, cfg: Settings) -> Column:
    f = cfg["filters"]["false_move_filter"]
    w, d = (zone(x, f["rsi_bullish_min"], f["rsi_bearish_max"]) for x in (weekly, daily))
    return (
        F.when(w.isNull() | d.isNull(), "unknown")
        .when((w == "bullish") & (d == "bullish"), "strong_bullish")
        .when((w == "bullish") & (d == "neutral"), "bullish_pullback")
        .when((w == "bearish") & (d == "bearish"), "strong_bearish")
        .when((w == "bearish") & (d == "neutral"), "bearish_bounce")
        .otherwise("neutral")
    )


def verdicts(enriched: DataFrame, cfg: Settings) -> DataFrame:
    """One row per security from enriched bars (rsi and donchian_breakout are used as they are)."""
    f, period = cfg["filters"]["false_move_filter"], cfg["filters"]["donchian_breakout"]["period"]
    k = f["pattern_lookback_days"]
    found = {n: make() for n, make in {**candles.BEARISH, **candles.BULLISH}.items()}
    low = full(F.min, C("low"), -period, -1)
    df = enriched.withColumns(found | {"__down": F.coalesce(C("close") < low, F.lit(False)), "__n": F.count(F.lit(1)).over(Window.partitionBy("security_code")), "__r": F.row_number().over(Window.partitionBy("security_code").orderBy(F.desc("date")))})
    last = df.filter(C("__r") <= k).groupBy("security_code").agg(
        F.first("__n").alias("n"),
        F.max_by("rsi", "date").alias("daily"),
        F.bool_or("donchian_breakout").alias("recent_breakout"),
        F.bool_or("__down").alias("recent_breakdown"),
        *[F.bool_or(n).alias(n) for n in found],
    )
    weeks = with_rsi(resample(enriched, "weekly"), 14, "__w")
    weeks = weeks.groupBy("security_code").agg(F.max_by("__w", "date").alias("w"), F.count(F.lit(1)).alias("weeks"))
    df = last.join(weeks, "security_code").withColumn("weekly", F.when(C("weeks") >= 15, C("w")))
    listed = lambda names: F.concat_ws(", ", *[F.when(C(n), F.lit(n)) for n in names])
    df = df.withColumns({"direction_zone": direction(C("weekly"), C("daily"), cfg), "bearish_patterns": listed(candles.BEARISH), "bullish_patterns": listed(candles.BULLISH)})
    risk = C("recent_breakout") & (C("bearish_patterns") != "") & C("direction_zone").isin("bearish_bounce", "strong_bearish")
    build = C("recent_breakdown") & (C("bullish_patterns") != "") & C("direction_zone").isin("bullish_pullback", "strong_bullish")
    known = C("n") >= period + k + 1
    only = lambda c: F.when(known, c)
    return df.select(
        "security_code",
        only(F.round("weekly", 1)).alias("weekly_rsi"),
        only(F.round("daily", 1)).alias("daily_rsi"),
        *[only(C(c)).alias(c) for c in ("direction_zone", "recent_breakout", "recent_breakdown", "bearish_patterns", "bullish_patterns")],
        F.when(~known, "insufficient_data").when(risk, "distribution_risk").when(build, "accumulation_signal").otherwise("none").alias("false_move_verdict"),
    )


def annotate(result: DataFrame, enriched: DataFrame, cfg: Settings) -> DataFrame:
    """The verdict columns on passing rows; NULL on the others."""
    passing = result.filter("passes_all_filters").select("security_code")
    checked = passing.join(verdicts(enriched.join(passing, "security_code", "left_semi"), cfg), "security_code", "left")
    return result.join(checked.withColumn("false_move_verdict", F.coalesce("false_move_verdict", F.lit("insufficient_data"))), "security_code", "left")
