"""Buy-today-sell-tomorrow: a setup from the day's bar and the last completed week, and how it paid."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.config import Settings
from barloom.functions.windows import back, ordered
from barloom.operators.indicators import enrich, with_rsi
from barloom.operators.timeframes import period_end, resample

C = F.col
MIN_BARS = 100


def completed_week_rsi(bars: DataFrame, n: int = 14) -> DataFrame:
    """bars with weekly_rsi of the last week that ended before the bar's date.

    A week labelled by its Friday is known from the next day on, so the value for a date is that of the row before
    its own week's: an equi-join on the week instead of an as-of join.
    """
    weeks = with_rsi(resample(bars, "weekly"), n, "__w").withColumn("weekly_rsi", back(C("__w")))
    return bars.withColumn("__end", period_end("weekly")).join(weeks.select("security_code", C("date").alias("__end"), "weekly_rsi"), ["security_code", "__end"], "left").drop("__end")


def signals(bars: DataFrame, cfg: Settings) -> DataFrame:
    """Bars of securities with MIN_BARS at least: is_setup, and next_close, next_high, next_low returns in percent."""
    b = cfg["filters"]["btst_check"]
    df = bars.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy("security_code"))).filter(C("__n") >= MIN_BARS).drop("__n")
    e = completed_week_rsi(enrich(df, cfg, None))
    setup = (C("close_strength") >= b["min_close_strength"]) & (C("volume_surge") >= b["min_volume_surge"]) & (C("weekly_rsi") >= b["min_weekly_rsi"])
    ahead = lambda c: (F.lead(c).over(ordered()) - C("close")) / C("close") * 100
    return e.withColumns({"is_setup": F.coalesce(setup, F.lit(False)), "next_close": ahead("close"), "next_high": ahead("high"), "next_low": ahead("low")})


def per_security(bars: DataFrame, cfg: Settings) -> DataFrame:
    """Counts and summed next-close returns of setups and of the other bars; a security's last bar has no tomorrow."""
    b = cfg["filters"]["btst_check"]
    s = signals(bars, cfg).filter("next_close IS NOT NULL")
    flag, hit, stop = C("is_setup"), C("next_high") >= b["target_return_pct"], C("next_low") <= -b["stop_loss_pct"]
    return s.groupBy("security_code").agg(
        F.count_if(flag).alias("n_flagged"),
        F.count_if(flag & hit).alias("n_flagged_hit_target"),
        F.count_if(flag & stop).alias("n_flagged_hit_stop"),
        F.coalesce(F.sum(F.when(flag, C("next_close"))), F.lit(0.0)).alias("sum_next_close_return_pct_flagged"),
        F.count_if(flag & (C("next_close") > 0)).alias("n_flagged_positive"),
        F.count_if(~flag).alias("n_baseline"),
        F.count_if(~flag & hit).alias("n_baseline_hit_target"),
        F.coalesce(F.sum(F.when(~flag, C("next_close"))), F.lit(0.0)).alias("sum_next_close_return_pct_baseline"),
    )


def total(bars: DataFrame, cfg: Settings) -> DataFrame:
    """The same over all securities: rates to one decimal, mean returns to two."""
    b = cfg["filters"]["btst_check"]
    p = per_security(bars, cfg)
    t = p.agg(F.count(F.lit(1)).alias("n_stocks_included"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in p.columns if c != "security_code"])
    part = lambda x, n, scale, digits: F.when(C(n) > 0, F.round(C(x) / C(n) * scale, digits))
    return t.select(
        "n_stocks_included",
        "n_flagged",
        part("n_flagged_hit_target", "n_flagged", 100, 1).alias("hit_target_rate_pct"),
        part("n_flagged_hit_stop", "n_flagged", 100, 1).alias("hit_stop_rate_pct"),
        part("sum_next_close_return_pct_flagged", "n_flagged", 1, 2).alias("avg_next_close_return_pct"),
        part("n_flagged_positive", "n_flagged", 100, 1).alias("pct_days_positive"),
        "n_baseline",
        part("n_baseline_hit_target", "n_baseline", 100, 1).alias("baseline_hit_target_rate_pct"),
        part("sum_next_close_return_pct_baseline", "n_baseline", 1, 2).alias("avg_baseline_next_close_return_pct"),
        F.lit(float(b["target_return_pct"])).alias("target_return_pct"),
        F.lit(float(b["stop_loss_pct"])).alias("stop_loss_pct"),
    )
