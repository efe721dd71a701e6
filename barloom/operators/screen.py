"""Rules over one row per security: filter reasons, risk levels, sub-scores, tiers, notes and explanation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.config import Settings
from barloom.functions.scalars import clip, half_away, linear, printed

C = F.col


def _true(c: str) -> Column:
    return F.coalesce(C(c), F.lit(False))


def reasons(cfg: Settings) -> Column:
    """array<string>: why a row fails the screen, in fixed order; empty if it passes. Missing turnover passes, a missing surge fails."""
    f = cfg["filters"]
    out: list[Column] = []

    def rule(block: str, cond: Column, code: str) -> None:
        if f[block]["enabled"]:
            out.append(F.when(cond, F.lit(code)))

    rule("liquidity", C("close") < f["liquidity"]["min_price"], "price_below_min")
    rule("liquidity", C("turnover_cr") < f["liquidity"]["min_avg_turnover_cr"], "turnover_below_min")
    rule("volume", F.coalesce(C("volume_surge") < f["volume"]["surge_multiplier"], F.lit(True)), "no_volume_surge")
    rule("dma50_breakout", ~_true("dma50_breakout_recent"), "no_50dma_breakout")
    rule("dma50_breakout", _true("dma50_breakout_recent") & (C("pct_above_sma50") < f["dma50_breakout"]["min_pct_above"]), "50dma_breakout_too_shallow")
    rule("dma200_breakout", ~_true("dma200_breakout_recent"), "no_200dma_breakout")
    rule("rsi", C("rsi").isNull(), "rsi_unavailable")
    rule("rsi", ~C("rsi").between(f["rsi"]["min_rsi"], f["rsi"]["max_rsi"]), "rsi_out_of_range")
    rule("donchian_breakout", ~_true("donchian_breakout"), "no_donchian_breakout")
    t = f["trend_filter"]
    if t["enabled"]:
        for key, col, code in (("require_50_above_200", "golden_cross", "no_golden_cross"), ("require_price_above_50", "price_above_50", "price_below_50dma"), ("require_price_above_200", "price_above_200", "price_below_200dma")):
            if t[key]:
                out.append(F.when(~_true(col), F.lit(code)))
    rule("adx", F.coalesce(C("adx") < f["adx"]["min_adx"], F.lit(True)), "adx_below_min")
    rule("supertrend", ~_true("supertrend_flip_recent"), "no_recent_supertrend_flip")
    return F.array_compact(F.array(*out)) if out else F.array().cast("array<string>")


def risk(cfg: Settings) -> dict[str, Column]:
    """stop_loss, target, risk_pct, reward_pct, supertrend_stop."""
    r = cfg["risk"]
    ok = F.coalesce((C("close") != 0) & (C("atr") != 0), F.lit(False))
    stop, target = C("close") - r["atr_stop_multiplier"] * C("atr"), C("close") + r["atr_target_multiplier"] * C("atr")
    return {
        "stop_loss": half_away(F.when(ok, stop), 2),
        "target": half_away(F.when(ok, target), 2),
        "risk_pct": half_away(F.when(ok, (C("close") - stop) / C("close") * 100), 2),
        "reward_pct": half_away(F.when(ok, (target - C("close")) / C("close") * 100), 2),
        "supertrend_stop": half_away(F.when(_true("supertrend_bullish"), C("supertrend")), 2),
    }


def _points(*pairs: tuple[str, int]) -> Column:
    return sum((F.when(_true(c), float(p)).otherwise(0.0) for c, p in pairs), F.lit(0.0))


def trend() -> Column:
    return clip(_points(("price_above_50", 30), ("price_above_200", 25), ("golden_cross", 25), ("supertrend_bullish", 20)))


def momentum() -> Column:
    r = C("rsi")
    score = F.when(r.isNull() | (r < 50), 0.0).when(r < 60, linear(r, 50, 60, 0, 70)).when(r <= 75, 100.0).when(r <= 85, linear(r, 75, 85, 100, 60)).otherwise(40.0)
    return clip(0.5 * score + 0.25 * F.when(C("macd_hist") > 0, 100.0).otherwise(0.0) + 0.25 * clip(C("roc10") * 5))


def volume() -> Column:
    """A missing surge counts as a full one."""
    s = C("volume_surge")
    surge = F.when(s < 1, linear(s, 0, 1, 0, 50)).when(s < 1.5, linear(s, 1, 1.5, 50, 75)).when(s < 2.5, linear(s, 1.5, 2.5, 75, 100)).otherwise(100.0)
    return clip(0.7 * surge + 0.3 * F.when(C("obv_slope20") > 0, 100.0).otherwise(30.0))


def breakout_quality() -> Column:
    flags = _points(("donchian_breakout", 40), ("dma50_breakout_recent", 20), ("supertrend_flip_recent", 20))
    return clip(flags + F.when(C("atr_pct_chg20") < 0, 10.0).otherwise(0.0) + clip(C("close_strength") * 10, 0, 10))


def relative_strength() -> Column:
    return clip(_points(("rs_new_high", 50)) + linear(C("relative_return_20d"), 0, 20, 0, 50))


def pivot_distance() -> Column:
    """Percent above the breakout level, or above the 50-bar mean where there is no breakout."""
    broke = _true("donchian_breakout") & F.coalesce(C("donchian_high") != 0, F.lit(False))
    return F.when(broke, (C("close") / C("donchian_high") - 1) * 100).otherwise(F.coalesce(C("pct_above_sma50"), F.lit(0.0)))


SCORES = {"trend": trend, "momentum": momentum, "volume": volume, "breakout_quality": breakout_quality, "relative_strength": relative_strength}


def sector_strength(rows: DataFrame) -> DataFrame:
    """sector, sector_score, sector_median: sectors ranked by the upper median of their relative returns (ties by name);
    a sector without data has no row, and where no sector has data every score is 50 (see `scored`)."""
    upper = F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY relative_return_20d DESC)")  # of an even number the higher one
    med = rows.filter("relative_return_20d IS NOT NULL").groupBy("sector").agg(upper.alias("sector_median"))
    w = Window.orderBy("sector_median", "sector")
    n = F.count(F.lit(1)).over(Window.partitionBy())
    return med.select("sector", ((F.row_number().over(w) - 1) * 100.0 / F.greatest(n - 1, F.lit(1))).alias("sector_score"), "sector_median")


def scored(rows: DataFrame, sectors: DataFrame, cfg: Settings) -> DataFrame:
    """rows with raw sub-scores (s_*), penalties, total, conviction_tier, notes and explanation; sectors are few and broadcast by the optimizer."""
    c = cfg["conviction"]
    df = rows.join(sectors.select("sector", "sector_score"), "sector", "left")
    df = df.withColumns({f"s_{n}": make() for n, make in SCORES.items()} | {"s_sector_strength": clip(F.coalesce("sector_score", F.lit(50.0))), "pivot_distance": pivot_distance()})
    weights = c["weights"]
    total = sum((C(f"s_{n}") * float(w) for n, w in weights.items()), F.lit(0.0)) / float(sum(weights.values()))
    e, o = c["extended_penalty"], c["rsi_overbought_penalty"]
    far = (C("pivot_distance") > e["pct_above_pivot_threshold"]) & F.lit(e["enabled"])
    hot = F.coalesce(C("rsi") > o["threshold"], F.lit(False)) & F.lit(o["enabled"])
    df = df.withColumn("penalties", F.when(far, float(e["penalty_points"])).otherwise(0.0) + F.when(hot, float(o["penalty_points"])).otherwise(0.0))
    df = df.withColumn("total", clip(total - C("penalties")))
    t = c["tiers"]
    tier = F.when(C("total") >= t["very_high_conviction"], "Very High Conviction").when(C("total") >= t["high_conviction"], "High Conviction").when(C("total") >= t["moderate_conviction"], "Moderate Conviction").otherwise("Watchlist")
    notes = [
        F.when(far, printed("Extended %.1f%% above pivot - chasing risk, consider waiting for a pullback.", C("pivot_distance"))),
        F.when(hot, printed("RSI %.0f deeply overbought - elevated mean-reversion risk.", C("rsi"))),
        F.when(_true("golden_cross") & _true("donchian_breakout"), F.lit("Golden-cross regime + fresh Donchian breakout - textbook momentum setup.")),
        F.when(~_true("rs_new_high"), F.lit("Not yet at a new relative-strength high vs benchmark - lagging the tape.")),
    ]
    return df.withColumns({"conviction_tier": tier, "notes": F.concat_ws(" | ", *notes), "explanation": explanation(o["threshold"])}).drop("sector_score")


def explanation(overbought: float) -> Column:
    """The same signals in words."""
    surge, rel = F.coalesce("volume_surge", F.lit(0.0)), C("relative_return_20d")
    on = F.when(surge >= 1.3, printed(" on %.1fx average volume", surge)).otherwise("")
    st, broke, dma = _true("supertrend_bullish"), _true("donchian_breakout"), _true("dma50_breakout_recent")
    above50, above200 = _true("price_above_50"), _true("price_above_200")
    rsi_says = lambda text: printed(f"RSI of %.0f {text}", C("rsi"))
    return F.concat_ws(
        " ",
        F.when(broke, F.concat(F.lit("Broke out to a fresh multi-week high"), on, F.lit(".")))
        .when(dma, F.concat(F.lit("Recently reclaimed its 50-day moving average"), on, F.lit(".")))
        .when(surge >= 1.3, F.concat(F.lit("Trading"), on, F.lit(", though without a fresh breakout trigger."))),
        F.when(_true("supertrend_flip_recent"), "Supertrend just flipped bullish - a fresh trend-following buy signal.")
        .when(st, "Supertrend remains in a bullish regime (green), though not a fresh flip.")
        .otherwise("Supertrend is bearish (red) - the trend-following signal isn't confirming yet."),
        F.when(_true("golden_cross") & above200, "Trading above both its 50- and 200-day averages in an established uptrend.")
        .when(above50 & ~above200, "Above its short-term trend but still below its longer-term 200-day average.")
        .when(~above50, "Currently below its 50-day average - short-term momentum has cooled."),
        F.when(C("rsi") > overbought, rsi_says("is deeply overbought, raising pullback risk."))
        .when(C("rsi") >= 60, rsi_says("shows strong, healthy momentum."))
        .when(C("rsi") >= 50, rsi_says("shows momentum building but not yet strong."))
        .when(C("rsi").isNotNull(), rsi_says("shows little momentum right now.")),
        F.when(rel > 5, printed("Outperforming the broader market by %.1f%% over the past month.", rel)).when(rel < -5, printed("Lagging the broader market by %.1f%% over the past month.", F.abs(rel))),
    )
