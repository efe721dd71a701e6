"""Weekly and monthly bars, the breakout radar, and historical hit rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.config import Settings
from barloom.functions.windows import back, full, sma
from barloom.operators.indicators import enrich, snapshot

C = F.col
TIMEFRAMES = ("daily", "weekly", "monthly")
MIN_BARS = 30
KEY = ("security_code", "timeframe")


def period_end(timeframe: str) -> Column:
    """The label of a date's period: the Friday on or after it, or its month's last day."""
    return {"daily": C("date"), "weekly": F.next_day(F.date_sub("date", 1), "FRI"), "monthly": F.last_day("date")}[timeframe]


def resample(bars: DataFrame, timeframe: str) -> DataFrame:
    """First open, highest high, lowest low, last close and summed volume of each period with bars."""
    return (
        bars.withColumn("__end", period_end(timeframe))
        .groupBy("security_code", "__end")
        .agg(F.min_by("open", "date").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "date").alias("close"), F.sum("volume").alias("volume"))
        .withColumnRenamed("__end", "date")
    )


def stacked(bars: DataFrame, timeframes: tuple[str, ...] = TIMEFRAMES) -> DataFrame:
    """All timeframes in one long table, so the indicator pipeline runs once."""
    out = None
    for t in timeframes:
        part = (bars if t == "daily" else resample(bars, t)).select("security_code", F.lit(t).alias("timeframe"), "date", "open", "high", "low", "close", "volume")
        out = part if out is None else out.unionByName(part)
    return out


def bollinger_width(x: Column, n: int, k: float, *key: str) -> Column:
    return 2 * k * full(F.stddev_samp, x, -(n - 1), 0, None, *key) / sma(x, n, *key)


def precursors(enriched: DataFrame, cfg: Settings, *key: str) -> DataFrame:
    """bb_width, bb_width_chg20, pct_below_pivot, pct_from_pivot, is_watch."""
    r = cfg["filters"]["breakout_radar"]
    df = enriched.withColumn("bb_width", bollinger_width(C("close"), r["bollinger_period"], 2.0, *key))
    df = df.withColumns({"bb_width_chg20": C("bb_width") - back(C("bb_width"), 20, *key), "pct_below_pivot": (C("donchian_high") - C("close")) / C("donchian_high") * 100})
    watch = (C("close") <= C("donchian_high")) & (C("pct_below_pivot") <= r["max_pct_below_pivot"]) & (C("atr_pct_chg20") < 0) & (C("bb_width_chg20") < 0)
    return df.withColumns({"pct_from_pivot": -C("pct_below_pivot"), "is_watch": F.coalesce(watch, F.lit(False))})


def prepared(bars: DataFrame, cfg: Settings, timeframes: tuple[str, ...] = TIMEFRAMES) -> DataFrame:
    """Enriched bars with precursors and bars_available, by timeframe, of series with MIN_BARS bars at least."""
    df = stacked(bars, timeframes).withColumn("bars_available", F.count(F.lit(1)).over(Window.partitionBy(*KEY)))
    long = df.filter(C("bars_available") >= MIN_BARS)
    return precursors(enrich(long, cfg, None, KEY), cfg, *KEY)


METRICS = {"pct_below_pivot": 1, "pct_from_pivot": 1, "atr_pct_chg20": 2, "bb_width_chg20": 4, "volume_surge": 2, "rsi": 1, "adx": 1, "close_strength": 2}


def evaluate(bars: DataFrame, cfg: Settings, timeframes: tuple[str, ...] = TIMEFRAMES) -> DataFrame:
    """One row per security and timeframe: availability, flags and rounded metrics of the last bar."""
    surge = cfg["filters"]["volume"]["surge_multiplier"]
    every = precursors(enrich(stacked(bars, timeframes), cfg, None, KEY), cfg, *KEY)
    last = snapshot(every.withColumn("bars_available", F.count(F.lit(1)).over(Window.partitionBy(*KEY))), KEY)
    fresh = F.coalesce(C("donchian_breakout") & (C("volume_surge") >= surge), F.lit(False))
    flags = {"is_fresh_breakout": fresh, "is_watch": C("is_watch")} | {c: F.round(c, d) for c, d in METRICS.items()}
    few = C("bars_available") < MIN_BARS
    return last.select(*KEY, "bars_available", *[F.when(~few, x).alias(n) for n, x in flags.items()], few.alias("insufficient_data"))


def radar(bars: DataFrame, dims: DataFrame, cfg: Settings, timeframes: tuple[str, ...] = TIMEFRAMES) -> DataFrame:
    """One wide row per security: <timeframe>_<metric>, and the timeframes on watch and broken out."""
    from barloom.operators.scan import named

    long = evaluate(bars, cfg, timeframes)
    fields = ["insufficient_data", "bars_available", "is_fresh_breakout", "is_watch", *METRICS]
    wide = long.groupBy("security_code").agg(*[F.first(F.when(C("timeframe") == t, C(f)), ignorenulls=True).alias(f"{t}_{f}") for t in timeframes for f in fields])
    listed = lambda f: F.concat_ws(", ", *[F.when(C(f"{t}_{f}"), F.lit(t)) for t in timeframes])
    n = sum((F.when(C(f"{t}_is_watch"), 1).otherwise(0) for t in timeframes), F.lit(0))
    wide = wide.withColumns({"watch_timeframes": listed("is_watch"), "breakout_timeframes": listed("is_fresh_breakout"), "n_watch_timeframes": n})
    return named(wide, dims, "NSE").drop("sector", "universe", "instrument_token")


def radar_tiers(r: DataFrame) -> DataFrame:
    """fresh where something broke out, else watch where something is on watch."""
    return r.withColumn("radar_tier", F.when(C("breakout_timeframes") != "", "fresh").when(C("watch_timeframes") != "", "watch"))


def radar_ranked(r: DataFrame) -> DataFrame:
    """Most timeframes on watch first; ties by security."""
    return r.orderBy(F.desc("n_watch_timeframes"), "security_code")


def forward_high(n: int, *key: str) -> Column:
    """The highest high of the next n bars, where all n exist."""
    return full(F.max, C("high"), 1, n, None, *key)


def hit_rates(bars: DataFrame, cfg: Settings, timeframe: str, forward: int = 15, target: float = 10.0) -> DataFrame:
    """Per security: bars on watch and others whose next `forward` bars reach `target` percent, against those that could."""
    p = prepared(bars, cfg, (timeframe,)).withColumn("__r", (forward_high(forward, *KEY) - C("close")) / C("close") * 100)
    ok, hit, flag = C("__r").isNotNull(), C("__r") >= target, C("is_watch")
    return p.groupBy("security_code").agg(
        F.count_if(flag & ok).alias("n_flagged"), F.count_if(flag & ok & hit).alias("n_flagged_hit"), F.count_if(~flag & ok).alias("n_baseline"), F.count_if(~flag & ok & hit).alias("n_baseline_hit")
    )


def _rate(a: str, b: str, digits: int = 1) -> Column:
    return F.when(C(b) > 0, F.round(C(a) / C(b) * 100, digits))


def with_rates(counts: DataFrame) -> DataFrame:
    return counts.withColumns({"flagged_hit_rate_pct": _rate("n_flagged_hit", "n_flagged"), "baseline_hit_rate_pct": _rate("n_baseline_hit", "n_baseline")})


def hit_rate_total(bars: DataFrame, cfg: Settings, timeframe: str, forward: int = 15, target: float = 10.0) -> DataFrame:
    """The same over all securities."""
    names = ("n_flagged", "n_flagged_hit", "n_baseline", "n_baseline_hit")
    total = hit_rates(bars, cfg, timeframe, forward, target).agg(F.count(F.lit(1)).alias("n_stocks_included"), *[F.coalesce(F.sum(n), F.lit(0)).cast("long").alias(n) for n in names])
    return with_rates(total)
