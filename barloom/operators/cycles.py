"""Price-time windows: swing pivots, cycle angles, square-of-nine levels, confirmation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.config import Settings
from barloom.functions.windows import full, rows
from barloom.operators.asof import asof

C = F.col


def extrema(lookback: int) -> dict[str, Column]:
    """Whether a bar is the highest high or lowest low of the 2 * lookback + 1 bars around it."""
    at = lambda agg, c: F.coalesce(full(agg, C(c), -lookback, lookback) == C(c), F.lit(False))
    return {"is_swing_high": at(F.max, "high"), "is_swing_low": at(F.min, "low")}


def pivots(bars: DataFrame, cfg: Settings) -> DataFrame:
    """security_code, anchor_type, anchor_date, anchor_price, today: each security's latest pivots in the anchor window."""
    g = cfg["filters"]["gann_panel"]
    df = bars.withColumns(extrema(g["swing_lookback"])).withColumn("today", F.max("date").over(Window.partitionBy("security_code")))
    df = df.filter(C("date") >= F.date_sub("today", g["anchor_window_days"]))
    last = lambda flag, price: F.max(F.when(C(flag), F.struct(C("date"), C(price).alias("price"))))
    two = df.groupBy("security_code").agg(F.first("today").alias("today"), last("is_swing_high", "high").alias("swing_high"), last("is_swing_low", "low").alias("swing_low"))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("anchor_type"), C(k).alias("at")) for k in ("swing_high", "swing_low")]))
    return two.select("security_code", "today", each.alias("x")).filter("x.at IS NOT NULL").select("security_code", "today", "x.anchor_type", C("x.at.date").alias("anchor_date"), C("x.at.price").alias("anchor_price"))


def level(price: Column, angle: Column, up: bool) -> Column:
    """The square-of-nine level: 180 degrees move the root of the price by one."""
    root = F.sqrt(price) + (1 if up else -1) * angle / 180.0
    return F.when((price > 0) & (root > 0), F.round(root * root, 2))


def windows(bars: DataFrame, cfg: Settings) -> DataFrame:
    """One row per pivot and angle whose date (one degree a day) lies in the shown range, with levels and confirmation."""
    g = cfg["filters"]["gann_panel"]
    angle = F.explode(F.array(*[F.lit(int(a)) for a in g["cycle_angles_degrees"]]))
    w = pivots(bars, cfg).withColumn("angle_degrees", angle).withColumn("window_date", F.date_add("anchor_date", C("angle_degrees")))
    w = w.filter((C("window_date") >= F.date_sub("today", g["recent_past_days"])) & (C("window_date") <= F.date_add("today", g["upcoming_horizon_days"])))
    w = w.withColumns(
        {"days_to_window": F.datediff("window_date", "today"), "level_up": level(C("anchor_price"), C("angle_degrees"), True), "level_down": level(C("anchor_price"), C("angle_degrees"), False)}
    )
    due = C("window_date") <= F.date_add("today", g["window_tolerance_days"])
    ahead = rows(1, g["confirmation_lookforward_days"])
    # the signal bar: the first on or after the window less the tolerance; only bars near the end of a series can be
    reach = g["recent_past_days"] + g["window_tolerance_days"]
    s = bars.withColumns({"__up": F.max("close").over(ahead), "__dn": F.min("close").over(ahead), "__last": F.max("date").over(Window.partitionBy("security_code"))})
    s = s.filter(C("date") >= F.date_sub("__last", reach)).select("security_code", C("date").alias("d"), C("high").alias("h"), C("low").alias("lo"), "__up", "__dn")
    start = w.withColumn("__from", F.date_sub("window_date", g["window_tolerance_days"]))
    out = asof(start, s, ["security_code"], "__from", "d", ["d", "h", "lo", "__up", "__dn"], "forward")
    sure = lambda x: F.coalesce(x, F.lit(False))
    verdict = F.when(~due, "upcoming").when(sure(C("__up") > C("h")), "bullish_confirmed").when(sure(C("__dn") < C("lo")), "bearish_confirmed").otherwise("unconfirmed")
    seen = lambda c, name: F.when(due, C(c)).alias(name)
    return out.select("security_code", "anchor_type", "angle_degrees", "anchor_date", "anchor_price", "window_date", "days_to_window", "level_up", "level_down", seen("d", "signal_date"), seen("h", "signal_high"), seen("lo", "signal_low"), verdict.alias("confirmation"))


def split(windows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(upcoming by days to their window, past ones latest first)."""
    ahead = C("confirmation") == "upcoming"
    return windows.filter(ahead).orderBy("days_to_window", "security_code"), windows.filter(~ahead).orderBy(F.desc("window_date"), "security_code")


def panel(bars: DataFrame, dims: DataFrame, cfg: Settings) -> DataFrame:
    from barloom.operators.scan import named

    return named(windows(bars, cfg), dims, "NSE").drop("sector", "universe", "instrument_token").orderBy("window_date", "security_code", "anchor_type", "angle_degrees")
