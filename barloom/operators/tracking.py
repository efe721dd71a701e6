"""State tables: tracked picks and recommendation history, as joins that return the next version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.config import Settings
from barloom.functions.scalars import printed
from barloom.operators.asof import attach

C = F.col
OPEN = "OPEN"
CLOSED = ("HIT_TARGET", "HIT_STOPLOSS", "EXPIRED", "CLOSED_MANUAL")

#: The columns of tracked picks and of the history, in order, with their types.
PICKS = {
    "pick_id": "string", "date_logged": "date", "security_code": "string", "tradingsymbol": "string", "exchange": "string", "company_name": "string", "universe": "string", "instrument_token": "long",
    "entry_price": "double", "stop_loss": "double", "target": "double", "supertrend_stop": "double", "entry_conviction_score": "double", "entry_conviction_tier": "string", "entry_rsi": "double",
    "entry_supertrend_bullish": "boolean", "entry_price_above_50": "boolean", "status": "string", "exit_date": "date", "exit_price": "double", "realized_pct": "double", "last_checked_date": "date",
    "last_checked_price": "double", "unrealized_pct": "double", "days_held": "long", "signal_notes": "string",
}
HISTORY = {
    "security_code": "string", "tradingsymbol": "string", "company_name": "string", "universe": "string", "first_seen_date": "date", "first_seen_price": "double", "first_seen_conviction_score": "double",
    "first_seen_conviction_tier": "string", "first_seen_supertrend_bullish": "boolean", "first_seen_price_above_50": "boolean", "last_seen_date": "date", "last_seen_price": "double", "times_seen": "long",
}
# Words and sentences that results must carry.
NEW, STILL, EXIT = "New", "Repeat - still long", "Repeat - exit / trail SL"
FLIPPED = "Supertrend has flipped bearish since entry - the trend that triggered this pick has reversed."
FADED = "RSI has faded from %.0f to %.0f - momentum has cooled off materially."
LOST = "Price has closed back below its 50DMA - the trend structure that supported this pick is broken."
INTACT = "No material deterioration flagged - setup still looks structurally intact."
FAILED = "Update failed: "


def _cast(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    return df.select(*[C(c).cast(k).alias(c) for c, k in kinds.items()])


def above_50() -> Column:
    return F.coalesce(C("pct_above_sma50") >= 0, F.lit(False))


def log_picks(picks: DataFrame, rows: DataFrame, as_of: Column) -> DataFrame:
    """picks with new OPEN rows for the scan rows whose security has none open (one row a security, the first by score)."""
    w = Window.partitionBy("security_code").orderBy(F.desc("conviction_score"), "security_code")
    rows = rows.withColumn("security_code", C("security_code").cast("string")).withColumn("__n", F.row_number().over(w)).filter("__n = 1")
    fresh = rows.join(picks.filter(C("status") == OPEN).select("security_code").distinct(), "security_code", "left_anti")
    day = as_of.cast("date")
    none = F.lit(None)
    made = fresh.select(
        F.concat("security_code", F.lit("_"), day.cast("string")).alias("pick_id"), day.alias("date_logged"), "security_code", "tradingsymbol", "exchange", "company_name", "universe", "instrument_token",
        C("close").alias("entry_price"), "stop_loss", "target", "supertrend_stop", C("conviction_score").alias("entry_conviction_score"), C("conviction_tier").alias("entry_conviction_tier"), C("rsi").alias("entry_rsi"),
        C("supertrend_bullish").alias("entry_supertrend_bullish"), above_50().alias("entry_price_above_50"), F.lit(OPEN).alias("status"), none.alias("exit_date"), none.alias("exit_price"), none.alias("realized_pct"),
        day.alias("last_checked_date"), C("close").alias("last_checked_price"), F.lit(0.0).alias("unrealized_pct"), F.lit(0).alias("days_held"), F.lit("").alias("signal_notes"),
    )
    return _cast(picks, PICKS).unionByName(_cast(made, PICKS))


def _code_in(bars: DataFrame) -> Column:
    """The security of picks, a text, as bars have it; what can't be one of theirs, NULL too, becomes a code that no security
    has, so that joins need no filter on it that would reach down to the trades of picks and have them shuffled once more."""
    kind = bars.schema["security_code"].dataType
    code = C("security_code").try_cast(kind)
    return F.coalesce(F.when(code.cast("string") == C("security_code"), code), F.lit(str(-(1 << 63))).try_cast(kind))


def evaluate(picks: DataFrame, bars: DataFrame, horizon: int = 15, block: int = 64) -> DataFrame:
    """pick_id and the new values of open picks that have bars after their day.

    The first bar that touches stop or target closes the pick, the stop first on the same day; this is asked of
    all bars before the horizon, so a touch after it still counts. Else bar number `horizon` closes it as EXPIRED.

    A security's bars, one a date, lie in blocks with their first date, lowest low and highest high in one row; a pick looks
    into the block of its day, its first one, the first later one that touches a level, and the one of the horizon. Bars stay
    where they are dealt, only picks are shuffled.
    """
    open_ = picks.filter(C("status") == OPEN).select("pick_id", _code_in(bars).alias("security_code"), "date_logged", "entry_price", "stop_loss", "target")
    b = bars.select("security_code", C("date").cast("date").alias("date"), "high", "low", "close")
    b = b.withColumn("i", F.row_number().over(Window.partitionBy("security_code").orderBy("date")) - 1)
    blocks = b.groupBy("security_code", F.floor(C("i") / block).cast("int").alias("k")).agg(
        F.min("date").alias("first"), F.min("low").alias("lo"), F.max("high").alias("hi"), F.sort_array(F.collect_list(F.struct("i", "date", "high", "low", "close"))).alias("bars")
    )
    whole = blocks.groupBy("security_code").agg(F.sort_array(F.collect_list(F.struct("k", "first", "lo", "hi", "bars"))).alias("blocks"), F.sum(F.size("bars")).alias("bars_in_all"), F.max(F.element_at("bars", -1)).alias("last"))
    last = lambda x: F.try_element_at(x, F.lit(-1))
    touched = lambda x, low, high: F.coalesce(x[low] <= C("stop_loss"), F.lit(False)) | F.coalesce(x[high] >= C("target"), F.lit(False))
    j = open_.join(whole, "security_code")
    j = j.withColumn("seen", last(F.filter("blocks", lambda x: x["first"] <= C("date_logged")))["bars"])
    j = j.withColumn("start", F.coalesce(last(F.filter("seen", lambda x: x["date"] <= C("date_logged")))["i"] + 1, F.lit(0))).filter(C("bars_in_all") > C("start"))
    first, end = F.floor(C("start") / block).cast("int"), C("start") + horizon - 1
    hit_in = lambda bars: F.get(F.filter(bars, lambda x: (x["i"] >= C("start")) & touched(x, "low", "high")), F.lit(0))
    later = F.get(F.filter("blocks", lambda x: (x["k"] > first) & touched(x, "lo", "hi")), F.lit(0))
    j = j.withColumns({"hit": F.coalesce(hit_in(F.get("blocks", first)["bars"]), hit_in(later["bars"])), "expired": F.get(F.get("blocks", F.floor(end / block).cast("int"))["bars"], end % block)}).drop("blocks", "seen")
    hit, expired = C("hit"), C("expired")
    stopped = F.coalesce(hit["low"] <= C("stop_loss"), F.lit(False))
    outcome = lambda x, status, price: F.struct((x["i"] - C("start") + 1).alias("rn"), status.alias("status"), price.alias("price"), x["date"].alias("date"))
    j = j.withColumns(
        {
            "event": F.when(hit.isNotNull(), outcome(hit, F.when(stopped, "HIT_STOPLOSS").otherwise("HIT_TARGET"), F.when(stopped, C("stop_loss")).otherwise(C("target")))),
            "end": F.when(expired.isNotNull(), outcome(expired, F.lit("EXPIRED"), expired["close"])),
        }
    )
    g = j.groupBy("pick_id").agg(
        F.min("event").alias("event"), F.max("end").alias("end"), F.first("entry_price").alias("entry"), F.first(C("bars_in_all") - C("start")).alias("n"),
        F.first("last.date").alias("last_checked_date"), F.first("last.close").alias("last_checked_price"),
    )
    g = g.withColumn("x", F.coalesce("event", "end"))
    gain = lambda p: F.when(C("entry") != 0, F.round((p - C("entry")) / C("entry") * 100, 2))
    realized = gain(C("x.price"))
    return g.select(
        "pick_id", F.coalesce("x.status", F.lit(OPEN)).alias("status"), C("x.date").alias("exit_date"), F.round("x.price", 2).alias("exit_price"), realized.alias("realized_pct"), "last_checked_date", "last_checked_price",
        F.when(C("x").isNull(), gain(C("last_checked_price"))).otherwise(realized).alias("unrealized_pct"), F.coalesce("x.rn", "n").cast("long").alias("days_held"),
    )


def health_notes() -> Column:
    """What has turned since entry; needs the pick's entry_* and the latest rsi, supertrend_bullish, price_above_50."""
    flipped = C("entry_supertrend_bullish") & ~C("supertrend_bullish")
    faded = (C("entry_rsi") >= 55) & (C("rsi") < 45)
    lost = C("entry_price_above_50") & ~C("price_above_50")
    notes = F.concat_ws(
        " | ",
        F.when(flipped, FLIPPED),
        F.when(faded, printed(FADED, C("entry_rsi"), C("rsi"))),
        F.when(lost, LOST),
    )
    return F.when(notes == "", INTACT).otherwise(notes)


def update(picks: DataFrame, bars: DataFrame, last: DataFrame, horizon: int = 15, failed: DataFrame | None = None) -> DataFrame:
    """The next version of picks: open ones with new bars are re-evaluated, with notes from the latest signals. Open picks of
    securities in failed(security_code, error) only note the error."""
    e = evaluate(picks, bars, horizon)
    now = [c for c in e.columns if c != "pick_id"]
    e = e.select("pick_id", *[C(c).alias(f"__{c}") for c in now])
    s = last.select(C("security_code").cast("string").alias("security_code"), "rsi", "supertrend_bullish", "price_above_50")
    j = attach(picks.join(e, "pick_id", "left"), s, "security_code")
    error = F.lit(None).cast("string")
    if failed is not None:
        j = j.join(failed.groupBy(C("security_code").cast("string").alias("security_code")).agg(F.min("error").alias("__error")), "security_code", "left")
        error = F.when(C("status") == OPEN, C("__error"))
    hit = C("__status").isNotNull() & error.isNull()
    notes = F.when(error.isNotNull(), F.concat(F.lit(FAILED), error)).when(hit, health_notes()).otherwise(C("signal_notes"))
    return _cast(j.withColumns({"signal_notes": notes} | {c: F.when(hit, C(f"__{c}")).otherwise(C(c)) for c in now}), PICKS)


def recheck(picks: DataFrame, bars: DataFrame, cfg: Settings, failed: DataFrame | None = None) -> DataFrame:
    """update() with signals made, without a benchmark, from the bars of securities with open picks alone."""
    from barloom.operators.scan import signals

    mine = picks.filter(C("status") == OPEN).select(_code_in(bars).alias("security_code")).distinct()
    bars = bars.join(mine, "security_code", "left_semi")
    last, _ = signals(bars, cfg, None)
    return update(picks, bars, last, cfg["conviction"]["target_horizon_days"][1], failed)


def by_date(picks: DataFrame) -> DataFrame:
    """The picks logged last first; ties by pick."""
    return picks.orderBy(F.desc("date_logged"), "pick_id")


def win_rate(picks: DataFrame) -> DataFrame:
    """Counts by outcome and the share of targets among targets and stops."""
    n = lambda *s: F.count_if(C("status").isin(*s))
    t, s = n("HIT_TARGET"), n("HIT_STOPLOSS")
    return picks.agg(n(OPEN).alias("n_open"), n(*CLOSED).alias("n_closed"), t.alias("n_target"), s.alias("n_stop"), F.when(t + s > 0, F.round(t / (t + s) * 100, 1)).alias("win_rate_pct"))


def annotate(result: DataFrame, history: DataFrame) -> DataFrame:
    """first_recommended_date, entry_price and recommendation_status against the history before this scan."""
    h = history.select(C("security_code").alias("__code"), "first_seen_date", "first_seen_price")
    j = result.join(h, C("security_code").cast("string") == C("__code"), "left")
    seen = C("__code").isNotNull()
    still = C("passes_all_filters") & F.coalesce("supertrend_bullish", F.lit(True)) & above_50()
    return j.withColumns(
        {
            "first_recommended_date": F.when(seen, C("first_seen_date")).otherwise(C("as_of").cast("date")),
            "entry_price": F.when(seen, C("first_seen_price")).otherwise(C("close")),
            "recommendation_status": F.when(~seen, NEW).when(still, STILL).otherwise(EXIT),
        }
    ).drop("__code", "first_seen_date", "first_seen_price")


def upsert(history: DataFrame, result: DataFrame) -> DataFrame:
    """The next version of the history: passing rows are added or seen once more; what was first seen never changes."""
    c = result.filter("passes_all_filters").withColumn("security_code", C("security_code").cast("string")).withColumn("__above", above_50())
    day = C("c.as_of").cast("date")
    first = {
        "tradingsymbol": C("c.tradingsymbol"), "company_name": C("c.company_name"), "universe": C("c.universe"), "first_seen_date": day, "first_seen_price": C("c.close"), "first_seen_conviction_score": C("c.conviction_score"),
        "first_seen_conviction_tier": C("c.conviction_tier"), "first_seen_supertrend_bullish": C("c.supertrend_bullish"), "first_seen_price_above_50": C("c.__above"),
    }
    old, new = C("h.security_code").isNotNull(), C("c.security_code").isNotNull()
    j = history.alias("h").join(c.alias("c"), C("h.security_code") == C("c.security_code"), "full_outer")
    out = j.select(
        F.coalesce("h.security_code", "c.security_code").alias("security_code"),
        *[F.when(old, C(f"h.{n}")).otherwise(x).alias(n) for n, x in first.items()],
        F.when(new, day).otherwise(C("h.last_seen_date")).alias("last_seen_date"),
        F.when(new, C("c.close")).otherwise(C("h.last_seen_price")).alias("last_seen_price"),
        F.when(old & new, F.coalesce("h.times_seen", F.lit(1)) + 1).when(old, C("h.times_seen")).otherwise(1).alias("times_seen"),
    )
    return _cast(out, HISTORY)
