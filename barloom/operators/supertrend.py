"""Supertrend: a path-dependent band, folded over each security's bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.windows import recent, smoothed, wilder
from barloom.operators.indicators import tail, true_range

C = F.col


def bands(bars: DataFrame, period: int, multiplier: float) -> DataFrame:
    """security_code, date, close, u, l: the basic bands, NULL until the average range is known."""
    df = bars.select("security_code", "date", "high", "low", "close").withColumn("__tr", true_range())
    df = smoothed(df, {"__atr": wilder(F.col("__tr"), period)})
    mid = (F.col("high") + F.col("low")) / 2
    return df.select("security_code", "date", "close", (mid + multiplier * F.col("__atr")).alias("u"), (mid - multiplier * F.col("__atr")).alias("l"))


def latest(bars: DataFrame, period: int = 10, multiplier: float = 3.0, flip_within: int = 3) -> DataFrame:
    """security_code, supertrend, supertrend_bullish, supertrend_flip_recent at the last bar, in the JVM.

    The fold starts at bar `period` (counted from 0) on the upper band and carries both final bands, the side, the
    last close and the bars since the last change to bullish. Equal bands count as the upper one.
    """
    arr = bands(bars, period, multiplier).groupBy("security_code").agg(F.sort_array(F.collect_list(F.struct("date", "u", "l", "close"))).alias("b"))
    long_enough = F.size("b") > period
    first = F.get("b", F.lit(period))
    none = F.lit(1 << 30)
    seed = F.struct(first["u"].alias("fu"), first["l"].alias("fl"), F.lit(True).alias("upper"), first["close"].alias("pc"), none.alias("since"), first["u"].alias("line"))

    def step(s, x):
        fu = F.when((x["u"] < s["fu"]) | (s["pc"] > s["fu"]), x["u"]).otherwise(s["fu"])
        fl = F.when((x["l"] > s["fl"]) | (s["pc"] < s["fl"]), x["l"]).otherwise(s["fl"])
        was_upper = s["upper"] | (s["fu"] == s["fl"])
        upper = F.when(was_upper, x["close"] <= fu).otherwise(x["close"] < fl)
        since = F.when(~upper & s["upper"], F.lit(0)).otherwise(s["since"] + F.when(s["since"] < none, 1).otherwise(0))
        return F.struct(fu.alias("fu"), fl.alias("fl"), upper.alias("upper"), x["close"].alias("pc"), since.alias("since"), F.when(upper, fu).otherwise(fl).alias("line"))

    rest = F.slice("b", F.lit(period + 2), F.greatest(F.size("b") - F.lit(period + 1), F.lit(0)))
    out = arr.withColumn("s", F.when(long_enough, F.aggregate(rest, seed, step)))
    return out.select("security_code", F.col("s.line").alias("supertrend"), F.coalesce(~F.col("s.upper"), F.lit(False)).alias("supertrend_bullish"), F.coalesce(F.col("s.since") < flip_within, F.lit(False)).alias("supertrend_flip_recent"))


def chart(bars: DataFrame, n: int = 150, period: int = 10, multiplier: float = 3.0) -> DataFrame:
    """What a chart of the last n bars shows: prices, volume, and Supertrend as a bullish and a bearish line."""
    s = series(bars, period, multiplier).select("security_code", "date", "supertrend", "supertrend_bullish")
    last = tail(bars, n).join(s, ["security_code", "date"])
    side = lambda up: F.when(F.col("supertrend_bullish") == F.lit(up), F.col("supertrend"))
    return last.withColumns({"supertrend_up": side(True), "supertrend_down": side(False)}).drop("supertrend", "supertrend_bullish")


#: Bars of a block: what is gathered in one row.
BLOCK = 64


def _through(levels: Column, x: Column) -> Column:
    """What a block makes of the band x that comes in: the value of the first level, from the outermost, that doesn't hold
    it, or x itself."""
    return F.coalesce(F.get(F.filter(levels, lambda v: (x < v["lo"]) | (x > v["hi"])), F.lit(0))["out"], x)


def _levels(bars: Column) -> Column:
    """A block's map of incoming bands: nested intervals lo..hi, each with the value at the block's end of what lies outside.

    One bar keeps x within its own interval and replaces it by its value v elsewhere. Going back from the last bar, its
    interval clips those inside, and outside of it stands what the bars after make of v.
    """
    none = F.array().cast("array<struct<lo:double,hi:double,out:double>>")

    def before(levels: Column, b: Column) -> Column:
        lo, hi = lambda v: F.greatest(v["lo"], b["lo"]), lambda v: F.least(v["hi"], b["hi"])
        outer = F.array(F.struct(b["lo"].alias("lo"), b["hi"].alias("hi"), _through(levels, b["v"]).alias("out")))

        def counts(v: Column, i: Column) -> Column:
            """Levels as wide as the bar's interval hold all that is left, and those within an empty one are never reached."""
            outside = F.get(levels, i - 1)
            return ((v["lo"] > b["lo"]) | (v["hi"] < b["hi"])) & ((i == 0) | (lo(outside) <= hi(outside)))

        clipped = F.transform(F.filter(levels, counts), lambda v: F.struct(lo(v).alias("lo"), hi(v).alias("hi"), v["out"].alias("out")))
        return F.when(b["lo"] > b["hi"], outer).otherwise(F.concat(outer, clipped))

    return F.aggregate(F.reverse(bars), none, before)


def _bands_of(bars: Column, x: Column) -> Column:
    """The band after each bar of a block that x comes into."""
    start = F.struct(x.alias("x"), F.array().cast("array<double>").alias("all"))

    def step(s: Column, b: Column) -> Column:
        now = F.when((s["x"] < b["lo"]) | (s["x"] > b["hi"]) | s["x"].isNull(), b["v"]).otherwise(s["x"])
        return F.struct(now.alias("x"), F.concat(s["all"], F.array(now)).alias("all"))

    return F.aggregate(bars, start, step)["all"]


def _incoming(levels: str) -> Column:
    """The band that comes into a block: from the last block before that is blind to what came into it, through the maps of
    the blocks after that one."""
    before = Window.partitionBy("security_code").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    blind = F.exists(levels, lambda v: v["lo"] > v["hi"]) & F.forall(levels, lambda v: v["out"] == F.get(levels, F.lit(0))["out"])
    known = F.last(F.when(blind, F.struct("__block", F.get(levels, F.lit(0))["out"].alias("x"))), True).over(before)
    open_ = F.collect_list(F.when(~blind, F.struct("__block", C(levels).alias("levels")))).over(before)
    rest = F.filter(open_, lambda m: known.isNull() | (m["__block"] > known["__block"]))
    return F.aggregate(rest, known["x"], lambda x, m: _through(m["levels"], x))


def series(bars: DataFrame, period: int = 10, multiplier: float = 3.0, flip_within: int = 3, block: int = BLOCK) -> DataFrame:
    """security_code, date, supertrend, supertrend_bullish, supertrend_flip_recent of every bar, in the JVM.

    A final band is the one before as long as that lies between the bar's own band and the close before, and the bar's own
    band elsewhere. Blocks of bars are folded into maps of the band that comes in, stitched by what the blocks before make of
    it, and then folded forward; no row holds more than a block of bars, and the open maps of the blocks since one that any
    band leaves alike. The side is a chain of maps of one bit: the last bar that sets it and the number of turns since then.
    """
    by = Window.partitionBy("security_code").orderBy("date")
    b = bands(bars, period, multiplier)
    b = b.withColumns({"__i": F.row_number().over(by) - 1 - period, "__pc": F.lag("close").over(by)})
    inf = float("inf")
    seed = C("__i") == 0
    early = C("__i") < 0  # no band yet: NULL goes in and comes out
    bar = lambda lo, hi, v: F.struct(F.when(seed, inf).when(early, -inf).otherwise(lo).alias("lo"), F.when(seed, -inf).when(early, inf).otherwise(hi).alias("hi"), F.when(~early, v).alias("v"))
    rows = F.struct("date", "close", bar(C("__pc"), C("u"), C("u")).alias("u"), bar(C("l"), C("__pc"), C("l")).alias("l"))
    blocks = b.groupBy("security_code", F.floor(C("__i") / block).alias("__block")).agg(F.sort_array(F.collect_list(rows)).alias("b"))
    side = lambda c: F.transform("b", lambda x: x[c])
    blocks = blocks.withColumns({"__u": _levels(side("u")), "__l": _levels(side("l"))})
    blocks = blocks.withColumns({"__xu": _incoming("__u"), "__xl": _incoming("__l")})
    blocks = blocks.withColumns({"fu": _bands_of(side("u"), C("__xu")), "fl": _bands_of(side("l"), C("__xl"))})
    each = blocks.select("security_code", F.inline(F.arrays_zip(side("date").alias("date"), side("close").alias("close"), "fu", "fl")))
    each = each.toDF("security_code", "date", "close", "fu", "fl")
    above, below = C("close") <= C("fu"), C("close") < C("fl")
    first = F.lag("fu").over(by).isNull()
    sets = first | (F.lag("fu").over(by) == F.lag("fl").over(by)) | (above == below)
    each = each.withColumns({"sets": sets, "value": first | above, "turn": (~sets & ~above).cast("int")})
    each = each.withColumn("turns", F.sum("turn").over(by))
    each = each.withColumn("at", F.last(F.when(C("sets"), F.struct("value", "turns")), True).over(by))
    each = each.withColumn("upper", C("at.value") != ((C("turns") - C("at.turns")) % 2 == 1))
    known = each.select("security_code", "date", F.when(C("upper"), C("fu")).otherwise(C("fl")).alias("supertrend"), (~C("upper")).alias("supertrend_bullish"))
    flip = C("supertrend_bullish") & ~F.lag("supertrend_bullish", 1, False).over(by)
    return known.withColumn("flip", flip).withColumn("supertrend_flip_recent", recent(C("flip"), flip_within)).drop("flip")
