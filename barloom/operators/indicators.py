"""The indicator pipeline: every column is a window expression over one sort by (security, date), most of them as SQL text,
which the JVM takes in one call."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.config import Settings
from barloom.functions import windows
from barloom.functions.windows import DEALT, TIME, before, block_size, dealt, ema, over, recent, smoothed, wilder
from barloom.operators.asof import attach
from barloom.sources.tables import BASE

C = F.col


def true_range(*key: str, order: str = TIME) -> Column:
    last = before("close", 1, *key, order=order)
    return F.expr(f"greatest(high - low, abs(high - {last}), abs(low - {last}))")


def rsi_from(gain: Column, loss: Column) -> Column:
    """100 where anything is missing, as in the warm-up and for flat series."""
    return F.coalesce(100 - 100 / (1 + gain / F.nullif(loss, F.lit(0.0))), F.lit(100.0))


def _moves(*key: str, order: str = TIME) -> dict[str, Column]:
    """Gain and loss against the bar before, true range, and the moves up and down of highs and lows."""
    d, up, down = (f"({x})" for x in (f"close - {before('close', 1, *key, order=order)}", f"high - {before('high', 1, *key, order=order)}", f"{before('low', 1, *key, order=order)} - low"))
    side = lambda sign: F.expr(f"CASE WHEN {d} IS NOT NULL THEN greatest({sign}{d}, 0.0D) END")
    more = lambda a, b: F.expr(f"CASE WHEN {a} > {b} AND {a} > 0 THEN {a} ELSE 0.0D END")
    return {"__gain": side(""), "__loss": side("-"), "__tr": true_range(*key, order=order), "__up": more(up, down), "__dn": more(down, up)}


def with_rsi(df: DataFrame, n: int, name: str = "rsi", *key: str) -> DataFrame:
    moves = _moves(*key)
    df = df.withColumns({k: moves[k] for k in ("__gain", "__loss")})
    df = smoothed(df, {"__g": wilder(C("__gain"), n), "__l": wilder(C("__loss"), n)}, *key)
    return df.withColumn(name, rsi_from(C("__g"), C("__l"))).drop("__gain", "__loss", "__g", "__l")


def with_averages(df: DataFrame, cfg: Settings, *key: str, blocks: int | None = None) -> DataFrame:
    """rsi, atr, plus_di, minus_di, adx, macd, macd_signal, macd_hist: two rounds of averages for all of them."""
    moves = _moves(*key, order=DEALT if blocks else TIME)
    n, m = cfg["filters"]["rsi"]["period"], cfg["filters"]["adx"]["period"]
    first = {"__g": wilder(C("__gain"), n), "__l": wilder(C("__loss"), n), "atr": wilder(C("__tr"), m), "__p": wilder(C("__up"), m), "__m": wilder(C("__dn"), m)}
    df = smoothed(df.withColumns(moves), first | {"__fast": ema(C("close"), 12), "__slow": ema(C("close"), 26)}, *key, blocks=blocks)
    atr = F.nullif(C("atr"), F.lit(0.0))
    df = df.withColumns({"rsi": rsi_from(C("__g"), C("__l")), "plus_di": 100 * C("__p") / atr, "minus_di": 100 * C("__m") / atr, "macd": C("__fast") - C("__slow")})
    dx = 100 * F.abs(C("plus_di") - C("minus_di")) / F.nullif(C("plus_di") + C("minus_di"), F.lit(0.0))
    df = smoothed(df, {"adx": wilder(dx, m), "macd_signal": ema(C("macd"), 9)}, *key, blocks=blocks)
    return df.withColumn("macd_hist", C("macd") - C("macd_signal")).drop("__gain", "__loss", "__tr", "__up", "__dn", "__g", "__l", "__p", "__m", "__fast", "__slow")


def with_benchmark(df: DataFrame, bench: DataFrame | None, *key: str, order: str = TIME) -> DataFrame:
    """Relative strength against bench(date, bench_close), carried forward over missing dates. The benchmark, a row a date,
    goes to the bars, which stay as they are dealt and sorted."""
    null = F.lit(None).cast("double")
    if bench is None:
        return df.withColumns({"rs_line": null, "rs_new_high": F.lit(False), "rs_roc20": null, "relative_return_20d": null})
    df = attach(df, F.broadcast(bench.select("date", "bench_close")), "date")
    df = df.withColumn("bench_close", F.expr(f"last(bench_close, true) {over(None, 0, *key, order=order)}"))
    df = df.withColumn("rs_line", C("close") / C("bench_close"))
    quarter = over(-62, 0, *key, order=order)
    df = df.withColumn("rs_line_high63", F.expr(f"CASE WHEN count(rs_line) {quarter} >= 20 THEN max(rs_line) {quarter} END"))
    gain = lambda x: f"({x} / {before(x, 20, *key, order=order)} - 1) * 100"
    return df.withColumns(
        {
            "rs_new_high": F.coalesce(C("rs_line") >= C("rs_line_high63"), F.lit(False)),
            "rs_roc20": F.expr(gain("rs_line")),
            "relative_return_20d": F.expr(f"{gain('close')} - {gain('bench_close')}"),
        }
    )


def enrich(bars: DataFrame, cfg: Settings, bench: DataFrame | None = None, key: tuple[str, ...] = ("security_code",)) -> DataFrame:
    """Bars with every indicator but Supertrend (see supertrend.py), from their base columns alone."""
    return _enriched(bars, cfg, bench, key).drop("__row", "__block")


def latest(bars: DataFrame, cfg: Settings, bench: DataFrame | None = None, key: tuple[str, ...] = ("security_code",)) -> tuple[DataFrame, DataFrame]:
    """(the snapshot of the enriched bars, all of them): the last rows are found in the order the bars are in anyway."""
    df = _enriched(bars, cfg, bench, key)
    return snapshot(df, key, DEALT).drop("__row", "__block"), df.drop("__row", "__block")


def _enriched(bars: DataFrame, cfg: Settings, bench: DataFrame | None, key: tuple[str, ...]) -> DataFrame:
    """enrich() with the blocks. Bars are sorted when they are narrow, by block and date, and never again: windows over
    wide rows in another order would sort all of them, more than memory holds, again and again."""
    f = cfg["filters"]
    keep = [c for c in BASE if c not in key]
    size = block_size(1 / f["rsi"]["period"], 1 / f["adx"]["period"], 2 / 10)  # 2 / 10: the signal line, faster than both lines of MACD
    df = dealt(bars.select(*key, *keep), size, *key)
    df = with_averages(df, cfg, *key, blocks=size)
    over = partial(windows.over, order=DEALT)
    last = lambda x, n=1: before(x, n, *key, order=DEALT)
    gain = lambda x, n: f"({x} / {last(x, n)} - 1) * 100"
    mean = lambda x, n, to=0: f"avg({x}) {over(to - n + 1, to, *key)}"
    whole = lambda agg, x, n, to=0: f"CASE WHEN count({x}) {over(to - n + 1, to, *key)} >= {n} THEN {agg}({x}) {over(to - n + 1, to, *key)} END"
    crossed = lambda level, n: f"coalesce(max(coalesce(close > {level} AND {last('close')} <= {last(level)}, false)) {over(1 - n, 0, *key)}, false)"
    df = df.selectExpr(
        "*",
        f"{whole('avg', 'close', 50)} AS sma50",
        f"{whole('avg', 'close', 200)} AS sma200",
        "atr / close * 100 AS atr_pct",
        f"{whole('max', 'high', f['donchian_breakout']['period'], -1)} AS donchian_high",
        f"coalesce(signum(close - {last('close')}), 0.0D) * volume AS __flow",
        f"volume / nullif({whole('avg', 'volume', f['volume']['lookback'], -1)}, 0.0D) AS volume_surge",
        f"{mean('(close - low) / nullif(high - low, 0.0D)', 3)} AS close_strength",
        f"{mean('close * volume', f['liquidity']['turnover_lookback'])} / 1e7D AS turnover_cr",
        *[f"{gain('close', n)} AS roc{n}" for n in (3, 5, 10)],
    )
    df = df.selectExpr(
        "*",
        f"sum(__flow) {over(None, 0, *key)} AS obv",
        "coalesce(close > donchian_high, false) AS donchian_breakout",
        *[f"{crossed(f'sma{n}', f[f'dma{n}_breakout']['lookback_days'])} AS dma{n}_breakout_recent" for n in (50, 200)],
        *[f"(close / sma{n} - 1) * 100 AS pct_above_sma{n}" for n in (50, 200)],
        f"atr_pct - {last('atr_pct', 20)} AS atr_pct_chg20",
    ).drop("__flow")
    df = df.selectExpr("*", f"obv - {last('obv', 20)} AS obv_slope20")
    return with_benchmark(df, bench, *key, order=DEALT)


def snapshot(enriched: DataFrame, key: tuple[str, ...] = ("security_code",), order: str = TIME) -> DataFrame:
    """The latest row of each security, as_of, and regime flags."""
    more = f"lead(true) OVER (PARTITION BY {', '.join(f'`{k}`' for k in key)} ORDER BY {order})"
    last = enriched.withColumn("__more", F.expr(more)).filter("__more IS NULL").drop("__more")
    no = F.lit(False)
    return last.withColumns(
        {
            "as_of": C("date"),
            "golden_cross": F.coalesce(C("sma50") > C("sma200"), no),
            "price_above_50": F.coalesce(C("close") > C("sma50"), no),
            "price_above_200": F.coalesce(C("close") > C("sma200"), no),
        }
    )


def tail(df: DataFrame, n: int, *key: str) -> DataFrame:
    """The last n bars of each security."""
    w = Window.partitionBy(*(key or ("security_code",))).orderBy(F.desc("date"))
    return df.withColumn("__n", F.row_number().over(w)).filter(C("__n") <= n).drop("__n")


__all__ = ["enrich", "latest", "recent", "rsi_from", "snapshot", "tail", "true_range", "with_averages", "with_benchmark", "with_rsi"]
