"""Every query by operator, with the DuckDB SQL it is checked against.

Series are compared at 3 decimals (prices) or 4, computed by both engines from the same tables.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.config import settings
from barloom.functions import scalars, windows
from barloom.operators import asof, candles, cycles, false_moves, indicators, mapping, next_day, quality, scan, screen, supertrend, timeframes, tracking
from barloom.plans import sql as Q
from barloom.session import scratch
from barloom.sources import fetched, state, tables
from barloom.streaming import tracked

C = F.col
Query = Callable[[SparkSession, str], DataFrame]
CFG = settings()
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        _QUERIES[name] = f
        if oracle:
            _SQL[name] = oracle
        return f

    return keep


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.bars_from_trades(spark, sf_dir)


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars(spark, sf_dir)
    return indicators.enrich(b, CFG, tables.benchmark(b))


def scanned(spark: SparkSession, sf_dir: str) -> scan.Scan:
    b = bars(spark, sf_dir)
    return scan.run(b, tables.universe(spark, sf_dir), CFG, tables.benchmark(b))


def rounded(df: DataFrame, columns: list[str], digits: int | None = 4) -> list[Column]:
    """The columns, doubles rounded; values that both engines take over unchanged need no rounding (None)."""
    kinds = dict(df.dtypes)
    return [scalars.half_away(C(c), digits).alias(c) if kinds[c] == "double" and digits is not None else C(c) for c in columns]


def rounded_sql(columns: list[str], digits: int | None = 4, plain: tuple[str, ...] = ()) -> str:
    return ", ".join(c if c in plain or digits is None else f"round({c}, {digits}) + 0.0 AS {c}" for c in columns)


FLAGS = ("donchian_breakout", "dma50_breakout_recent", "dma200_breakout_recent", "rs_new_high", "supertrend_bullish", "supertrend_flip_recent", "golden_cross", "price_above_50", "price_above_200", "is_watch")

#: name -> (columns of the enriched bars, digits)
SERIES: dict[str, tuple[list[str], int | None]] = {
    "w01_sma": (["sma50", "sma200"], 3),
    "w05_rsi": (["rsi"], 4),
    "w07_atr": (["atr"], 3),
    "w08_adx": (["plus_di", "minus_di", "adx"], 4),
    "w09_macd": (["macd", "macd_signal", "macd_hist"], 3),
    "w10_donchian_high": (["donchian_high"], None),
    "w11_donchian_breakout": (["donchian_breakout"], 4),
    "w14_obv": (["obv"], 3),
    "w15_obv_slope": (["obv_slope20"], 3),
    "w16_crossed_above": (["dma50_breakout_recent", "dma200_breakout_recent"], 4),
    "w17_volume_surge": (["volume_surge"], 4),
    "w18_close_strength": (["close_strength"], 6),
    "w19_turnover": (["turnover_cr"], 4),
    "w20_rates_of_change": (["roc3", "roc5", "roc10", "pct_above_sma50", "pct_above_sma200"], 4),
    "w21_atr_pct": (["atr_pct", "atr_pct_chg20"], 4),
    "j05_benchmark_join": (["bench_close"], 6),
    "w22_relative_strength": (["rs_line", "rs_line_high63", "rs_new_high", "rs_roc20", "relative_return_20d"], 4),
}
SERIES["w23_pipeline"] = (["sma50", "rsi", "adx", "macd_hist", "donchian_breakout", "volume_surge", "close_strength", "turnover_cr", "roc10", "atr_pct_chg20", "rs_new_high", "relative_return_20d"], 3)


def _series(columns: list[str], digits: int | None) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = enriched(spark, sf_dir)
        return e.select("security_code", "date", *rounded(e, columns, digits))

    return run


for _name, (_columns, _digits) in SERIES.items():
    query(_name, f"WITH {Q.ALL} SELECT security_code, date, {rounded_sql(_columns, _digits, FLAGS)} FROM enr")(_series(_columns, _digits))


@query("s05_bars", f"WITH {Q.TRADES} SELECT security_code, date, {rounded_sql(tables.BASE[2:], None)} FROM bars")
def _(spark, sf_dir):
    return bars(spark, sf_dir)


@query(
    "s06_hourly_bars",
    """SELECT event_type AS security_code, date_trunc('hour', ts) AS date, arg_min(value, {'a': ts, 'b': event_id}) AS open, max(value) AS high, min(value) AS low, arg_max(value, {'a': ts, 'b': event_id}) AS close,
    CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY ALL""",
)
def _(spark, sf_dir):
    return tables.bars_from_events(spark, sf_dir)


_W = "(PARTITION BY security_code ORDER BY date)"


@query("w02_ema", f"WITH {Q.ALL} SELECT security_code, date, {rounded_sql(['ema12', 'ema26'], 3)} FROM enr")
def _(spark, sf_dir):
    b = windows.smoothed(bars(spark, sf_dir), {"ema12": windows.ema(C("close"), 12), "ema26": windows.ema(C("close"), 26)})
    return b.select("security_code", "date", *rounded(b, ["ema12", "ema26"], 3))


@query("w03_gain_loss", f"WITH {Q.ALL} SELECT security_code, date, CASE WHEN dif IS NOT NULL THEN greatest(dif, 0) + 0.0 END AS gain, CASE WHEN dif IS NOT NULL THEN greatest(-dif, 0) + 0.0 END AS loss FROM enr")
def _(spark, sf_dir):
    d = C("close") - windows.back(C("close"))
    b = bars(spark, sf_dir).withColumn("d", d)
    part = lambda x: F.when(C("d").isNotNull(), F.greatest(x, F.lit(0.0)) + 0.0)
    return b.select("security_code", "date", part(C("d")).alias("gain"), part(-C("d")).alias("loss"))


@query("w04_wilder", f"WITH {Q.ALL} SELECT security_code, date, {rounded_sql(['ag', 'al'], 3)} FROM enr")
def _(spark, sf_dir):
    b = bars(spark, sf_dir).withColumn("d", C("close") - windows.back(C("close")))
    side = lambda x: F.when(C("d").isNotNull(), F.greatest(x, F.lit(0.0)))
    b = windows.smoothed(b, {"ag": windows.wilder(side(C("d")), 14), "al": windows.wilder(side(-C("d")), 14)})
    return b.select("security_code", "date", *rounded(b, ["ag", "al"], 3))


@query("w06_true_range", f"WITH {Q.ALL} SELECT security_code, date, tr AS true_range FROM enr")
def _(spark, sf_dir):
    return bars(spark, sf_dir).select("security_code", "date", indicators.true_range().alias("true_range"))


_ST = f"WITH RECURSIVE {Q.ALL}, {Q.SUPERTREND}"


@query("w12_supertrend", f"{_ST} SELECT security_code, date, round(supertrend, 3) + 0.0 AS supertrend, supertrend_bullish, supertrend_flip_recent FROM st")
def _(spark, sf_dir):
    s = supertrend.series(bars(spark, sf_dir))
    return s.select("security_code", "date", *rounded(s, ["supertrend", "supertrend_bullish", "supertrend_flip_recent"], 3))


@query("w13_supertrend_latest", f"{_ST} SELECT security_code, round(supertrend, 3) + 0.0 AS supertrend, supertrend_bullish, supertrend_flip_recent FROM st QUALIFY row_number() OVER (PARTITION BY security_code ORDER BY date DESC) = 1")
def _(spark, sf_dir):
    s = supertrend.latest(bars(spark, sf_dir))
    return s.select("security_code", *rounded(s, ["supertrend", "supertrend_bullish", "supertrend_flip_recent"], 3))


_SCAN = f"WITH RECURSIVE {Q.SCAN}"
SNAP = ["close", "sma50", "rsi", "adx", "macd_hist", "donchian_high", "volume_surge", "turnover_cr", "supertrend", "supertrend_bullish", "supertrend_flip_recent", "golden_cross", "price_above_50", "price_above_200"]


@query("w24_snapshot", f"{_SCAN} SELECT security_code, as_of, {rounded_sql(SNAP, 3, FLAGS)} FROM snap")
def _(spark, sf_dir):
    b = bars(spark, sf_dir)
    last, _ = scan.signals(scan.enough(b, CFG["data"]["min_bars"])[0], CFG, tables.benchmark(b))
    return last.select("security_code", "as_of", *rounded(last, SNAP, 3))


def _scan_query(name: str, columns: dict[str, str]) -> None:
    """A query over the scan result; columns: name -> SQL over sc."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return scanned(spark, sf_dir).result.select("security_code", *columns)

    query(name, f"{_SCAN} SELECT security_code, {', '.join(f'{x} AS {c}' for c, x in columns.items())} FROM sc")(run)


_r1 = lambda c: f"round({c}, 1) + 0.0"
_scan_query("r01_filter_reasons", {"passes_all_filters": "fail_reasons = ''", "fail_reasons": "fail_reasons"})
_scan_query(
    "r02_risk_levels",
    {
        "stop_loss": "round(close - 1.5 * atr, 2) + 0.0", "target": "round(close + 3 * atr, 2) + 0.0", "risk_pct": "round(1.5 * atr / close * 100, 2) + 0.0", "reward_pct": "round(3 * atr / close * 100, 2) + 0.0",
        "supertrend_stop": "round(CASE WHEN supertrend_bullish THEN supertrend END, 2) + 0.0",
    },
)
for _id, _part in (("r03", "trend"), ("r04", "momentum"), ("r05", "volume"), ("r06", "breakout_quality"), ("r07", "relative_strength")):
    _scan_query(f"{_id}_score_{_part}", {f"score_{_part}": _r1(f"s_{_part}")})
_scan_query("r09_conviction", {"conviction_score": _r1("total"), "penalties": "penalties"})
_scan_query("r10_tier", {"conviction_tier": "conviction_tier"})
_scan_query("r11_notes", {"notes": "notes"})
_scan_query("r12_explanation", {"explanation": "explanation"})
_scan_query("j07_dimension_lookup", {c: c for c in ("company_name", "sector", "universe", "tradingsymbol", "exchange", "instrument_token")})

_FULL = ", ".join(
    {
        **{c: c for c in scan.COLUMNS if c not in ("security_code",)},
        **{c: f"round({c}, 4) + 0.0 AS {c}" for c in ("rsi", "adx", "pct_above_sma50", "pct_above_sma200", "volume_surge", "turnover_cr", "relative_return_20d", "roc5", "roc10")},
        **{f"score_{n}": f"round(s_{n}, 1) + 0.0 AS score_{n}" for n in (*screen.SCORES, "sector_strength")},
        "passes_all_filters": "fail_reasons = '' AS passes_all_filters", "conviction_score": "round(total, 1) + 0.0 AS conviction_score",
        "stop_loss": "round(close - 1.5 * atr, 2) + 0.0 AS stop_loss", "target": "round(close + 3 * atr, 2) + 0.0 AS target", "risk_pct": "round(1.5 * atr / close * 100, 2) + 0.0 AS risk_pct",
        "reward_pct": "round(3 * atr / close * 100, 2) + 0.0 AS reward_pct", "supertrend_stop": "round(CASE WHEN supertrend_bullish THEN supertrend END, 2) + 0.0 AS supertrend_stop",
    }.values()
)


def _scan_rounded(r: DataFrame) -> DataFrame:
    deep = ("rsi", "adx", "pct_above_sma50", "pct_above_sma200", "volume_surge", "turnover_cr", "relative_return_20d", "roc5", "roc10")
    return r.withColumns({c: scalars.half_away(C(c), 4) for c in deep})


@query("t01_scan", f"{_SCAN} SELECT security_code, {_FULL} FROM sc")
def _(spark, sf_dir):
    return _scan_rounded(scan.ranked(scanned(spark, sf_dir).result))


@query("t02_top_n", f"{_SCAN} SELECT security_code, tradingsymbol, round(total, 1) + 0.0 AS conviction_score, CAST(row_number() OVER (ORDER BY round(total, 1) DESC, security_code) AS INT) AS rank FROM sc QUALIFY rank <= 7")
def _(spark, sf_dir):
    return scan.top(scanned(spark, sf_dir).result, 7).select("security_code", "tradingsymbol", "conviction_score", "rank")


@query(
    "t03_trade_cards",
    f"""{_SCAN} SELECT CAST(row_number() OVER (ORDER BY round(total, 1) DESC, security_code) AS INT) AS rank, security_code, tradingsymbol, exchange, close AS entry, round(close - 1.5 * atr, 2) AS stop_loss, round(close + 3 * atr, 2) AS target,
    round(1.5 * atr / close * 100, 2) AS risk_pct, round(3 * atr / close * 100, 2) AS reward_pct, round(round(3 * atr / close * 100, 2) / round(1.5 * atr / close * 100, 2), 1) AS risk_reward, explanation AS rationale FROM sc QUALIFY rank <= 3""",
)
def _(spark, sf_dir):
    return scan.cards(scanned(spark, sf_dir).result)


@query("t05_conviction_calls", f"{_SCAN} SELECT security_code, conviction_tier, round(total, 1) + 0.0 AS conviction_score FROM sc WHERE total >= 45")
def _(spark, sf_dir):
    return scan.conviction_calls(scanned(spark, sf_dir).result).select("security_code", "conviction_tier", "conviction_score")


@query("t06_tail", f"WITH {Q.TRADES} SELECT security_code, date, close FROM bars QUALIFY row_number() OVER (PARTITION BY security_code ORDER BY date DESC) <= 150")
def _(spark, sf_dir):
    return indicators.tail(bars(spark, sf_dir), 150).select("security_code", "date", "close")


@query("a12_tier_counts", f"{_SCAN} SELECT conviction_tier, count(*) AS n FROM sc GROUP BY conviction_tier")
def _(spark, sf_dir):
    return scan.tier_counts(scanned(spark, sf_dir).result)


@query("a02_sector_strength", f"{_SCAN} SELECT sector, round(sector_score, 4) + 0.0 AS sector_score, round(sector_median, 4) + 0.0 AS sector_median FROM sec")
def _(spark, sf_dir):
    b = bars(spark, sf_dir)
    last, _ = indicators.latest(scan.enough(b, CFG["data"]["min_bars"])[0], CFG, tables.benchmark(b))
    s = screen.sector_strength(scan.named(last, tables.universe(spark, sf_dir)))
    return s.select("sector", *rounded(s, ["sector_score", "sector_median"]))


@query("p02_loose_screen", f"{_SCAN} SELECT security_code, close >= 30 AND turnover_cr >= 0 AND coalesce(volume_surge >= 1.0, false) AS passes FROM snap")
def _(spark, sf_dir):
    """Blocks switched off by an overlay drop out of the plan."""
    off = {"enabled": False}
    cfg = settings("breakout125", {"filters": {"liquidity": {"min_price": 30, "min_avg_turnover_cr": 0}, "volume": {"lookback": 20}, "rsi": off, "donchian_breakout": {"enabled": False, "period": 20}, "supertrend": {"period": 10, "multiplier": 3.0}}})
    b = bars(spark, sf_dir)
    last, _ = scan.signals(scan.enough(b, 60)[0], cfg, None)
    return last.select("security_code", (F.size(screen.reasons(cfg)) == 0).alias("passes"))


@query("p05_min_history", f"WITH {Q.TRADES} SELECT security_code, 'insufficient_history' AS reason FROM bars GROUP BY security_code HAVING count(*) < 540")
def _(spark, sf_dir):
    return scan.enough(bars(spark, sf_dir), 540)[1]


@query("p07_view", f"{_SCAN} SELECT security_code, round(total, 1) + 0.0 AS conviction_score FROM sc WHERE round(total, 1) >= 10 AND security_code % 3 = 0 AND security_code % 4 <> 1")
def _(spark, sf_dir):
    themed = scan.with_theme(scanned(spark, sf_dir).result, tables.universe(spark, sf_dir).filter("security_code % 3 = 0").select("security_code", F.lit("Healthcare").alias("theme")))
    verdict = F.when(C("security_code") % 4 == 0, "confirmed").when(C("security_code") % 4 == 1, "distribution_risk")
    return scan.view(themed.withColumn("false_move_verdict", verdict), min_score=10, no_distribution=True, themes=["Healthcare"]).select("security_code", "conviction_score")


@query("j08_theme", f"{_SCAN} SELECT security_code, CASE WHEN security_code % 3 = 0 THEN 'Healthcare' ELSE 'Unclassified' END AS theme FROM sc")
def _(spark, sf_dir):
    r = scanned(spark, sf_dir).result
    themes = tables.universe(spark, sf_dir).filter("security_code % 3 = 0").select("security_code", F.lit("Healthcare").alias("theme"))
    return scan.with_theme(r.select("security_code"), themes)


@query("a15_diagnostics", f"WITH {Q.TRADES}, {Q.DIMS}, n AS (SELECT security_code, count(*) AS n FROM bars GROUP BY 1) SELECT (SELECT count(*) FROM dims) AS n_universe, (SELECT count(instrument_token) FROM dims) AS n_resolved, count_if(n >= 540) AS n_ok, count_if(n < 540) AS n_skipped, count_if(n < 535) AS n_failed, (SELECT string_agg(security_code || ': ' || n || ' bars', '; ' ORDER BY security_code::VARCHAR || ': ' || n || ' bars') FROM (SELECT * FROM n WHERE n < 535 ORDER BY security_code LIMIT 5)) AS errors FROM n")
def _(spark, sf_dir):
    ok, few = scan.enough(bars(spark, sf_dir), 540)
    short = bars(spark, sf_dir).groupBy("security_code").count().filter("count < 535")
    return scan.diagnostics(tables.universe(spark, sf_dir), ok, few, short.select("security_code", F.concat("count", F.lit(" bars")).alias("error")))


for _t, _table in (("weekly", "w"), ("monthly", "m")):

    def _resample(spark, sf_dir, t=_t):
        return timeframes.resample(bars(spark, sf_dir), t)

    query(f"a01_{_t}", f"WITH {Q.TRADES}, {Q.PERIODS} SELECT security_code, date, {rounded_sql(tables.BASE[2:], None)} FROM {_table}")(_resample)

_RADAR = f"WITH {Q.RADAR}"
PRE = ["bb_width", "bb_width_chg20", "pct_below_pivot", "pct_from_pivot", "is_watch"]


@query("w26_precursors", f"{_RADAR} SELECT security_code, timeframe, date, {rounded_sql(PRE, 4, FLAGS)} FROM pre")
def _(spark, sf_dir):
    p = timeframes.prepared(bars(spark, sf_dir), CFG)
    return p.select("security_code", "timeframe", "date", *rounded(p, PRE))


@query("w27_forward_high", f"WITH {Q.TRADES} SELECT security_code, date, {Q.full('max', 'high', 1, 15, 'security_code')} AS forward_high FROM bars")
def _(spark, sf_dir):
    return bars(spark, sf_dir).select("security_code", "date", timeframes.forward_high(15).alias("forward_high"))


_METRICS_SQL = ", ".join(f"round(p.{c}, {d}) + 0.0 AS {c}" for c, d in timeframes.METRICS.items())
_EVALUATED = f"""have AS (SELECT security_code, timeframe, count(*) AS bars_available FROM stk0 GROUP BY ALL), ev AS (SELECT h.security_code, h.timeframe, h.bars_available, coalesce(p.donchian_breakout AND p.volume_surge >= 1.5, CASE WHEN p.date IS NOT NULL THEN false END) AS is_fresh_breakout,
  p.is_watch, {_METRICS_SQL}, h.bars_available < 30 AS insufficient_data FROM have h LEFT JOIN (SELECT * FROM pre QUALIFY row_number() OVER (PARTITION BY security_code, timeframe ORDER BY date DESC) = 1) p USING (security_code, timeframe))"""


@query("r20_radar_long", f"{_RADAR}, {_EVALUATED} SELECT * FROM ev")
def _(spark, sf_dir):
    return timeframes.evaluate(bars(spark, sf_dir), CFG)


@query(
    "r20_radar",
    f"""{_RADAR}, {_EVALUATED} SELECT security_code, company_name, tradingsymbol, exchange, CAST(max(CASE WHEN timeframe = 'weekly' THEN bars_available END) AS BIGINT) AS weekly_bars_available, max(CASE WHEN timeframe = 'daily' THEN rsi END) AS daily_rsi,
    coalesce(string_agg(timeframe, ', ' ORDER BY CASE timeframe WHEN 'daily' THEN 1 WHEN 'weekly' THEN 2 ELSE 3 END) FILTER (is_watch), '') AS watch_timeframes,
    coalesce(string_agg(timeframe, ', ' ORDER BY CASE timeframe WHEN 'daily' THEN 1 WHEN 'weekly' THEN 2 ELSE 3 END) FILTER (is_fresh_breakout), '') AS breakout_timeframes, CAST(count_if(is_watch) AS INT) AS n_watch_timeframes
    FROM ev JOIN dims USING (security_code) GROUP BY ALL""",
)
def _(spark, sf_dir):
    r = timeframes.radar(bars(spark, sf_dir), tables.universe(spark, sf_dir), CFG)
    return r.select("security_code", "company_name", "tradingsymbol", "exchange", "weekly_bars_available", "daily_rsi", "watch_timeframes", "breakout_timeframes", "n_watch_timeframes")


_HITS = "count_if(is_watch AND fwd IS NOT NULL) AS n_flagged, count_if(is_watch AND fwd >= 10) AS n_flagged_hit, count_if(NOT is_watch AND fwd IS NOT NULL) AS n_baseline, count_if(NOT is_watch AND fwd >= 10) AS n_baseline_hit"


@query("a03_hit_rates", f"{_RADAR} SELECT security_code, {_HITS} FROM pre WHERE timeframe = 'daily' GROUP BY security_code")
def _(spark, sf_dir):
    return timeframes.hit_rates(bars(spark, sf_dir), CFG, "daily")


@query(
    "a04_hit_rate_total",
    f"{_RADAR}, t AS (SELECT count(DISTINCT security_code) AS n_stocks_included, {_HITS} FROM pre WHERE timeframe = 'weekly') SELECT *, round(n_flagged_hit * 100.0 / nullif(n_flagged, 0), 1) AS flagged_hit_rate_pct, round(n_baseline_hit * 100.0 / nullif(n_baseline, 0), 1) AS baseline_hit_rate_pct FROM t",
)
def _(spark, sf_dir):
    return timeframes.hit_rate_total(bars(spark, sf_dir), CFG, "weekly")


_ND = f"WITH {Q.NEXT_DAY}"


@query("j06_completed_week", f"{_ND} SELECT security_code, date, round(weekly_rsi, 4) + 0.0 AS weekly_rsi FROM asof0")
def _(spark, sf_dir):
    return next_day.completed_week_rsi(bars(spark, sf_dir)).select("security_code", "date", F.round("weekly_rsi", 4).alias("weekly_rsi"))


@query("w28_next_bar", f"{_ND} SELECT security_code, date, round(nc, 4) + 0.0 AS next_close, round(nh, 4) + 0.0 AS next_high, round(nl, 4) + 0.0 AS next_low FROM nd")
def _(spark, sf_dir):
    s = next_day.signals(bars(spark, sf_dir), CFG)
    return s.select("security_code", "date", *rounded(s, ["next_close", "next_high", "next_low"]))


@query("r21_setup", f"{_ND} SELECT security_code, date, is_setup FROM nd WHERE is_setup")
def _(spark, sf_dir):
    return next_day.signals(bars(spark, sf_dir), CFG).filter("is_setup").select("security_code", "date", "is_setup")


_ND_AGG = """count_if(is_setup) AS n_flagged, count_if(is_setup AND nh >= 4.5) AS n_flagged_hit_target, count_if(is_setup AND nl <= -2) AS n_flagged_hit_stop, round(coalesce(sum(CASE WHEN is_setup THEN nc END), 0), 3) + 0.0 AS sum_next_close_return_pct_flagged,
 count_if(is_setup AND nc > 0) AS n_flagged_positive, count_if(NOT is_setup) AS n_baseline, count_if(NOT is_setup AND nh >= 4.5) AS n_baseline_hit_target, round(coalesce(sum(CASE WHEN NOT is_setup THEN nc END), 0), 3) + 0.0 AS sum_next_close_return_pct_baseline"""


@query("a05_next_day", f"{_ND} SELECT security_code, {_ND_AGG} FROM nd WHERE nc IS NOT NULL GROUP BY security_code")
def _(spark, sf_dir):
    p = next_day.per_security(bars(spark, sf_dir), CFG)
    return p.select(*rounded(p, p.columns, 3))


@query(
    "a06_next_day_total",
    f"""{_ND}, t AS (SELECT count(DISTINCT security_code) AS k, count_if(is_setup) AS f, count_if(NOT is_setup) AS b, count_if(is_setup AND nh >= 4.5) AS fh, count_if(is_setup AND nl <= -2) AS fs, sum(CASE WHEN is_setup THEN nc END) AS fr,
    count_if(is_setup AND nc > 0) AS fp, count_if(NOT is_setup AND nh >= 4.5) AS bh, sum(CASE WHEN NOT is_setup THEN nc END) AS br FROM nd WHERE nc IS NOT NULL)
    SELECT k AS n_stocks_included, f AS n_flagged, round(fh * 100.0 / nullif(f, 0), 1) AS hit_target_rate_pct, round(fs * 100.0 / nullif(f, 0), 1) AS hit_stop_rate_pct, round(fr / nullif(f, 0), 2) AS avg_next_close_return_pct,
    round(fp * 100.0 / nullif(f, 0), 1) AS pct_days_positive, b AS n_baseline, round(bh * 100.0 / nullif(b, 0), 1) AS baseline_hit_target_rate_pct, round(br / nullif(b, 0), 2) AS avg_baseline_next_close_return_pct,
    CAST(4.5 AS DOUBLE) AS target_return_pct, CAST(2.0 AS DOUBLE) AS stop_loss_pct FROM t""",
)
def _(spark, sf_dir):
    return next_day.total(bars(spark, sf_dir), CFG)


for _id, _pattern in (("c01", "bearish_engulfing"), ("c02", "bullish_engulfing"), ("c03", "shooting_star"), ("c04", "hammer"), ("c05", "evening_star"), ("c06", "morning_star")):

    def _candle(spark, sf_dir, p=_pattern):
        return bars(spark, sf_dir).withColumn("hit", {**candles.BEARISH, **candles.BULLISH}[p]()).filter("hit").select("security_code", "date", C("hit").alias(p))

    query(f"{_id}_{_pattern}", f"WITH {Q.TRADES}, {Q.CANDLES} SELECT security_code, date, {_pattern} FROM candles WHERE {_pattern}")(_candle)


@query("w29_donchian_low", f"WITH {Q.TRADES} SELECT security_code, date, {Q.full('min', 'low', -20, -1, 'security_code')} AS donchian_low FROM bars")
def _(spark, sf_dir):
    return bars(spark, sf_dir).select("security_code", "date", windows.full(F.min, C("low"), -20, -1).alias("donchian_low"))


@query(
    "r19_false_moves",
    f"""WITH {Q.FALSE_MOVES} SELECT security_code, round(weekly, 1) + 0.0 AS weekly_rsi, round(daily, 1) + 0.0 AS daily_rsi, direction_zone, recent_breakout, recent_breakdown, bearish_patterns, bullish_patterns,
    CASE WHEN recent_breakout AND bearish_patterns <> '' AND direction_zone IN ('bearish_bounce', 'strong_bearish') THEN 'distribution_risk'
    WHEN recent_breakdown AND bullish_patterns <> '' AND direction_zone IN ('bullish_pullback', 'strong_bullish') THEN 'accumulation_signal' ELSE 'none' END AS false_move_verdict FROM fm WHERE n >= 24""",
)
def _(spark, sf_dir):
    return false_moves.verdicts(indicators.enrich(bars(spark, sf_dir), CFG, None), CFG)


_CY = f"WITH {Q.CYCLES}"


@query("w30_swing_extrema", f"{_CY} SELECT security_code, date, is_swing_high, is_swing_low FROM sw0 WHERE is_swing_high OR is_swing_low")
def _(spark, sf_dir):
    return bars(spark, sf_dir).withColumns(cycles.extrema(10)).filter("is_swing_high OR is_swing_low").select("security_code", "date", "is_swing_high", "is_swing_low")


@query("w31_recent_pivots", f"{_CY} SELECT security_code, today, anchor_type, anchor_date, anchor_price FROM pv")
def _(spark, sf_dir):
    return cycles.pivots(bars(spark, sf_dir), CFG)


@query("r23_square_of_nine", f"{_CY} SELECT security_code, anchor_type, angle_degrees, round(pow(sqrt(anchor_price) + angle_degrees / 180.0, 2), 2) + 0.0 AS level_up, round(CASE WHEN sqrt(anchor_price) > angle_degrees / 180.0 THEN pow(sqrt(anchor_price) - angle_degrees / 180.0, 2) END, 2) + 0.0 AS level_down FROM gw")
def _(spark, sf_dir):
    return cycles.windows(bars(spark, sf_dir), CFG).select("security_code", "anchor_type", "angle_degrees", "level_up", "level_down")


@query(
    "r22_time_windows",
    f"""{_CY} SELECT g.security_code, g.anchor_type, g.angle_degrees, g.anchor_date, g.anchor_price, g.window_date, CAST(g.window_date - g.today AS INT) AS days_to_window, s.date AS signal_date,
    s.high AS signal_high, s.low AS signal_low, CASE WHEN g.window_date > g.today + 3 THEN 'upcoming' WHEN s.mx > s.high THEN 'bullish_confirmed' WHEN s.mn < s.low THEN 'bearish_confirmed' ELSE 'unconfirmed' END AS confirmation
    FROM gw g LEFT JOIN sg USING (security_code, anchor_type, angle_degrees) LEFT JOIN sw0 s ON s.security_code = g.security_code AND s.date = sg.d""",
)
def _(spark, sf_dir):
    return cycles.windows(bars(spark, sf_dir), CFG).drop("level_up", "level_down")


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly statements of each customer from orders: revenue, and the finished part of it as income."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    y = o.groupBy(C("o_custkey").cast("string").alias("symbol"), F.make_date(F.year("o_orderdate"), F.lit(12), F.lit(31)).alias("fiscal_year_end"))
    y = y.agg(F.sum("o_totalprice").alias("r"), F.sum(F.when(C("o_orderstatus") == "F", C("o_totalprice"))).alias("n"))
    item = F.explode(F.array(F.struct(F.lit("Total Revenue").alias("item"), C("r").alias("value")), F.struct(F.lit("Net Income").alias("item"), C("n").alias("value"))))
    return y.select("symbol", "fiscal_year_end", item.alias("x")).select("symbol", "x.item", "fiscal_year_end", "x.value")


_STATEMENTS = """y AS (SELECT CAST(o_custkey AS VARCHAR) AS symbol, year(o_orderdate) AS fy, sum(o_totalprice) AS r, sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS n FROM orders GROUP BY ALL),
i AS (SELECT symbol, fy, 'r' AS item, r AS v FROM y UNION ALL SELECT symbol, fy, 'n', n FROM y),
k AS (SELECT *, row_number() OVER (PARTITION BY symbol, item ORDER BY fy DESC) AS rn FROM i WHERE v IS NOT NULL),
g AS (SELECT symbol, max(CASE WHEN item = 'r' AND rn = 1 THEN v END) AS r1, max(CASE WHEN item = 'r' AND rn = 2 THEN v END) AS r2, max(CASE WHEN item = 'n' AND rn = 1 THEN v END) AS n1, max(CASE WHEN item = 'n' AND rn = 2 THEN v END) AS n2 FROM k GROUP BY symbol),
yoy AS (SELECT symbol, CASE WHEN r2 > 0 THEN round((r1 - r2) / r2 * 100, 1) + 0.0 END AS sales_growth_pct, CASE WHEN n2 > 0 THEN round((n1 - n2) / n2 * 100, 1) + 0.0 END AS pat_growth_pct FROM g)"""


@query("a09_yoy_growth", f"WITH {_STATEMENTS} SELECT * FROM yoy")
def _(spark, sf_dir):
    return quality.yoy_growth(statements(spark, sf_dir), quality.GROWTH_ITEMS)


_T252 = "t252 AS (SELECT *, close / lag(close) OVER x - 1 AS rx, bench_close / lag(bench_close) OVER x - 1 AS ry FROM (SELECT b.*, bench_close FROM bars b JOIN bench USING (date) QUALIFY row_number() OVER (PARTITION BY security_code ORDER BY b.date DESC) <= 252) WINDOW x AS (PARTITION BY security_code ORDER BY date))"
_VOL = "round(stddev_samp(rx) * sqrt(252) * 100, 1) + 0.0"
_BETA = "round(covar_samp(rx, ry) / nullif(var_samp(CASE WHEN rx IS NOT NULL THEN ry END), 0), 2) + 0.0"


@query("a07_volatility", f"WITH {Q.TRADES}, {Q.BENCH}, {_T252} SELECT security_code, {_VOL} AS annualized_volatility_pct FROM t252 GROUP BY security_code")
def _(spark, sf_dir):
    return quality.volatility(bars(spark, sf_dir))


@query("a08_beta", f"WITH {Q.TRADES}, {Q.BENCH}, {_T252} SELECT security_code, {_BETA} AS beta FROM t252 GROUP BY security_code")
def _(spark, sf_dir):
    b = bars(spark, sf_dir)
    return quality.beta(asof.attach(b, tables.benchmark(b), "date"))


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quote fields of each supplier, some missing."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    k, a = C("s_suppkey"), C("s_acctbal")
    return s.select(
        k.alias("security_code"), (a * 1e7).alias("marketCap"), F.when(k % 7 != 0, (k % 40) / 100.0).alias("ebitdaMargins"), F.when(k % 5 != 0, (k % 30) / 100.0).alias("returnOnEquity"),
        F.when(k % 3 != 0, (k % 50) * 10.0).alias("debtToEquity"), F.when(k % 4 != 0, (k % 60) + 1.0).alias("trailingPE"),
    )


_QUOTES = """q AS (SELECT s_suppkey AS security_code, s_acctbal * 1e7 AS mc, CASE WHEN s_suppkey % 7 <> 0 THEN (s_suppkey % 40) / 100.0 END AS em, CASE WHEN s_suppkey % 5 <> 0 THEN (s_suppkey % 30) / 100.0 END AS roe,
 CASE WHEN s_suppkey % 3 <> 0 THEN (s_suppkey % 50) * 10.0 END AS de, CASE WHEN s_suppkey % 4 <> 0 THEN (s_suppkey % 60) + 1.0 END AS pe FROM supplier),
fmet AS (SELECT security_code, pe, round(mc / 1e7, 1) + 0.0 AS market_cap_cr, CAST(round(em * 100, 1) AS DOUBLE) AS ebitda_margin_pct, CAST(round(roe * 100, 1) AS DOUBLE) AS roe_pct, CAST(round(de / 100, 2) AS DOUBLE) AS debt_to_equity FROM q),
fund AS (SELECT *, market_cap_cr <= 5000 AS market_cap_ok, ebitda_margin_pct BETWEEN 15 AND 25 AS ebitda_margin_ok, roe_pct >= 15 AS roe_ok, debt_to_equity <= 2 AS debt_to_equity_ok FROM fmet)"""


def _checked_sql(checks: list[str], prefix: str, passes: str) -> str:
    miss = ", ".join(f"CASE WHEN {c} IS NULL THEN '{c.removesuffix('_ok')}' END" for c in checks)
    m = f"array_to_string(list_filter([{miss}], lambda x: x IS NOT NULL), ', ')"
    return (
        f"{', '.join(checks)}, {' AND '.join(f'{c} IS NOT NULL' for c in checks)} AS {prefix}_data_complete, {' AND '.join(f'coalesce({c}, true)' for c in checks)} AND ({' OR '.join(f'{c} IS NOT NULL' for c in checks)}) AS {passes}, "
        f"CASE WHEN {m} <> '' THEN 'Unverified (missing: ' || {m} || ')' ELSE '' END AS {prefix}_note"
    )


_FUND = ["market_cap_ok", "ebitda_margin_ok", "roe_ok", "debt_to_equity_ok"]
_GROW = ["sales_growth_ok", "pat_growth_ok", "volatility_ok", "beta_ok", "peg_ok"]


@query("r13_fundamental_metrics", f"WITH {_QUOTES} SELECT security_code, market_cap_cr, ebitda_margin_pct, roe_pct, debt_to_equity FROM fmet")
def _(spark, sf_dir):
    return quality.fundamentals_metrics(quotes(spark, sf_dir)).select("security_code", "market_cap_cr", "ebitda_margin_pct", "roe_pct", "debt_to_equity")


@query("r14_fundamentals", f"WITH {_QUOTES} SELECT security_code, {_checked_sql(_FUND, 'fundamentals', 'passes_fundamentals')} FROM fund")
def _(spark, sf_dir):
    f = quality.fundamentals(quality.fundamentals_metrics(quotes(spark, sf_dir)), CFG)
    return f.select("security_code", *_FUND, "fundamentals_data_complete", "passes_fundamentals", "fundamentals_note")


def growth_metrics(spark: SparkSession, sf_dir: str, volatile: bool = True) -> DataFrame:
    """Growth, volatility (if wanted: it takes a pass over the bars) and beta of each quoted security."""
    b = bars(spark, sf_dir)
    y = quality.yoy_growth(statements(spark, sf_dir), quality.GROWTH_ITEMS).withColumn("security_code", C("symbol").cast("long"))
    m = quotes(spark, sf_dir).join(y, "security_code", "left")
    m = asof.attach(m, quality.volatility(b), "security_code") if volatile else m
    m = asof.attach(m, quality.beta(asof.attach(b, tables.benchmark(b), "date")), "security_code")
    return m.withColumns({"trailing_pe": C("trailingPE"), "peg": quality.peg(C("trailingPE"), C("pat_growth_pct"))})


_GROWTH = f"""{Q.TRADES}, {Q.BENCH}, {_T252}, {_STATEMENTS}, {_QUOTES}, vb AS (SELECT security_code, {_VOL} AS annualized_volatility_pct, {_BETA} AS beta FROM t252 GROUP BY security_code),
gm AS (SELECT q.security_code, q.pe, sales_growth_pct, pat_growth_pct, annualized_volatility_pct, beta, CASE WHEN q.pe > 0 AND pat_growth_pct > 0 THEN round(q.pe / pat_growth_pct, 2) + 0.0 END AS peg
 FROM q LEFT JOIN yoy ON CAST(yoy.symbol AS BIGINT) = q.security_code LEFT JOIN vb USING (security_code)),
gr AS (SELECT *, sales_growth_pct >= 20 AS sales_growth_ok, pat_growth_pct >= 40 AS pat_growth_ok, annualized_volatility_pct <= 35 AS volatility_ok, beta BETWEEN 0.8 AND 1.2 AS beta_ok, peg <= 1 AS peg_ok FROM gm)"""


@query("r16_peg", f"WITH {_GROWTH} SELECT security_code, peg FROM gr")
def _(spark, sf_dir):
    return growth_metrics(spark, sf_dir).select("security_code", "peg")


@query("r15_growth", f"WITH {_GROWTH} SELECT security_code, {_checked_sql(_GROW, 'growth', 'passes_growth_screen')} FROM gr")
def _(spark, sf_dir):
    g = quality.growth(growth_metrics(spark, sf_dir), CFG)
    return g.select("security_code", *_GROW, "growth_data_complete", "passes_growth_screen", "growth_note")


def _held(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan in which two of three rows count as passing, with growth columns."""
    r = scanned(spark, sf_dir).result.withColumn("passes_all_filters", C("security_code") % 3 != 0)
    g = growth_metrics(spark, sf_dir, False).select("security_code", "sales_growth_pct", "pat_growth_pct", "peg", "trailing_pe", "beta", F.when(C("security_code") % 2 == 0, C("security_code") % 5 > 0).alias("passes_growth_screen"), F.lit(None).cast("boolean").alias("passes_fundamentals"))
    return quality.portfolio(r.join(g, "security_code", "left"), 10)


_HELD = f"""{Q.SCAN}, {_GROWTH.replace(Q.TRADES + ', ' + Q.BENCH + ', ', '')},
held AS (SELECT sc.security_code, sector, round(total, 1) AS score, sales_growth_pct, pat_growth_pct, peg, pe AS trailing_pe, beta, turnover_cr FROM sc LEFT JOIN gr USING (security_code)
 WHERE security_code % 3 <> 0 AND coalesce(CASE WHEN security_code % 2 = 0 THEN security_code % 5 > 0 END, true) ORDER BY score DESC, security_code LIMIT 10)"""


@query("t08_portfolio", f"WITH RECURSIVE {_HELD} SELECT security_code, score + 0.0 AS conviction_score, round(100.0 / count(*) OVER (), 2) AS weight_pct FROM held")
def _(spark, sf_dir):
    return _held(spark, sf_dir).select("security_code", "conviction_score", "weight_pct")


_AVG = ("sales_growth_pct", "pat_growth_pct", "peg", "trailing_pe", "beta", "turnover_cr")


@query("a10_portfolio_summary", f"WITH RECURSIVE {_HELD} SELECT count(*) AS n_holdings, count(DISTINCT sector) AS n_sectors, {', '.join(f'round(avg({m}), 6) + 0.0 AS avg_{m}, count({m}) AS n_{m}' for m in _AVG)} FROM held")
def _(spark, sf_dir):
    return quality.portfolio_summary(_held(spark, sf_dir).drop("market_cap_cr"), digits=6)


def picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One open pick per security, logged at its 30th bar from the end; every fifth can only expire or stay open."""
    b = bars(spark, sf_dir).filter("security_code IS NOT NULL")
    from pyspark.sql import Window

    at = b.withColumn("rn", F.row_number().over(Window.partitionBy("security_code").orderBy(F.desc("date")))).filter(C("rn") == F.when(C("security_code") % 10 == 0, 10).otherwise(30))
    wide = C("security_code") % 5 == 0
    code = C("security_code").cast("string")
    rows = at.select(
        F.concat(code, F.lit("_"), C("date").cast("string")).alias("pick_id"), C("date").alias("date_logged"), code.alias("security_code"), C("close").alias("entry_price"),
        F.when(wide, C("close") * 0.0001).otherwise(C("close") * 0.5).alias("stop_loss"), F.when(wide, C("close") * 1000).otherwise(C("close") * 1.5).alias("target"), F.lit(60.0).alias("entry_rsi"),
        F.lit(True).alias("entry_supertrend_bullish"), F.lit(True).alias("entry_price_above_50"), F.lit("OPEN").alias("status"), F.lit("").alias("signal_notes"),
    )
    return tables.with_columns(rows, tracking.PICKS)


_PICKS = f"""{Q.TRADES}, pk AS (SELECT security_code AS code, CAST(security_code AS VARCHAR) || '_' || CAST(date AS VARCHAR) AS pick_id, date AS logged, close AS entry, CASE WHEN security_code % 5 = 0 THEN close * 0.0001 ELSE close * 0.5 END AS stop,
 CASE WHEN security_code % 5 = 0 THEN close * 1000 ELSE close * 1.5 END AS target FROM bars QUALIFY row_number() OVER (PARTITION BY security_code ORDER BY date DESC) = CASE WHEN security_code % 10 = 0 THEN 10 ELSE 30 END),
pb AS (SELECT pk.*, b.date, b.close, row_number() OVER (PARTITION BY pick_id ORDER BY b.date) AS rn, CASE WHEN low <= stop THEN 'HIT_STOPLOSS' WHEN high >= target THEN 'HIT_TARGET' END AS ev FROM pk JOIN bars b ON b.security_code = code AND b.date > logged),
pe0 AS (SELECT pick_id, any_value(entry) AS entry, any_value(stop) AS stop, any_value(target) AS target, min(CASE WHEN ev IS NOT NULL THEN rn END) AS hit, arg_min(ev, rn) FILTER (ev IS NOT NULL) AS ev, count(*) AS n, max(date) AS last_checked_date,
 arg_max(close, date) AS last_checked_price, max(CASE WHEN rn = 15 THEN close END) AS hc, max(CASE WHEN rn = 15 THEN date END) AS hd, arg_min(date, rn) FILTER (ev IS NOT NULL) AS ed FROM pb GROUP BY pick_id),
pe AS (SELECT pick_id, coalesce(ev, CASE WHEN n >= 15 THEN 'EXPIRED' ELSE 'OPEN' END) AS status, coalesce(ed, hd) AS exit_date, CASE ev WHEN 'HIT_STOPLOSS' THEN stop WHEN 'HIT_TARGET' THEN target ELSE hc END AS xp, entry, last_checked_date, last_checked_price,
 coalesce(hit, CASE WHEN n >= 15 THEN 15 ELSE n END) AS days_held FROM pe0)"""
_EVALUATED_PICKS = """pick_id, status, exit_date, round(xp, 2) + 0.0 AS exit_price, round((xp - entry) / entry * 100, 2) + 0.0 AS realized_pct, last_checked_date, last_checked_price,
 round((coalesce(xp, last_checked_price) - entry) / entry * 100, 2) + 0.0 AS unrealized_pct, days_held"""


@query("k03_evaluate_picks", f"WITH {_PICKS} SELECT {_EVALUATED_PICKS} FROM pe")
def _(spark, sf_dir):
    return tracking.evaluate(picks(spark, sf_dir), bars(spark, sf_dir))


@query(
    "k02_update_picks",
    f"""WITH RECURSIVE {Q.SCAN}, {_PICKS.replace(Q.TRADES + ', ', '')} SELECT pe.pick_id, status, days_held, coalesce(nullif(array_to_string(list_filter([
    CASE WHEN NOT supertrend_bullish THEN 'Supertrend has flipped bearish since entry - the trend that triggered this pick has reversed.' END, CASE WHEN rsi < 45 THEN printf('RSI has faded from %.0f to %.0f - momentum has cooled off materially.', 60.0, rsi) END,
    CASE WHEN NOT price_above_50 THEN 'Price has closed back below its 50DMA - the trend structure that supported this pick is broken.' END], lambda x: x IS NOT NULL), ' | '), ''),
    'No material deterioration flagged - setup still looks structurally intact.') AS signal_notes FROM pe JOIN pk USING (pick_id) JOIN snap ON snap.security_code = pk.code""",
)
def _(spark, sf_dir):
    return tracking.recheck(picks(spark, sf_dir), bars(spark, sf_dir), CFG).select("pick_id", "status", "days_held", "signal_notes")


_CUT = "2001-09-15"
_FIRST_PICKS = re.sub(r"\b(pb|pe0|pe)\b", r"\1_first", _PICKS[_PICKS.index("pb AS") :]).replace("b.date > logged", f"b.date > logged AND b.date < DATE '{_CUT}'")


@query(
    "k02_streamed_picks",
    f"""WITH {_PICKS}, {_FIRST_PICKS}, both_pe AS (SELECT * FROM pe_first WHERE status <> 'OPEN' UNION ALL SELECT * FROM pe ANTI JOIN (SELECT pick_id FROM pe_first WHERE status <> 'OPEN') USING (pick_id)) SELECT {_EVALUATED_PICKS} FROM both_pe""",
)
def _(spark, sf_dir):
    """Picks and the bars before a day, then the other bars, taken by a stream that starts anew from its checkpoint."""
    home, b, p = scratch(spark, "streamed"), bars(spark, sf_dir), picks(spark, sf_dir)
    state.commit(p, home, 1)
    p.write.parquet(f"{home}/picks")
    for part in (C("date") < _CUT, C("date") >= _CUT):
        b.filter(part).write.mode("append").parquet(f"{home}/bars")
        tracked.follow(spark, home, f"{home}/bars", CFG).awaitTermination()
    return state.latest(spark, home, tracking.PICKS)[0].select("pick_id", "status", "exit_date", "exit_price", "realized_pct", "last_checked_date", "last_checked_price", "unrealized_pct", "days_held")


@query("a13_win_rate", f"WITH {_PICKS} SELECT count_if(status = 'OPEN') AS n_open, count_if(status <> 'OPEN') AS n_closed, count_if(status = 'HIT_TARGET') AS n_target, count_if(status = 'HIT_STOPLOSS') AS n_stop, round(count_if(status = 'HIT_TARGET') * 100.0 / nullif(count_if(status LIKE 'HIT%'), 0), 1) AS win_rate_pct FROM pe")
def _(spark, sf_dir):
    return tracking.win_rate(tracking.evaluate(picks(spark, sf_dir), bars(spark, sf_dir)))


@query("k01_log_picks", f"{_SCAN} SELECT CAST(security_code AS VARCHAR) || '_2024-01-31' AS pick_id, CAST(security_code AS VARCHAR) AS security_code, close AS entry_price, conviction_tier AS entry_conviction_tier, coalesce(pct_above_sma50 >= 0, false) AS entry_price_above_50 FROM sc WHERE security_code % 4 <> 0")
def _(spark, sf_dir):
    """Securities with an open pick are refused."""
    open_ = picks(spark, sf_dir).filter("CAST(security_code AS LONG) % 4 = 0")
    new = tracking.log_picks(open_, scanned(spark, sf_dir).result, F.lit("2024-01-31"))
    return new.filter("date_logged = DATE '2024-01-31'").select("pick_id", "security_code", "entry_price", "entry_conviction_tier", "entry_price_above_50")


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = tables.universe(spark, sf_dir).filter("security_code % 2 = 0")
    h = s.select(C("security_code").cast("string").alias("security_code"), F.lit("2023-01-02").cast("date").alias("first_seen_date"), F.lit(10.0).alias("first_seen_price"), F.lit("2023-01-02").cast("date").alias("last_seen_date"), F.lit(10.0).alias("last_seen_price"), F.lit(3).alias("times_seen"))
    return tables.with_columns(h, tracking.HISTORY)


def _some_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(spark, sf_dir).result.withColumn("passes_all_filters", C("security_code") % 3 != 0)


@query(
    "j09_recommendation_status",
    f"""{_SCAN} SELECT security_code, CASE WHEN security_code % 2 = 0 THEN DATE '2023-01-02' ELSE as_of END AS first_recommended_date, CASE WHEN security_code % 2 = 0 THEN CAST(10 AS DOUBLE) ELSE close END AS entry_price,
    CASE WHEN security_code % 2 <> 0 THEN 'New' WHEN security_code % 3 <> 0 AND supertrend_bullish AND pct_above_sma50 >= 0 THEN 'Repeat - still long' ELSE 'Repeat - exit / trail SL' END AS recommendation_status FROM sc""",
)
def _(spark, sf_dir):
    a = tracking.annotate(_some_pass(spark, sf_dir), history(spark, sf_dir))
    return a.select("security_code", "first_recommended_date", "entry_price", "recommendation_status")


@query(
    "j15_history_upsert",
    f"""{_SCAN} SELECT CAST(d.security_code AS VARCHAR) AS security_code, CASE WHEN d.security_code % 2 = 0 THEN DATE '2023-01-02' ELSE as_of END AS first_seen_date, CASE WHEN d.security_code % 3 <> 0 THEN as_of ELSE DATE '2023-01-02' END AS last_seen_date,
    CASE WHEN d.security_code % 3 <> 0 THEN close ELSE CAST(10 AS DOUBLE) END AS last_seen_price, CAST(CASE WHEN d.security_code % 2 = 0 THEN CASE WHEN d.security_code % 3 <> 0 THEN 4 ELSE 3 END ELSE 1 END AS BIGINT) AS times_seen
    FROM dims d LEFT JOIN sc USING (security_code) WHERE d.security_code % 2 = 0 OR d.security_code % 3 <> 0""",
)
def _(spark, sf_dir):
    u = tracking.upsert(history(spark, sf_dir), _some_pass(spark, sf_dir))
    return u.select("security_code", "first_seen_date", "last_seen_date", "last_seen_price", "times_seen")


NAMES = "concat(p_name, CASE p_partkey % 5 WHEN 0 THEN ' (India) Ltd.' WHEN 1 THEN ' Industries & Co' WHEN 2 THEN '-A.B.C. Limited' WHEN 3 THEN ' Pvt T D Power' ELSE '' END)"


@query(
    "x03_name_key",
    rf"""WITH a AS (SELECT p_partkey, trim(regexp_replace(upper(regexp_replace({NAMES}, '[^A-Za-z0-9& ]', ' ', 'g')), ' +', ' ', 'g')) AS s FROM part),
    b AS (SELECT p_partkey, string_split(s, ' ') AS t FROM a), c AS (SELECT p_partkey, list_reduce(list_prepend('', t), lambda x, y: CASE WHEN x = '' THEN y WHEN len(y) = 1 AND y <> '&' AND regexp_matches(x, '(^| |\x01)[^& ]$') THEN x || chr(1) || y ELSE x || ' ' || y END) AS j FROM b)
    SELECT p_partkey, array_to_string(list_filter(string_split(replace(j, chr(1), ''), ' '), lambda w: w <> '' AND w NOT IN ('LIMITED', 'LTD', 'LTD.', 'LIMITE', 'PVT', 'PRIVATE', 'CO', 'COMPANY', 'INDUSTRIES', 'INDIA', 'AND', '&')), ' ') AS name_key FROM c""",
)
def _(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return p.select("p_partkey", scalars.name_key(F.expr(NAMES)).alias("name_key"))


def dumps(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A universe from parts, and two exchanges' dumps that hold most of it under varied names."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    code = C("p_partkey").cast("string")
    u = p.select(code.alias("security_code"), F.initcap(F.concat_ws(" ", "p_name", "p_brand")).alias("company_name_raw"), C("p_type").alias("sector"))
    dump = lambda df, name, base: df.select(code.alias("exchange_token"), F.concat(F.lit("S"), code).alias("tradingsymbol"), (C("p_partkey") + base).alias("instrument_token"), C("p_partkey").alias("pos"), scalars.name_key(name).alias("name_key"))
    bse = dump(p.filter("p_partkey % 10 <> 0"), F.concat_ws(" ", "p_name", "p_brand", F.lit("Ltd")), 1_000_000)
    nse = dump(p.filter("p_partkey % 3 <> 0"), F.concat_ws(" ", "p_name", "p_brand", F.when(C("p_partkey") % 4 == 0, "Holdings")), 2_000_000)
    return u, bse, nse


_NAME_KEYS = rf"""ka AS (SELECT *, trim(regexp_replace(upper(regexp_replace(nm, '[^A-Za-z0-9& ]', ' ', 'g')), ' +', ' ', 'g')) AS s FROM named0),
    kb AS (SELECT * EXCLUDE (s, nm), list_reduce(list_prepend('', string_split(s, ' ')), lambda x, y: CASE WHEN x = '' THEN y WHEN len(y) = 1 AND y <> '&' AND regexp_matches(x, '(^| |\x01)[^& ]$') THEN x || chr(1) || y ELSE x || ' ' || y END) AS j FROM ka),
    named AS (SELECT * EXCLUDE (j), array_to_string(list_filter(string_split(replace(j, chr(1), ''), ' '), lambda w: w <> '' AND w NOT IN {scalars.SUFFIX_WORDS}), ' ') AS k FROM kb)"""

#: Matching blocks: the longest common block of two segments, the first in either, then the same left and right of it.
_J03 = rf"""WITH RECURSIVE named0 AS (SELECT p_partkey AS id, false AS listed, p_name || ' ' || p_brand || ' Ltd' AS nm FROM part WHERE p_partkey % 10 <> 0
      UNION ALL SELECT p_partkey, true, p_name || ' ' || p_brand || CASE WHEN p_partkey % 4 = 0 THEN ' Holdings' ELSE '' END FROM part WHERE p_partkey % 3 <> 0), {_NAME_KEYS},
    w AS (SELECT id, k FROM named WHERE NOT listed AND k <> ''), d AS (SELECT id, k FROM named WHERE listed AND k <> ''),
    exact AS (SELECT w.id, min(d.id) AS best, CAST(1 AS DOUBLE) AS score FROM w JOIN d USING (k) GROUP BY w.id),
    pairs AS (SELECT w.id AS a_id, d.id AS b_id, w.k AS a, d.k AS b FROM w JOIN d ON split_part(w.k, ' ', 1) = split_part(d.k, ' ', 1) WHERE w.id NOT IN (SELECT id FROM exact)),
    seg AS (SELECT a_id, b_id, a, b, 1 AS alo, len(a) AS ahi, 1 AS blo, len(b) AS bhi, CAST(0 AS BIGINT) AS n FROM pairs
      UNION ALL
      SELECT a_id, b_id, a, b, CASE side WHEN 0 THEN alo ELSE i + n END, CASE side WHEN 0 THEN i - 1 ELSE ahi END, CASE side WHEN 0 THEN blo ELSE j + n END, CASE side WHEN 0 THEN j - 1 ELSE bhi END, CASE side WHEN 0 THEN n ELSE 0 END
      FROM (SELECT a_id, b_id, a, b, alo, ahi, blo, bhi, count(*) AS n, min(i) AS i, min(j) AS j
            FROM (SELECT *, i - row_number() OVER (PARTITION BY a_id, b_id, alo, blo, i - j ORDER BY i) AS run
                  FROM (SELECT x.*, y.j FROM (SELECT *, unnest(range(alo, ahi + 1)) AS i FROM seg WHERE ahi >= alo AND bhi >= blo) x, LATERAL (SELECT unnest(range(x.blo, x.bhi + 1)) AS j) y WHERE x.a[x.i] = x.b[y.j]))
            GROUP BY a_id, b_id, a, b, alo, ahi, blo, bhi, i - j, run QUALIFY row_number() OVER (PARTITION BY a_id, b_id, alo, blo ORDER BY count(*) DESC, min(i), min(j)) = 1), (VALUES (0), (1)) AS sides(side)),
    r AS (SELECT a_id, b_id, any_value(a) AS a, any_value(b) AS b, 2.0 * sum(n) / (len(any_value(a)) + len(any_value(b))) AS ratio FROM seg GROUP BY a_id, b_id),
    sc AS (SELECT a_id, b_id, CAST(CASE WHEN starts_with(b || ' ', a || ' ') AND contains(a, ' ') OR starts_with(a || ' ', b || ' ') AND contains(b, ' ') THEN greatest(ratio, 0.95) ELSE ratio END AS DOUBLE) AS score FROM r WHERE ratio > 0),
    best AS (SELECT id, best, score FROM exact UNION ALL (SELECT a_id, b_id, score FROM sc QUALIFY row_number() OVER (PARTITION BY a_id ORDER BY score DESC, b_id) = 1))
    SELECT array_to_string(list_transform(string_split(p_name || ' ' || p_brand, ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ') AS company_name_raw, CAST(p_partkey AS VARCHAR) AS security_code, p_type AS sector, 'BY_CODE' AS universe, p_partkey % 10 <> 0 AS resolved,
    CASE WHEN p_partkey % 10 = 0 THEN 'security_code_not_found_in_dump' WHEN score >= 0.82 THEN 'matched_nse_by_name' ELSE 'no_confident_nse_match_using_bse' END AS reason, CASE WHEN p_partkey % 10 <> 0 THEN CASE WHEN score >= 0.82 THEN 'NSE' ELSE 'BSE' END END AS exchange,
    CASE WHEN p_partkey % 10 <> 0 THEN 'S' || CASE WHEN score >= 0.82 THEN best ELSE p_partkey END END AS tradingsymbol, CASE WHEN p_partkey % 10 <> 0 THEN CASE WHEN score >= 0.82 THEN best + 2000000 ELSE p_partkey + 1000000 END END AS instrument_token,
    CASE WHEN p_partkey % 10 <> 0 THEN p_partkey + 1000000 END AS bse_instrument_token, CASE WHEN p_partkey % 10 <> 0 THEN round(coalesce(score, 0), 3) ELSE 0 END AS match_confidence FROM part LEFT JOIN best ON best.id = p_partkey"""


@query("j03_name_mapping", _J03)
def _(spark, sf_dir):
    u, bse, nse = dumps(spark, sf_dir)
    return mapping.by_code(u, bse, nse)


@query(
    "j01_code_lookup",
    "SELECT CAST(p_partkey AS VARCHAR) AS security_code, p_partkey % 10 <> 0 AS resolved, CASE WHEN p_partkey % 10 <> 0 THEN p_partkey + 1000000 END AS bse_instrument_token FROM part",
)
def _(spark, sf_dir):
    u, bse, nse = dumps(spark, sf_dir)
    return mapping.by_code(u, bse, nse).select("security_code", "resolved", "bse_instrument_token")


@query(
    "j04_symbol_mapping",
    """SELECT 'S' || p_partkey AS security_code, p_partkey % 3 <> 0 AS resolved, CASE WHEN p_partkey % 3 <> 0 THEN 'exact_nse_symbol_match' ELSE 'symbol_not_found_in_nse_dump' END AS reason,
    CASE WHEN p_partkey % 3 <> 0 THEN p_partkey + 2000000 END AS instrument_token, CAST(CASE WHEN p_partkey % 3 <> 0 THEN 1.0 ELSE 0.0 END AS DOUBLE) AS match_confidence FROM part""",
)
def _(spark, sf_dir):
    u, _, nse = dumps(spark, sf_dir)
    m = mapping.by_symbol(u.withColumn("security_code", F.concat(F.lit("S"), "security_code")), nse)
    return m.select("security_code", "resolved", "reason", "instrument_token", "match_confidence")


@query(
    "u01_combine_mappings",
    """WITH a AS (SELECT s_suppkey AS k, s_suppkey % 3 <> 0 AS r FROM supplier), b AS (SELECT p_partkey AS k, p_partkey % 3 <> 0 AS r FROM part)
    SELECT 'S' || k AS security_code, r AS resolved, CASE WHEN r AND k IN (SELECT k FROM b) THEN 'A+B' ELSE 'A' END AS universe FROM a UNION ALL SELECT 'S' || k, r, 'B' FROM b WHERE NOT r OR k NOT IN (SELECT k FROM a)""",
)
def _(spark, sf_dir):
    _, _, nse = dumps(spark, sf_dir)
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    listed = lambda df, key, name, tag: mapping.by_symbol(df.select(F.concat(F.lit("S"), key).alias("security_code"), C(name).alias("company_name_raw"), F.lit("x").alias("sector")), nse, tag)
    return mapping.combine(listed(s, "s_suppkey", "s_name", "A"), listed(p, "p_partkey", "p_name", "B")).select("security_code", "resolved", "universe")


@query("a16_keep_first", "SELECT p_brand, min(p_partkey) AS p_partkey FROM part GROUP BY p_brand")
def _(spark, sf_dir):
    return tables.keep_first(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_brand", "p_partkey"), "p_brand", "p_partkey")


@query("x07_quote_symbol", f"WITH {Q.DIMS} SELECT security_code, tradingsymbol || CASE WHEN exchange = 'BSE' THEN '.BO' ELSE '.NS' END AS quote_symbol FROM dims")
def _(spark, sf_dir):
    return tables.universe(spark, sf_dir).select("security_code", scalars.quote_symbol(C("tradingsymbol"), C("exchange")).alias("quote_symbol"))


@query("p03_resolved", "SELECT 'S' || p_partkey AS security_code, p_partkey + 2000000 AS instrument_token FROM part WHERE p_partkey % 3 <> 0")
def _(spark, sf_dir):
    u, _, nse = dumps(spark, sf_dir)
    return mapping.resolved(mapping.by_symbol(u.withColumn("security_code", F.concat(F.lit("S"), "security_code")), nse)).select("security_code", "instrument_token")


@query("p04_low_confidence", "SELECT 'S' || p_partkey AS security_code, CAST(p_size / 50.0 AS DOUBLE) AS match_confidence FROM part WHERE p_partkey % 3 <> 0 AND p_size / 50.0 < 0.9")
def _(spark, sf_dir):
    u, _, nse = dumps(spark, sf_dir)
    m = mapping.by_symbol(u.withColumn("security_code", F.concat(F.lit("S"), "security_code")), nse)
    size = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.concat(F.lit("S"), "p_partkey").alias("security_code"), (C("p_size") / 50.0).alias("match_confidence"))
    return mapping.low_confidence(m.drop("match_confidence").join(size, "security_code")).select("security_code", "match_confidence")


@query("p09_radar_tiers", f"""{_RADAR}, {_EVALUATED} SELECT security_code, CASE WHEN count_if(is_fresh_breakout) > 0 THEN 'fresh' WHEN count_if(is_watch) > 0 THEN 'watch' END AS radar_tier FROM ev GROUP BY ALL""")
def _(spark, sf_dir):
    return timeframes.radar_tiers(timeframes.radar_ranked(timeframes.radar(bars(spark, sf_dir), tables.universe(spark, sf_dir), CFG))).select("security_code", "radar_tier")


@query("p10_cycle_split", f"{_CY} SELECT security_code, anchor_type, angle_degrees, window_date, window_date > today + 3 AS upcoming FROM gw")
def _(spark, sf_dir):
    ahead, past = cycles.split(cycles.windows(bars(spark, sf_dir), CFG))
    part = lambda df, x: df.select("security_code", "anchor_type", "angle_degrees", "window_date", F.lit(x).alias("upcoming"))
    return part(ahead, True).unionByName(part(past, False))


@query("a17_instrument_types", "SELECT p_type AS instrument_type, count(*) AS n FROM part GROUP BY p_type")
def _(spark, sf_dir):
    return tables.instrument_types(spark.read.parquet(f"{sf_dir}/part.parquet").select(C("p_type").alias("instrument_type")))


@query(
    "s20_chart",
    f"""{_ST} SELECT b.security_code, b.date, b.close, CASE WHEN supertrend_bullish THEN round(supertrend, 3) + 0.0 END AS supertrend_up, CASE WHEN NOT supertrend_bullish THEN round(supertrend, 3) + 0.0 END AS supertrend_down
    FROM bars b JOIN st USING (security_code, date) QUALIFY row_number() OVER (PARTITION BY b.security_code ORDER BY b.date DESC) <= 150""",
)
def _(spark, sf_dir):
    c = supertrend.chart(bars(spark, sf_dir))
    return c.select("security_code", "date", "close", *rounded(c, ["supertrend_up", "supertrend_down"], 3))


@query("x08_slug_and_cut", "SELECT p_partkey, trim(regexp_replace(lower(p_name || ' (' || p_brand || ')'), '[^a-z0-9]+', '_', 'g'), '_') AS slug, substring(p_type, 1, 12) AS short FROM part")
def _(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return p.select("p_partkey", scalars.slug(F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")"))).alias("slug"), scalars.cut(C("p_type"), 12).alias("short"))


@query("x13_json", """SELECT s_suppkey AS security_code, s_acctbal AS "marketCap", CAST(NULL AS DOUBLE) AS "trailingPE" FROM supplier""")
def _(spark, sf_dir):
    """Quote info as stored: to JSON text in base 64 and back, by schema."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(C("s_suppkey").alias("security_code"), F.base64(F.to_json(F.struct(C("s_acctbal").alias("marketCap")))).alias("text"))
    return s.withColumn("info", F.from_json(F.unbase64("text").cast("string"), tables.QUOTE)).select("security_code", "info.marketCap", "info.trailingPE")


@query(
    "s05_fetch_or_cache",
    f"""WITH {Q.TRADES}, u AS (SELECT s_suppkey AS k FROM supplier UNION SELECT -s_suppkey FROM supplier WHERE s_suppkey % 5 = 0) SELECT CAST(k AS VARCHAR) AS security_code, count(date) AS n_bars, CAST(min(date) AS DATE) AS first_date, CAST(max(date) AS DATE) AS last_date,
    round(sum(close), 3) + 0.0 AS sum_close, CASE WHEN count(date) = 0 THEN 'no service' END AS error FROM u LEFT JOIN bars ON security_code = k GROUP BY k""",
)
def _(spark, sf_dir):
    """Bars stored in a file a security and read back by key, with a row for each security that has none."""
    home = scratch(spark, "bars")
    fetched.write_files(bars(spark, sf_dir), home)
    codes = [r[0] for r in tables.universe(spark, sf_dir).select("security_code").collect()]  # a universe of securities plans the read
    df = fetched.history(spark, home, [*codes, *[-k for k in codes if k % 5 == 0]], partitions=int(spark.conf.get("spark.sql.shuffle.partitions")))
    day = lambda f: f(C("date")).cast("date")
    return df.groupBy("security_code").agg(F.count("date").alias("n_bars"), day(F.min).alias("first_date"), day(F.max).alias("last_date"), (F.round(F.sum("close"), 3) + 0.0).alias("sum_close"), F.max("error").alias("error"))


@query(
    "s06_outcomes",
    f"""WITH {Q.TRADES}, n AS (SELECT security_code, count(*) AS n FROM bars GROUP BY 1) SELECT s_suppkey AS security_code, 'SYM' || s_suppkey AS tradingsymbol, CASE WHEN s_suppkey % 2 = 0 THEN 'NSE' ELSE 'BSE' END AS exchange, s_suppkey % 4 <> 0 AND n IS NOT NULL AS ok,
    CASE WHEN s_suppkey % 4 <> 0 THEN coalesce(n, 0) ELSE 0 END AS n_bars, CASE WHEN s_suppkey % 4 = 0 OR n IS NULL THEN 'no service' END AS error FROM supplier LEFT JOIN n ON security_code = s_suppkey WHERE s_suppkey % 3 <> 0""",
)
def _(spark, sf_dir):
    """Of the resolved securities a quarter have no file."""
    home = scratch(spark, "bars")
    fetched.write_files(bars(spark, sf_dir).filter("security_code % 4 <> 0"), home)
    mapping_ = tables.universe(spark, sf_dir).withColumn("resolved", C("security_code") % 3 != 0)
    codes = [r[0] for r in mapping_.filter("resolved").select("security_code").collect()]
    return fetched.outcomes(fetched.history(spark, home, codes, partitions=int(spark.conf.get("spark.sql.shuffle.partitions"))), mapping_)


_LISTED = "part QUALIFY row_number() OVER (PARTITION BY code ORDER BY p_partkey) = 1"


def _csv(df: DataFrame, name: str) -> str:
    """df as one CSV folder in its order."""
    path = scratch(df.sparkSession, name)
    tables.write_csv(df, path)
    return path


@query(
    "s01_constituents",
    rf"""WITH named0 AS (SELECT *, name AS nm FROM (SELECT p_partkey, p_brand AS code, p_name || ' (India) Ltd.' AS name, CASE WHEN p_partkey % 4 <> 0 THEN p_type END AS sector FROM part) QUALIFY row_number() OVER (PARTITION BY code ORDER BY p_partkey) = 1), {_NAME_KEYS}
    SELECT code AS security_code, name AS company_name_raw, coalesce(sector, 'Unclassified') AS sector, k AS name_key, 'BY_CODE' AS universe FROM named""",
)
def _(spark, sf_dir):
    """A list of codes written from parts; the first row of each code counts."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").orderBy("p_partkey").coalesce(1)
    rows = p.select(F.concat("p_name", F.lit(" (India) Ltd.")).alias("Constituents"), C("p_brand").alias("Symbol"), F.when(C("p_partkey") % 4 != 0, C("p_type")).alias("Macro-Economic Sector"))
    return tables.constituents(spark, _csv(rows, "constituents"))


@query(
    "s02_symbol_constituents",
    """SELECT code AS security_code, p_name AS company_name_raw, p_type AS sector, 'TOTAL' AS universe FROM (SELECT *, CASE WHEN p_partkey % 5 <> 0 THEN p_brand || '-' || p_size END AS code FROM part) WHERE code IS NOT NULL QUALIFY row_number() OVER (PARTITION BY code ORDER BY p_partkey) = 1""",
)
def _(spark, sf_dir):
    """A list of symbols; rows without one go."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").orderBy("p_partkey").coalesce(1)
    rows = p.select(C("p_name").alias("Company Name"), F.when(C("p_partkey") % 5 != 0, F.concat_ws("-", "p_brand", "p_size")).alias("Symbol"), C("p_type").alias("Industry"))
    return tables.constituents(spark, _csv(rows, "symbols"), "BY_SYMBOL", "TOTAL").drop("name_key")


@query("s03_instruments", """SELECT 'S' || p_partkey AS tradingsymbol, CAST(p_partkey AS VARCHAR) AS exchange_token, p_partkey + 2000000 AS instrument_token, p_name AS name, 'EQ' AS instrument_type FROM part WHERE p_partkey % 3 <> 0""")
def _(spark, sf_dir):
    return tables.instruments(spark, _csv(_dump_rows(spark, sf_dir), "dump")).drop("segment", "name_key")


def _dump_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An exchange's dump: two thirds equities, the rest indices."""
    p, equity = spark.read.parquet(f"{sf_dir}/part.parquet"), C("p_partkey") % 3 != 0
    return p.select(
        F.concat(F.lit("S"), "p_partkey").alias("tradingsymbol"), C("p_partkey").cast("string").alias("exchange_token"), (C("p_partkey") + 2_000_000).alias("instrument_token"), C("p_name").alias("name"),
        F.when(equity, "EQ").otherwise("IDX").alias("instrument_type"), F.when(equity, "NSE").otherwise("INDICES").alias("segment"),
    )


@query("s07_benchmark_token", "SELECT 'S' || max(p_partkey) AS tradingsymbol, max(p_partkey) + 2000000 AS instrument_token FROM part WHERE p_partkey % 3 = 0")
def _(spark, sf_dir):
    """The token of an index, looked up by its symbol."""
    dump = _dump_rows(spark, sf_dir)
    symbol = dump.filter("segment = 'INDICES'").agg(F.max_by("tradingsymbol", "instrument_token")).first()[0]
    return spark.range(1).select(F.lit(symbol).alias("tradingsymbol"), F.lit(tables.benchmark_token(dump, symbol)).cast("long").alias("instrument_token"))


@query("s11_theme_map", "SELECT CAST(s_suppkey AS VARCHAR) AS security_code, CAST(NULL AS VARCHAR) AS tradingsymbol, s_name AS company_name, CASE WHEN s_suppkey % 2 = 0 THEN 'Defence' ELSE 'Healthcare' END AS theme FROM supplier")
def _(spark, sf_dir):
    """A theme table without a symbol column."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    return tables.theme_map(spark, _csv(s.select(C("s_suppkey").alias("security_code"), C("s_name").alias("company_name"), F.when(C("s_suppkey") % 2 == 0, "Defence").otherwise("Healthcare").alias("theme")), "themes"))


@query("s16_csv_sink", f"{_SCAN} SELECT CAST(security_code AS VARCHAR) AS security_code, CAST(fail_reasons = '' AS VARCHAR) AS passes_all_filters, CAST(round(total, 1) + 0.0 AS DOUBLE) AS conviction_score FROM sc")
def _(spark, sf_dir):
    """The scan as written, read back as text but for the score."""
    path = _csv(scanned(spark, sf_dir).result.select("security_code", "passes_all_filters", "conviction_score"), "scan")
    return spark.read.option("header", True).csv(path).withColumn("conviction_score", C("conviction_score").cast("double"))


@query("p06_candidates", f"{_SCAN} SELECT security_code FROM sc WHERE fail_reasons = ''")
def _(spark, sf_dir):
    return scan.candidates(scanned(spark, sf_dir).result).select("security_code")


@query("p14_shown", f"{_SCAN} SELECT security_code, conviction_tier, sector FROM sc")
def _(spark, sf_dir):
    """Wanted columns that a result doesn't have are left out."""
    return scan.shown(scanned(spark, sf_dir).result, ["security_code", "theme", "conviction_tier", "peg", "sector"])


@query("j10_annotate", f"{_SCAN}, {_QUOTES} SELECT security_code, CASE WHEN security_code % 3 <> 0 THEN market_cap_ok END AS market_cap_ok, CASE WHEN security_code % 3 <> 0 THEN roe_ok END AS roe_ok FROM sc LEFT JOIN fund USING (security_code)")
def _(spark, sf_dir):
    """Screens are written on passing rows only."""
    checked = quality.fundamentals(quality.fundamentals_metrics(quotes(spark, sf_dir)), CFG)
    return quality.annotate(_some_pass(spark, sf_dir), checked, ["market_cap_ok", "roe_ok"]).select("security_code", "market_cap_ok", "roe_ok")


@query("t07_picks_by_date", f"WITH {_PICKS} SELECT pick_id, logged AS date_logged, CAST(row_number() OVER (ORDER BY logged DESC, pick_id) AS BIGINT) AS place FROM pk")
def _(spark, sf_dir):
    ordered = tracking.by_date(picks(spark, sf_dir)).select("pick_id", "date_logged")
    return running_place(ordered)


def running_place(ordered: DataFrame) -> DataFrame:
    """The place of each row of an ordered frame: rows of the partitions before, and the rows before within its own."""
    from pyspark.sql import Window

    rows = ordered.withColumns({"__p": F.spark_partition_id(), "__i": F.monotonically_increasing_id()})
    rows = rows.withColumn("__n", F.row_number().over(Window.partitionBy("__p").orderBy("__i")))
    sizes = rows.groupBy("__p").agg(F.max("__n").alias("__s"))
    before = sizes.select("__p", (F.sum("__s").over(Window.orderBy("__p")) - C("__s")).alias("__b"))
    return rows.join(before, "__p").select(*ordered.columns, (C("__b") + C("__n")).cast("long").alias("place"))


@query(
    "k02_failed_picks",
    f"""WITH RECURSIVE {_PICKS} SELECT pk.pick_id, CASE WHEN code % 4 = 0 THEN 'OPEN' ELSE pe.status END AS status, CASE WHEN code % 4 = 0 THEN NULL ELSE pe.days_held END AS days_held, code % 4 = 0 AS noted FROM pk LEFT JOIN pe USING (pick_id)""",
)
def _(spark, sf_dir):
    """Securities without bars: their picks note the error and stay as they are, the others go on."""
    p, b = picks(spark, sf_dir), bars(spark, sf_dir)
    gone = tables.universe(spark, sf_dir).filter("security_code % 4 = 0").select("security_code", F.lit("no service").alias("error"))
    after = tracking.recheck(p, b.filter("security_code % 4 <> 0"), CFG, gone)
    return after.select("pick_id", "status", "days_held", (C("signal_notes") == "Update failed: no service").alias("noted"))


_GAPS = "gb AS (SELECT * FROM bench WHERE day(date) % 7 <> 0), ga AS (SELECT b.security_code, b.date, b.close, last_value(g.bench_close IGNORE NULLS) OVER (PARTITION BY b.security_code ORDER BY b.date) AS bench_close FROM bars b LEFT JOIN gb g USING (date))"


@query("j05_benchmark_gaps", f"WITH {Q.TRADES}, {Q.BENCH}, {_GAPS} SELECT security_code, date, round(bench_close, 7) + 0.0 AS bench_close, round(close / bench_close, 4) + 0.0 AS rs_line FROM ga")
def _(spark, sf_dir):
    """A benchmark without every seventh day of the month: its last value is carried over."""
    b = bars(spark, sf_dir)
    r = indicators.with_benchmark(b, tables.benchmark(b).filter(F.day("date") % 7 != 0))
    return r.select("security_code", "date", F.round("bench_close", 7).alias("bench_close"), F.round("rs_line", 4).alias("rs_line"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranked, explained screen."""
    return scan.ranked(scanned(spark, sf_dir).result)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def _narrow(sql: str) -> str:
    """DuckDB counts conditions in 128 bits; every count_if becomes a BIGINT."""
    out, at = "", 0
    while (k := sql.find("count_if(", at)) >= 0:
        end, depth = k + len("count_if("), 1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        out += f"{sql[at:k]}CAST({sql[k:end]} AS BIGINT)"
        at = end
    return out + sql[at:]


def oracle_sql() -> dict[str, str]:
    return {name: _narrow(sql) for name, sql in _SQL.items()}
