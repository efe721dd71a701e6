"""Hand-valued cases of the screening engine, and properties of the indicator pipeline."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.config import DEFAULTS, overlay, settings
from barloom.functions import scalars, windows
from barloom.operators import asof, candles, cycles, false_moves, indicators, mapping, next_day, quality, scan, screen, supertrend, timeframes, tracking
from barloom.sources import state, tables

C = F.col


def bars(spark, closes, code="1", highs=None, lows=None, opens=None, volumes=None, start="2024-01-01", freq="B"):
    days = pd.date_range(start, periods=len(closes), freq=freq).date
    pick = lambda given, k, default: default if given is None else given[k]
    rows = [(code, days[k], float(pick(opens, k, c)), float(pick(highs, k, 1.01 * c)), float(pick(lows, k, 0.99 * c)), float(c), float(pick(volumes, k, 100_000))) for k, c in enumerate(closes)]
    return spark.createDataFrame(rows, "security_code string, date date, open double, high double, low double, close double, volume double")


def column(df, name):
    return [r[name] for r in df.orderBy("date").select(name).collect()]


def wave(n, base=100.0):
    import math

    return [base + 10 * math.sin(k / 7) + 0.05 * k + (k % 5) for k in range(n)]


def test_overlay_keeps_base_and_replaces_lists():
    a = {"x": {"y": 1, "z": [1, 2]}, "k": 1}
    b = overlay(a, {"x": {"z": [3]}, "k": {"n": 2}})
    assert b == {"x": {"y": 1, "z": [3]}, "k": {"n": 2}} and a["x"]["z"] == [1, 2]
    assert settings("swing")["filters"]["donchian_breakout"]["period"] == 15 and DEFAULTS["filters"]["donchian_breakout"]["period"] == 20


def test_volume_surge_and_low_channel(spark):
    b = bars(spark, [10] * 21, volumes=[100] * 20 + [300])
    assert column(indicators.enrich(b, settings()), "volume_surge")[-1] == 3.0
    low = bars(spark, list(range(10, 0, -1)), lows=list(range(10, 0, -1)))
    assert column(low.withColumn("l", windows.full(F.min, C("low"), -3, -1)), "l")[5] == 6


def test_crossed_above_and_recent(spark):
    b = bars(spark, [10, 10, 10, 12, 12, 12]).withColumn("level", F.lit(11.0))
    got = column(b.withColumn("x", windows.crossed_above(C("close"), C("level"), 3)), "x")
    assert got[3] and got[5] and not got[1]


def test_smoothing_matches_recursion(spark):
    closes = wave(120)
    b = windows.smoothed(bars(spark, closes), {"e": windows.ema(C("close"), 12), "w": windows.wilder(C("close"), 14)})
    s = pd.Series(closes)
    for name, expected in (("e", s.ewm(span=12, adjust=False, min_periods=12).mean()), ("w", s.ewm(alpha=1 / 14, adjust=False, min_periods=14).mean())):
        got = column(b, name)
        assert [g is None for g in got] == expected.isna().tolist()
        assert all(abs(g - e) < 1e-9 for g, e in zip(got, expected, strict=True) if g is not None)


def test_smoothing_of_long_series_and_of_series_with_gaps(spark):
    rng = np.random.default_rng(3)
    closes = (100 + rng.normal(0, 1, 20_000).cumsum() * 0.1).tolist()
    holes = [None if i < 5 or rng.random() < 0.2 or 700 < i < 760 else x for i, x in enumerate(closes)]
    rows = [("A", i, x, y) for i, (x, y) in enumerate(zip(closes, holes, strict=True))]
    df = spark.createDataFrame(rows, "security_code string, date int, close double, hole double")
    spans = {"e9": windows.ema(C("close"), 9), "e12": windows.ema(C("close"), 12), "e26": windows.ema(C("close"), 26), "w14": windows.wilder(C("close"), 14), "slow": windows.ema(C("close"), 400), "h12": windows.ema(C("hole"), 12), "h14": windows.wilder(C("hole"), 14)}
    got = windows.smoothed(df, spans).orderBy("date").toPandas()
    for name, (_, alpha, need) in spans.items():
        expected = pd.Series(holes if name[0] == "h" else closes, dtype=float).ewm(alpha=alpha, adjust=False, min_periods=need).mean()
        assert (got[name].isna() == expected.isna()).all(), name
        assert (got[name] - expected).abs().max() < 1e-9, name


def test_rsi_bounds_and_warm_up(spark):
    got = column(indicators.with_rsi(bars(spark, wave(60)), 14), "rsi")
    assert got[:14] == [100.0] * 14 and all(0 <= x <= 100 for x in got)
    assert column(indicators.with_rsi(bars(spark, [5] * 30), 14), "rsi")[-1] == 100.0


def test_supertrend_follows_a_trend_and_both_forms_agree(spark):
    closes = [100 - k for k in range(30)] + [70 + 3 * k for k in range(30)]
    b = bars(spark, closes)
    series = supertrend.series(b).orderBy("date").collect()
    last = supertrend.latest(b).first()
    assert not series[25].supertrend_bullish and series[-1].supertrend_bullish
    assert last.supertrend_bullish and abs(last.supertrend - series[-1].supertrend) < 1e-9 and last.supertrend_flip_recent == series[-1].supertrend_flip_recent
    assert supertrend.latest(bars(spark, [1] * 10)).first().supertrend is None


def test_pipeline_is_blind_to_the_future_and_to_row_order(spark):
    b = bars(spark, wave(150))
    names = ["rsi", "adx", "macd_hist", "sma50", "donchian_high", "obv_slope20"]
    whole = indicators.enrich(b, settings()).orderBy("date").select(*names).collect()
    cut = indicators.enrich(b.orderBy(F.rand(3)).filter("date < DATE '2024-06-01'"), settings()).orderBy("date").select(*names).collect()
    assert all((x is None and y is None) or abs(x - y) < 1e-9 for p, q in zip(whole, cut, strict=False) for x, y in zip(p, q, strict=True))


def test_weekly_bars(spark):
    b = bars(spark, range(105, 115), opens=range(100, 110), highs=range(110, 120), lows=range(90, 100), volumes=[1000] * 10)
    one, two = timeframes.resample(b, "weekly").orderBy("date").collect()
    assert (one.open, one.high, one.low, one.close, one.volume, one.date) == (100, 114, 90, 109, 5000, dt.date(2024, 1, 5)) and (two.open, two.close) == (105, 114)


def test_completed_week_never_sees_its_own_week(spark):
    b = bars(spark, wave(160))
    got = {r.date: r.weekly_rsi for r in next_day.completed_week_rsi(b).collect()}
    weeks = indicators.with_rsi(timeframes.resample(b, "weekly"), 14).orderBy("date").collect()
    for d, v in got.items():
        done = [w.rsi for w in weeks if w.date < d]
        assert v == (done[-1] if done else None)


def test_risk_levels_and_filters(spark):
    row = spark.createDataFrame([(100.0, 4.0, 90.0, True), (100.0, None, 90.0, False), (100.0, 0.0, 90.0, None)], "close double, atr double, supertrend double, supertrend_bullish boolean")
    got = row.select(*[c.alias(n) for n, c in screen.risk(settings()).items()]).collect()
    assert tuple(got[0]) == (94.0, 112.0, 6.0, 12.0, 90.0) and tuple(got[1]) == (None,) * 5 and tuple(got[2]) == (None,) * 5


SNAP = "close double, sma50 double, rsi double, macd_hist double, roc10 double, volume_surge double, obv_slope20 double, donchian_high double, atr_pct_chg20 double, close_strength double, relative_return_20d double, pct_above_sma50 double, adx double, turnover_cr double, price_above_50 boolean, price_above_200 boolean, golden_cross boolean, donchian_breakout boolean, dma50_breakout_recent boolean, dma200_breakout_recent boolean, supertrend_bullish boolean, supertrend_flip_recent boolean, rs_new_high boolean, security_code string, sector string"
BASE = dict(zip([x.split()[0] for x in SNAP.split(", ")], [105.0, 100.0, 65.0, 0.5, 8.0, 2.0, 1000.0, 104.0, -0.5, 0.8, 10.0, 5.0, 25.0, 9.0] + [True] * 9 + ["1", "S"], strict=True))


def snap(spark, *changes):
    rows = [tuple((BASE | {"security_code": str(k)} | c).values()) for k, c in enumerate(changes)]
    return spark.createDataFrame(rows, SNAP)


def test_scores_tiers_and_penalties(spark):
    rows = snap(spark, {}, {"rsi": 90.0, "close": 130.0}, {k: (None if isinstance(v, float) else False) for k, v in BASE.items() if k not in ("security_code", "sector", "close")})
    out = screen.scored(rows, screen.sector_strength(rows), settings()).orderBy("security_code").collect()
    good, chased, empty = out
    assert good.conviction_tier in ("Very High Conviction", "High Conviction") and good.penalties == 0 and good.s_trend == 100.0
    assert chased.penalties == 25.0 and "chasing" in chased.notes and "deeply overbought" in chased.notes and chased.total < good.total
    assert empty.conviction_tier == "Watchlist" and empty.s_volume == 0.7 * 100 + 0.3 * 30 and "lagging the tape" in empty.notes
    assert good.explanation.startswith("Broke out to a fresh multi-week high on 2.0x average volume.")


def test_reasons_in_order(spark):
    rows = snap(spark, {}, {"close": 10.0, "turnover_cr": 1.0, "volume_surge": None, "rsi": None, "adx": None, "donchian_breakout": False}, {"turnover_cr": None, "pct_above_sma50": -1.0})
    got = [r.w for r in rows.orderBy("security_code").select(screen.reasons(settings()).alias("w")).collect()]
    assert got[0] == [] and got[1] == ["price_below_min", "turnover_below_min", "no_volume_surge", "rsi_unavailable", "no_donchian_breakout", "adx_below_min"] and got[2] == ["50dma_breakout_too_shallow"]


def test_sector_ranking_uses_the_upper_median(spark):
    rows = spark.createDataFrame([("A", 1.0), ("A", 5.0), ("B", 3.0), ("C", None)], "sector string, relative_return_20d double")
    got = {r.sector: (r.sector_score, r.sector_median) for r in screen.sector_strength(rows).collect()}
    assert got == {"A": (100.0, 5.0), "B": (0.0, 3.0)}


@pytest.mark.parametrize(
    ("name", "ohlc"),
    [
        ("bearish_engulfing", [(10, 13, 9, 12), (12.5, 13, 9, 9.5)]),
        ("bullish_engulfing", [(12, 13, 9, 10), (9.5, 13, 9, 12.5)]),
        ("shooting_star", [(10, 14, 9.5, 11)]),
        ("hammer", [(11, 11.5, 7, 12)]),
        ("evening_star", [(10, 16, 9, 15), (15, 16, 14, 15.5), (15, 15, 10, 11)]),
        ("morning_star", [(15, 16, 9, 10), (10, 11, 9, 9.5), (10, 15, 10, 14)]),
    ],
)
def test_candles(spark, name, ohlc):
    o, h, low, c = zip(*ohlc, strict=True)
    b = bars(spark, c, opens=o, highs=h, lows=low)
    assert column(b.withColumn("x", {**candles.BEARISH, **candles.BULLISH}[name]()), "x")[-1]


def test_direction_matrix(spark):
    pairs = [(65.0, 65.0), (65.0, 50.0), (30.0, 30.0), (30.0, 50.0), (50.0, 50.0), (None, 50.0)]
    rows = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "k int, w double, d double")
    got = [r.z for r in rows.orderBy("k").select(false_moves.direction(C("w"), C("d"), settings()).alias("z")).collect()]
    assert got == ["strong_bullish", "bullish_pullback", "strong_bearish", "bearish_bounce", "neutral", "unknown"]


def test_square_of_nine(spark):
    rows = spark.createDataFrame([(0, 100.0, 180), (1, 0.01, 360)], "k int, p double, a int")
    got = rows.orderBy("k").select(cycles.level(C("p"), C("a"), True).alias("u"), cycles.level(C("p"), C("a"), False).alias("d")).collect()
    assert tuple(got[0]) == (121.0, 81.0) and got[1].d is None


def test_hit_rate_known_jump(spark):
    e = bars(spark, [100] * 20 + [115] * 20)
    df = e.withColumn("fwd", (timeframes.forward_high(5) - C("close")) / C("close") * 100)
    assert df.filter("fwd IS NOT NULL").count() == 35
    assert column(df, "fwd")[19] >= 10 and column(df, "fwd")[10] < 10


def test_fundamentals_units_and_unknowns(spark):
    q = spark.createDataFrame([(4.5e10, 0.187, 0.162, 45.2), (4.5e10, None, 0.162, 45.2), (None,) * 4, (9e10, 0.187, 0.162, 45.2)], "marketCap double, ebitdaMargins double, returnOnEquity double, debtToEquity double")
    m = quality.fundamentals(quality.fundamentals_metrics(q), settings()).collect()
    assert (m[0].market_cap_cr, m[0].ebitda_margin_pct, m[0].roe_pct, m[0].debt_to_equity) == (4500.0, 18.7, 16.2, 0.45)
    assert [r.passes_fundamentals for r in m] == [True, True, False, False]
    assert m[1].fundamentals_note == "Unverified (missing: ebitda_margin)" and not m[1].fundamentals_data_complete


def test_growth_beta_peg(spark):
    f = spark.createDataFrame([("A", "Total Revenue", dt.date(y, 3, 31), v) for y, v in ((2023, 100.0), (2024, 120.0))] + [("A", "Net Income", dt.date(y, 3, 31), v) for y, v in ((2023, -5.0), (2024, 10.0))], "symbol string, item string, fiscal_year_end date, value double")
    r = quality.yoy_growth(f, quality.GROWTH_ITEMS).first()
    assert r.sales_growth_pct == 20.0 and r.pat_growth_pct is None
    closes = wave(60)
    twice = [100.0]
    for a, b in zip(closes, closes[1:], strict=False):
        twice.append(twice[-1] * (1 + 2 * (b / a - 1)))
    b = bars(spark, twice).withColumn("bench_close", F.element_at(F.array(*[F.lit(x) for x in closes]), F.row_number().over(windows.ordered())))
    assert quality.beta(b).first().beta == 2.0
    got = spark.createDataFrame([(30.0, 40.0), (30.0, -1.0), (None, 5.0)], "pe double, g double").select(quality.peg(C("pe"), C("g")).alias("p")).collect()
    assert [x.p for x in got] == [0.75, None, None]


def test_portfolio_takes_screens_not_run_as_passed(spark):
    rows = [("1", "A", 90.0, True, None, None, "x"), ("2", "B", 80.0, True, False, None, "1.5"), ("3", "B", 70.0, True, True, True, "2.5"), ("4", "C", 99.0, False, True, True, "9")]
    r = spark.createDataFrame(rows, "security_code string, sector string, conviction_score double, passes_all_filters boolean, passes_growth_screen boolean, passes_fundamentals boolean, peg string")
    held = quality.portfolio(r, 5)
    assert [(x.security_code, x.weight_pct) for x in held.collect()] == [("1", 50.0), ("3", 50.0)]
    s = quality.portfolio_summary(held).first()
    assert (s.n_holdings, s.n_sectors, s.avg_peg, s.n_peg) == (2, 2, 2.5, 1)


def picks(spark, rows):
    p = spark.createDataFrame(rows, "pick_id string, security_code string, date_logged date, entry_price double, stop_loss double, target double, status string")
    return tables.with_columns(p, tracking.PICKS)


def test_pick_outcomes(spark):
    day = dt.date(2024, 1, 1)
    made, all_bars = [], None
    cases = {"target": ([100, 113], [99, 99]), "stop": ([101, 101], [93, 99]), "both": ([113], [93]), "expired": ([101] * 15, [99] * 15), "open": ([101] * 3, [99] * 3), "late": ([101] * 16 + [113], [99] * 17)}
    for name, (highs, lows) in cases.items():
        made.append((name, name, day, 100.0, 94.0, 112.0, "OPEN"))
        b = bars(spark, [100] * len(highs), code=name, highs=highs, lows=lows, start="2024-01-02")
        all_bars = b if all_bars is None else all_bars.unionByName(b)
    got = {r.pick_id: r for r in tracking.evaluate(picks(spark, made), all_bars).collect()}
    assert (got["target"].status, got["target"].days_held, got["target"].realized_pct) == ("HIT_TARGET", 2, 12.0)
    assert (got["stop"].status, got["stop"].realized_pct) == ("HIT_STOPLOSS", -6.0) and got["both"].status == "HIT_STOPLOSS"
    assert (got["expired"].status, got["expired"].days_held) == ("EXPIRED", 15) and (got["open"].status, got["open"].unrealized_pct) == ("OPEN", 0.0)
    assert got["late"].status == "HIT_TARGET" and got["late"].days_held == 17


def test_log_refuses_open_duplicates_and_upsert_counts(spark):
    r = spark.createDataFrame([("1", "T", 5.0, True), ("2", "U", 4.0, True)], "security_code string, tradingsymbol string, conviction_score double, passes_all_filters boolean")
    for c, k in (("exchange", "string"), ("company_name", "string"), ("universe", "string"), ("instrument_token", "long"), ("close", "double"), ("stop_loss", "double"), ("target", "double"), ("supertrend_stop", "double"), ("conviction_tier", "string"), ("rsi", "double"), ("supertrend_bullish", "boolean"), ("pct_above_sma50", "double")):
        r = r.withColumn(c, F.lit(None).cast(k))
    r = r.withColumn("as_of", F.lit("2024-01-31").cast("date"))
    old = picks(spark, [("1_x", "1", dt.date(2024, 1, 1), 1.0, 1.0, 1.0, "OPEN")])
    assert sorted(x.pick_id for x in tracking.log_picks(old, r, F.lit("2024-01-31")).collect()) == ["1_x", "2_2024-01-31"]
    empty = spark.createDataFrame([], ", ".join(f"{c} {k}" for c, k in tracking.HISTORY.items()))
    once = tracking.upsert(empty, r)
    twice = {x.security_code: x.times_seen for x in tracking.upsert(once, r).collect()}
    assert {x.security_code: x.times_seen for x in once.collect()} == {"1": 1, "2": 1} and twice == {"1": 2, "2": 2}
    status = tracking.annotate(r.withColumn("pct_above_sma50", F.lit(1.0)), once.filter("security_code = '1'")).orderBy("security_code").collect()
    assert [x.recommendation_status for x in status] == [tracking.STILL, tracking.NEW]


def test_name_keys_and_matching(spark):
    names = ["E.I.D.-PARRY (INDIA) LTD.", "T D POWER SYSTEMS LTD.", "ABB INDIA LIMITED", None, "A & B Co"]
    rows = spark.createDataFrame([(k, n) for k, n in enumerate(names)], "k int, n string")
    got = [r.x for r in rows.orderBy("k").select(scalars.name_key(C("n")).alias("x")).collect()]
    assert got == ["EID PARRY", "TD POWER SYSTEMS", "ABB", "", "A B"]
    dump = spark.createDataFrame([("ALPHA BETA GAMMA", 1, "ABG", 11), ("ALPHA BETA GAMMA DELTA", 2, "ABGD", 12), ("ZED", 3, "Z", 13)], "name_key string, pos int, tradingsymbol string, instrument_token long")
    want = spark.createDataFrame([("a", "ALPHA BETA GAMMA"), ("b", "ALPHA BETA"), ("c", "ZOO")], "security_code string, name_key string")
    m = {r.security_code: (r.sym, r.score) for r in mapping.best_names(want, dump).collect()}
    assert m["a"] == ("ABG", 1.0) and m["b"][0] == "ABG" and m["b"][1] == 0.95 and "c" not in m


def test_combined_universes(spark):
    cols = "security_code string, universe string, resolved boolean, tradingsymbol string, exchange string"
    a = spark.createDataFrame([("1", "A", True, "X", "NSE"), ("2", "A", False, None, None)], cols)
    b = spark.createDataFrame([("X", "B", True, "X", "NSE"), ("3", "B", False, None, None)], cols)
    got = sorted((r.security_code, r.universe) for r in mapping.combine(a, b).collect())
    assert got == [("1", "A+B"), ("2", "A"), ("3", "B")]


def test_sources_and_state(spark, tmp_path):
    (tmp_path / "c.csv").write_text("Constituents,Symbol,Macro-Economic Sector\n Alpha Ltd ,0500001,Energy\nAlpha again,0500001,Energy\nBeta,500002,\n")
    u = tables.constituents(spark, str(tmp_path / "c.csv")).orderBy("security_code").collect()
    assert [(r.security_code, r.company_name_raw, r.sector, r.name_key) for r in u] == [("0500001", "Alpha Ltd", "Energy", "ALPHA"), ("500002", "Beta", "Unclassified", "BETA")]
    assert tables.theme_map(spark, str(tmp_path / "none.csv")).count() == 0
    assert tables.read_state(spark, str(tmp_path / "s"), tracking.HISTORY).count() == 0
    path = state.commit(spark.createDataFrame([("1", 2)], "security_code string, times_seen long"), str(tmp_path / "s"), 1)
    assert tables.read_state(spark, path, tracking.HISTORY).first().times_seen == 2
    tables.write_bars(bars(spark, wave(5)), str(tmp_path / "b"), 4)
    assert tables.bars(spark, str(tmp_path / "b")).count() == 5 and tables.fresh(spark, str(tmp_path / "b"), 1).count() == 5


def test_view_keeps_rows_without_a_verdict(spark):
    r = spark.createDataFrame([("1", None), ("2", "distribution_risk"), ("3", "none")], "security_code string, false_move_verdict string")
    assert sorted(x.security_code for x in scan.view(r, no_distribution=True).collect()) == ["1", "3"]


def test_short_series_are_skipped(spark):
    ok, few = scan.enough(bars(spark, wave(59), code="s").unionByName(bars(spark, wave(60), code="l")), 60)
    assert ok.select("security_code").distinct().collect()[0][0] == "l" and few.first().reason == "insufficient_history"


def test_mapping_is_loaded_or_built(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.createDataFrame([("A", True)], "security_code string, resolved boolean")

    path = str(tmp_path / "m")
    assert [mapping.load_or_build(spark, path, build, refresh).count() for refresh in (False, False, True)] == [1, 1, 1] and len(calls) == 2


def test_diagnostics_list_five_errors(spark):
    dims = spark.createDataFrame([(k, None if k == 1 else k) for k in range(8)], "security_code long, instrument_token long")
    bad = spark.createDataFrame([(k, "no bars") for k in range(7)], "security_code long, error string")
    r = scan.diagnostics(dims, dims.limit(0), dims.limit(3), bad).first()
    assert (r.n_universe, r.n_resolved, r.n_ok, r.n_skipped, r.n_failed) == (8, 7, 0, 3, 7) and r.errors == "; ".join(f"{k}: no bars" for k in range(5))


def test_radar_marks_short_series(spark):
    dims = spark.createDataFrame([("1", "One", "S", "U", "ONE", "NSE", 1)], "security_code string, company_name_raw string, sector string, universe string, tradingsymbol string, exchange string, instrument_token long")
    r = timeframes.radar(bars(spark, wave(40)), dims, settings()).first()
    assert r.monthly_insufficient_data and r.monthly_rsi is None and not r.daily_insufficient_data and r.daily_bars_available == 40


def test_asof_matches_brute_force(spark):
    import random

    rng = random.Random(2)
    day = lambda k: dt.date(2024, 1, 1) + dt.timedelta(days=k)
    left = [(c, k, day(rng.randrange(60)) if k % 9 else None) for c in "aab" for k in range(40)]
    right = [(c, day(rng.randrange(0, 60, 3)), float(rng.randrange(100))) for c in "ac" for _ in range(15)]
    frames = spark.createDataFrame(left, "code string, n int, at date"), spark.createDataFrame(right, "code string, day date, v double")
    for direction in ("backward", "forward"):
        for tolerance in (None, 2):
            got = asof.asof(*frames, ["code"], "at", "day", ["day", "v"], direction, None if tolerance is None else F.lit(tolerance))
            want = []
            for c, k, t in left:
                near = [(d, v) for x, d, v in right if x == c and t is not None and ((d <= t) if direction == "backward" else (d >= t)) and (tolerance is None or abs((d - t).days) <= tolerance)]
                want.append((c, k, t, *((max(near) if direction == "backward" else min(near)) if near else (None, None))))
            assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_many_picks_of_a_security_match_brute_force(spark):
    import random

    rng = random.Random(4)
    closes = [100.0]
    for _ in range(400):
        closes.append(closes[-1] * (1 + rng.gauss(0, 0.02)))
    b = bars(spark, closes)
    rows = [tuple(r) for r in b.orderBy("date").select("date", "high", "low", "close").collect()]
    picks = [(f"p{k}", "1", rows[rng.randrange(len(rows))][0] - dt.timedelta(days=rng.randrange(3)), 100.0, 100.0 - rng.random() * 60, 100.0 + rng.random() * 90, "OPEN") for k in range(300)]
    picks.append(("none", "1", rows[-1][0], 1.0, 0.5, None, "OPEN"))
    frame = spark.createDataFrame(picks, "pick_id string, security_code string, date_logged date, entry_price double, stop_loss double, target double, status string")
    want = {}
    for name, _, day, _, stop, target, _ in picks:
        later = [r for r in rows if r[0] > day]
        hit = next(((k + 1, "HIT_STOPLOSS" if low <= stop else "HIT_TARGET", d) for k, (d, high, low, _) in enumerate(later) if low <= stop or target is not None and high >= target), None)
        end = (15, "EXPIRED", later[14][0]) if len(later) >= 15 else (len(later), "OPEN", None)
        if later:
            want[name] = hit or end
    got = {r.pick_id: (r.days_held, r.status, r.exit_date) for r in tracking.evaluate(frame, b, 15, block=16).collect()}
    assert got == want and len({s for _, s, _ in want.values()}) >= 3


def test_a_failed_pick_only_notes_the_error(spark):
    b = bars(spark, wave(80), code="1").unionByName(bars(spark, wave(80), code="2"))
    day = dt.date(2024, 2, 1)
    p = tables.with_columns(spark.createDataFrame([("x", "1", day, 100.0, 1.0, 999.0, "OPEN", "old"), ("y", "2", day, 100.0, 1.0, 999.0, "OPEN", ""), ("z", "1", day, 1.0, 1.0, 2.0, "EXPIRED", "shut")], "pick_id string, security_code string, date_logged date, entry_price double, stop_loss double, target double, status string, signal_notes string"), tracking.PICKS)
    failed = spark.createDataFrame([("1", "no answer")], "security_code string, error string")
    got = {r.pick_id: (r.status, r.signal_notes) for r in tracking.recheck(p, b, settings(), failed).collect()}
    assert got["x"] == ("OPEN", "Update failed: no answer") and got["z"] == ("EXPIRED", "shut") and got["y"][0] == "EXPIRED" and got["y"][1] != ""
    assert [r.pick_id for r in tracking.by_date(p).collect()] == ["x", "y", "z"]


def test_queries_answer_from_the_table_as_it_is(spark, sf, tmp_path):
    """No query keeps anything in the session."""
    from barloom.plans import registry

    path = str(tmp_path / "lineitem.parquet")
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    lines.write.parquet(path)
    before = registry.queries()["s05_bars"](spark, str(tmp_path)).count()
    lines.limit(100).write.mode("overwrite").parquet(path)
    assert registry.queries()["s05_bars"](spark, str(tmp_path)).count() <= 100 < before
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == 0


def _final_plan(df) -> list[str]:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("+- == Initial Plan ==")[0].split("\n")


@pytest.mark.parametrize(("name", "sorts"), [("w23_pipeline", 3), ("t02_top_n", None)])
def test_trades_are_shuffled_once_and_bars_sorted_narrow(spark, sf, name, sorts):
    from barloom.plans import registry

    plan = _final_plan(registry.queries()[name](spark, sf))
    assert sum("FileScan" in x and "l_suppkey" in x for x in plan) == 1
    assert sum("Exchange hashpartitioning(l_suppkey" in x and "Reused" not in x for x in plan) == 1
    assert sorts is None or sum("- Sort [" in x or ") Sort [" in x for x in plan) == sorts


def test_averages_in_given_blocks_and_in_their_own(spark):
    """Blocks that suit one average and not the other."""
    b = bars(spark, wave(400))
    specs = {"e": windows.ema(C("close"), 12), "w": windows.wilder(C("close"), 200)}
    want = windows.smoothed(b, specs).orderBy("date").select("e", "w").collect()
    got = windows.smoothed(windows.dealt(b, 200, "security_code"), specs, blocks=200)
    assert {"__row", "__block"} <= set(got.columns) and not any(c.startswith("__outer") for c in got.columns)
    for x, y in zip(got.orderBy("date").select("e", "w").collect(), want, strict=True):
        assert (x.e, x.w) == pytest.approx((y.e, y.w), rel=1e-12) if y.w is not None else x.w is None


def test_scores_and_texts_round_as_sql_does(spark):
    """Halves: of the product with the power of ten in scores, of what the double is in texts."""
    import random

    import duckdb

    rnd = random.Random(5)
    xs = [63.949999999999996, 2.25, 2.35, 1.15, 82.5, 83.5, 0.05, -0.25, -0.05, 0.0, 0.25, 1e9 + 0.25, 1e15 + 0.5, 1e17, 0.49999999999999994, 1.005, 4503599627370497.5, 1e300]
    xs += [rnd.randrange(-40000, 40000) / 20 for _ in range(400)] + [rnd.randrange(1, 400) / rnd.randrange(1, 400) * 20 for _ in range(400)] + [rnd.randrange(0, 3000) / 16 for _ in range(400)]
    got = spark.createDataFrame([(x,) for x in [*xs, None]], "x double").select(
        "x", scalars.half_away(C("x"), 1).alias("a"), scalars.half_away(C("x"), 2).alias("b"), F.when(F.abs("x") < 1e7, scalars.printed("%.1f%%", C("x"))).alias("c"), F.when(F.abs("x") < 1e7, scalars.printed("of %.0f", C("x"))).alias("d")
    )
    got = {r.x: tuple(r)[1:] for r in got.collect()}
    sql = duckdb.execute("SELECT x, round(x, 1) + 0.0, round(x, 2) + 0.0 FROM (SELECT unnest(?::DOUBLE[]) AS x)", [xs]).fetchall()
    want = {x: (a, b, "%.1f%%" % x if abs(x) < 1e7 else None, "of %.0f" % x if abs(x) < 1e7 else None) for x, a, b in sql}
    assert {x: y for x, y in got.items() if x is not None} == want
    assert got[None][:2] == (None, None)


@pytest.mark.parametrize(("name", "whole", "scans"), [("k02_update_picks", 1, 2), ("a10_portfolio_summary", 2, 2)])
def test_queries_over_several_views_of_bars_share_the_shuffle(spark, sf, name, whole, scans):
    """Trades are shuffled once; picks also read codes and days alone, and the portfolio shuffles those of passing securities."""
    from barloom.plans import registry

    plan = _final_plan(registry.queries()[name](spark, sf))
    reads = [x for x in plan if "FileScan" in x and "l_suppkey" in x]
    assert sum("l_orderkey" in x for x in reads) == whole and len(reads) == scans
    assert not any("Exchange hashpartitioning(security_code#" in x and ", k#" in x for x in plan)


def test_picks_match_only_their_own_codes(spark):
    """Codes of picks are texts, those of bars may be numbers: what is no number, or another text of it, matches nothing."""
    b = bars(spark, [10] * 20 + [5] * 20).withColumn("security_code", C("security_code").cast("long"))
    made = [(f"p{k}", c, dt.date(2024, 1, 1)) for k, c in enumerate(["1", "01", "x", None, str(-(1 << 63))])]
    p = tables.with_columns(spark.createDataFrame(made, "pick_id string, security_code string, date_logged date").withColumns({"entry_price": F.lit(10.0), "stop_loss": F.lit(6.0), "target": F.lit(99.0), "status": F.lit("OPEN")}), tracking.PICKS)
    assert [tuple(r) for r in tracking.evaluate(p, b).select("pick_id", "status", "days_held").collect()] == [("p0", "HIT_STOPLOSS", 20)]
    assert {r.pick_id: r.status for r in tracking.recheck(p, b, settings()).collect()} == {"p0": "HIT_STOPLOSS", "p1": "OPEN", "p2": "OPEN", "p3": "OPEN", "p4": "OPEN"}
