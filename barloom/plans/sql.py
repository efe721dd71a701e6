"""DuckDB SQL for the engine's queries, written against the source tables: common table expressions and their selects."""

from __future__ import annotations

TRADES = """
trades AS (SELECT l_suppkey AS security_code, CAST(l_shipdate AS DATE) AS date, l_extendedprice / l_quantity AS p, l_discount AS d, l_tax AS t, l_quantity AS q,
  {'a': l_orderkey, 'b': l_linenumber, 'c': l_partkey, 'd': l_quantity, 'e': l_extendedprice, 'f': l_discount, 'g': l_tax} AS o FROM lineitem),
bars AS (SELECT security_code, date, arg_min(p * (1 - d) * (1 + t), o) AS open, max(p * (1 + t)) AS high, min(p * (1 - d)) AS low, arg_max(p, o) AS close, sum(q) AS volume FROM trades GROUP BY ALL)"""

DIMS = """
dims AS (SELECT s_suppkey AS security_code, s_name AS company_name, coalesce(n_name, 'Unclassified') AS sector, 'BY_CODE' AS universe, 'SYM' || s_suppkey AS tradingsymbol,
  CASE WHEN s_suppkey % 2 = 0 THEN 'NSE' ELSE 'BSE' END AS exchange, s_suppkey + 1000 AS instrument_token FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey)"""

BENCH = "bench AS (SELECT date, avg(close) AS bench_close FROM bars GROUP BY date)"


def ew(x: str, alpha: str, need: int, start: int, key: str) -> str:
    """An exponential average whose input starts at row `start` (counted from 0)."""
    i, w = f"(idx - {start})", f"OVER (PARTITION BY {key} ORDER BY date ROWS UNBOUNDED PRECEDING)"
    return f"CASE WHEN {i} + 1 >= {need} THEN pow(1 - {alpha}, {i}) * sum(CASE WHEN {i} = 0 THEN {x} WHEN {i} > 0 THEN {alpha} * {x} * pow(1 - {alpha}, -{i}) END) {w} END"


def full(agg: str, x: str, a: int, b: int, key: str, need: int | None = None) -> str:
    side = lambda n: f"{-n} PRECEDING" if n < 0 else "CURRENT ROW" if n == 0 else f"{n} FOLLOWING"
    w = f"OVER (PARTITION BY {key} ORDER BY date ROWS BETWEEN {side(a)} AND {side(b)})"
    return f"CASE WHEN count({x}) {w} >= {need or b - a + 1} THEN {agg}({x}) {w} END"


def enriched(source: str = "bars", key: str = "security_code", bench: bool = True, name: str = "enr") -> str:
    """CTEs that end in `name`: source with every indicator at default settings."""
    w = f"(PARTITION BY {key} ORDER BY date)"
    p = name
    lag = lambda x, n=1: f"lag({x}, {n}) OVER {w}"
    ten = "1.0 / 14"
    roc = lambda x, n: f"({x} / {lag(x, n)} - 1) * 100"
    cross = lambda m, k: f"coalesce(max(CASE WHEN x{m} THEN 1 ELSE 0 END) OVER (PARTITION BY {key} ORDER BY date ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW), 0) = 1"
    joined = f"SELECT e.*, last_value(b.bench_close IGNORE NULLS) OVER (PARTITION BY {key} ORDER BY e.date ROWS UNBOUNDED PRECEDING) AS bench_close FROM {p}6 e LEFT JOIN bench b ON e.date = b.date" if bench else f"SELECT *, CAST(NULL AS DOUBLE) AS bench_close FROM {p}6"
    return f"""
{p}0 AS (SELECT *, row_number() OVER {w} - 1 AS idx, {lag('close')} AS pc, {lag('high')} AS ph, {lag('low')} AS pl FROM {source}),
{p}1 AS (SELECT *, close - pc AS dif, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr, coalesce(CASE WHEN high - ph > pl - low AND high - ph > 0 THEN high - ph END, 0.0) AS pdm,
  coalesce(CASE WHEN pl - low > high - ph AND pl - low > 0 THEN pl - low END, 0.0) AS mdm, (close - low) / nullif(high - low, 0) AS cs FROM {p}0),
{p}2 AS (SELECT *, {ew('greatest(dif, 0)', ten, 14, 1, key)} AS ag, {ew('greatest(-dif, 0)', ten, 14, 1, key)} AS al, {ew('tr', ten, 14, 0, key)} AS atr, {ew('tr', '0.1', 10, 0, key)} AS atr10,
  {ew('pdm', ten, 14, 0, key)} AS sp, {ew('mdm', ten, 14, 0, key)} AS sm, {ew('close', '2.0 / 13', 12, 0, key)} AS ema12, {ew('close', '2.0 / 27', 26, 0, key)} AS ema26,
  {full('avg', 'close', -49, 0, key)} AS sma50, {full('avg', 'close', -199, 0, key)} AS sma200, {full('max', 'high', -20, -1, key)} AS donchian_high, {full('min', 'low', -20, -1, key)} AS donchian_low,
  volume / nullif({full('avg', 'volume', -20, -1, key)}, 0) AS volume_surge, avg(cs) OVER (PARTITION BY {key} ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS close_strength,
  avg(close * volume) OVER (PARTITION BY {key} ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) / 1e7 AS turnover_cr,
  sum(coalesce(sign(dif), 0) * volume) OVER (PARTITION BY {key} ORDER BY date ROWS UNBOUNDED PRECEDING) AS obv,
  {roc('close', 3)} AS roc3, {roc('close', 5)} AS roc5, {roc('close', 10)} AS roc10, {roc('close', 20)} AS roc20 FROM {p}1),
{p}3 AS (SELECT *, coalesce(100 - 100 / (1 + ag / nullif(al, 0)), 100.0) AS rsi, atr / close * 100 AS atr_pct, 100 * sp / nullif(atr, 0) AS plus_di, 100 * sm / nullif(atr, 0) AS minus_di, ema12 - ema26 AS macd,
  coalesce(close > donchian_high, false) AS donchian_breakout, (close / sma50 - 1) * 100 AS pct_above_sma50, (close / sma200 - 1) * 100 AS pct_above_sma200, obv - {lag('obv', 20)} AS obv_slope20,
  close > sma50 AND pc <= {lag('sma50')} AS x50, close > sma200 AND pc <= {lag('sma200')} AS x200 FROM {p}2),
{p}4 AS (SELECT *, 100 * abs(plus_di - minus_di) / nullif(plus_di + minus_di, 0) AS dx, {ew('macd', '0.2', 9, 25, key)} AS macd_signal, atr_pct - {lag('atr_pct', 20)} AS atr_pct_chg20,
  {cross('50', 5)} AS dma50_breakout_recent, {cross('200', 10)} AS dma200_breakout_recent FROM {p}3),
{p}5 AS (SELECT *, {ew('dx', ten, 14, 13, key)} AS adx, macd - macd_signal AS macd_hist FROM {p}4),
{p}6 AS (SELECT * FROM {p}5),
{p}7 AS ({joined}),
{p}8 AS (SELECT *, close / bench_close AS rs_line FROM {p}7),
{p}9 AS (SELECT *, {full('max', 'rs_line', -62, 0, key, 20)} AS rs_line_high63, {roc('rs_line', 20)} AS rs_roc20, roc20 - {roc('bench_close', 20)} AS relative_return_20d FROM {p}8),
{p} AS (SELECT *, coalesce(rs_line >= rs_line_high63, false) AS rs_new_high FROM {p}9)"""


SUPERTREND = """
stb AS (SELECT security_code, date, idx, close, (high + low) / 2 + 3 * atr10 AS u, (high + low) / 2 - 3 * atr10 AS l FROM enr),
st0 AS (SELECT security_code, idx, u AS fu, l AS fl, true AS upper, close FROM stb WHERE idx = 10
  UNION ALL SELECT security_code, idx, nfu, nfl, CASE WHEN upper OR fu = fl THEN close <= nfu ELSE close < nfl END, close FROM (
    SELECT b.security_code, b.idx, b.close, s.upper, s.fu, s.fl, CASE WHEN b.u < s.fu OR s.close > s.fu THEN b.u ELSE s.fu END AS nfu, CASE WHEN b.l > s.fl OR s.close < s.fl THEN b.l ELSE s.fl END AS nfl
    FROM st0 s JOIN stb b ON b.security_code = s.security_code AND b.idx = s.idx + 1)),
st1 AS (SELECT b.security_code, b.date, b.idx, CASE WHEN s.upper THEN s.fu ELSE s.fl END AS supertrend, coalesce(NOT s.upper, false) AS supertrend_bullish FROM stb b LEFT JOIN st0 s USING (security_code, idx)),
st2 AS (SELECT *, supertrend_bullish AND NOT lag(supertrend_bullish, 1, false) OVER (PARTITION BY security_code ORDER BY date) AS flip FROM st1),
st AS (SELECT *, max(CASE WHEN flip THEN 1 ELSE 0 END) OVER (PARTITION BY security_code ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) = 1 AS supertrend_flip_recent FROM st2)"""

SNAPSHOT = """
cnt AS (SELECT security_code, count(*) AS n FROM bars GROUP BY security_code),
snap AS (SELECT e.*, e.date AS as_of, coalesce(sma50 > sma200, false) AS golden_cross, coalesce(close > sma50, false) AS price_above_50, coalesce(close > sma200, false) AS price_above_200,
  s.supertrend, s.supertrend_bullish, s.supertrend_flip_recent, d.company_name, d.sector, d.universe, d.tradingsymbol, d.exchange, d.instrument_token
  FROM enr e JOIN st s USING (security_code, date) JOIN dims d USING (security_code) JOIN cnt USING (security_code) WHERE n >= 60 QUALIFY row_number() OVER (PARTITION BY security_code ORDER BY e.date DESC) = 1)"""

SCORES = """
med AS (SELECT sector, list_sort(list(relative_return_20d)) AS xs FROM snap WHERE relative_return_20d IS NOT NULL GROUP BY sector),
sec AS (SELECT sector, xs[len(xs) // 2 + 1] AS sector_median, (row_number() OVER (ORDER BY xs[len(xs) // 2 + 1], sector) - 1) * 100.0 / greatest(count(*) OVER () - 1, 1) AS sector_score FROM med),
sc0 AS (SELECT snap.*, coalesce(sector_score, 50.0) AS s_sector_strength,
  CAST(30 * price_above_50::INT + 25 * price_above_200::INT + 25 * golden_cross::INT + 20 * supertrend_bullish::INT AS DOUBLE) AS s_trend,
  least(100, greatest(0, 0.5 * CASE WHEN rsi < 50 THEN 0 WHEN rsi < 60 THEN (rsi - 50) / 10 * 70 WHEN rsi <= 75 THEN 100 WHEN rsi <= 85 THEN 100 - (rsi - 75) / 10 * 40 ELSE 40 END
    + 0.25 * CASE WHEN macd_hist > 0 THEN 100 ELSE 0 END + 0.25 * coalesce(least(100, greatest(0, roc10 * 5)), 0))) AS s_momentum,
  0.7 * CASE WHEN volume_surge < 1 THEN greatest(volume_surge, 0) * 50 WHEN volume_surge < 1.5 THEN 50 + (volume_surge - 1) / 0.5 * 25 WHEN volume_surge < 2.5 THEN 75 + (volume_surge - 1.5) * 25 ELSE 100 END
    + 0.3 * CASE WHEN obv_slope20 > 0 THEN 100 ELSE 30 END AS s_volume,
  least(100, 40 * donchian_breakout::INT + 20 * dma50_breakout_recent::INT + 20 * supertrend_flip_recent::INT + CASE WHEN atr_pct_chg20 < 0 THEN 10 ELSE 0 END + coalesce(least(10, greatest(0, close_strength * 10)), 0)) AS s_breakout_quality,
  50 * rs_new_high::INT + coalesce(least(1, greatest(0, relative_return_20d / 20)), 0) * 50 AS s_relative_strength,
  CASE WHEN donchian_breakout THEN (close / donchian_high - 1) * 100 ELSE coalesce(pct_above_sma50, 0) END AS pivot_distance
  FROM snap LEFT JOIN sec USING (sector)),
sc1 AS (SELECT *, CAST(CASE WHEN pivot_distance > 12 THEN 15 ELSE 0 END + CASE WHEN rsi > 82 THEN 10 ELSE 0 END AS DOUBLE) AS penalties FROM sc0),
sc2 AS (SELECT *, least(100, greatest(0, (20 * s_trend + 20 * s_momentum + 15 * s_volume + 20 * s_breakout_quality + 15 * s_relative_strength + 10 * s_sector_strength) / 100.0 - penalties)) AS total FROM sc1),
sc AS (SELECT *, CASE WHEN total >= 75 THEN 'Very High Conviction' WHEN total >= 60 THEN 'High Conviction' WHEN total >= 45 THEN 'Moderate Conviction' ELSE 'Watchlist' END AS conviction_tier,
  array_to_string(list_filter([CASE WHEN close < 20 THEN 'price_below_min' END, CASE WHEN turnover_cr < 3 THEN 'turnover_below_min' END, CASE WHEN NOT coalesce(volume_surge >= 1.5, false) THEN 'no_volume_surge' END,
    CASE WHEN NOT dma50_breakout_recent THEN 'no_50dma_breakout' WHEN pct_above_sma50 < 0 THEN '50dma_breakout_too_shallow' END, CASE WHEN rsi IS NULL THEN 'rsi_unavailable' WHEN rsi < 60 OR rsi > 100 THEN 'rsi_out_of_range' END,
    CASE WHEN NOT donchian_breakout THEN 'no_donchian_breakout' END, CASE WHEN NOT golden_cross THEN 'no_golden_cross' END, CASE WHEN NOT price_above_50 THEN 'price_below_50dma' END,
    CASE WHEN NOT price_above_200 THEN 'price_below_200dma' END, CASE WHEN NOT coalesce(adx >= 20, false) THEN 'adx_below_min' END, CASE WHEN NOT supertrend_flip_recent THEN 'no_recent_supertrend_flip' END],
    lambda x: x IS NOT NULL), ', ') AS fail_reasons,
  array_to_string(list_filter([CASE WHEN pivot_distance > 12 THEN printf('Extended %.1f%% above pivot - chasing risk, consider waiting for a pullback.', pivot_distance) END,
    CASE WHEN rsi > 82 THEN printf('RSI %.0f deeply overbought - elevated mean-reversion risk.', rsi) END,
    CASE WHEN golden_cross AND donchian_breakout THEN 'Golden-cross regime + fresh Donchian breakout - textbook momentum setup.' END,
    CASE WHEN NOT rs_new_high THEN 'Not yet at a new relative-strength high vs benchmark - lagging the tape.' END], lambda x: x IS NOT NULL), ' | ') AS notes,
  array_to_string(list_filter([
    CASE WHEN donchian_breakout THEN 'Broke out to a fresh multi-week high' || CASE WHEN volume_surge >= 1.3 THEN printf(' on %.1fx average volume', volume_surge) ELSE '' END || '.'
      WHEN dma50_breakout_recent THEN 'Recently reclaimed its 50-day moving average' || CASE WHEN volume_surge >= 1.3 THEN printf(' on %.1fx average volume', volume_surge) ELSE '' END || '.'
      WHEN volume_surge >= 1.3 THEN 'Trading' || printf(' on %.1fx average volume', volume_surge) || ', though without a fresh breakout trigger.' END,
    CASE WHEN supertrend_flip_recent THEN 'Supertrend just flipped bullish - a fresh trend-following buy signal.' WHEN supertrend_bullish THEN 'Supertrend remains in a bullish regime (green), though not a fresh flip.'
      ELSE 'Supertrend is bearish (red) - the trend-following signal isn''t confirming yet.' END,
    CASE WHEN golden_cross AND price_above_200 THEN 'Trading above both its 50- and 200-day averages in an established uptrend.' WHEN price_above_50 AND NOT price_above_200 THEN 'Above its short-term trend but still below its longer-term 200-day average.'
      WHEN NOT price_above_50 THEN 'Currently below its 50-day average - short-term momentum has cooled.' END,
    CASE WHEN rsi > 82 THEN printf('RSI of %.0f is deeply overbought, raising pullback risk.', rsi) WHEN rsi >= 60 THEN printf('RSI of %.0f shows strong, healthy momentum.', rsi)
      WHEN rsi >= 50 THEN printf('RSI of %.0f shows momentum building but not yet strong.', rsi) ELSE printf('RSI of %.0f shows little momentum right now.', rsi) END,
    CASE WHEN relative_return_20d > 5 THEN printf('Outperforming the broader market by %.1f%% over the past month.', relative_return_20d)
      WHEN relative_return_20d < -5 THEN printf('Lagging the broader market by %.1f%% over the past month.', abs(relative_return_20d)) END], lambda x: x IS NOT NULL), ' ') AS explanation FROM sc2)"""

ALL = ", ".join([TRADES, DIMS, BENCH, enriched()])
SCAN = ", ".join([ALL, SUPERTREND, SNAPSHOT, SCORES])

PERIODS = """
weekly AS (SELECT security_code, CAST(date + CAST((5 - isodow(date) + 7) % 7 AS INT) AS DATE) AS e, * EXCLUDE (security_code) FROM bars),
w AS (SELECT security_code, e AS date, arg_min(open, date) AS open, max(high) AS high, min(low) AS low, arg_max(close, date) AS close, sum(volume) AS volume FROM weekly GROUP BY security_code, e),
m AS (SELECT security_code, last_day(date) AS date, arg_min(open, date) AS open, max(high) AS high, min(low) AS low, arg_max(close, date) AS close, sum(volume) AS volume FROM bars GROUP BY security_code, last_day(date))"""

STACKED = """
stk0 AS (SELECT security_code, 'daily' AS timeframe, date, open, high, low, close, volume FROM bars UNION ALL SELECT security_code, 'weekly', date, open, high, low, close, volume FROM w
  UNION ALL SELECT security_code, 'monthly', date, open, high, low, close, volume FROM m),
stk1 AS (SELECT *, count(*) OVER (PARTITION BY security_code, timeframe) AS bars_available FROM stk0), stk AS (SELECT * FROM stk1 WHERE bars_available >= 30)"""
K2 = "security_code, timeframe"
PRECURSOR = f"""
pre0 AS (SELECT *, 4 * {full('stddev_samp', 'close', -19, 0, K2)} / {full('avg', 'close', -19, 0, K2)} AS bb_width, (donchian_high - close) / donchian_high * 100 AS pct_below_pivot FROM re),
pre1 AS (SELECT *, bb_width - lag(bb_width, 20) OVER (PARTITION BY {K2} ORDER BY date) AS bb_width_chg20, -pct_below_pivot AS pct_from_pivot FROM pre0),
pre AS (SELECT *, coalesce(close <= donchian_high AND pct_below_pivot <= 5 AND atr_pct_chg20 < 0 AND bb_width_chg20 < 0, false) AS is_watch,
  ({full('max', 'high', 1, 15, K2)} - close) / close * 100 AS fwd FROM pre1)"""
RADAR = ", ".join([TRADES, DIMS, PERIODS, STACKED, enriched("stk", K2, False, "re"), PRECURSOR])

WEEK_RSI = f"""
wr0 AS (SELECT *, row_number() OVER (PARTITION BY security_code ORDER BY date) - 1 AS idx, close - lag(close) OVER (PARTITION BY security_code ORDER BY date) AS dif FROM w),
wr1 AS (SELECT *, {ew('greatest(dif, 0)', '1.0 / 14', 14, 1, 'security_code')} AS ag, {ew('greatest(-dif, 0)', '1.0 / 14', 14, 1, 'security_code')} AS al FROM wr0),
wr AS (SELECT security_code, date, coalesce(100 - 100 / (1 + ag / nullif(al, 0)), 100.0) AS w_rsi FROM wr1)"""
NEXT_DAY = ", ".join([TRADES, BENCH, enriched(), PERIODS, WEEK_RSI, """
asof0 AS (SELECT e.*, r.w_rsi AS weekly_rsi FROM enr e ASOF LEFT JOIN (SELECT security_code, date + 1 AS known, w_rsi FROM wr) r ON e.security_code = r.security_code AND r.known <= e.date),
nd0 AS (SELECT *, coalesce(close_strength >= 0.7 AND volume_surge >= 1.5 AND weekly_rsi >= 55, false) AS is_setup, (lead(close) OVER (PARTITION BY security_code ORDER BY date) - close) / close * 100 AS nc,
  (lead(high) OVER (PARTITION BY security_code ORDER BY date) - close) / close * 100 AS nh, (lead(low) OVER (PARTITION BY security_code ORDER BY date) - close) / close * 100 AS nl,
  count(*) OVER (PARTITION BY security_code) AS n_bars FROM asof0), nd AS (SELECT * FROM nd0 WHERE n_bars >= 100)"""])

CANDLES = """
cl AS (SELECT *, lag(open) OVER x AS o1, lag(close) OVER x AS c1, lag(open, 2) OVER x AS o2, lag(close, 2) OVER x AS c2, abs(close - open) AS body, high - greatest(open, close) AS up, least(open, close) - low AS dn
  FROM bars WINDOW x AS (PARTITION BY security_code ORDER BY date)),
candles AS (SELECT security_code, date, coalesce(c1 > o1 AND close < open AND open >= c1 AND close <= o1, false) AS bearish_engulfing, coalesce(c1 < o1 AND close > open AND open <= c1 AND close >= o1, false) AS bullish_engulfing,
  coalesce(up >= 2 * body AND dn <= body AND body > 0, false) AS shooting_star, coalesce(dn >= 2 * body AND up <= body AND body > 0, false) AS hammer,
  coalesce(c2 - o2 > 0 AND abs(c1 - o1) <= 0.3 * (c2 - o2) AND close < open AND close < (o2 + c2) / 2, false) AS evening_star,
  coalesce(o2 - c2 > 0 AND abs(c1 - o1) <= 0.3 * (o2 - c2) AND close > open AND close > (o2 + c2) / 2, false) AS morning_star FROM cl)"""
FALSE_MOVES = ", ".join([ALL, PERIODS, WEEK_RSI, CANDLES, """
fm0 AS (SELECT e.security_code, e.date, e.rsi, e.donchian_breakout, coalesce(e.close < e.donchian_low, false) AS down, c.* EXCLUDE (security_code, date), row_number() OVER (PARTITION BY e.security_code ORDER BY e.date DESC) AS r,
  count(*) OVER (PARTITION BY e.security_code) AS n FROM enr e JOIN candles c USING (security_code, date)),
fm1 AS (SELECT security_code, max(n) AS n, arg_max(rsi, date) AS daily, bool_or(donchian_breakout) AS recent_breakout, bool_or(down) AS recent_breakdown, bool_or(bearish_engulfing) AS be, bool_or(evening_star) AS es,
  bool_or(shooting_star) AS ss, bool_or(bullish_engulfing) AS bu, bool_or(morning_star) AS ms, bool_or(hammer) AS hm FROM fm0 WHERE r <= 3 GROUP BY security_code),
fm2 AS (SELECT fm1.*, weekly, CASE WHEN weekly >= 60 THEN 1 WHEN weekly < 40 THEN -1 WHEN weekly IS NOT NULL THEN 0 END AS wz, CASE WHEN daily >= 60 THEN 1 WHEN daily < 40 THEN -1 WHEN daily IS NOT NULL THEN 0 END AS dz
  FROM fm1 JOIN (SELECT security_code, CASE WHEN count(*) >= 15 THEN arg_max(w_rsi, date) END AS weekly FROM wr GROUP BY security_code) USING (security_code)),
fm AS (SELECT *, CASE WHEN wz IS NULL OR dz IS NULL THEN 'unknown' WHEN wz = 1 AND dz = 1 THEN 'strong_bullish' WHEN wz = 1 AND dz = 0 THEN 'bullish_pullback' WHEN wz = -1 AND dz = -1 THEN 'strong_bearish'
  WHEN wz = -1 AND dz = 0 THEN 'bearish_bounce' ELSE 'neutral' END AS direction_zone,
  array_to_string(list_filter([CASE WHEN be THEN 'bearish_engulfing' END, CASE WHEN es THEN 'evening_star' END, CASE WHEN ss THEN 'shooting_star' END], lambda x: x IS NOT NULL), ', ') AS bearish_patterns,
  array_to_string(list_filter([CASE WHEN bu THEN 'bullish_engulfing' END, CASE WHEN ms THEN 'morning_star' END, CASE WHEN hm THEN 'hammer' END], lambda x: x IS NOT NULL), ', ') AS bullish_patterns FROM fm2)"""])

CYCLES = ", ".join([TRADES, f"""
sw0 AS (SELECT *, max(date) OVER (PARTITION BY security_code) AS today, coalesce({full('max', 'high', -10, 10, 'security_code')} = high, false) AS is_swing_high, coalesce({full('min', 'low', -10, 10, 'security_code')} = low, false) AS is_swing_low,
  max(close) OVER (PARTITION BY security_code ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING) AS mx, min(close) OVER (PARTITION BY security_code ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING) AS mn FROM bars),
pv AS (SELECT security_code, today, 'swing_high' AS anchor_type, max(date) AS anchor_date, arg_max(high, date) AS anchor_price FROM sw0 WHERE is_swing_high AND date >= today - 250 GROUP BY security_code, today
  UNION ALL SELECT security_code, today, 'swing_low', max(date), arg_max(low, date) FROM sw0 WHERE is_swing_low AND date >= today - 250 GROUP BY security_code, today),
gw0 AS (SELECT pv.*, angle_degrees, anchor_date + angle_degrees AS window_date FROM pv, (SELECT CAST(unnest([90, 180, 270, 360]) AS INT) AS angle_degrees)),
gw AS (SELECT * FROM gw0 WHERE window_date BETWEEN today - 30 AND today + 60),
sg AS (SELECT g.security_code, g.anchor_type, g.angle_degrees, min(s.date) AS d FROM gw g JOIN sw0 s ON s.security_code = g.security_code AND s.date >= g.window_date - 3 WHERE g.window_date <= g.today + 3 GROUP BY ALL)"""])
