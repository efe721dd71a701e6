"""The full screen: one ranked, explained row per security, and the views over it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.config import Settings
from barloom.functions.scalars import half_away, printed
from barloom.operators import screen, supertrend
from barloom.operators.asof import attach
from barloom.operators.indicators import latest

C = F.col

#: The result's columns, in order.
COLUMNS = (
    "security_code company_name sector universe tradingsymbol exchange instrument_token as_of close rsi adx pct_above_sma50 pct_above_sma200 volume_surge turnover_cr donchian_breakout "
    "dma50_breakout_recent dma200_breakout_recent supertrend_bullish supertrend_flip_recent golden_cross relative_return_20d rs_new_high roc5 roc10 passes_all_filters fail_reasons conviction_score "
    "conviction_tier score_trend score_momentum score_volume score_breakout_quality score_relative_strength score_sector_strength penalties notes explanation stop_loss target risk_pct reward_pct supertrend_stop"
).split()


@dataclass(frozen=True)
class Scan:
    """The ranked table, the enriched bars it came from, and the securities left out."""

    result: DataFrame
    enriched: DataFrame
    skipped: DataFrame


def named(df: DataFrame, dims: DataFrame, exchange: str = "BSE") -> DataFrame:
    """df with the security dimension: name and symbol default to the code, sector to Unclassified, universe to '?'."""
    keep = [c for c in ("security_code", "company_name_raw", "sector", "universe", "tradingsymbol", "exchange", "instrument_token") if c in dims.columns]
    code = C("security_code").cast("string")
    out = df.join(dims.select(*keep), "security_code", "left")
    return out.withColumns(
        {
            "company_name": F.coalesce("company_name_raw", code),
            "sector": F.coalesce("sector", F.lit("Unclassified")),
            "universe": F.coalesce("universe", F.lit("?")),
            "tradingsymbol": F.coalesce("tradingsymbol", code),
            "exchange": F.coalesce("exchange", F.lit(exchange)),
        }
    ).drop("company_name_raw")


def enough(bars: DataFrame, need: int) -> tuple[DataFrame, DataFrame]:
    """(bars of securities with `need` bars at least, the other securities with a reason)."""
    n = F.count(F.lit(1)).over(Window.partitionBy("security_code"))
    few = bars.groupBy("security_code").count().filter(C("count") < need).select("security_code", F.lit("insufficient_history").alias("reason"))
    return bars.withColumn("__n", n).filter(C("__n") >= need).drop("__n"), few


def signals(bars: DataFrame, cfg: Settings, bench: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(latest row of each security with all indicators, enriched bars); Supertrend is folded for the last bar only."""
    last, enriched = latest(bars, cfg, bench)
    return with_supertrend(last, bars, cfg), enriched


def with_supertrend(last: DataFrame, bars: DataFrame, cfg: Settings) -> DataFrame:
    """Rows of securities with the Supertrend of their last bar."""
    s = cfg["filters"]["supertrend"]
    return attach(last, supertrend.latest(bars, s["period"], s["multiplier"], s["flip_lookback_days"]), "security_code")


def run(bars: DataFrame, dims: DataFrame, cfg: Settings, bench: DataFrame | None = None) -> Scan:
    ok, few = enough(bars, cfg["data"]["min_bars"])
    last, enriched = latest(ok, cfg, bench)
    rows = named(with_supertrend(last, ok, cfg), dims)
    rows = rows.withColumns({"__why": screen.reasons(cfg)} | screen.risk(cfg))
    rows = screen.scored(rows, screen.sector_strength(named(last, dims)), cfg)
    rows = rows.withColumns(
        {"passes_all_filters": F.size("__why") == 0, "fail_reasons": F.array_join("__why", ", "), "conviction_score": half_away(C("total"), 1)}
        | {f"score_{n}": half_away(C(f"s_{n}"), 1) for n in (*screen.SCORES, "sector_strength")}
    )
    return Scan(rows.select(*COLUMNS), enriched, few)


def ranked(result: DataFrame) -> DataFrame:
    return result.orderBy(F.desc("conviction_score"), "security_code")


def top(result: DataFrame, n: int) -> DataFrame:
    """The best n rows over all scored ones, with their rank."""
    best = ranked(result).limit(n)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("conviction_score"), "security_code")))


def candidates(result: DataFrame) -> DataFrame:
    return result.filter("passes_all_filters")


def view(result: DataFrame, only_candidates: bool = False, min_score: float | None = None, fundamentals: bool = False, growth: bool = False, no_distribution: bool = False, themes: list[str] | None = None) -> DataFrame:
    """The stack of view filters; a verdict that was not made passes."""
    conds: list[Column] = []
    if only_candidates:
        conds.append(C("passes_all_filters"))
    if min_score is not None:
        conds.append(C("conviction_score") >= min_score)
    if fundamentals:
        conds.append(F.coalesce(C("passes_fundamentals"), F.lit(False)))
    if growth:
        conds.append(F.coalesce(C("passes_growth_screen"), F.lit(False)))
    if no_distribution:
        conds.append(~C("false_move_verdict").eqNullSafe("distribution_risk"))
    if themes is not None:
        conds.append(C("theme").isin(*themes))
    for c in conds:
        result = result.filter(c)
    return result


def conviction_calls(result: DataFrame) -> DataFrame:
    return ranked(result.filter(C("conviction_tier").isin("Very High Conviction", "High Conviction", "Moderate Conviction")))


def tier_counts(result: DataFrame) -> DataFrame:
    return result.groupBy("conviction_tier").agg(F.count(F.lit(1)).alias("n"))


def shown(result: DataFrame, want: list[str]) -> DataFrame:
    """The wanted columns that exist."""
    return result.select(*[c for c in want if c in result.columns])


def cards(result: DataFrame, n: int = 3) -> DataFrame:
    """What a trade card says: entry, risk to reward, and a rationale with fallbacks."""
    facts = F.concat_ws(" - ", printed("RSI %.0f", C("rsi")), F.when(C("adx").isNotNull(), printed("ADX %.0f", C("adx"))), F.when(C("volume_surge").isNotNull(), printed("Volume %.1fx avg", C("volume_surge"))))
    text = lambda c: F.nullif(F.trim(C(c)), F.lit(""))
    entry = F.coalesce(*[C(c) for c in ("entry_price", "close") if c in result.columns])
    rr = F.when(F.coalesce((C("risk_pct") != 0) & (C("reward_pct") != 0), F.lit(False)), half_away(C("reward_pct") / C("risk_pct"), 1))
    rationale = F.coalesce(text("explanation"), text("notes"), F.nullif(facts, F.lit("")), F.lit("Passed all technical filters for the active preset."))
    return top(result, n).select("rank", "security_code", "tradingsymbol", "exchange", entry.alias("entry"), "stop_loss", "target", "risk_pct", "reward_pct", rr.alias("risk_reward"), rationale.alias("rationale"))


def with_theme(result: DataFrame, theme_map: DataFrame) -> DataFrame:
    t = theme_map.select("security_code", "theme")
    return result.join(t, "security_code", "left").withColumn("theme", F.coalesce("theme", F.lit("Unclassified")))


def diagnostics(dims: DataFrame, ok: DataFrame, skipped: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """Counts of a run: universe, resolved, fetched, skipped, failed, and the first five errors of failed(security_code, error)."""
    resolved = C("resolved") if "resolved" in dims.columns else C("instrument_token").isNotNull()
    part = lambda df, kind, error=F.lit(None): df.select(F.lit(kind).alias("kind"), error.cast("string").alias("error"))
    rows = part(dims, "universe").union(part(dims.filter(resolved), "resolved")).union(part(ok.select("security_code").distinct(), "ok")).union(part(skipped, "skipped"))
    if failed is not None:
        rows = rows.union(part(failed, "failed")).union(part(failed.orderBy("security_code").limit(5), "error", F.concat_ws(": ", "security_code", "error")))
    counts = [F.count_if(C("kind") == k).alias(f"n_{k}") for k in ("universe", "resolved", "ok", "skipped", "failed")]
    return rows.agg(*counts, F.array_join(F.sort_array(F.collect_list("error")), "; ").alias("errors"))
