"""Fundamentals and growth screens with three-valued checks: unknown never fails by itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.config import Settings
from barloom.functions.windows import back, rows
from barloom.operators.indicators import tail

C = F.col


def fundamentals_metrics(quotes: DataFrame) -> DataFrame:
    """Crores, percent and a ratio from raw quote fields; NULL stays NULL."""
    return quotes.withColumns(
        {
            "market_cap_cr": F.round(C("marketCap") / 1e7, 1),
            "ebitda_margin_pct": F.round(C("ebitdaMargins") * 100, 1),
            "roe_pct": F.round(C("returnOnEquity") * 100, 1),
            "debt_to_equity": F.round(C("debtToEquity") / 100, 2),
        }
    )


def verdict(checks: dict[str, Column], strict: bool, prefix: str) -> dict[str, Column]:
    """The checks, <prefix>_data_complete, passes_<prefix>, and a note that lists unknown checks."""
    known = [c.isNotNull() for c in checks.values()]
    complete = _all(known)
    good = _all([F.coalesce(c, F.lit(True)) for c in checks.values()]) & _any(known)
    missing = F.concat_ws(", ", *[F.when(c.isNull(), F.lit(n.removesuffix("_ok"))) for n, c in checks.items()])
    note = F.when(missing != "", F.concat(F.lit("Unverified (missing: "), missing, F.lit(")"))).otherwise("")
    return checks | {f"{prefix}_data_complete": complete, f"passes_{prefix}": good & complete if strict else good, f"{prefix}_note": note}


def _all(cs: list[Column]) -> Column:
    out = cs[0]
    for c in cs[1:]:
        out = out & c
    return out


def _any(cs: list[Column]) -> Column:
    out = cs[0]
    for c in cs[1:]:
        out = out | c
    return out


def fundamentals(metrics: DataFrame, cfg: Settings) -> DataFrame:
    f = cfg["filters"]["fundamentals"]
    checks = {
        "market_cap_ok": C("market_cap_cr") <= f["max_market_cap_cr"],
        "ebitda_margin_ok": C("ebitda_margin_pct").between(f["ebitda_margin_min"], f["ebitda_margin_max"]),
        "roe_ok": C("roe_pct") >= f["min_roe_pct"],
        "debt_to_equity_ok": C("debt_to_equity") <= f["max_debt_to_equity"],
    }
    return metrics.withColumns(verdict(checks, f["require_complete_data"], "fundamentals"))


def yoy_growth(statements: DataFrame, items: dict[str, str]) -> DataFrame:
    """symbol and, for each output name and statement item, the growth of the newest value over the one before it;
    NULL under two values or where the earlier one is not positive."""
    w = Window.partitionBy("symbol", "item").orderBy(F.desc("fiscal_year_end"))
    two = statements.filter(C("value").isNotNull() & C("item").isin(*items.values())).repartition("symbol").withColumn("__n", F.row_number().over(w)).filter("__n <= 2")
    value = lambda item, n: F.max(F.when((C("item") == item) & (C("__n") == n), C("value")))
    g = two.groupBy("symbol").agg(*[value(item, n).alias(f"{name}_{n}") for name, item in items.items() for n in (1, 2)])
    return g.select("symbol", *[F.when(C(f"{name}_2") > 0, F.round((C(f"{name}_1") - C(f"{name}_2")) / C(f"{name}_2") * 100, 1)).alias(name) for name in items])


GROWTH_ITEMS = {"sales_growth_pct": "Total Revenue", "pat_growth_pct": "Net Income"}


def volatility(bars: DataFrame, days: int = 252) -> DataFrame:
    """annualized_volatility_pct over the last `days` closes; NULL under 20 bars or 10 returns."""
    t = tail(bars.select("security_code", "date", "close"), days)
    t = t.withColumn("r", C("close") / back(C("close")) - 1)
    v = F.when((F.count(F.lit(1)) >= 20) & (F.count("r") >= 10), F.round(F.stddev_samp("r") * F.sqrt(F.lit(252.0)) * 100, 1))
    return t.groupBy("security_code").agg(v.alias("annualized_volatility_pct"))


def beta(bars: DataFrame, days: int = 252) -> DataFrame:
    """beta of close against bench_close over the last `days` rows: rows without either are dropped before returns."""
    t = tail(bars.select("security_code", "date", "close", "bench_close"), days)
    both = F.when(C("close").isNotNull() & C("bench_close").isNotNull(), F.struct("close", "bench_close"))
    t = t.withColumn("now", both).withColumn("before", F.last("now", True).over(rows(Window.unboundedPreceding, -1)))
    t = t.withColumns({c: C(f"now.{k}") / C(f"before.{k}") - 1 for c, k in (("x", "close"), ("y", "bench_close"))})
    known = lambda c: F.when(C("x").isNotNull() & C("y").isNotNull(), C(c))
    b = t.groupBy("security_code").agg(F.count(F.lit(1)).alias("n"), F.count(known("x")).alias("m"), F.covar_samp(known("x"), known("y")).alias("c"), F.var_samp(known("y")).alias("v"))
    return b.select("security_code", F.when((C("n") >= 20) & (C("m") >= 10), F.round(C("c") / F.nullif(C("v"), F.lit(0.0)), 2)).alias("beta"))


def peg(pe: Column, growth: Column) -> Column:
    return F.when((pe > 0) & (growth > 0), F.round(pe / growth, 2))


def growth(metrics: DataFrame, cfg: Settings) -> DataFrame:
    """Checks over sales_growth_pct, pat_growth_pct, annualized_volatility_pct, beta and peg."""
    g = cfg["filters"]["growth_quality"]
    checks = {
        "sales_growth_ok": C("sales_growth_pct") >= g["sales_growth_min_pct"],
        "pat_growth_ok": C("pat_growth_pct") >= g["pat_growth_min_pct"],
        "volatility_ok": C("annualized_volatility_pct") <= g["max_annualized_volatility_pct"],
        "beta_ok": C("beta").between(g["min_beta"], g["max_beta"]),
        "peg_ok": C("peg") <= g["max_peg"],
    }
    return metrics.withColumns(verdict(checks, g["require_complete_data"], "growth")).withColumnRenamed("passes_growth", "passes_growth_screen")


def annotate(result: DataFrame, checked: DataFrame, columns: list[str]) -> DataFrame:
    """Screen columns on passing rows only; the others keep NULL, which means not run."""
    passing = result.filter("passes_all_filters").select("security_code")
    return result.join(checked.join(passing, "security_code", "left_semi").select("security_code", *columns), "security_code", "left")


def portfolio(result: DataFrame, n: int = 10) -> DataFrame:
    """The n best passing rows (a screen that was not run passes), equally weighted."""
    ok = C("passes_all_filters") & F.coalesce("passes_growth_screen", F.lit(True)) & F.coalesce("passes_fundamentals", F.lit(True))
    best = result.filter(ok).orderBy(F.desc("conviction_score"), "security_code").limit(n)
    return best.withColumn("weight_pct", F.round(100.0 / F.count(F.lit(1)).over(Window.partitionBy()), 2))


PORTFOLIO_METRICS = ("sales_growth_pct", "pat_growth_pct", "peg", "trailing_pe", "beta", "market_cap_cr", "turnover_cr")


def portfolio_summary(held: DataFrame, digits: int = 2) -> DataFrame:
    """Averages with the number of rows that have data, holdings and sectors; texts that are no numbers count as missing."""
    num = {m: C(m).try_cast("double") for m in PORTFOLIO_METRICS if m in held.columns}
    return held.agg(
        F.count(F.lit(1)).alias("n_holdings"), F.count_distinct("sector").alias("n_sectors"), *[x for m, c in num.items() for x in (F.round(F.avg(c), digits).alias(f"avg_{m}"), F.count(c).alias(f"n_{m}"))]
    )
