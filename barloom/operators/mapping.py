"""Symbol mapping: constituents to instruments by code, by symbol, and by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.operators import name_match
from barloom.sources.tables import keep_first

C = F.col
MIN_CONFIDENCE = 0.82
#: Reasons by default: of the code lookup (no row, sure by name, unsure), and of the symbol lookup (found, no row).
CODE_REASONS = ("security_code_not_found_in_dump", "matched_nse_by_name", "no_confident_nse_match_using_bse")
SYMBOL_REASONS = ("exact_nse_symbol_match", "symbol_not_found_in_nse_dump")
COLUMNS = ("company_name_raw", "security_code", "sector", "universe", "resolved", "reason", "exchange", "tradingsymbol", "instrument_token", "bse_instrument_token", "match_confidence")


def best_names(wanted: DataFrame, dump: DataFrame) -> DataFrame:
    """security_code and the best row of dump(name_key, pos, tradingsymbol, instrument_token) by name.

    Equal keys score 1. Others are compared within the block of their first word: the similarity ratio, at least 0.95
    where the words of one key begin those of the other; ties go to the earlier row.
    """
    d = dump.filter("name_key <> ''").select(C("name_key").alias("name"), "pos", C("tradingsymbol").alias("sym"), C("instrument_token").cast("long").alias("token"))
    w = wanted.filter("name_key <> ''").select(C("security_code").cast("string").alias("security_code"), C("name_key").alias("name"))
    first = d.groupBy("name").agg(F.min(F.struct("pos", "sym", "token")).alias("r"))
    exact = w.join(first, "name").select("security_code", "r.sym", "r.token", F.lit(1.0).alias("score"))
    rest = w.join(first.select("name"), "name", "left_anti")
    return exact.unionByName(name_match.closest(rest, d).drop("compared"))


def by_code(universe: DataFrame, bse: DataFrame, nse: DataFrame, min_confidence: float = MIN_CONFIDENCE, tag: str = "BY_CODE", reasons: tuple[str, str, str] = CODE_REASONS) -> DataFrame:
    """Constituents to BSE rows by exchange token, then to the best NSE row by the BSE row's name key; below the
    confidence the BSE line stays. Dumps have name_key and pos (their order)."""
    b = keep_first(bse, "exchange_token", "pos").select("exchange_token", C("name_key").alias("bk"), C("tradingsymbol").alias("bsym"), C("instrument_token").alias("btoken"))
    u = universe.join(b, C("security_code") == C("exchange_token"), "left")
    m = best_names(u.filter("exchange_token IS NOT NULL").select("security_code", C("bk").alias("name_key")), nse)
    j = u.join(m, "security_code", "left")
    found = C("exchange_token").isNotNull()
    sure = F.coalesce(C("score") >= min_confidence, F.lit(False))
    return j.select(
        "company_name_raw",
        "security_code",
        "sector",
        F.lit(tag).alias("universe"),
        found.alias("resolved"),
        F.when(~found, reasons[0]).when(sure, reasons[1]).otherwise(reasons[2]).alias("reason"),
        F.when(found, F.when(sure, "NSE").otherwise("BSE")).alias("exchange"),
        F.when(found, F.when(sure, C("sym")).otherwise(C("bsym"))).alias("tradingsymbol"),
        F.when(found, F.when(sure, C("token")).otherwise(C("btoken"))).alias("instrument_token"),
        F.when(found, C("btoken")).alias("bse_instrument_token"),
        F.when(found, F.round(F.coalesce("score", F.lit(0.0)), 3)).otherwise(0.0).alias("match_confidence"),
    )


def by_symbol(universe: DataFrame, nse: DataFrame, tag: str = "BY_SYMBOL", reasons: tuple[str, str] = SYMBOL_REASONS) -> DataFrame:
    """Constituents to NSE rows by trading symbol."""
    n = keep_first(nse, "tradingsymbol", "pos").select("tradingsymbol", "instrument_token")
    j = universe.join(n, C("security_code") == C("tradingsymbol"), "left")
    found = C("tradingsymbol").isNotNull()
    return j.select(
        "company_name_raw",
        "security_code",
        "sector",
        F.lit(tag).alias("universe"),
        found.alias("resolved"),
        F.when(found, reasons[0]).otherwise(reasons[1]).alias("reason"),
        F.when(found, "NSE").alias("exchange"),
        "tradingsymbol",
        "instrument_token",
        F.lit(None).cast("long").alias("bse_instrument_token"),
        F.when(found, 1.0).otherwise(0.0).alias("match_confidence"),
    )


def combine(*mappings: DataFrame) -> DataFrame:
    """All mappings in one: rows of the same instrument become the first of them, with the universe tags joined by '+';
    unresolved rows stay as they are."""
    out = None
    for k, m in enumerate(mappings):
        part = m.withColumn("__at", F.lit(k))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    same = F.when(C("resolved"), F.concat(F.coalesce("tradingsymbol", F.lit("")), F.lit("@"), F.coalesce("exchange", F.lit(""))))
    out = out.withColumn("__k", F.coalesce(same, F.concat(F.lit("\0"), C("__at").cast("string"), F.lit("\0"), F.coalesce(C("security_code").cast("string"), F.lit("")))))
    tags = out.groupBy("__k").agg(F.array_join(F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("__at", "security_code", "universe"))), lambda x: x["universe"])), "+").alias("__tags"))
    first = out.withColumn("__n", F.row_number().over(Window.partitionBy("__k").orderBy("__at", "security_code"))).filter((C("__n") == 1) | ~C("resolved"))
    return first.join(tags, "__k").withColumn("universe", F.when(C("resolved"), C("__tags")).otherwise(C("universe"))).drop("__k", "__at", "__n", "__tags")


def resolved(mapping: DataFrame) -> DataFrame:
    return mapping.filter("resolved")


def load_or_build(spark: SparkSession, path: str, build: Callable[[], DataFrame], refresh: bool = False) -> DataFrame:
    """The mapping stored at path (Parquet); built and written there first if there is none, or to refresh it."""
    from pyspark.errors import AnalysisException

    if not refresh:
        try:
            return spark.read.parquet(path)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def low_confidence(mapping: DataFrame, below: float = 0.9) -> DataFrame:
    return mapping.filter(C("resolved") & (C("match_confidence") < below))
