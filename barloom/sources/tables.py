"""Sources and sinks: bars, constituents, instruments, quotes, statements, themes, state tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.scalars import name_key

BASE = ["security_code", "date", "open", "high", "low", "close", "volume"]
_S = T.StringType()


def schema(text: str) -> T.StructType:
    return T.StructType.fromDDL(text)


def bars_from_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of each supplier from its line items. Trades are dealt by security once, before anything is taken from
    them: bars and the windows over them need no further shuffle, and all that one query makes of bars reads the same one."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    columns = "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"
    t = t.select("l_suppkey", "l_shipdate", *columns).repartition("l_suppkey")
    order = F.struct(*columns)
    p = F.col("l_extendedprice") / F.col("l_quantity")
    t = t.select(F.col("l_suppkey").alias("security_code"), F.col("l_shipdate").cast("date").alias("date"), p.alias("p"), order.alias("o"))
    up, down = 1 + F.col("o.l_tax"), 1 - F.col("o.l_discount")
    return t.groupBy("security_code", "date").agg(
        F.min_by(F.col("p") * down * up, "o").alias("open"),
        F.max(F.col("p") * up).alias("high"),
        F.min(F.col("p") * down).alias("low"),
        F.max_by("p", "o").alias("close"),
        F.sum("o.l_quantity").alias("volume"),
    )


def bars_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of each event type's values."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    at = F.struct("ts", "event_id")
    return e.groupBy(F.col("event_type").alias("security_code"), F.date_trunc("hour", "ts").alias("date")).agg(
        F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"), F.count(F.lit(1)).cast("double").alias("volume")
    )


def benchmark(bars: DataFrame) -> DataFrame:
    """Each date's mean close, summed as decimals: the same in every order of the bars. It goes whole to what it is joined with."""
    mean = F.sum(F.col("close").cast("decimal(38,14)")).cast("double") / F.count("close")
    return F.broadcast(bars.groupBy("date").agg(F.when(F.count("close") > 0, mean).alias("bench_close")))


def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The security dimension from suppliers and nations: sector by nation."""
    s, n = spark.read.parquet(f"{sf_dir}/supplier.parquet"), spark.read.parquet(f"{sf_dir}/nation.parquet")
    j = s.join(n, s.s_nationkey == n.n_nationkey, "left")
    return j.select(
        F.col("s_suppkey").alias("security_code"),
        F.col("s_name").alias("company_name_raw"),
        F.coalesce("n_name", F.lit("Unclassified")).alias("sector"),
        F.lit("BY_CODE").alias("universe"),
        F.concat(F.lit("SYM"), F.col("s_suppkey")).alias("tradingsymbol"),
        F.when(F.col("s_suppkey") % 2 == 0, "NSE").otherwise("BSE").alias("exchange"),
        (F.col("s_suppkey") + 1000).alias("instrument_token"),
    )


def _csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text (codes keep leading zeros), with the place of each row."""
    df = spark.read.option("header", True).option("inferSchema", False).csv(path)
    return df.withColumn("__at", F.struct(F.input_file_name(), F.monotonically_increasing_id()))


def _first(df: DataFrame, key: str, order: Column | str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n", "__at")


def keep_first(df: DataFrame, key: str, order: Column | str) -> DataFrame:
    """One row per key: the first in the given order."""
    return _first(df, key, order)


#: Name, code and sector columns of constituent lists by kind: lists of exchange codes, and lists of trading symbols.
LISTS = {"BY_CODE": ("Constituents", "Symbol", "Macro-Economic Sector"), "BY_SYMBOL": ("Company Name", "Symbol", "Industry")}


def constituents(spark: SparkSession, path: str, kind: str = "BY_CODE", tag: str | None = None) -> DataFrame:
    """A constituent list of a kind in LISTS: trimmed codes and names, sector, name key, universe tag; first row of each code
    in the order of files and of rows within them. A row without a code goes from lists of symbols."""
    columns = LISTS[kind]
    df = _csv(spark, path)
    out = df.select(
        F.trim(F.col(f"`{columns[1]}`")).alias("security_code"),
        F.trim(F.col(f"`{columns[0]}`")).alias("company_name_raw"),
        F.trim(F.coalesce(F.col(f"`{columns[2]}`"), F.lit("Unclassified"))).alias("sector"),
        name_key(F.trim(F.col(f"`{columns[0]}`"))).alias("name_key"),
        F.lit(tag or kind).alias("universe"),
        "__at",
    )
    return _first(out.filter("security_code IS NOT NULL") if kind == "BY_SYMBOL" else out, "security_code", "__at")


INSTRUMENTS = "tradingsymbol STRING, exchange_token STRING, instrument_token LONG, name STRING, instrument_type STRING, segment STRING"


def instruments(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """An exchange's instrument dump, equities only, with name keys."""
    reader = spark.read.schema(schema(INSTRUMENTS))
    df = reader.option("header", True).csv(path) if fmt == "csv" else reader.format(fmt).load(path)
    return df.filter("instrument_type = 'EQ'").withColumn("name_key", name_key(F.col("name")))


def instrument_types(dump: DataFrame) -> DataFrame:
    """How many instruments a dump has of each type."""
    return dump.groupBy("instrument_type").agg(F.count(F.lit(1)).alias("n"))


def benchmark_token(dump: DataFrame, symbol: str) -> int:
    """The token of an index; an error if there is none."""
    found = dump.filter((F.col("tradingsymbol") == symbol) & (F.col("segment") == "INDICES")).select("instrument_token").head()
    if found is None:
        raise LookupError(f"no index {symbol}")
    return found.instrument_token


def bars(spark: SparkSession, path: str) -> DataFrame:
    """Stored bars (Parquet)."""
    return spark.read.parquet(path).select(*BASE)


def write_bars(df: DataFrame, path: str, buckets: int = 64) -> None:
    """Bars in `buckets` folders by a hash of the security, so one security reads one folder."""
    df.withColumn("bucket", F.pmod(F.xxhash64("security_code"), F.lit(buckets))).repartition("bucket").sortWithinPartitions("security_code", "date").write.mode("overwrite").partitionBy("bucket").parquet(path)


def fresh(spark: SparkSession, path: str, hours: float) -> DataFrame:
    """The rows of files changed within the last `hours`: a time-to-live for cached tables."""
    df = spark.read.parquet(path)
    return df.filter(F.col("_metadata.file_modification_time") >= F.current_timestamp() - F.expr(f"INTERVAL {int(hours * 3600)} SECONDS"))


QUOTE = "marketCap DOUBLE, ebitdaMargins DOUBLE, returnOnEquity DOUBLE, debtToEquity DOUBLE, trailingPE DOUBLE"


def quotes(spark: SparkSession, path: str) -> DataFrame:
    """Quote info by symbol (JSON lines with a symbol)."""
    return spark.read.schema(schema("symbol STRING, " + QUOTE)).json(path)


def statements(spark: SparkSession, path: str) -> DataFrame:
    """Income statements in long form."""
    return spark.read.schema(schema("symbol STRING, item STRING, fiscal_year_end DATE, value DOUBLE")).json(path)


THEMES = ("security_code", "tradingsymbol", "company_name", "theme")


def theme_map(spark: SparkSession, path: str) -> DataFrame:
    """The theme of each security; a missing file is an empty table, missing columns are NULL."""
    from pyspark.errors import AnalysisException

    try:
        df = spark.read.option("header", True).csv(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema(", ".join(f"{c} STRING" for c in THEMES)))
    return with_columns(df, dict.fromkeys(THEMES, "string"))


def with_columns(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """df with exactly these columns; those it lacks are NULL."""
    return df.select(*[F.col(c).cast(k).alias(c) if c in df.columns else F.lit(None).cast(k).alias(c) for c, k in kinds.items()])


def read_state(spark: SparkSession, path: str, kinds: dict[str, str]) -> DataFrame:
    """A state table, its columns filled up; empty where nothing was written yet."""
    from pyspark.errors import AnalysisException

    try:
        return with_columns(spark.read.parquet(path), kinds)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER" not in str(e):
            raise
        return spark.createDataFrame([], schema(", ".join(f"{c} {k}" for c, k in kinds.items())))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
