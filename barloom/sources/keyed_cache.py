"""Answers of a service by key, kept for a time: an append-only Parquet table and a fetch of what it lacks.

Each call finds the keys without a fresh answer by an anti-join on the age of their files, fetches those alone, one after
the other within each task, and appends them in one write; the answer of a key is the newest one. Errors are rows too. They
count as answers for their time only with `keep_errors`; else the next call asks again.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.session import scratch

C = F.col
ROW = "key STRING, answer STRING, error STRING"
#: Hours that answers last: instrument dumps, quotes, yearly statements.
DUMP_HOURS, QUOTE_HOURS, STATEMENT_HOURS = 24, 24 * 7, 24 * 30
Service = Callable[[str], object]


def stored(spark: SparkSession, home: str) -> DataFrame:
    """key, answer (JSON), error, at: every row ever written; empty where nothing was."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(ROW).parquet(home).select("key", "answer", "error", C("_metadata.file_modification_time").alias("at"))
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], ROW + ", at TIMESTAMP")


def fresh(rows: DataFrame, hours: float, keep_errors: bool) -> DataFrame:
    """The newest answer of each key that is younger than `hours`."""
    young = C("at") >= F.current_timestamp() - F.expr(f"INTERVAL {int(hours * 3600)} SECONDS")
    good = rows.filter(young if keep_errors else young & C("error").isNull())
    return good.groupBy("key").agg(F.max_by(F.struct("answer", "error", "at"), "at").alias("x")).select("key", "x.answer", "x.error", "x.at")


def cached(keys: DataFrame, home: str, service: Service, hours: float, keep_errors: bool = False, parts: int = 8) -> DataFrame:
    """key, answer, error, at of the keys (first column of keys). `service` returns what is stored as JSON, or raises."""
    spark = keys.sparkSession
    wanted = keys.select(C(keys.columns[0]).cast("string").alias("key")).filter("key IS NOT NULL").distinct()

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            names, answers, errors = part.column(0).to_pylist(), [], []
            for key in names:
                try:
                    answers.append(json.dumps(service(key), default=str))
                    errors.append(None)
                except Exception as e:  # services raise what they like; the row says what
                    answers.append(None)
                    errors.append(str(e) or type(e).__name__)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(answers, pa.string()), pa.array(errors, pa.string())], ["key", "answer", "error"])

    # what is known is pinned before the write, so that the anti-join and the answers below see the same
    lacking = wanted.join(fresh(stored(spark, home), hours, keep_errors).select("key"), "key", "left_anti")
    if not lacking.isEmpty():
        aside = scratch(spark, "asked")
        lacking.write.parquet(aside)
        spark.read.schema("key STRING").parquet(aside).repartition(parts).mapInArrow(ask, ROW).write.mode("append").parquet(home)
    return fresh(stored(spark, home), hours, True).join(wanted, "key", "left_semi")


def values(rows: DataFrame, kinds: str) -> DataFrame:
    """rows with their JSON answers as columns of the given types; NULL where there is an error."""
    return rows.select("key", F.from_json("answer", kinds).alias("x"), "error").select("key", "x.*", "error")


def quotes(keys: DataFrame, home: str, service: Service, kinds: str, hours: float = QUOTE_HOURS) -> DataFrame:
    """Quote info by symbol; a failed symbol is asked again by the next call."""
    return values(cached(keys, home, service, hours), kinds)


def statements(keys: DataFrame, home: str, service: Service, kinds: str, hours: float = STATEMENT_HOURS) -> DataFrame:
    """Statement figures by symbol; a failed symbol counts as known to be missing until its time is over."""
    return values(cached(keys, home, service, hours, keep_errors=True), kinds)


def dump(spark: SparkSession, exchange: str, home: str, service: Service, kinds: str, hours: float = DUMP_HOURS, refresh: bool = False) -> DataFrame:
    """An exchange's instruments (a list of records) as rows; an error is raised, as nothing can be done without them."""
    rows = cached(spark.createDataFrame([(exchange,)], "key STRING"), home, service, 0 if refresh else hours, parts=1)
    if refresh or hours == 0:
        rows = fresh(stored(spark, home), hours or 24 * 365, False).filter(C("key") == exchange)
    first = rows.select("error").head()
    if first is None or first.error is not None:
        raise LookupError(f"no instruments of {exchange}: {first.error if first else 'none'}")
    each: Column = F.inline(F.from_json("answer", f"ARRAY<STRUCT<{', '.join(f'{n}: {k}' for n, k in (c.split() for c in kinds.split(', ')))}>>"))
    return rows.select(each)
