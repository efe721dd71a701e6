"""Bars by fetch or cache: a Python data source over one Parquet file a security.

    spark.dataSource.register(FetchedBars)
    spark.read.format("fetched_bars").options(path=..., keys=..., fetch="package.module:function").load()

A file younger than `ttl_hours` is read; one that is older, missing or broken is fetched anew by `fetch(key, first, last,
interval)`, which returns records or an Arrow table with date, open, high, low, close, volume. A failed call is repeated
`retries` times in all, after min(2^k, 8) seconds; an empty answer is a failure. What came is sorted by date, stripped of
its time zone and stored under a name of its own before it is renamed, so a repeated task does no harm. A security that
fails all the same gives one row with its error, and the others go on.

Files are listed once, when the read is planned; filters on security_code leave only those securities to read or fetch
(where the session sets spark.sql.python.filterPushdown.enabled). Partitions take turns in the securities, and each waits as long between
calls as keeps all of them within `requests_per_second`.
"""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date, timedelta
from uuid import uuid4

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

PRICES = ("open", "high", "low", "close", "volume")
SCHEMA = "security_code string, date timestamp, open double, high double, low double, close double, volume double, error string"
_ARROW = pa.schema([("security_code", pa.string()), ("date", pa.timestamp("us", tz="UTC")), *[(c, pa.float64()) for c in PRICES], ("error", pa.string())])


def store(path: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a folder and the folder's path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Wanted:
    """One security: its file's path, and whether the file is fresh."""

    key: str
    file: str
    fresh: bool


class Slice(InputPartition):
    def __init__(self, wanted: list[Wanted]) -> None:
        super().__init__(wanted)
        self.wanted = wanted


def normal(table: pa.Table) -> pa.Table:
    """Bars in order of date, doubles, dates without a zone as UTC microseconds."""
    day = table.column("date")
    if pa.types.is_string(day.type) or pa.types.is_large_string(day.type):
        day = day.cast(pa.timestamp("us"))
    elif pa.types.is_timestamp(day.type) and day.type.tz:
        from pyarrow import compute

        day = compute.local_timestamp(day)
    columns = [day.cast(pa.timestamp("us")), *[table.column(c).cast(pa.float64()) for c in PRICES]]
    return pa.table(columns, names=["date", *PRICES]).sort_by("date")


def save(path: str, key: str, interval: str, table: pa.Table) -> None:
    """Stores a security's bars: written aside, then renamed."""
    files, folder = store(path)
    files.create_dir(folder, recursive=True)
    aside = f"{folder}/.{key}-{uuid4().hex}"
    pq.write_table(table, aside, filesystem=files)
    files.move(aside, f"{folder}/{key}_{interval}.parquet")


def loaded(path: str, file: str) -> pa.Table | None:
    """The bars of a file; None if it can't be read or has none."""
    try:
        table = normal(pq.read_table(file, filesystem=store(path)[0]))
    except Exception:  # whatever is wrong with a cached file, it is fetched anew
        return None
    return table if table.num_rows else None


class FetchedBars(DataSource):
    """Options: path, keys (JSON list; else all securities with a file), fetch, interval (day), ttl_hours (6), history_days
    (400), retries (3), requests_per_second (2.5), partitions (200), today (ISO date; else the system's), pushdown."""

    @classmethod
    def name(cls) -> str:
        return "fetched_bars"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        options = {k.lower(): v for k, v in self.options.items()}
        return (FilteringReader if options.get("pushdown") == "true" else Reader)(options)


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        get = options.get
        self.path, self.interval, self.service = options["path"], get("interval", "day"), get("fetch")
        self.keys = json.loads(options["keys"]) if get("keys") else None
        self.ttl, self.days, self.retries = float(get("ttl_hours", 6)), int(get("history_days", 400)), int(get("retries", 3))
        self.rate, self.slices, self.today = float(get("requests_per_second", 2.5)), int(get("partitions", 200)), get("today")
        self.only: set[str] | None = None

    def partitions(self) -> list[Slice]:
        from pyarrow import fs

        files, folder = store(self.path)
        end, now = f"_{self.interval}.parquet", time.time()
        found = {i.base_name.removesuffix(end): i for i in files.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if i.base_name.endswith(end) and not i.base_name.startswith(".")}
        keys = [str(k) for k in self.keys] if self.keys is not None else sorted(found)
        wanted = [
            Wanted(k, found[k].path if k in found else "", k in found and now - found[k].mtime.timestamp() <= self.ttl * 3600)
            for k in dict.fromkeys(keys)
            if self.only is None or k in self.only
        ]
        n = max(1, min(self.slices, len(wanted)))
        self.pause = n / self.rate if self.rate > 0 else 0.0
        return [Slice(wanted[k::n]) for k in range(n)]

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        last = 0.0
        for w in partition.wanted:
            table = loaded(self.path, w.file) if w.fresh else None
            error = None
            if table is None:
                table, error, last = self._fetched(w.key, last)
            n = 1 if table is None else table.num_rows
            code = pa.array([w.key] * n, pa.string())
            if table is None:
                yield pa.RecordBatch.from_arrays([code, *[pa.nulls(1, f.type) for f in list(_ARROW)[1:-1]], pa.array([error], pa.string())], schema=_ARROW)
                continue
            columns = [table.column("date").cast(pa.timestamp("us", tz="UTC")), *[table.column(c) for c in PRICES]]
            yield from pa.table([code, *columns, pa.nulls(n, pa.string())], schema=_ARROW).to_batches()

    def _fetched(self, key: str, last: float) -> tuple[pa.Table | None, str | None, float]:
        """(bars, error, time of the last call)."""
        error = "no service"
        for attempt in range(self.retries if self.service else 0):
            time.sleep(max(0.0, last + self.pause - time.monotonic()))
            last = time.monotonic()
            try:
                module, _, name = self.service.partition(":")
                until = date.fromisoformat(self.today) if self.today else date.today()
                got = getattr(importlib.import_module(module), name)(key, until - timedelta(days=self.days), until, self.interval)
                table = got if isinstance(got, pa.Table) else pa.Table.from_pylist(list(got))
                if not table.num_rows:
                    raise ValueError("empty answer")
                table = normal(table)
                save(self.path, key, self.interval, table)
                return table, None, last
            except Exception as e:  # services raise what they like; the security's row says what
                error = str(e) or type(e).__name__
                if attempt + 1 < self.retries:
                    time.sleep(min(2**attempt, 8))
        return None, error, last


class FilteringReader(Reader):
    """Takes over filters on security_code."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("security_code",):
                found = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only = found if self.only is None else self.only & found
            else:
                yield f


def history(spark: SparkSession, path: str, keys: list[str] | None = None, **options) -> DataFrame:
    """Bars of the securities by fetch or cache, with `error` set in the one row of each that failed."""
    spark.dataSource.register(FetchedBars)
    options["pushdown"] = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")  # Spark refuses readers that filter without it
    if keys is not None:
        options["keys"] = json.dumps([str(k) for k in keys])
    return spark.read.format("fetched_bars").options(path=path, **{k: str(v) for k, v in options.items()}).load()


def split(fetched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bars, securities that failed with their errors)."""
    return fetched.filter("error IS NULL").drop("error"), fetched.filter("error IS NOT NULL").select("security_code", "error")


def outcomes(fetched: DataFrame, mapping: DataFrame) -> DataFrame:
    """One row for each resolved security of mapping: tradingsymbol, exchange, ok, n_bars, error."""
    by = fetched.groupBy(F.col("security_code").alias("__code")).agg(F.count("date").alias("n_bars"), F.max("error").alias("error"))
    wanted = mapping.filter("resolved").select("security_code", "tradingsymbol", "exchange")
    ok = F.col("error").isNull() & (F.coalesce("n_bars", F.lit(0)) > 0)
    return wanted.join(by, F.col("security_code").cast("string") == F.col("__code"), "left").select("security_code", "tradingsymbol", "exchange", ok.alias("ok"), F.coalesce("n_bars", F.lit(0)).alias("n_bars"), "error")


def write_files(bars: DataFrame, path: str, interval: str = "day") -> int:
    """Stores bars in one file a security, as the source caches them; how many securities there were."""

    def run(table: pa.Table) -> pa.Table:
        save(path, str(table.column("security_code")[0].as_py()), interval, normal(table))
        return pa.table({"n": pa.array([1], pa.int64())})

    done = bars.select("security_code", "date", *PRICES).groupBy("security_code").applyInArrow(run, "n long")
    return done.agg(F.sum("n")).first()[0] or 0
