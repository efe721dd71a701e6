"""Cutting lineage in a folder that the driver and every executor share."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache, wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session. Where none is set: one under /tmp in local mode, an error on a cluster."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        home = spark.conf.get("spark.checkpoint.dir", None)
        if home is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(home or "/tmp/checkpoints")
    return sc.getCheckpointDir()


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder wherever it lies."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame, parts: int | None = None) -> DataFrame:
    """A reliable checkpoint, in at most `parts` files: lost executors cost nothing. The files go when the frame is
    collected, if the session sets spark.cleaner.referenceTracking.cleanCheckpoints.

    A checkpoint keeps Catalyst's size estimate, which multiplies with every join: over many rounds its digits alone take
    minutes to multiply. Past 2^100 the frame is made anew from the checkpoint's rows, without an estimate."""
    spark = df.sparkSession
    shared_dir(spark)
    done = (df if parts is None else df.coalesce(parts)).checkpoint(eager=True)
    if int(str(done._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > 1 << 100:
        done = DataFrame(spark._jsparkSession.createDataFrame(done._jdf.javaRDD(), done._jdf.schema()), spark)
    return done


def even(column: str) -> Column:
    """A number from 0 to 1 by the column's hash, evenly spread over any number of rows: for samples by share."""
    return (F.xxhash64(column).cast("double") / 2.0**63 + 1) / 2


def few(df: DataFrame) -> int:
    """Partitions for frames that are much smaller than the input df, such as ids and pairs: one for every 16 MB of the
    input, 4 at least, and no more than the session's shuffles have."""
    return min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), max(4, input_bytes(df) >> 24))


def text_batches(spark: SparkSession, rows: int = 1000, size: int = 32 << 20) -> None:
    """Holds Arrow batches of this session to `rows` rows and about `size` bytes from now on (frames run later, so the
    setting stays): a batch of whole texts, however long, or of two texts a row, then stays small in every Python worker;
    a longer text is a batch of its own."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = _bytes(spark.conf.get(key))
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


def _bytes(setting: str) -> int:
    """A number, or a size such as 64MB."""
    found = re.fullmatch(r"(-?\d+)\s*([kmgt]?)i?b?", setting.strip().lower())
    return int(found[1]) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[found[2]] if found else 0


def input_bytes(df: DataFrame) -> int:
    """About the compressed size of df(text): Catalyst's estimate for files just read; where it knows none (frames
    made in memory, joins), half the bytes of the texts, counted."""
    guess = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if guess < 1 << 50:
        return guess
    return (df.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0) // 2


#: What Python workers keep from task to task: module -> functions that let it go.
_KEPT: dict[str, list[Callable[[], None]]] = {}


def kept_in_worker(f: Callable) -> Callable:
    """A cached function whose values stay in a Python worker while it runs tasks of the function's own module."""
    out = lru_cache(maxsize=2)(f)
    _KEPT.setdefault(f.__module__, []).append(out.cache_clear)
    return out


def let_go(module: str) -> None:
    """Clears what other modules keep in this worker."""
    for other, clear in _KEPT.items():
        if other != module:
            for c in clear:
                c()


def lean(f: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """For functions over Arrow batches: a Python worker outlives its task. What other operators keep in it goes when a task
    of this one begins, and what the task has freed goes back to the machine when it ends."""

    @wraps(f)
    def run(batches: Iterator) -> Iterator:
        from barloom.llm import _store

        _store.let_go(f.__module__)
        try:
            yield from f(batches)
        finally:
            import ctypes

            import pyarrow as pa

            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # a C library without it
                pass

    return run


def own_names(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """For operators that give documents back with their columns: whatever these are called, inside they have names that
    clash with none of the operator's."""

    @wraps(f)
    def run(docs: DataFrame, *more, **named) -> DataFrame:
        names = docs.columns
        inside = docs.toDF(*[c if c in ("doc_id", "text", "n_chars") else f"own{k}" for k, c in enumerate(names)])
        return f(inside, *more, **named).toDF(*names)

    return run
