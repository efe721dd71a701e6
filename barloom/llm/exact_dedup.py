"""Exact deduplication by two-pass Bloom filtering.

Texts are equal when they agree after lower-casing A-Z; SHA-256 of that text stands for it. The texts
are read once: (doc_id, digest) rows are cut to a checkpoint, about 50 bytes a document. Pass 1 writes
each partition's digests as sorted filter positions, merged by filter block into a filter of the
positions that were hit twice. Pass 2 asks the filter: rows that no other row can equal pass straight
through; only the possibly repeated ones are shuffled, pre-aggregated by digest, and joined back; a digest that
many rows have is broadcast to them instead.

The filter has at most `max_bits` bits for each of two hash rows (16 MiB each by default), so what is
broadcast is bounded. Past about max_bits / 8 documents more rows are called "possibly repeated" and
shuffled; results are exact at any load.

Defined results: null text counts as empty; of equal texts the row with the largest doc_id stays; a null
doc_id is smaller than any other; of rows that also share the doc_id, all have the same decision by
doc_id and `kept` is true for each of them; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm import _sketch
from barloom.llm._components import spread_join
from barloom.llm._store import cut, lean, own_names, text_batches

MAX_BITS = 1 << 27
TABLE = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _sums(texts: pa.Array) -> pa.Array:
    import hashlib

    return pa.array([hashlib.sha256((x.as_py() or b"").translate(TABLE)).hexdigest() for x in texts.cast(pa.large_binary())], pa.string())


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, text_sha256) of every row."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            yield pa.RecordBatch.from_arrays([part.column(0), _sums(part.column(1))], ["doc_id", "text_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, text_sha256 string")


def _with_digest(docs: DataFrame) -> DataFrame:
    """docs and the digest of every row as __digest."""
    at = docs.columns.index("text")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            yield pa.RecordBatch.from_arrays([*part.columns, _sums(part.column(at))], [*part.schema.names, "__digest"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("__digest", T.StringType())]))


def _keys(part: pa.RecordBatch, column: int) -> np.ndarray:
    return np.array([int(x[:16], 16) for x in part.column(column).to_pylist()], np.uint64)


def mark(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per document, dropped ones too."""
    spark = docs.sparkSession
    text_batches(spark)
    rows = cut(digests(docs))
    width = _sketch.width_for(rows.count() * 8, max_bits)
    seen = _sketch.build(rows.select("text_sha256"), lambda part: _keys(part, 0), width)

    @lean
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            maybe = _sketch.repeated(seen.value, _keys(part, 1), width)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(maybe)], ["doc_id", "text_sha256", "maybe"])

    asked = cut(rows.mapInArrow(ask, "doc_id long, text_sha256 string, maybe boolean"))
    alone = asked.filter(~F.col("maybe")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    some = asked.filter("maybe").select("doc_id", "text_sha256")
    best = some.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"), F.count(F.lit(1)).alias("rows"))
    joined = spread_join(some, best, "text_sha256", "rows").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
    return alone.unionByName(joined)


@own_names
def drop_copies(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """docs without the rows that `mark` drops, columns unchanged.

    Only rows with the doc_id of a dropped one are shuffled, to be joined by doc_id and digest, as a null or repeated doc_id
    may also stand on a text that stays; a filter of the dropped ids lets all other rows pass straight through.
    """
    text_batches(docs.sparkSession)
    gone = cut(mark(docs, max_bits).filter(~F.col("kept")).select(F.col("doc_id").alias("__gone"), F.col("text_sha256").alias("__sum")).distinct())
    may_go = _sketch.among(gone.select("__gone"), F.col("doc_id"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__gone")) & (F.col("__digest") == F.col("__sum"))
    left = _with_digest(docs.filter(may_go)).join(gone, same, "left_anti").drop("__digest")
    return docs.filter(~may_go).unionByName(left)
