"""Substring deduplication with a count-min prefilter.

A window is `size` consecutive words of one document. Each word covered by a window whose word sequence
also starts in a document with a smaller id goes; windows are judged on the input.

Pass 1 (sketch). Windows are counted through winnowed anchors: of a window's hashed sub-windows of
size // 2 + 1 words the least one stands for it, so equal windows have equal anchors and a document
writes about 1/13 of its windows. Each partition sketches its anchors, one count a document and run; the
merged sketch overestimates in how many documents an anchor, and so any window with it, occurs.

Pass 2 (exact). Only windows whose anchor is estimated repeated are hashed to 96 bits. Windows repeated
among rows held together are settled at once, so a task sends a window's smallest document only, however
hot the passage. The rest go, packed, to buckets by anchor; a bucket sorts its windows and marks those of
documents with a larger id. Marks are runs of window starts, gathered by document and joined to the texts.

The sketch is sized for the input up to `max_bits` cells a row, so the broadcast is bounded; past that
more windows pass the prefilter and are shuffled; results are exact at any load.

Defined results: null text has no words (0 words, empty kept text); documents under `size` words keep
everything; a null doc_id counts as larger than any other; rows that share a doc_id do not remove each
other's words; an empty table gives no rows; other columns are kept by `remove` and ignored by `digest`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm import _sketch, _words
from barloom.llm._store import cut, input_bytes, lean, own_names, text_batches

SIZE = 50
MAX_BITS = 1 << 29
NO_ID = (1 << 63) - 1
HOLD = 1 << 19
U = np.uint64


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("__id"), F.xxhash64(text).alias("__row"), text.alias("__text"))


def _anchored(part: pa.RecordBatch, column: int, size: int):
    """Per group of rows: (first row, words, first word by row, row and position of each window, its anchor)."""
    data, offsets = _words.buffers(part.column(column))
    sub = size // 2 + 1
    for lo, hi in _words.groups(offsets):
        starts, ends, first = _words.spans(data, offsets[lo : hi + 1])
        counts = np.diff(first)
        if not (counts >= size).any():
            continue
        words = _words.hashes(data, int(offsets[lo]), starts, ends)
        anchors = _words.slide_min(_words.windows(words, sub), size - sub + 1)
        inside = np.maximum(counts - size + 1, 0)
        row = np.repeat(np.arange(hi - lo), inside)
        pos = np.arange(len(row)) - np.repeat(np.cumsum(inside) - inside, inside)
        yield lo, words, first, row, pos, anchors[first[:-1][row] + pos]


def _runs(row: np.ndarray, key: np.ndarray) -> np.ndarray:
    new = np.empty(len(row), bool)
    new[:1] = True
    new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
    return new


def _anchor_keys(part: pa.RecordBatch, size: int) -> np.ndarray:
    out = [np.zeros(0, U)]
    for _, _, _, row, _, anchor in _anchored(part, 0, size):
        new = _runs(row, anchor)
        row, anchor = row[new], anchor[new]
        order = np.lexsort((anchor, row))
        row, anchor = row[order], anchor[order]
        out.append(anchor[_runs(row, anchor)])
    return _words.mix(np.concatenate(out))


def _settle(ids: np.ndarray, keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For equal keys: True where the id is not the least one; also the order that groups keys."""
    order = np.lexsort((ids, *keys))
    same = np.ones(max(0, len(ids) - 1), bool)
    for k in keys:
        s = k[order]
        same &= s[1:] == s[:-1]
    new = np.concatenate([[True], ~same]) if len(ids) else np.zeros(0, bool)
    least = ids[order][np.flatnonzero(new)][np.cumsum(new) - 1]
    later = np.zeros(len(ids), bool)
    later[order] = ids[order] > least
    return later, order


def _ranges(doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, first, last) runs of consecutive positions; doc, pos sorted."""
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1] + 1)
    at = np.flatnonzero(new)
    end = np.append(at[1:], len(doc)) - 1 if len(doc) else at
    return doc[at], pos[at], pos[end]


_WIRE = [("bucket", pa.int32()), ("ids", pa.binary()), ("rows", pa.binary()), ("counts", pa.binary()), ("first", pa.binary()), ("second", pa.binary()), ("pos", pa.binary()), ("settled", pa.bool_())]


def _blobs(bucket: int, ids, rows, doc, pos, h1, h2, settled: bool) -> tuple:
    """One bucket's windows, grouped by document (doc is sorted)."""
    new = np.ones(len(doc), bool)
    new[1:] = doc[1:] != doc[:-1]
    at = np.flatnonzero(new)
    counts = np.diff(np.append(at, len(doc)))
    d = doc[at]
    return bucket, ids[d].tobytes(), rows[d].tobytes(), counts.astype("<i4").tobytes(), h1.tobytes(), h2.tobytes(), pos.astype("<i4").tobytes(), settled


def marks(docs: DataFrame, size: int = SIZE, max_bits: int = MAX_BITS) -> DataFrame:
    """(__id, __row, __runs): the runs of window starts to remove, by document row."""
    spark = docs.sparkSession
    text_batches(spark)
    keyed = _keyed(docs)
    guess = input_bytes(docs)
    width = _sketch.width_for(guess // 10, max_bits)
    seen = _sketch.build(keyed.select("__text"), lambda part: _anchor_keys(part, size), width)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(parts, guess // (1 << 21), 8)

    @lean
    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        count = 0

        def out() -> Iterator[pa.RecordBatch]:
            shift = np.cumsum([0] + [len(x[0]) for x in held[:-1]])
            ids, rows = (np.concatenate([x[i] for x in held]) for i in (0, 1))
            doc = np.concatenate([x[2] + s for x, s in zip(held, shift, strict=True)])
            pos, anchor, h1, h2 = (np.concatenate([x[i] for x in held]) for i in (3, 4, 5, 6))
            later, _ = _settle(ids[doc], [h2, h1])
            rows_out = []
            where = (anchor % U(buckets)).astype(np.int64)
            d, a, b = _ranges(doc[later], pos[later])
            home = (_words.mix(ids[d].astype(U)) % U(buckets)).astype(np.int64)
            order = np.argsort(home, kind="stable")
            d, a, b, home = d[order], a[order], b[order], home[order]
            cuts = np.flatnonzero(np.diff(home)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(home)], strict=True):
                if lo < hi:
                    rows_out.append(_blobs(int(home[lo]), ids, rows, d[lo:hi], b[lo:hi] - a[lo:hi], a[lo:hi].astype("<i4"), np.zeros(0, np.uint32), True))
            keep = np.flatnonzero(~later)
            keep = keep[np.argsort(where[keep], kind="stable")]
            w = where[keep]
            cuts = np.flatnonzero(np.diff(w)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(w)], strict=True):
                if lo < hi:
                    i = keep[lo:hi]
                    rows_out.append(_blobs(int(w[lo]), ids, rows, doc[i], pos[i], h1[i], h2[i], False))
            for lo in range(0, len(rows_out), 256):
                cols = zip(*rows_out[lo : lo + 256], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, _WIRE, strict=True)], [n for n, _ in _WIRE])

        for part in batches:
            ids = part.column(0).to_numpy(zero_copy_only=False)
            rows = part.column(1).to_numpy(zero_copy_only=False)
            for lo, words, first, row, pos, anchor in _anchored(part, 2, size):
                new = _runs(row, anchor)
                runs = np.cumsum(new) - 1
                hit = _sketch.repeated(seen.value, _words.mix(anchor[new]), width)[runs]
                if not hit.any():
                    continue
                row, pos, anchor = row[hit], pos[hit], anchor[hit]
                at = first[:-1][row] + pos
                n = len(first) - 1
                held.append((ids[lo : lo + n], rows[lo : lo + n], row, pos, anchor, _words.windows(words, size)[at], (_words.windows(words, size, True)[at] >> U(32)).astype(np.uint32)))
                count += len(row)
                if count >= HOLD:
                    yield from out()
                    held, count = [], 0
        if count:
            yield from out()

    @lean
    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        at = None

        def emit(ids, rows, a, b) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(rows), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], ["__id", "__row", "a", "b"])

        def out() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            shift = np.cumsum([0] + [len(x[0]) for x in held[:-1]])
            ids, rows = (np.concatenate([x[i] for x in held]) for i in (0, 1))
            doc = np.concatenate([np.repeat(np.arange(len(x[0])), x[2]) + s for x, s in zip(held, shift, strict=True)])
            h1, h2, pos = (np.concatenate([x[i] for x in held]) for i in (3, 4, 5))
            later, _ = _settle(ids[doc], [h2, h1])
            doc, pos = doc[later], pos[later]
            if len(doc):
                order = np.lexsort((pos, doc))
                d, a, b = _ranges(doc[order], pos[order])
                yield emit(ids[d], rows[d], a, b)

        for part in batches:
            for bucket, *raw, done in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if bucket != at:
                    yield from out()
                    held, at = [], bucket
                ids, rows = np.frombuffer(raw[0], "<i8"), np.frombuffer(raw[1], "<i8")
                counts, pos = np.frombuffer(raw[2], "<i4"), np.frombuffer(raw[5], "<i4")
                if done:
                    d, a = np.repeat(np.arange(len(ids)), counts), np.frombuffer(raw[3], "<i4")
                    yield emit(ids[d], rows[d], a, a + pos)
                else:
                    held.append((ids, rows, counts, np.frombuffer(raw[3], "<u8"), np.frombuffer(raw[4], "<u4"), pos))
        yield from out()

    wire = "bucket int, ids binary, rows binary, counts binary, first binary, second binary, pos binary, settled boolean"
    found = keyed.mapInArrow(candidates, wire).repartition(min(parts * 4, buckets), "bucket").sortWithinPartitions("bucket")
    runs = found.mapInArrow(settle, "__id long, __row long, a int, b int")
    return runs.groupBy("__id", "__row").agg(F.collect_list(F.struct("a", "b")).alias("__runs"))


def _covered(n: int, runs: list[dict], size: int) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    for r in runs:
        edge[r["a"]] += 1
        edge[min(n, r["b"] + size)] -= 1
    return np.cumsum(edge)[:n] > 0


def _kept(text: bytes, runs: list[dict] | None, size: int) -> tuple[int, int, bytes]:
    words = text.split()
    if not runs:
        return len(words), 0, b" ".join(words)
    gone = _covered(len(words), runs, size)
    return len(words), int(gone.sum()), b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)


def _marked(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows with their __runs, NULL where nothing goes; texts that a filter of the marks doesn't know aren't shuffled."""
    found = cut(found)
    may = _sketch.among(found.select("__row"), F.col("__row"))
    none = F.lit(None).cast(found.schema["__runs"].dataType)
    return rows.filter(~may).withColumn("__runs", none).unionByName(rows.filter(may).join(found, ["__id", "__row"], "left"))


def digest(docs: DataFrame, size: int = SIZE, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space), by document row."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for part in batches:
            texts, runs = part.column(1).cast(pa.large_binary()), part.column(2)
            rows = [(n, m, hashlib.sha256(k).hexdigest()) for n, m, k in (_kept(t.as_py() or b"", r.as_py(), size) for t, r in zip(texts, runs, strict=True))]
            cols = list(zip(*rows, strict=True)) or [(), (), ()]
            ids = part.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([None if i == NO_ID else i for i in ids], pa.int64()), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return _marked(_keyed(docs), marks(docs, size, max_bits)).select("__id", "__text", "__runs").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


@own_names
def remove(docs: DataFrame, size: int = SIZE, max_bits: int = MAX_BITS) -> DataFrame:
    """docs with repeated passages cut from `text` (and `n_chars` brought up to date where it exists).

    Texts that lose nothing stay as they were; the others are their kept words joined by one space.
    """

    @F.pandas_udf("string")
    def cut_text(text, runs):
        import pandas as pd

        return pd.Series([None if t is None else t if r is None else _kept(t.encode(), list(r), size)[2].decode() for t, r in zip(text, runs, strict=True)], dtype=object)

    names = docs.columns
    key = docs.withColumn("__id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))).withColumn("__row", F.xxhash64(F.col("text").cast("string")))
    joined = _marked(key, marks(docs, size, max_bits))
    out = joined.withColumn("text", F.when(F.col("__runs").isNull(), F.col("text")).otherwise(cut_text(F.col("text").cast("string"), F.col("__runs"))))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col("__runs").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return out.select(*names)
