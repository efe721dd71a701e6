"""Two-row count-min sketches that tell "at most once" from "perhaps repeated".

Map tasks keep their keys, sort them by cell and write each block of cells as delta-coded positions: a
sketch of the partition, as small as its keys. Blocks are merged by adding counts, saturating at 2. The
driver gets one bit per cell ("2 or more"), at most 2 * max_bits / 8 bytes whatever the input, and
broadcasts it. Estimates never fall below the true count, so nothing repeated is missed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm._store import lean
from barloom.llm._words import mix

U = np.uint64
BLOCK = 20
FLUSH = 1 << 20


def width_for(expected: int, max_bits: int) -> int:
    """A power of two of at least `expected` cells, between 2^BLOCK and max_bits."""
    return int(min(max_bits, 1 << max(BLOCK, int(max(1, expected) - 1).bit_length())))


def cells(keys: np.ndarray, width: int) -> list[np.ndarray]:
    """The cell of each key in either row: the key is a uniform 64-bit hash."""
    mask = U(width - 1)
    return [(keys & mask).astype(np.int64), ((keys * U(0x9E3779B97F4A7C15)) >> U(64 - width.bit_length() + 1)).astype(np.int64) + width]


def _rows(keys: np.ndarray, width: int) -> Iterator[tuple[int, bytes, bytes]]:
    """(block, cells hit once, cells hit more often), cells delta-coded."""
    for at in cells(keys, width):
        at.sort()
        new = np.empty(len(at), bool)
        new[:1] = True
        new[1:] = at[1:] != at[:-1]
        first = np.flatnonzero(new)
        twice = np.diff(np.append(first, len(at))) > 1
        at = at[first]
        block = at >> BLOCK
        cuts = np.flatnonzero(np.diff(block)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(at)], strict=True):
            if lo < hi:
                inside, again = (at[lo:hi] & ((1 << BLOCK) - 1)).astype(np.int32), twice[lo:hi]
                yield int(block[lo]), *(np.diff(x, prepend=np.int32(0)).astype("<i4").tobytes() for x in (inside[~again], inside[again]))


def build(df: DataFrame, keys: Callable[[pa.RecordBatch], np.ndarray], width: int) -> Broadcast:
    """The merged sketch of keys(batch) over all batches of df, broadcast as packed bits by block."""
    spark = df.sparkSession

    @lean
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=1)
        held: list[np.ndarray] = []
        total = 0

        def out() -> Iterator[pa.RecordBatch]:
            rows = [(b, press.compress(one), press.compress(two)) for b, one, two in _rows(np.concatenate(held), width)] if total else []
            for lo in range(0, len(rows), 64):
                cols = list(zip(*rows[lo : lo + 64], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary())], ["block", "once", "more"])

        for part in batches:
            held.append(keys(part))
            total += len(held[-1])
            if total >= FLUSH:
                yield from out()
                held, total = [], 0
        yield from out()

    @lean
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdDecompressor()
        at, cell = None, np.zeros(1 << BLOCK, np.uint8)

        def out() -> pa.RecordBatch:
            bits = np.packbits(cell > 1, bitorder="little").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([zstandard.compress(bits, 1)], pa.binary())], ["block", "bits"])

        for part in batches:
            for block, once, more in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if block != at:
                    if at is not None:
                        yield out()
                    at = block
                    cell[:] = 0
                i = np.cumsum(np.frombuffer(press.decompress(once), "<i4"))
                cell[i] += cell[i] < 2
                cell[np.cumsum(np.frombuffer(press.decompress(more), "<i4"))] = 2
        if at is not None:
            yield out()

    blocks = 2 * width >> BLOCK
    parts = min(blocks, int(spark.conf.get("spark.sql.shuffle.partitions")))
    merged = df.mapInArrow(count, "block int, once binary, more binary").repartition(parts, "block").sortWithinPartitions("block").mapInArrow(merge, "block int, bits binary").collect()
    import zstandard

    bits = np.zeros(2 * width // 8, np.uint8)
    for row in merged:
        lo = row.block << (BLOCK - 3)
        bits[lo : lo + (1 << (BLOCK - 3))] = np.frombuffer(zstandard.decompress(bytes(row.bits)), np.uint8)
    return spark.sparkContext.broadcast(bits)


def repeated(bits: np.ndarray, keys: np.ndarray, width: int) -> np.ndarray:
    """True where both cells of the key were hit twice or more."""
    out = np.ones(len(keys), bool)
    for at in cells(keys, width):
        out &= (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
    return out


def among(keys: DataFrame, column: Column, max_bits: int = 1 << 27) -> Column:
    """True where `column` (long) is in the only column of keys, nulls included, and for a few others: what is False needs
    no join. A filter of bounded size is broadcast; past it more rows are True."""
    width = width_for(keys.count() * 8, max_bits)
    hashed = lambda ids: mix(ids.view(U))
    whole = lambda c: F.coalesce(c.cast("long"), F.lit(-(1 << 63) + 1))
    only = keys.select(whole(F.col(keys.columns[0])).alias("key"))
    bits = build(only, lambda part: np.repeat(hashed(part.column(0).to_numpy(zero_copy_only=False)), 2), width)

    @F.pandas_udf("boolean")
    def ask(ids: pd.Series) -> pd.Series:
        return pd.Series(repeated(bits.value, hashed(ids.to_numpy(np.int64)), width))

    return ask(whole(column))
