"""Words, hashes and windows over Arrow text buffers, vectorised with numpy.

A word is a maximal run of bytes outside space and 0x09-0x0D. Word hashes are 64-bit polynomial hashes
of randomly mapped bytes (wrapping arithmetic), finished with a mixer, so that equal words hash alike
in every process and on every machine.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
PIECE = 1 << 20


def _rng_table(seed: int, n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(1, 1 << 63, n, dtype=np.uint64) * U(2) + U(1)


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BYTES = _rng_table(11, 256)
BASES = [0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F]


class Powers:
    """Powers of an odd base and of its inverse modulo 2^64, grown on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.inv = U(base), U(pow(base, -1, 1 << 64))
        self.up = self.down = np.ones(1, U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up, self.down = (np.concatenate([x, x * U(pow(int(b), k, 1 << 64))]) for x, b in ((self.up, self.base), (self.down, self.inv)))
        return self.up[:n], self.down[:n]


_BYTE, _WORD1, _WORD2 = (Powers(b) for b in BASES)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def groups(offsets: np.ndarray, most: int = 1 << 20):
    """(lo, hi) row ranges of at most `most` bytes each, one row at least."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def spans(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte spans of all words of data[offsets[0]:offsets[-1]], relative to offsets[0];
    first[i] is the index of row i's first word, with one more entry for the total."""
    base = offsets[0]
    rel = offsets - base
    here = ~space[data[base : offsets[-1]]]
    before = np.empty_like(here)
    before[:1] = False
    before[1:] = here[:-1]
    cuts = rel[:-1][rel[:-1] < len(here)]
    before[cuts] = False
    starts = np.flatnonzero(here & ~before)
    after = np.empty_like(here)
    after[-1:] = False
    after[:-1] = here[1:]
    inner = cuts[cuts > 0] - 1
    after[inner] = False
    ends = np.flatnonzero(here & ~after) + 1
    return starts, ends, np.searchsorted(starts, rel)


def hashes(data: np.ndarray, base: int, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hashes of the words at base + starts .. base + ends."""
    out = np.empty(len(starts), U)
    table = BYTES[LOWER] if lower else BYTES
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + PIECE, "right")))
        a, b = int(starts[lo]), int(ends[hi - 1])
        up, down = _BYTE.upto(b - a + 1)
        sums = np.empty(b - a + 1, U)
        sums[0] = 0
        np.cumsum(table[data[base + a : base + b]] * up[: b - a], out=sums[1:])
        s, e = starts[lo:hi] - a, ends[lo:hi] - a
        out[lo:hi] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(U))
        lo = hi
    return out


def windows(words: np.ndarray, k: int, second: bool = False) -> np.ndarray:
    """Hash of words[i:i+k] for every i; `second` gives an independent one."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    out = np.empty(n, U)
    power = _WORD2 if second else _WORD1
    for lo in range(0, n, PIECE):
        hi = min(n, lo + PIECE)
        part = words[lo : hi + k - 1]
        up, down = power.upto(len(part) + 1)
        sums = np.empty(len(part) + 1, U)
        sums[0] = 0
        np.cumsum(part * up[: len(part)], out=sums[1:])
        out[lo:hi] = mix((sums[k:] - sums[:-k]) * down[: hi - lo] + U(k))
    return out


def slide_min(x: np.ndarray, w: int) -> np.ndarray:
    """min(x[i:i+w]) for every i, by doubling."""
    size, cur = 1, x
    while size * 2 <= w:
        cur = np.minimum(cur[:-size], cur[size:])
        size *= 2
    rest = w - size
    return cur if not rest else np.minimum(cur[: len(cur) - rest], cur[rest:])


def row_of(first: np.ndarray) -> np.ndarray:
    """The row of every word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


LETTER = np.zeros(256, bool)
LETTER[97:123] = LETTER[65:91] = LETTER[128:] = True


def letter_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As `spans`, for maximal runs of ASCII letters and bytes of other scripts."""
    return spans(data, offsets, ~LETTER)
