"""N-gram Jaccard self-join with count-vector R-trees: documents whose sets of word shingles are alike.

A document's set holds its distinct 5-word shingles (A-Z lower-cased; fewer words: the whole sequence).
Two documents link when 100 * |intersection| >= 80 * |union|. Sets that are equal collapse first.

Points. Shingles are hashed into GROUPS groups; a set's point is its count per group. Two sets share at
most the sum of the coordinate minima of their points, and a tree node whose box has upper corner u holds no
partner of q unless sum(min(q, u)) reaches what the sizes demand. Pairs of points are also bounded in 512 finer groups,
whose counts are kept modulo 2.

Routing. Points of texts of a few hundred shingles are spread so evenly in 32 dimensions that one R-tree
over a corpus would visit nearly every leaf (two unrelated sets of 620 shingles bound to 0.87 of their
size, a link needs 0.89). Sets are therefore routed to trees by prefix shingles: in one global order
(estimated document frequency, then hash) linked sets share one of their first n - ceil(0.8 n) + 1
shingles, so each such shingle that is not certainly unique gets a tree of the sets that have it. Order and
uniqueness come from two sketches of bounded size; any order is lossless. Trees of very frequent shingles
are dealt to a grid of chunk pairs, so no task holds a hot shingle's sets together.

Searching. Round 1: every set asks each of its trees for the one earlier set with the best bound (pairs linear
in the rows) and is paired with the tree's least set; each set's best pair and its pair with the least set it met
are verified on whole sets, and links are joined into components. Round 2:
every tree is asked again for the pairs that pass the bound and lie in different components, whatever round 1 found in
it, and these are verified too, each text once for a connected group of pairs. So large groups of near copies connect
without listing their pairs, and no link between different components is lost. The components of up to ROOTS sets are
broadcast for this; sets beyond count as apart from all until their exact components are joined (more shuffle, same result).

Bounds: sketches are sized for the input up to `max_bits` cells a row; past that, order gets closer to
hash order and unique shingles are routed too (more shuffle, same result). Shingles are compared as 64-bit
hashes within a pair of documents; equal sets by 128 bits and size.

Defined results: null and blank texts have no shingles and link with nothing; repeated rows link; a null
doc_id counts as larger than any other and is given back as null; rows that share a doc_id are one
document in the graph where both stand for their sets; an empty table gives no rows; other columns
are ignored by `classes` and kept by `representatives`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm import _sketch, _words
from barloom.llm._components import components, spread_join
from barloom.llm._store import cut, few, input_bytes, lean, own_names, text_batches

N = 5
PERCENT = 80
GROUPS = 32
FINE = 8
FREQUENCY_CELLS = 1 << 23
MAX_BITS = 1 << 29
NO_ID = (1 << 63) - 1
HOLD_ROWS = 1 << 18
CHUNK = 4096
LEAF = 16
#: Shingles in a chunk of a job.
JOB = 1 << 15
SALT = 8
#: Groups a shingle of the points that pairs are tested by before texts travel.
PARITY = 4
#: At most this many sets' components are broadcast (12 bytes each).
ROOTS = 1 << 22
U = np.uint64


def _sets(column: pa.Array, n: int = N) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every row."""
    data, offsets = _words.buffers(column)
    for lo, hi in _words.groups(offsets):
        starts, ends, first = _words.spans(data, offsets[lo : hi + 1])
        words = _words.hashes(data, int(offsets[lo]), starts, ends, lower=True)
        grams = _words.windows(words, n)
        for k in range(hi - lo):
            a, b = int(first[k]), int(first[k + 1])
            yield np.unique(grams[a : b - n + 1] if b - a >= n else _words.windows(words[a:b], b - a)) if b > a else grams[:0]


def _signature(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums over a set, as signed numbers."""
    return tuple(int(np.sum(_words.mix(s ^ U(seed)), dtype=U).view(np.int64)) for seed in (0x243F6A8885A308D3, 0x13198A2E03707344))


def needed(a, b):
    """The least intersection that links sets of these sizes: 100 i >= 80 (a + b - i)."""
    return -((-PERCENT * (a + b)) // (100 + PERCENT))


def prefix_length(n: int) -> int:
    return n - -((-PERCENT * n) // 100) + 1


FREQUENCY_BLOCK = 1 << 18
#: Counts are broadcast as one byte each, in eighths of a power of two.
COUNTS = np.round(np.exp2(np.arange(256) / 8) - 1).astype(np.int64)


def _thin(part: np.ndarray) -> bytes:
    """Counts in two bits each, those of 3 and more listed behind, compressed: most cells of a partition hold few."""
    import zstandard

    low, at = np.minimum(part, 3).astype(np.uint8), np.flatnonzero(part >= 3)
    bits = low[0::4] | low[1::4] << 2 | low[2::4] << 4 | low[3::4] << 6
    listed = np.diff(at, prepend=0).astype("<i4").tobytes() + part[at].astype("<u2").tobytes()
    return zstandard.compress(np.array([len(at)], "<i4").tobytes() + bits.tobytes() + listed, 1)


def _thick(raw: bytes, block: int, total: np.ndarray) -> None:
    """Adds what `_thin` wrote to total."""
    import zstandard

    raw = zstandard.decompress(raw)
    bits, n = np.frombuffer(raw, np.uint8, block // 4, 4), int(np.frombuffer(raw, "<i4", 1)[0])
    for k in range(4):
        total[k::4] += (bits >> (2 * k)) & 3
    total[np.cumsum(np.frombuffer(raw, "<i4", n, 4 + block // 4))] += np.frombuffer(raw, "<u2", n, 4 + block // 4 + 4 * n).astype(np.int64) - 3


def _measured(keyed: DataFrame, width: int) -> DataFrame:
    """One pass over the texts: rows (id, n, s1, s2) by document and rows (block, cells) by partition, the latter a
    two-row count-min sketch of how many sets have a shingle."""
    block = min(FREQUENCY_BLOCK, 2 * width)
    names = ["id", "n", "s1", "s2", "block", "cells"]

    def add(table: np.ndarray, keys: np.ndarray) -> None:
        for at in _sketch.cells(keys, width):
            cell, n = np.unique(at, return_counts=True)
            table[cell] = np.minimum(table[cell].astype(np.int64) + n, 65535).astype(np.uint16)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(2 * width, np.uint16)
        held: list[np.ndarray] = []
        count = 0
        for part in batches:
            rows = []
            for s in _sets(part.column(1)):
                rows.append((len(s), *_signature(s)))
                held.append(s)
                count += len(s)
                if count > 1 << 19:
                    add(table, np.concatenate(held))
                    held, count = [], 0
            n, s1, s2 = zip(*rows, strict=True) if rows else ((), (), ())
            none = [pa.nulls(len(rows), t) for t in (pa.int32(), pa.binary())]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), *none], names)
        if held:
            add(table, np.concatenate(held))
        for k in range(0, 2 * width, block):
            part = table[k : k + block]
            if part.any():
                none = [pa.nulls(1, pa.int64()) for _ in range(4)]
                yield pa.RecordBatch.from_arrays([*none, pa.array([k // block], pa.int32()), pa.array([_thin(part)], pa.binary())], names)

    return cut(keyed.mapInArrow(run, "id long, n long, s1 long, s2 long, block int, cells binary"))


def _frequencies(measured: DataFrame, width: int) -> tuple[Broadcast, float]:
    """The merged frequency sketch, one byte a cell, and its mean count."""
    import zstandard

    spark, block = measured.sparkSession, min(FREQUENCY_BLOCK, 2 * width)

    @lean
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, np.zeros(block, np.int64)
        for part in batches:
            for k, raw in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if k != at:
                    if at is not None:
                        yield row(at, total)
                    at, total = k, np.zeros(block, np.int64)
                _thick(raw, block, total)
        if at is not None:
            yield row(at, total)

    def row(at: int, total: np.ndarray) -> pa.RecordBatch:
        import zstandard

        coded = np.minimum(np.round(8 * np.log2(total + 1.0)), 255).astype(np.uint8)
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([zstandard.compress(coded.tobytes(), 1)], pa.binary()), pa.array([int(total.sum())], pa.int64())], ["block", "cells", "total"])

    parts = min(2 * width // block, int(spark.conf.get("spark.sql.shuffle.partitions")))
    blocks = measured.filter("block IS NOT NULL").select("block", "cells")
    merged = blocks.repartition(parts, "block").sortWithinPartitions("block").mapInArrow(merge, "block int, cells binary, total long").collect()
    table, total = np.zeros(2 * width, np.uint8), 0
    for r in merged:
        table[r.block * block : (r.block + 1) * block] = np.frombuffer(zstandard.decompress(bytes(r.cells)), np.uint8)
        total += r.total
    return spark.sparkContext.broadcast(table), total / (2 * width)


def _prefix(table: np.ndarray, noise: float, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The set's first shingles in the global order and their estimated frequencies, less what cells hold by chance."""
    a, b = _sketch.cells(s, len(table) // 2)
    guess = np.maximum(0, COUNTS[np.minimum(table[a], table[b])] - int(noise + 3 * noise**0.5))
    level = np.frexp(guess.astype(np.float64))[1].astype(np.int64)
    order = np.lexsort((s, level))[: prefix_length(len(s))]
    return s[order], guess[order]


def point(s: np.ndarray) -> np.ndarray:
    """Counts by group; 255 stands for 255 or more."""
    return np.minimum(np.bincount((s >> U(40)).astype(np.int64) % GROUPS, minlength=GROUPS), 255).astype(np.uint8)


def bound(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Summed coordinate minima of points (broadcast over leading axes); unlimited where both reach 255."""
    low = np.minimum(a, b)
    return low.sum(-1, dtype=np.int32) + np.where((low == 255).any(-1), 1 << 30, 0).astype(np.int32)


def fine_point(s: np.ndarray) -> np.ndarray:
    """Counts in 64 * FINE finer groups modulo 2, as bits."""
    odd = np.bincount((s >> U(20)).astype(np.int64) % (64 * FINE), minlength=64 * FINE) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(U)


def fine_bound(na, nb, a: np.ndarray, b: np.ndarray):
    """Summed minima are (na + nb - sum |difference|) / 2, and a difference is at least its parity."""
    return (na + nb - np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)) // 2


class Tree:
    """A packed R-tree over points: leaves of LEAF points in order of size and counts, boxes kept as upper corners with the least size."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, fine: np.ndarray) -> None:
        order = np.lexsort((*points.T[:4], sizes))
        self.order, self.points, self.sizes, self.fine = order, points[order], sizes[order], fine[order]
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        top, least, most = self.points, self.sizes, self.sizes
        while len(top) > 1:
            cut_at = np.arange(0, len(top), LEAF)
            top, least, most = np.maximum.reduceat(top, cut_at), np.minimum.reduceat(least, cut_at), np.maximum.reduceat(most, cut_at)
            self.levels.append((top, least, most))

    def search(self, first: int, last: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, partner, bound) of all partners before the queries first..last-1, as places in the order."""
        q = np.arange(first, last)
        at = np.zeros(len(q), np.int64)
        if not self.levels:
            return
        for top, least, most in reversed(self.levels):
            ok = bound(self.points[q], top[at]) >= needed(self.sizes[q], least[at])
            ok &= 100 * most[at] >= PERCENT * self.sizes[q]
            q, at = q[ok], at[ok]
            q, at = np.repeat(q, LEAF), (at[:, None] * LEAF + np.arange(LEAF)).ravel()
            size = len(self.sizes) if top is self.levels[0][0] else len(self.levels[[x[0] is top for x in self.levels].index(True) - 1][0])
            fine = at < size
            q, at = q[fine], at[fine]
        ok = at < q
        q, at = q[ok], at[ok]
        yield _within(q, at, self.points, self.sizes, self.fine)


def _within(a: np.ndarray, b: np.ndarray, points: np.ndarray, sizes: np.ndarray, fine: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs that may link, with the lesser of both bounds."""
    need = needed(sizes[a], sizes[b])
    v = bound(points[a], points[b])
    ok = v >= need
    a, b, v, need = a[ok], b[ok], v[ok], need[ok]
    v = np.minimum(v, fine_bound(sizes[a], sizes[b], fine[a], fine[b]))
    ok = v >= need
    return a[ok], b[ok], v[ok]


def _pairs_of_equal_groups(points: np.ndarray, sizes: np.ndarray, fine: np.ndarray, starts: np.ndarray, m: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(later, earlier, bound) over many groups of m rows each, all at once."""
    for i in range(1, m):
        for j in range(i):
            yield _within(starts + i, starts + j, points, sizes, fine)


def _search(token: np.ndarray, sizes: np.ndarray, points: np.ndarray, fine: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(later, earlier, bound) row pairs that pass the bound within runs of equal tokens."""
    new = np.ones(len(token), bool)
    new[1:] = token[1:] != token[:-1]
    start = np.flatnonzero(new)
    count = np.diff(np.append(start, len(token)))
    for m in np.unique(count[(count > 1) & (count <= LEAF)]):
        yield from _pairs_of_equal_groups(points, sizes, fine, start[count == m], int(m))
    for s, m in zip(start[count > LEAF], count[count > LEAF], strict=True):
        tree = Tree(points[s : s + m], sizes[s : s + m], fine[s : s + m])
        step = max(16, min(256, (1 << 18) // int(m)))  # some 100 MB at most
        for lo in range(0, m, step):
            for a, b, v in tree.search(lo, min(m, lo + step)):
                yield s + tree.order[a], s + tree.order[b], v


def _nearest(token, sig, sizes, points, fine) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row its best-bounded earlier partner and the ratio of bound to need, as pairs of signatures; only the best so far is held."""
    best, partner = np.zeros(len(token)), np.full(len(token), -1, np.int64)
    for later, earlier, value in _search(token, sizes, points, fine):
        ratio = value / np.maximum(1, needed(sizes[later], sizes[earlier]))
        order = np.lexsort((earlier, -ratio, later))
        later, earlier, ratio = later[order], earlier[order], ratio[order]
        new = np.ones(len(later), bool)
        new[1:] = later[1:] != later[:-1]
        later, earlier, ratio = later[new], earlier[new], ratio[new]
        up = ratio > best[later]
        best[later[up]], partner[later[up]] = ratio[up], earlier[up]
    found = np.flatnonzero(partner >= 0)
    # also each row with its tree's least set: copies of one document then share a hub, and few rounds connect them
    new = np.ones(len(token), bool)
    new[1:] = token[1:] != token[:-1]
    hub = np.flatnonzero(new)[np.cumsum(new) - 1] if len(token) else found
    rows, hubs, value = _within(np.flatnonzero(~new), hub[~new], points, sizes, fine)
    s, t = np.concatenate([sig[found], sig[rows]]), np.concatenate([sig[partner[found]], sig[hubs]])
    ratio = np.concatenate([best[found], value / np.maximum(1, needed(sizes[rows], sizes[hubs]))])
    s, t = np.minimum(s, t), np.maximum(s, t)
    order = np.lexsort((-ratio, t, s))
    s, t, ratio = s[order], t[order], ratio[order]
    new = s != t
    new[1:] &= (s[1:] != s[:-1]) | (t[1:] != t[:-1])
    return s[new], t[new], ratio[new]


def _groups_with(token: np.ndarray, flag: np.ndarray) -> np.ndarray:
    """True on the rows of runs of equal tokens where any row has the flag."""
    new = np.ones(len(token), bool)
    new[1:] = token[1:] != token[:-1]
    return np.logical_or.reduceat(flag, np.flatnonzero(new))[np.cumsum(new) - 1] if len(token) else flag


def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    lo, hi = np.minimum(a, b), np.maximum(a, b)
    pairs = np.unique(np.stack([lo, hi], 1), axis=0) if len(lo) else np.zeros((0, 2), np.int64)
    pairs = pairs[pairs[:, 0] != pairs[:, 1]]
    return pairs[:, 0], pairs[:, 1]


def _pair_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["s", "t"])


_WIRE = "bucket int, token binary, at binary, sig binary, size binary, point binary, fine binary"
_NAMES = ["bucket", "token", "at", "sig", "size", "point", "fine"]


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *[pa.array([x.tobytes() for x in c], pa.binary()) for c in cols[1:]]], _NAMES)


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each bucket (sorted by bucket) as one: sets listed once, tokens of one set and repeated trees left out."""
    held: list[tuple] = []
    bucket_now = None

    def out() -> Iterator[pa.RecordBatch]:
        token, at = np.concatenate([h[0] for h in held]), np.concatenate([h[1] + k for h, k in zip(held, np.cumsum([0] + [len(h[2]) for h in held[:-1]]), strict=True)])
        sig, first, place = np.unique(np.concatenate([h[2] for h in held]), return_index=True, return_inverse=True)
        size, pt, fine = (np.concatenate([h[k] for h in held])[first] for k in (3, 4, 5))
        at = place[at]
        order = np.lexsort((at, token))
        token, at = token[order], at[order]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (at[1:] != at[:-1])
        token, at = token[new], at[new]
        more = np.zeros(len(token), bool)
        same = token[1:] == token[:-1]
        more[1:] |= same
        more[:-1] |= same
        token, at = token[more], at[more]
        if not len(token):
            return
        start = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        count = np.diff(np.append(start, len(token)))
        members = np.add.reduceat(_words.mix(sig.view(U))[at], start) + _words.mix(count.astype(U))
        once = np.zeros(len(start), bool)  # shingles with the same sets need one tree
        once[np.unique(members, return_index=True)[1]] = True
        keep = np.repeat(once, count)
        token, at = token[keep], at[keep]
        used, at = np.unique(at, return_inverse=True)
        yield _packed([(bucket_now, token, at.astype(np.int32), sig[used], size[used], pt[used], fine[used])])

    for part in batches:
        for bucket, *raw in zip(*(c.to_pylist() for c in part.columns), strict=True):
            if bucket != bucket_now:
                if held:
                    yield from out()
                held, bucket_now = [], bucket
            held.append(_arrays(raw))
    if held:
        yield from out()


def _routed(keyed: DataFrame, reps: DataFrame, measured: DataFrame, cells: int, parts: int) -> DataFrame:
    """One row per bucket of trees, packed: tokens in runs, each with the place of its set in the bucket's list of
    sets (sig, size, point, fine); tokens of one set are left out. Of equal sets only the representative's rows (and
    perhaps a few others) are read, so shingles that only equal sets share count as unique."""
    guess = input_bytes(keyed)
    chosen = _filter(reps.select(F.col("rep").alias("id")))
    frequency, noise = _frequencies(measured, cells)
    width = _sketch.width_for(guess // 2, MAX_BITS)

    def firsts(part: pa.RecordBatch) -> np.ndarray:
        return np.concatenate([np.zeros(0, U), *[_prefix(frequency.value, noise, s)[0] for s in _sets(chosen(part).column(1)) if len(s)]])

    seen = _sketch.build(keyed, firsts, width)
    buckets = max(16, guess >> 25)

    @lean
    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        done: set[tuple] = set()
        count = 0

        def out() -> Iterator[pa.RecordBatch]:
            token = np.concatenate([h[0] for h in held])
            rows = np.repeat(np.arange(len(held)), [len(h[0]) for h in held])
            sig, size = np.array([h[1] for h in held], np.int64), np.array([h[2] for h in held], np.int32)
            pt, fine = np.stack([h[3] for h in held]), np.stack([h[4] for h in held])
            where = (_words.mix(token) % U(buckets)).astype(np.int64)
            order = np.argsort(where, kind="stable")
            token, rows, where = token[order], rows[order], where[order]
            cuts = np.flatnonzero(np.diff(where)) + 1
            made = []
            for lo, hi in zip([0, *cuts], [*cuts, len(where)], strict=True):
                if lo < hi:
                    r, at = np.unique(rows[lo:hi], return_inverse=True)
                    made.append((int(where[lo]), token[lo:hi], at.astype(np.int32), sig[r], size[r], pt[r], fine[r]))
            for lo in range(0, len(made), 64):
                yield _packed(made[lo : lo + 64])

        for part in batches:
            for s in _sets(chosen(part).column(1)):
                if not len(s):
                    continue
                sig = _signature(s)
                if sig in done:
                    continue
                done.add(sig)
                token, guess_n = _prefix(frequency.value, noise, s)
                maybe = _sketch.repeated(seen.value, token, width)
                token, guess_n = token[maybe], guess_n[maybe]
                if not len(token):
                    continue
                pieces = np.maximum(1, -(-guess_n // CHUNK))
                keys = [_words.mix(token[pieces == 1])]
                for t, k in zip(token[pieces > 1], pieces[pieces > 1], strict=True):
                    mine = abs(sig[1]) % int(k)
                    other = np.arange(int(k))
                    grid = np.minimum(other, mine) * int(k) + np.maximum(other, mine)
                    keys.append(_words.mix(_words.mix(np.full(1, t)) + grid.astype(U) + U(1)))
                keys = np.concatenate(keys)
                held.append((keys, sig[0], len(s), point(s), fine_point(s)))
                count += len(keys)
                if count >= HOLD_ROWS:
                    yield from out()
                    held, count = [], 0
                    if len(done) > 1 << 17:
                        done.clear()
        if held:
            yield from out()

    return cut(keyed.mapInArrow(route, _WIRE).repartition(min(4 * parts, buckets), "bucket").sortWithinPartitions("bucket").mapInArrow(_gather, _WIRE))


def _arrays(raw: list[bytes]) -> tuple:
    return np.frombuffer(raw[0], U), np.frombuffer(raw[1], np.int32).astype(np.int64), np.frombuffer(raw[2], np.int64), np.frombuffer(raw[3], np.int32), np.frombuffer(raw[4], np.uint8).reshape(-1, GROUPS), np.frombuffer(raw[5], U).reshape(-1, FINE)


def _unpack(part: pa.RecordBatch) -> Iterator[tuple]:
    """bucket, token, sig, size, point, fine: the last four by row of token."""
    for bucket, *raw in zip(*(c.to_pylist() for c in part.columns[:7]), strict=True):
        token, at, sig, size, pt, fine = _arrays(raw)
        yield bucket, token, sig[at], size.astype(np.int64)[at], pt[at], fine[at]


def _runs(token: np.ndarray, rows: int = 1 << 16) -> Iterator[slice]:
    """Slices of whole runs of equal tokens, of `rows` rows or one run: what is held by row stays small."""
    ends = np.append(np.flatnonzero(token[1:] != token[:-1]) + 1, len(token))
    lo = 0
    while lo < len(token):
        hi = int(ends[np.searchsorted(ends, min(lo + rows, len(token)), "right") - 1])
        if hi <= lo:
            hi = int(ends[np.searchsorted(ends, lo, "right")])
        yield slice(lo, hi)
        lo = hi


def _filter(ends: DataFrame):
    """A function that keeps the rows of a batch whose first column is among ends(id), and perhaps a few others; a filter of
    bounded size is broadcast."""
    width = _sketch.width_for(ends.count() * 8, 1 << 27)
    keys = lambda ids: _words.mix(ids.to_numpy(zero_copy_only=False).view(U))
    wanted = _sketch.build(ends, lambda part: np.repeat(keys(part.column(0)), 2), width)
    return lambda part: part.filter(pa.array(_sketch.repeated(wanted.value, keys(part.column(0)), width)))


def _both(pairs: DataFrame, parts: int) -> DataFrame:
    """(id) of all ends of pairs(a, b)."""
    return cut(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), parts)


def parities(s: np.ndarray) -> bytes:
    """Counts of a set in at least PARITY groups a shingle, modulo 2, as bits; the number of groups is a power of two."""
    groups = 1 << max(6, int(PARITY * len(s) - 1).bit_length())
    odd = np.bincount((s >> U(8)).astype(np.int64) & (groups - 1), minlength=groups) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def parity_bound(na: int, nb: int, x: bytes, y: bytes) -> int:
    """The largest overlap that two sets' parities allow: halves of the longer one are folded by exclusive or first."""
    x, y = np.frombuffer(x, U), np.frombuffer(y, U)
    while len(x) != len(y):
        x, y = (x, y) if len(x) > len(y) else (y, x)
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return (na + nb - int(np.bitwise_count(x ^ y).sum())) // 2


def _possible(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """pairs(a, b) that still may link by the points of PARITY and more groups a shingle, about a tenth of the texts' size."""
    parts = few(docs)
    keep = _filter(_both(pairs, parts))

    @lean
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            part = keep(part)
            got = [(len(s), parities(s)) for s in _sets(part.column(1))]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([n for n, _ in got], pa.int64()), pa.array([x for _, x in got], pa.binary())], ["id", "n", "bits"])

    @lean
    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            na, nb, x, y = (part.column(i).to_pylist() for i in range(2, 6))
            ok = pa.array([parity_bound(*z) >= needed(*z[:2]) for z in zip(na, nb, x, y, strict=True)], pa.bool_())
            yield part.select(["a", "b"]).filter(ok)

    points = cut(docs.mapInArrow(sketch, "id long, n long, bits binary"))
    both = pairs.join(points.toDF("a", "na", "xa").hint("merge"), "a").join(points.toDF("b", "nb", "xb").hint("merge"), "b")
    return cut(both.select("a", "b", "na", "nb", "xa", "xb").mapInArrow(test, "a long, b long").coalesce(parts).distinct(), parts)


def _alike(a: np.ndarray, b: np.ndarray) -> bool:
    return len(np.intersect1d(a, b, assume_unique=True)) >= needed(len(a), len(b))


def _jobs(pairs: DataFrame, sizes: DataFrame, parts: int) -> DataFrame:
    """(job, a, b): pairs that documents connect share a job; a connected group of more than JOB shingles is dealt to
    chunks by hash and its pairs to pairs of chunks, so a job holds about 2 * JOB shingles whatever the group."""
    nodes = cut(components(pairs, parts).join(sizes, F.col("node") == F.col("id")).select("node", "root", "n"), parts)
    large = nodes.groupBy("root").agg(F.sum("n").alias("n")).filter(F.col("n") > JOB).select("root", F.ceil(F.col("n") / JOB).alias("chunks"))
    large = large.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    placed = nodes.withColumn("salt", F.pmod(F.hash("node"), F.lit(SALT))).join(large, ["root", "salt"], "left")
    chunk = F.coalesce(F.pmod(F.xxhash64("node"), F.col("chunks")), F.lit(0)).alias("chunk")
    # a hub has many pairs: its row is repeated under salts, its pairs are dealt to them by their other end
    placed = placed.select("node", "root", chunk, F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    by = lambda mine, other, name: (placed.select(F.col("node").alias(mine), F.col("salt"), F.col("root"), F.col("chunk").alias(name)), F.pmod(F.hash(other), F.lit(SALT)))
    (at_a, salt_a), (at_b, salt_b) = by("a", "b", "ca"), by("b", "a", "cb")
    both = pairs.withColumn("salt", salt_a).join(at_a, ["a", "salt"]).withColumn("salt", salt_b).join(at_b.drop("root"), ["b", "salt"])
    return cut(both.select(F.xxhash64("root", F.least("ca", "cb"), F.greatest("ca", "cb")).alias("job"), "a", "b"), parts)


def _verified(pairs: DataFrame, docs: DataFrame, sizes: DataFrame) -> DataFrame:
    """(a, b) of the pairs of document ids whose sets link. Pairs that the finer points exclude are left out first; of the
    others each text travels once to each job that has a pair with it."""
    small = few(docs)
    jobs = _jobs(_possible(pairs, docs), sizes, small)
    members = cut(jobs.select("job", F.explode(F.array("a", "b")).alias("id")).distinct(), small)
    keep = _filter(members.select("id").distinct())

    @lean
    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            yield keep(part)

    none = F.lit(None)
    texts = docs.mapInArrow(wanted, "id long, text string").hint("merge").join(members, "id").select("job", F.col("id").alias("a"), none.cast("long").alias("b"), "text")
    rows = texts.unionByName(jobs.withColumn("text", none.cast("string")))

    @lean
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}
        for part in batches:
            job, a, b = part.column(0).to_numpy(), part.column(1).to_numpy(), part.column(2).to_pylist()
            sets = _sets(part.column(3))
            found = []
            for k in range(len(a)):
                s = next(sets)
                if job[k] != now:
                    now, held = job[k], {}
                if b[k] is None:
                    held.setdefault(a[k], []).append(s)
                elif any(_alike(x, y) for x in held.get(a[k], ()) for y in held.get(b[k], ())):
                    found.append((a[k], b[k]))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "job").sortWithinPartitions("job", F.col("b").isNotNull())
    return cut(dealt.select("job", "a", "b", "text").mapInArrow(verify, "a long, b long").distinct(), small)


def _roots(known: DataFrame) -> Broadcast:
    """The sorted first signatures of known(s1, root) and their roots as numbers from 0; of more than ROOTS an even share."""
    share = -(-known.count() // ROOTS)
    if share > 1:
        known = known.filter(F.pmod(F.xxhash64("s1"), F.lit(share)) == 0)

    @lean
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            yield pa.RecordBatch.from_arrays([pa.array([c.to_numpy().tobytes()], pa.binary()) for c in part.columns], ["sigs", "roots"])

    rows = known.mapInArrow(pack, "sigs binary, roots binary").collect()
    sig, root = (np.concatenate([np.zeros(0, np.int64), *[np.frombuffer(r[i], np.int64) for r in rows]]) for i in (0, 1))
    order = np.argsort(sig)
    return known.sparkSession.sparkContext.broadcast((sig[order], np.unique(root, return_inverse=True)[1][order].astype(np.int32)))


def _root_of(sig: np.ndarray, sigs: np.ndarray, roots: np.ndarray) -> np.ndarray:
    """The numbers of the roots of first signatures, -1 where none is known."""
    if not len(sigs):
        return np.full(len(sig), -1, np.int32)
    at = np.minimum(np.searchsorted(sigs, sig), len(sigs) - 1)
    return np.where(sigs[at] == sig, roots[at], -1)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.col("text").cast("string").alias("text"))


def links(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sets, links): sets has id, n, rep by row (rep: least id with an equal set, null without shingles);
    links has pairs (a, b) of representatives that were verified, enough to connect every component."""
    text_batches(docs.sparkSession)
    keyed = _keyed(docs)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    cells = _sketch.width_for(input_bytes(docs) // 8, FREQUENCY_CELLS)
    small = few(docs)
    measured = _measured(keyed, cells)
    sets = measured.filter("block IS NULL").select("id", "n", "s1", "s2")
    reps = cut(sets.filter("n > 0").groupBy("s1", "s2", "n").agg(F.min("id").alias("rep")), small)
    weights = reps.groupBy(F.col("rep").alias("id")).agg(F.max("n").alias("n"))
    routed = _routed(keyed, reps, measured, cells, parts)

    @lean
    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for _, *raw in zip(*(c.to_pylist() for c in part.columns), strict=True):
                token, at, sig, size, pt, fine = _arrays(raw)
                for x in _runs(token):
                    k = at[x]
                    a, b, ratio = _nearest(token[x], sig[k], size.astype(np.int64)[k], pt[k], fine[k])
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(ratio)], ["s", "t", "r"])

    def to_ids(pairs: DataFrame) -> DataFrame:
        """Pairs of first signatures as pairs of representatives; a shared first signature gives every set that has it."""
        by = reps.select("s1", "rep")
        x = pairs.join(by.toDF("s", "x"), "s").join(by.toDF("t", "y"), "t")
        x = x.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "r").filter("a <> b")
        return x.groupBy("a", "b").agg(F.max("r").alias("r"))

    near = cut(routed.mapInArrow(nearest, "s long, t long, r double").groupBy("s", "t").agg(F.max("r").alias("r")), small)
    first = cut(to_ids(near), small)
    hub = to_ids(near.groupBy("t").agg(F.min("s").alias("s"), F.lit(0.0).alias("r")))
    # verified first: each document's best pair over all trees, and its pair with the least set it met
    end = F.explode(F.array("a", "b")).alias("id")
    best = first.select("a", "b", "r", end).groupBy("id").agg(F.max(F.struct("r", "a", "b")).alias("p")).select("p.a", "p.b").union(hub.select("a", "b")).distinct()
    best = cut(best, small)
    linked = _verified(best, keyed, weights)
    root = cut(components(linked, small), small)
    rooted = F.coalesce("root", "rep")
    known = cut(reps.join(root, F.col("rep") == F.col("node"), "left").groupBy("s1").agg(F.min(rooted).alias("root"), F.max(rooted).alias("last"), F.count("root").alias("n")), small)
    together = _roots(known.filter("root = last AND n > 0").select("s1", "root"))
    known = known.select("s1", "root")

    @lean
    def trim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of every tree the sets with a pair that passes the bound and isn't known to lie within a component, dealt anew
        by the least of them: trees of one group of near copies meet in few buckets, where a pair is found once."""
        for part in batches:
            for _, *raw in zip(*(c.to_pylist() for c in part.columns), strict=True):
                token, at, sig, size, pt, fine = _arrays(raw)
                root = _root_of(sig, *together.value)
                still = np.zeros(len(token), bool)
                for x in _runs(token):
                    k = at[x]
                    r, new = root[k], np.ones(len(k), bool)
                    new[1:] = token[x][1:] != token[x][:-1]
                    open_ = np.flatnonzero(_groups_with(token[x], (r < 0) | (r != r[np.flatnonzero(new)][np.cumsum(new) - 1])))
                    k, r, part_still = k[open_], r[open_], np.zeros(len(open_), bool)
                    for a, b, _ in _search(token[x][open_], size.astype(np.int64)[k], pt[k], fine[k]):
                        apart = (r[a] != r[b]) | (r[a] < 0)
                        part_still[a[apart]] = part_still[b[apart]] = True
                    still[x.start + open_[part_still]] = True
                token, at = token[still], at[still]
                if not len(token):
                    continue
                new = np.ones(len(token), bool)
                new[1:] = token[1:] != token[:-1]
                least = np.minimum.reduceat(sig[at], np.flatnonzero(new))[np.cumsum(new) - 1]
                home = (_words.mix(least.view(U)) % U(homes)).astype(np.int64)
                order = np.argsort(home, kind="stable")
                token, at, home = token[order], at[order], home[order]
                cuts = np.flatnonzero(np.diff(home)) + 1
                for lo, hi in zip([0, *cuts], [*cuts, len(home)], strict=True):
                    used, place = np.unique(at[lo:hi], return_inverse=True)
                    yield _packed([(int(home[lo]), token[lo:hi], place.astype(np.int32), sig[used], size[used], pt[used], fine[used])])

    homes = max(64, input_bytes(docs) >> 23)
    opened = cut(routed.mapInArrow(trim, _WIRE).repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_gather, _WIRE))

    @lean
    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for bucket, _, sig, *_ in _unpack(part):
                sig = np.unique(sig)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sig), bucket, np.int32)), pa.array(sig)], ["bucket", "s1"])

    @lean
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def out() -> pa.RecordBatch:
            s, r = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            order = np.argsort(s)
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([s[order].tobytes()], pa.binary()), pa.array([r[order].tobytes()], pa.binary())], ["bucket", "sigs", "roots"])

        for part in batches:
            bucket, sig, r = (c.to_numpy() for c in part.columns)
            cuts = np.flatnonzero(np.diff(bucket)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(bucket)], strict=True):
                if lo < hi:
                    if bucket[lo] != at and held:
                        yield out()
                        held = []
                    at = int(bucket[lo])
                    held.append((sig[lo:hi], r[lo:hi]))
        if held:
            yield out()

    rooted = opened.mapInArrow(members, "bucket int, s1 long").join(known, "s1").select("bucket", "s1", "root")
    rooted = rooted.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(pack, "bucket int, sigs binary, roots binary")

    @lean
    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            sigs, roots = part.column(7).to_pylist(), part.column(8).to_pylist()
            for k, (_, token, sig, size, pt, fine) in enumerate(_unpack(part)):
                r = np.frombuffer(roots[k], np.int64)[np.searchsorted(np.frombuffer(sigs[k], np.int64), sig)]
                new = np.ones(len(token), bool)
                new[1:] = token[1:] != token[:-1]
                mixed = _groups_with(token, r != r[np.flatnonzero(new)][np.cumsum(new) - 1])
                token, sig, size, pt, fine, r = token[mixed], sig[mixed], size[mixed], pt[mixed], fine[mixed], r[mixed]
                held, count = [np.zeros((0, 2), np.int64)], 0
                for a, b, _ in _search(token, size, pt, fine):
                    apart = r[a] != r[b]
                    held.append(np.stack(_distinct(sig[a[apart]], sig[b[apart]]), 1))
                    count += len(held[-1])
                    if count > 1 << 18:
                        held = [np.unique(np.concatenate(held), axis=0)]
                        count = 0
                    if len(held[0]) > 1 << 20:
                        yield _pair_batch(held[0][:, 0], held[0][:, 1])
                        held = [held[0][:0]]
                pairs = np.unique(np.concatenate(held), axis=0)
                if len(pairs):
                    yield _pair_batch(pairs[:, 0], pairs[:, 1])

    second = opened.join(rooted, "bucket").mapInArrow(rest, "s long, t long").distinct().withColumn("r", F.lit(0.0))
    second = cut(to_ids(second.coalesce(small)).join(best, ["a", "b"], "left_anti").select("a", "b"), small)
    all_links = linked if second.isEmpty() else linked.unionByName(_verified(second, keyed, weights))
    rows = sets.join(reps, ["s1", "s2", "n"], "left").select("id", "n", "rep")
    return rows, all_links


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    rows, found = links(docs)
    root = components(found, few(docs)).withColumnRenamed("node", "rep")
    joined = rows.join(root, "rep", "left")
    back = lambda c: F.when(c < F.lit(NO_ID), c)
    return joined.select(back(F.col("id")).alias("doc_id"), F.col("n").alias("n_shingles"), back(F.coalesce("root", "rep", "id")).alias("component_id"))


@own_names
def representatives(docs: DataFrame) -> DataFrame:
    """docs with one row of each component, that of the least doc_id (null as the largest; then any, the same in every
    run); every column stays. Rows are told by a 64-bit hash of doc_id and text, so null and repeated ids join nothing;
    rows that a filter of the dropped hashes doesn't know aren't shuffled."""
    doc_id = F.col("doc_id").cast("long")
    node = F.least(F.xxhash64(doc_id, F.col("text").cast("string")), F.lit(NO_ID - 1))
    found = classes(docs.withColumn("doc_id", node)).filter("doc_id <> component_id")
    member = cut(found.select(F.col("doc_id").alias("__node"), "component_id").distinct())
    member = member.union(member.select("component_id", "component_id").distinct())
    rows = cut(docs.select(doc_id.alias("__gone"), node.alias("__node")).join(member, "__node").distinct())
    order = F.struct(F.col("__gone").isNull(), "__gone", "__node")
    least = rows.groupBy("component_id").agg(F.min(order).getField("__node").alias("least"), F.count(F.lit(1)).alias("w"))
    gone = cut(spread_join(rows, least, "component_id", "w").filter("__node <> least").select("__gone", "__node"))
    may_go = _sketch.among(gone.select("__node"), node)
    left = docs.filter(may_go).join(gone, doc_id.eqNullSafe(F.col("__gone")) & (node == F.col("__node")), "left_anti")
    return docs.filter(~may_go).unionByName(left)
