"""Hard-negative mining with vantage-point trees over norm-augmented vectors.

With one more component sqrt(M^2 - |v|^2), M the largest norm, a row's distance to an anchor is
sqrt(|a|^2 + M^2 - 2 a.v): the higher the inner product, the nearer the row, and a window of scores is an annulus. A tree
splits rows at the median distance from a vantage point; by the triangle inequality each leaf has a least and a greatest
distance to an anchor. An anchor visits leaves nearest first, only those that meet one of its annuli, and an annulus
shrinks to its k-th row found so far; rows leave it by score, ties by the smaller id. Labels are checked on the rows.

Over all rows, a tree fitted on a sample of at most SAMPLE rows deals every row to one of at most CELLS cells, and each
cell to shards of about SHARD rows by a hash of the id, so a cell of any share is spread. A task sorts its shards with the
anchors that ask them, builds a shard's tree and streams the anchors past it in blocks: it holds one shard and one block.
Anchors ask their nearest shards first (the root of the number of shards); what they find narrows the annuli for the other
shards, of which cell bounds leave out those that can't hold anything. Results are exact: recall is 1.

Components are floor(256 * x), x as double; scores are exact while they stay below 2^53.

Defined results: rows without vec_id, label or vector, or with a null or non-finite component take no part; a shorter
vector counts as filled up with zeros; of rows with the same vec_id the one with the least label and vector takes part; an
anchor without another row of its label, or without rows in its window, has no rows; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm._store import cut, even, lean

C = F.col
SAMPLE, CELLS, SHARD, LEAF, BLOCK = 4096, 256, 32_768, 64, 256
FOUND = "anchor_id long, slot int, id long, score long"


def cleaned(rows: DataFrame, relabel: int = 7, classes: int = 10) -> DataFrame:
    """vec_id, label, vec (integer components as doubles) of the rows that take part, one row a vec_id. Every relabel-th
    vec_id has the next label of `classes`."""
    vec = C("embedding").cast("array<double>")
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ok = rows.select(C("vec_id").cast("long").alias("vec_id"), C("label").cast("long").alias("label"), vec.alias("vec")).filter(C("vec_id").isNotNull() & C("label").isNotNull() & C("vec").isNotNull() & finite)
    moved = F.when(C("vec_id") % relabel == 0, (C("label") + 1) % classes).otherwise(C("label")) if relabel else C("label")
    one = ok.groupBy("vec_id").agg(F.min(F.struct("label", "vec")).alias("r")).select("vec_id", C("r.label").alias("label"), C("r.vec").alias("vec"))
    return one.select("vec_id", moved.alias("label"), F.transform("vec", lambda x: F.floor(x * 256).cast("double")).alias("vec"))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Lists of doubles as rows of dims columns, filled up with zeros."""
    flat, n = column.flatten().to_numpy(zero_copy_only=False), len(column)
    sizes = np.array([0 if x is None else x for x in column.value_lengths().to_pylist()], np.int64)
    if (sizes == dims).all():
        return flat.reshape(n, dims)
    out = np.zeros((n, dims))
    row = np.repeat(np.arange(n), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


class Tree:
    """A vantage-point tree over the rows x with norms up to sqrt(m2): leaves of at most `leaf` rows."""

    def __init__(self, x: np.ndarray, m2: float, leaf: int) -> None:
        self.m2, n = m2, len(x)
        last = np.sqrt(np.maximum(m2 - (x * x).sum(1), 0))
        order, vantage, self.radius, self.child, paths, self.leaves = np.arange(n), [], [], [], [], []
        work = [(0, n, ())]
        while work:
            a, b, path = work.pop()
            if path:
                self.child[path[-1][0]][path[-1][3]] = len(vantage) if b - a > leaf else ~len(paths)
            if b - a <= leaf:
                self.leaves.append((a, b))
                paths.append(path)
                continue
            part = order[a:b]
            far = lambda v, part=part: np.sqrt(np.maximum(2 * m2 - 2 * (x[part] @ x[v] + last[part] * last[v]), 0))
            v = int(part[np.argmax(far(part[0]))])
            d = far(v)
            at = np.argsort(d, kind="stable")
            order[a:b], d, half = part[at], d[at], (b - a) // 2
            node = len(vantage)
            vantage.append(v)
            self.radius.append(float(d[half - 1]))
            self.child.append([0, 0])
            work += [(a + half, b, (*path, (node, d[half], d[-1], 1))), (a, a + half, (*path, (node, d[0], d[half - 1], 0)))]
        self.order, self.vantage, self.last = order, x[vantage], last[vantage]
        depth = max(1, max(map(len, paths)))
        pad = [(0, -np.inf, np.inf, 0)]
        full = [[*p, *pad * (depth - len(p))] for p in paths]
        self.node, self.lo, self.hi = (np.array([[s[i] for s in p] for p in full], kind) for i, kind in enumerate((int, float, float)))

    def bounds(self, asks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(least, greatest) score that rows of each leaf can have with each ask."""
        reach = (asks * asks).sum(1)[:, None] + self.m2
        if not len(self.vantage):
            return np.full((len(asks), len(self.leaves)), -np.inf), np.full((len(asks), len(self.leaves)), np.inf)
        d = np.sqrt(np.maximum(reach - 2 * asks @ self.vantage.T, 0))
        near, far = np.zeros((len(asks), len(self.leaves))), np.full((len(asks), len(self.leaves)), np.inf)
        for j in range(self.node.shape[1]):
            at = d[:, self.node[:, j]]
            np.maximum(near, np.maximum(at - self.hi[:, j], self.lo[:, j] - at), out=near)
            np.minimum(far, at + self.hi[:, j], out=far)
        slack = 1e-6 * (1 + reach)
        return (reach - far * far) / 2 - slack, (reach - near * near) / 2 + slack

    def route(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each of other rows."""
        out = np.zeros(len(x), int)
        if not len(self.vantage):
            return out
        last = np.sqrt(np.maximum(self.m2 - (x * x).sum(1), 0))
        work = [(0, np.arange(len(x)))]
        while work:
            node, rows = work.pop()
            if node < 0:
                out[rows] = ~node
            elif len(rows):
                d = np.sqrt(np.maximum(2 * self.m2 - 2 * (x[rows] @ self.vantage[node] + last[rows] * self.last[node]), 0))
                inside = d <= self.radius[node]
                work += [(self.child[node][0], rows[inside]), (self.child[node][1], rows[~inside])]
        return out


class Shard:
    """The rows of one shard, in a tree."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> None:
        by_id = np.argsort(ids, kind="stable")
        ids, labels, x = ids[by_id], labels[by_id], x[by_id]
        self.tree = Tree(x, float((x * x).sum(1).max()), LEAF)
        for a, b in self.tree.leaves:
            self.tree.order[a:b].sort()
        self.ids, self.labels, self.x = (v[self.tree.order] for v in (ids, labels, x))

    def ask(self, ids: np.ndarray, labels: np.ndarray, asks: np.ndarray, lo: np.ndarray, hi: np.ndarray, k: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores), each by ask, window and place: the first k rows of the same or of another label by score within each
        window lo..hi of scores; -inf where there are fewer."""
        n, m = lo.shape
        best, who = np.full((n, m, k), -np.inf), np.full((n, m, k), np.iinfo(np.int64).max)
        low, high = self.tree.bounds(asks)
        nearest = np.argsort(-high, axis=1, kind="stable")
        place = np.empty_like(nearest)
        np.put_along_axis(place, nearest, np.arange(nearest.shape[1])[None, :], axis=1)
        begin, step = 0, 1
        while begin < nearest.shape[1]:
            floor = np.maximum(lo, best[:, :, -1])
            open_ = np.zeros_like(low, bool)
            for w in range(m):
                open_ |= (high >= floor[:, w : w + 1]) & (low <= hi[:, w : w + 1]) & (floor[:, w : w + 1] <= hi[:, w : w + 1])
            open_ &= place >= begin
            if not open_.any():
                break
            now = open_ & (place < begin + step)
            for leaf in np.flatnonzero(now.any(0)):
                self._visit(*self.tree.leaves[leaf], np.flatnonzero(now[:, leaf]), ids, labels, asks, lo, hi, same, best, who)
            begin, step = begin + step, step * 2
        return who, best

    def _visit(self, a: int, b: int, rows: np.ndarray, ids, labels, asks, lo, hi, same, best, who) -> None:
        scores = asks[rows] @ self.x[a:b].T
        fits = (labels[rows, None] == self.labels[None, a:b]) == same
        fits &= ids[rows, None] != self.ids[None, a:b]
        scores[~fits] = -np.inf
        k = best.shape[2]
        for w in range(lo.shape[1]):
            inside = np.where((scores >= np.maximum(lo[rows, w], best[rows, w, -1])[:, None]) & (scores <= hi[rows, w, None]), scores, -np.inf)
            some = np.flatnonzero(inside.max(1) > -np.inf)
            if not len(some):
                continue
            first = np.argsort(-inside[some], axis=1, kind="stable")[:, :k]
            s = np.concatenate([best[rows[some], w], np.take_along_axis(inside[some], first, 1)], 1)
            i = np.concatenate([who[rows[some], w], self.ids[a:b][first]], 1)
            at = np.lexsort((i, -s), axis=1)[:, :k]
            best[rows[some], w], who[rows[some], w] = np.take_along_axis(s, at, 1), np.take_along_axis(i, at, 1)


class Index(NamedTuple):
    """All rows by shard, and what asks are aimed with: bounded by CELLS, whatever the rows."""

    rows: DataFrame
    dims: int
    tree: Tree
    shards: np.ndarray  # how many shards each cell has
    parts: int


def index(rows: DataFrame, sample: int = SAMPLE, shard: int = SHARD) -> Index:
    """Deals rows(vec_id, label, vec) to shards; cells have bounds on the distances of all their rows, not of the sample's."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n, dims, m2 = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("vec")), F.lit(0)), F.coalesce(F.max(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)), F.lit(0.0))).first()
    shard = max(1, min(shard, max(1024, n // (2 * parts))))
    cells = max(1, min(CELLS, n // shard))
    some = rows.filter(even("vec_id") <= min(1.0, sample / max(n, 1))).select("vec").limit(2 * sample).toArrow()
    x = matrix(some.column("vec").combine_chunks(), dims) if some.num_rows else np.zeros((1, dims))
    tree = Tree(x, m2, max(1, math.ceil(len(x) / cells)))
    held = spark.sparkContext.broadcast(tree)

    @lean
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(held.value.route(matrix(part.column(2), dims)), pa.int32())], [*part.schema.names, "cell"])

    @lean
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, low, high = held.value, {}, {}
        for part in batches:
            x = matrix(part.column(0), dims)
            last = np.sqrt(np.maximum(m2 - (x * x).sum(1), 0))
            d = np.sqrt(np.maximum(2 * m2 - 2 * (x @ t.vantage.T + last[:, None] * t.last[None, :]), 0))
            cell = part.column(1).to_numpy()
            for c in np.unique(cell):
                a, b = d[cell == c].min(0), d[cell == c].max(0)
                low[c], high[c] = np.minimum(low.get(c, a), a), np.maximum(high.get(c, b), b)
        rows = [(int(c), i, float(low[c][v]), float(high[c][v])) for c in low if len(t.vantage) for i, v in enumerate(t.node[c])]
        cols = list(zip(*rows, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.float64())], ["cell", "step", "lo", "hi"])

    dealt = cut(rows.mapInArrow(deal, "vec_id long, label long, vec array<double>, cell int"))
    counts = np.zeros(len(tree.leaves), np.int64)
    for r in dealt.groupBy("cell").count().collect():
        counts[r["cell"]] = r["count"]
    for r in dealt.select("vec", "cell").mapInArrow(measure, "cell int, step int, lo double, hi double").groupBy("cell", "step").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect():
        if np.isfinite(tree.hi[r.cell, r.step]):
            tree.lo[r.cell, r.step], tree.hi[r.cell, r.step] = r.lo, r.hi
    shards = -(-counts // shard)
    salts = F.element_at(F.lit([int(max(1, s)) for s in shards]), C("cell") + 1)
    first = F.element_at(F.lit([int(s) for s in np.cumsum(shards) - shards]), C("cell") + 1)
    sharded = dealt.withColumn("shard", (first + F.pmod(F.xxhash64("vec_id"), salts)).cast("int")).drop("cell")
    return Index(sharded, dims, tree, shards, parts)


def _aimed(asks: DataFrame, at: Index, first: bool) -> DataFrame:
    """asks by shard: those nearest to each ask (as many as the root of their number), or all others that can hold anything."""
    total, of = int(at.shards.sum()), np.repeat(np.arange(len(at.shards)), at.shards)
    few, tree, dims = max(1, math.isqrt(total)), asks.sparkSession.sparkContext.broadcast(at.tree), at.dims

    @lean
    def aim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            x = matrix(part.column(2), dims)
            low, high = (b[:, of] for b in tree.value.bounds(x))
            order = np.argsort(-high, axis=1, kind="stable")
            mine = np.zeros((len(x), total), bool)
            np.put_along_axis(mine, order[:, :few], True, axis=1)
            width = max([1, *part.column(3).value_lengths().to_pylist()])
            lo, hi = (padded(part.column(c), width, fill) for c, fill in ((3, np.inf), (4, -np.inf)))
            able = np.zeros_like(mine)
            for w in range(width):
                able |= (high >= lo[:, w : w + 1]) & (low <= hi[:, w : w + 1]) & (lo[:, w : w + 1] <= hi[:, w : w + 1])
            row, shard = np.nonzero((mine if first else ~mine) & able)
            out = part.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(shard, pa.int32())], [*part.schema.names, "shard"])

    return asks.mapInArrow(aim, "id long, label long, vec array<double>, lo array<double>, hi array<double>, shard int")


def padded(column: pa.Array, width: int, fill: float) -> np.ndarray:
    out = np.full((len(column), width), fill)
    for i, x in enumerate(column.to_pylist()):
        out[i, : len(x)] = x
    return out


def _searched(asks: DataFrame, at: Index, k: int, same: bool) -> DataFrame:
    """What each asked shard has for each ask: a shard's rows come first in its task, then its asks in blocks."""
    none = F.lit(None).cast("array<double>")
    rows = at.rows.select("shard", F.lit(False).alias("asks"), C("vec_id").alias("id"), "label", "vec", none.alias("lo"), none.alias("hi"))
    both = rows.unionByName(asks.select("shard", F.lit(True).alias("asks"), "id", "label", "vec", "lo", "hi"))
    both = both.repartition(max(at.parts, min(2 * at.parts, int(at.shards.sum()))), "shard").sortWithinPartitions("shard", "asks", "id")
    dims = at.dims

    @lean
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, shard = None, [], None
        for part in batches:
            number, asking = part.column(0).to_numpy(), part.column(1).to_numpy(zero_copy_only=False)
            turns = np.flatnonzero((np.diff(number) != 0) | (asking[1:] != asking[:-1])) + 1
            for a, b in zip([0, *turns], [*turns, len(number)], strict=True):
                if a == b:
                    continue
                if number[a] != now:
                    now, held, shard = number[a], [], None
                piece = part.slice(a, b - a)
                if not asking[a]:
                    held.append((piece.column(2).to_numpy(), piece.column(3).to_numpy(), matrix(piece.column(4), dims)))
                    continue
                if shard is None and held:
                    shard, held = Shard(*(np.concatenate(x) for x in zip(*held, strict=True))), []
                for lo in range(0, (b - a) if shard is not None else 0, BLOCK):
                    yield _answers(shard, piece.slice(lo, BLOCK), dims, k, same)

    return both.mapInArrow(search, FOUND)


def _answers(shard: Shard, asks: pa.RecordBatch, dims: int, k: int, same: bool) -> pa.RecordBatch:
    width = max([1, *asks.column(5).value_lengths().to_pylist()])
    lo, hi = padded(asks.column(5), width, np.inf), padded(asks.column(6), width, -np.inf)
    ids = asks.column(2).to_numpy()
    who, best = shard.ask(ids, asks.column(3).to_numpy(), matrix(asks.column(4), dims), lo, hi, k, same)
    ask, slot, place = np.nonzero(best > -np.inf)
    return pa.RecordBatch.from_arrays([pa.array(ids[ask]), pa.array(slot, pa.int32()), pa.array(who[ask, slot, place]), pa.array(best[ask, slot, place].astype(np.int64))], ["anchor_id", "slot", "id", "score"])


def _top(found: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "id")
    return found.withColumn("place", F.row_number().over(by)).filter(C("place") <= k)


def nearest(asks: DataFrame, at: Index, k: int, same: bool) -> DataFrame:
    """anchor_id, slot (from 0), id, score, place (from 1): for each of asks(id, label, vec, lo, hi) and each of its windows
    lo[slot]..hi[slot], the first k rows of the same label or of other labels, never the ask's own."""
    asks = cut(asks)
    one = cut(_top(_searched(_aimed(asks, at, True), at, k, same), k))
    bound = one.filter(C("place") == k).groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("slot", C("score").cast("double")))).alias("bound"))
    narrowed = asks.join(bound, C("id") == C("anchor_id"), "left").withColumn("lo", F.transform("lo", lambda x, i: F.greatest(x, F.coalesce(C("bound")[i], x)))).select("id", "label", "vec", "lo", "hi")
    two = _searched(_aimed(narrowed, at, False), at, k, same)
    return cut(_top(one.drop("place").unionByName(two), k))


def mine(rows: DataFrame, every: int = 50, positives: int = 5, k: int = 3, least: int = 50, most: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for anchors, the rows with a vec_id that is a
    multiple of `every`: k negatives a positive whose score is least..most percent of the positive's."""
    rows = cut(cleaned(rows))
    at = index(rows)
    free = F.array(F.lit(float("-inf"))), F.array(F.lit(float("inf")))
    anchors = rows.filter(C("vec_id") % every == 0).select(C("vec_id").alias("id"), "label", "vec")
    found = nearest(anchors.select("id", "label", "vec", free[0].alias("lo"), free[1].alias("hi")), at, positives, True)
    found = found.select("anchor_id", (C("place") - 1).alias("slot"), C("id").alias("positive_id"), C("score").alias("positive_score"))
    low, high = F.ceil(C("positive_score") * least / 100).cast("double"), F.floor(C("positive_score") * most / 100).cast("double")
    each = found.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("slot", low.alias("lo"), high.alias("hi")))).alias("w"))
    asks = anchors.join(each, C("id") == C("anchor_id")).select("id", "label", "vec", C("w.lo").alias("lo"), C("w.hi").alias("hi"))
    hard = nearest(asks, at, k, False).select("anchor_id", "slot", C("place").alias("rank"), C("id").alias("negative_id"), C("score").alias("negative_score"))
    return hard.join(found, ["anchor_id", "slot"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
