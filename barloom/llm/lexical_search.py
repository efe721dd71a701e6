"""Ranked lexical search over sharded postings, document at a time.

A task turns the texts it reads into shards of at most DOCS documents: for each term the documents that hold it, sorted by
doc_id, in compressed blocks. A block covers SPAN consecutive documents of its shard, so blocks of different terms with the
same number are about the same documents. A query merges its terms' lists by a heap of their next blocks: the blocks with
the least number are decoded together, each document's score is summed over them, and documents enter the bounded result
heap, keyed by score and then by doc_id, in order of doc_id; a document under the heap's least entry is passed over. A task
merges its shards' results, and the queries' best rows of all tasks are merged last.

Shards may be restricted to the terms of the queries at hand: a filter of bounded size tells which terms may be among
them, and of those only the equal ones are ever looked up. Counts of the corpus come from all documents and all terms.
Terms are compared by a 64-bit hash, their length, and their first and last eight bytes.

Weights are floor(1000 * ln((2 N + 2) / (2 df + 1))); the rest is integer arithmetic (see `search`). Queries are asked in
blocks of about QUERIES terms, which are broadcast, one block after the other; a task holds one shard and one block.

Defined results: null and empty texts have no terms and aren't counted; a query without terms has no rows; queries with
the same id are one query; a null doc_id comes after all others of the same score; documents with the same doc_id are
ranked each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm import _sketch, _words
from barloom.llm._store import cut, lean

C = F.col
U = np.uint64
#: Bytes that separate terms: ASCII other than digits and letters.
APART = np.ones(256, bool)
APART[48:58] = APART[65:91] = APART[97:123] = APART[128:] = False
DOCS, TEXT, SPAN, HELD, QUERIES = 16_384, 32 << 20, 4096, 64 << 20, 1 << 18
NO_ID = np.iinfo(np.int64).max
POSTINGS = "shard long, term binary, block int, n int, total long, data binary"


def term_keys(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, spans, row, first): the hash and byte span of every term, its row, and the place of each row's first term."""
    data, offsets = _words.buffers(texts)
    starts, ends, first = _words.spans(data, offsets, APART)
    base = int(offsets[0])
    hashed = _words.hashes(data, base, starts, ends, lower=True)
    return hashed, np.stack([starts, ends]), _words.row_of(first), first


def whole_keys(texts: pa.Array, hashed: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """28 bytes for each term at the given spans: its hash, its length, its first and its last eight bytes."""
    data, offsets = _words.buffers(texts)
    low = _words.LOWER[data[int(offsets[0]) : int(offsets[-1])]]
    starts, ends = spans
    low = np.concatenate([np.zeros(8, np.uint8), low, np.zeros(8, np.uint8)])
    out = np.zeros((len(starts), 28), np.uint8)
    out[:, :8] = hashed.astype("<u8").view(np.uint8).reshape(-1, 8)
    out[:, 8:12] = (ends - starts).astype("<u4").view(np.uint8).reshape(-1, 4)
    step = np.arange(8)
    size = (ends - starts)[:, None]
    out[:, 12:20] = low[starts[:, None] + step + 8] * (step < size)
    out[:, 20:28] = low[ends[:, None] + step] * (step >= 8 - size)
    return out


def _groups(texts: pa.Array) -> Iterator[pa.Array]:
    _, offsets = _words.buffers(texts)
    for lo, hi in _words.groups(offsets, 4 << 20):
        yield lo, texts.slice(lo, hi - lo)


class Corpus(NamedTuple):
    """Postings by shard, each shard's documents, and counts over all documents."""

    postings: DataFrame  # POSTINGS, shard by shard; first the row without a term: the shard's doc_ids and lengths
    docs: int  # N
    terms: int  # L


def index(docs: DataFrame, queries: DataFrame | None = None, max_bits: int = 1 << 27) -> Corpus:
    """Shards over docs(doc_id, text), of all terms, or of those that queries(item_id, text) may ask for. Written once to the
    checkpoint folder."""
    spark = docs.sparkSession
    seen = width = None
    if queries is not None:
        asked = query_terms(queries).select("term").distinct()
        width = _sketch.width_for(asked.count() * 8, max_bits)
        seen = _sketch.build(asked, lambda part: np.repeat(_hash_of(part.column(0)), 2), width)

    @lean
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId() << 32
        held, n, size = [], 0, 0
        for batch in batches:
            ids = np.array([NO_ID if x is None else x for x in batch.column(0).to_pylist()], np.int64)
            for lo, texts in _groups(batch.column(1)):
                hashed, spans, row, first = term_keys(texts)
                lengths = np.diff(first)
                mine = np.flatnonzero(_sketch.repeated(seen.value, hashed, width)) if seen is not None else np.arange(len(hashed))
                keys = whole_keys(texts, hashed[mine], spans[:, mine])
                order = np.lexsort((row[mine], hashed[mine]))
                held.append((ids[lo : lo + len(texts)], lengths, keys[order], row[mine][order]))
                n, size = n + len(texts), size + len(mine) * 36 + len(texts) * 16
                if n >= DOCS or size >= TEXT:
                    yield from _written(shard, held)
                    shard, held, n, size = shard + 1, [], 0, 0
        if held:
            yield from _written(shard, held)

    found = cut(docs.select(C("doc_id").cast("long"), C("text").cast("string")).mapInArrow(build, POSTINGS))
    total = found.filter("term IS NULL").agg(F.sum("n"), F.sum("total")).first()
    return Corpus(found, total[0] or 0, total[1] or 0)


def _hash_of(terms: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(t[:8] for t in terms.to_pylist()), "<u8")


def packed(*columns: np.ndarray) -> bytes:
    """Columns of one length, compressed."""
    import zstandard

    return zstandard.compress(b"".join(np.ascontiguousarray(c, "<i8").tobytes() for c in columns), 1)


def unpacked(data: bytes, n: int = 2) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.decompress(data), "<i8").reshape(n, -1)


def _small(at: np.ndarray, tf: np.ndarray) -> bytes:
    """Ascending places in a block, as differences, and counts."""
    wide = int(tf.max() > 255)
    return bytes([wide]) + _press(np.diff(at, prepend=0).astype("<u2").tobytes() + tf.astype("<u4" if wide else np.uint8).tobytes())


def _press(body: bytes) -> bytes:
    import zstandard

    return b"\0" + body if len(body) < 96 else b"\1" + zstandard.compress(body, 1)


def _decoded(data: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    import zstandard

    body = data[2:] if data[1] == 0 else zstandard.decompress(data[2:])
    return np.cumsum(np.frombuffer(body, "<u2", n), dtype=np.int64), np.frombuffer(body, "<u4" if data[0] else np.uint8, n, offset=2 * n).astype(np.int64)


def _written(shard: int, held: list[tuple]) -> Iterator[pa.RecordBatch]:
    """One shard: its documents sorted by doc_id (those without terms left out), then its terms' blocks."""
    ids, lengths = (np.concatenate([x[i] for x in held]) for i in (0, 1))
    shift = np.cumsum([0] + [len(x[0]) for x in held[:-1]])
    keys = np.concatenate([x[2] for x in held])
    doc = np.concatenate([x[3] + s for x, s in zip(held, shift, strict=True)])
    order = np.argsort(ids, kind="stable")
    order = order[lengths[order] > 0]
    place = np.zeros(len(ids), np.int64)
    place[order] = np.arange(len(order))
    names = ["shard", "term", "block", "n", "total", "data"]
    kinds = [pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
    out = [(shard, None, -1, len(order), int(lengths.sum()), packed(ids[order], lengths[order]))]
    if len(keys):
        _, index, which = np.unique(keys[:, :8].copy().view("<u8").ravel(), return_index=True, return_inverse=True)
        if (keys != keys[index][which]).any():  # two terms of one hash
            _, index, which = np.unique(keys.view("S28").ravel(), return_index=True, return_inverse=True)
        code, tf = np.unique(which.astype(np.int64) * len(ids) + place[doc], return_counts=True)
        which, at = np.divmod(code, len(ids))
        block = at // SPAN
        cuts = np.flatnonzero((np.diff(which) != 0) | (np.diff(block) != 0)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(at)], strict=True):
            out.append((shard, keys[index[which[a]]].tobytes(), int(block[a]), b - a, 0, _small(at[a:b] - block[a] * SPAN, tf[a:b])))
    for lo in range(0, len(out), 4096):
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out[lo : lo + 4096], strict=True), kinds, strict=True)], names)


def query_terms(queries: DataFrame) -> DataFrame:
    """item_id, term (28-byte key), times: the terms of each query, repeats counted."""

    @lean
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            hashed, spans, row, _ = term_keys(part.column(1))
            keys = whole_keys(part.column(1), hashed, spans)
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array([k.tobytes() for k in keys], pa.binary())], ["item_id", "term"])

    found = queries.select(C("item_id").cast("long"), C("text").cast("string")).mapInArrow(read, "item_id long, term binary")
    return found.groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("times"))


class Shard:
    """One shard's postings: blocks by term, decoded and scored when first asked for."""

    def __init__(self, corpus: Corpus) -> None:
        self.n, self.l = corpus.docs, corpus.terms
        self.blocks: dict[bytes, list[tuple[int, int, bytes]]] = {}
        self.scored: dict[tuple[bytes, int], tuple[np.ndarray, np.ndarray]] = {}
        self.held = 0
        self.ids = np.zeros(0, np.int64)

    def add(self, term: bytes | None, block: int, n: int, data: bytes) -> None:
        if term is None:
            self.ids, lengths = unpacked(data)
            self.m12 = 12 * (75 + 25 * lengths * self.n // max(1, self.l))
        else:
            self.blocks.setdefault(term, []).append((block, n, data))

    def scores(self, term: bytes, block: int, n: int, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(places in the block, score of one unit of weight) of a term's documents."""
        key = (term, block)
        if key not in self.scored:
            if self.held > HELD:
                self.scored, self.held = {}, 0
            at, tf = _decoded(data, n)
            self.scored[key] = at, (1_000_000_000 * tf) // (1000 * tf + self.m12[at + block * SPAN])
            self.held += 16 * n + 200
        return self.scored[key]

    def best(self, terms: list[tuple[bytes, int]], k: int, heap: list[tuple[int, int]]) -> None:
        """Puts this shard's documents into the heap of the k best (score, -doc_id)."""
        cursors = []
        for i, (term, weight) in enumerate(terms):
            blocks = self.blocks.get(term)
            if blocks and weight:
                heapq.heappush(cursors, (blocks[0][0], i, 0))
        while cursors:
            now = cursors[0][0]
            total = np.zeros(min(SPAN, len(self.ids) - now * SPAN), np.int64)
            while cursors and cursors[0][0] == now:
                _, i, j = cursors[0]
                term, weight = terms[i]
                at, unit = self.scores(term, *self.blocks[term][j])
                total[at] += weight * unit
                if j + 1 < len(self.blocks[term]):
                    heapq.heapreplace(cursors, (self.blocks[term][j + 1][0], i, j + 1))
                else:
                    heapq.heappop(cursors)
            self._enter(total, now * SPAN, k, heap)

    def _enter(self, total: np.ndarray, at: int, k: int, heap: list[tuple[int, int]]) -> None:
        floor = heap[0][0] if len(heap) >= k else 1
        rows = np.flatnonzero(total >= max(1, floor))
        if len(rows) > 4 * k:  # of many only those at or above the k-th score can stay
            rows = rows[total[rows] >= np.partition(total[rows], len(rows) - k)[len(rows) - k]]
        for score, doc in zip(total[rows].tolist(), self.ids[at + rows].tolist(), strict=True):
            if len(heap) < k:
                heapq.heappush(heap, (score, -doc))
            elif (score, -doc) > heap[0]:
                heapq.heapreplace(heap, (score, -doc))


def search(corpus: Corpus, queries: DataFrame, k: int = 20) -> DataFrame:
    """item_id, rank, doc_id, score: each query's k best documents.

    With N documents that have terms, L terms in all of them and n in a document: m = 75 + (25 n N) div L; a document's
    score is the sum, over the query's terms, of weight * ((10^9 tf) div (1000 tf + 12 m)); only scores above 0 count.
    """
    spark = queries.sparkSession
    df = corpus.postings.filter("term IS NOT NULL").groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * corpus.docs + 2.0) / (2.0 * C("df") + 1.0))).cast("long")
    terms = query_terms(queries).join(df, "term").select("item_id", F.struct("term", (weight * C("times")).alias("weight")).alias("t"))
    asks = cut(terms.groupBy("item_id").agg(F.sort_array(F.collect_list("t")).alias("terms")))
    shards = corpus.postings.filter("term IS NULL").select("shard")
    number = max(1, -(-(asks.agg(F.sum(F.size("terms"))).first()[0] or 0) // QUERIES))
    found = None
    for block in range(number):
        mine = [(r.item_id, [(bytes(t.term), t.weight) for t in r.terms]) for r in asks.filter(F.pmod(F.xxhash64("item_id"), F.lit(number)) == block).collect()]
        part = _asked(corpus, spark.sparkContext.broadcast(mine), k)
        found = part if found is None else found.unionByName(part)
    by = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    best = found.withColumn("rank", F.row_number().over(by)).filter(C("rank") <= k)
    return best.select("item_id", "rank", F.when(C("doc_id") < F.lit(int(NO_ID)), C("doc_id")).alias("doc_id"), "score")


def _asked(corpus: Corpus, queries: Broadcast, k: int) -> DataFrame:
    """item_id, doc_id, score: the k best of each task's shards for one block of queries."""
    counts = corpus._replace(postings=None)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: list[list[tuple[int, int]]] = [[] for _ in queries.value]
        now, shard = None, Shard(counts)

        def ask() -> None:
            for (_, terms), heap in zip(queries.value, heaps, strict=True):
                shard.best(terms, k, heap)

        for part in batches:
            for number, *row in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if number != now:
                    ask()
                    now, shard = number, Shard(counts)
                shard.add(*row)
        ask()
        out = [(item, -doc, score) for (item, _), heap in zip(queries.value, heaps, strict=True) for score, doc in heap]
        cols = list(zip(*out, strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["item_id", "doc_id", "score"])

    return corpus.postings.select("shard", "term", "block", "n", "data").mapInArrow(run, "item_id long, doc_id long, score long")
