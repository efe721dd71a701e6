"""Language identification with language-bitmask n-gram filters.

One bit-sliced Bloom filter serves all languages: a cell is a bitmask with one bit a language (in as many 64-bit words as
they need), an n-gram sets its languages' bits in `HASHES` cells, and a lookup's AND of these cells gives every language that
has the n-gram (and perhaps some that don't). N-grams are byte n-grams of letter runs with their ends
marked. A language has an n-gram when its documents show it twice or more and at no less than `RATIO` of
the largest relative frequency among all languages, so stray foreign words and noise set no bits.

A text's n-grams are looked up all at once; each language's popcount over n-grams, c of n, is corrected
for that language's false-positive rate f (its bits' density to the power HASHES): p = (c/n - f) / (1 - f).
The language of the largest p wins, ties to the first in order; the score is that p over the sum of the
two largest.

Bounds: fitted on at most about `max_rows` labelled rows, dealt evenly to languages (whole texts). Prediction reads every n-gram of every text.

Defined results: null texts and texts without a letter give `und` and score 0; a text whose n-grams are
all unknown gives the language with most training rows and score 0; rows with null lang or text train
nothing; with no training rows everything is `und`; repeated rows are judged one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm import _words
from barloom.llm._store import even, lean, text_batches

MAX_ROWS = 12_000
SIZES = (3, 5)
HASHES = 3
RATIO = 0.2
U = np.uint64
FOLD = np.where(_words.LETTER, _words.LOWER, 0).astype(np.uint8)


def _grams(data: np.ndarray, lo: int, hi: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(start, hash) of the n-grams of data[lo:hi], by size; an n-gram spans letters and at most the marks at its ends."""
    x = FOLD[data[lo:hi]]
    gap = np.concatenate([[0], np.cumsum(x == 0)])
    wide = x.astype(U)
    for n in SIZES:
        m = len(x) - n + 1
        if m <= 0:
            continue
        inner = gap[n - 1 : n - 1 + m] == gap[1 : 1 + m]
        at = np.flatnonzero(inner & ((x[:m] != 0) | (x[1 : 1 + m] != 0)))
        key = np.full(len(at), U(n))
        for k in range(n):
            key = (key << U(8)) | wide[at + k]
        yield at, _words.mix(key)


def _pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(row, lo, hi): rows cut into pieces of about 2 MB."""
    for row in range(len(offsets) - 1):
        a, b = int(offsets[row]), int(offsets[row + 1])
        for lo in range(a, max(b, a + 1), 1 << 21):
            yield row, lo, min(b, lo + (1 << 21) + max(SIZES) - 1)


def _has_letter(text: np.ndarray) -> bool:
    return bool((_words.LETTER[text] & (text < 128)).any()) or any(map(str.isalpha, text.tobytes().decode()))


class Filters:
    """The bit-sliced filters; `languages` in the order of their bits, 64 in each column of masks and cells."""

    def __init__(self, languages: list[str], keys: np.ndarray, masks: np.ndarray, fallback: str) -> None:
        kind = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if np.dtype(t).itemsize * 8 >= min(64, len(languages)))
        self.languages, self.fallback = languages, fallback
        self.words = max(1, -(-len(languages) // 64))
        self.cells = np.zeros((self.words, 1 << max(12, int(8 * max(1, len(keys)) - 1).bit_length())), kind)
        masks = masks.reshape(len(keys), self.words).astype(kind)
        for at in self._at(keys):
            for w in range(self.words):
                np.bitwise_or.at(self.cells[w], at, masks[:, w])
        self.false_rate = np.array([self._bit(self.cells, k).mean() for k in range(len(languages))]) ** HASHES

    @staticmethod
    def _bit(masks: np.ndarray, k: int) -> np.ndarray:
        """The bit of language k in masks, which have one row for every 64 languages."""
        row = masks[k // 64]
        return (row >> row.dtype.type(k % 64)) & row.dtype.type(1)

    def _at(self, keys: np.ndarray) -> Iterator[np.ndarray]:
        bits = U(self.cells.shape[1].bit_length() - 1)
        for k in range(HASHES):
            yield ((keys * U(_words.BASES[k])) >> (U(64) - bits)).astype(np.int64)

    def masks(self, keys: np.ndarray) -> np.ndarray:
        out = None
        for at in self._at(keys):
            out = self.cells[:, at] if out is None else out & self.cells[:, at]
        return out

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        data, offsets = _words.buffers(column)
        rows, count = len(offsets) - 1, len(self.languages)
        hits, total = np.zeros((rows, count)), np.zeros(rows)
        for lo, hi in _words.groups(offsets, 1 << 20):
            if hi == lo + 1:
                spans = [(r + lo, a, b) for r, a, b in _pieces(data, offsets[lo : hi + 1])]
                for row, a, b in spans:
                    for _, keys in _grams(data, a, b):
                        m = self.masks(keys)
                        total[row] += len(keys)
                        for k in range(count):
                            hits[row, k] += np.count_nonzero(self._bit(m, k))
                continue
            base = int(offsets[lo])
            for at, keys in _grams(data, base, int(offsets[hi])):
                m = self.masks(keys)
                first = np.searchsorted(at, offsets[lo : hi + 1] - base)
                total[lo:hi] += np.diff(first)
                for k in range(count):
                    sums = np.concatenate([[0], np.cumsum(self._bit(m, k), dtype=np.int64)])
                    hits[lo:hi, k] += np.diff(sums[first])
        share = np.clip((hits / np.maximum(total, 1)[:, None] - self.false_rate) / (1 - np.minimum(self.false_rate, 0.999)), 0, 1)
        names, scores = [], np.zeros(rows)
        best = share.argmax(1) if count else np.zeros(rows, int)
        for r in range(rows):
            top = share[r, best[r]] if count else 0.0
            if not count or not _has_letter(data[offsets[r] : offsets[r + 1]]):
                names.append("und")
            elif top <= 0:
                names.append(self.fallback)
            else:
                names.append(self.languages[best[r]])
                scores[r] = top / np.sort(share[r])[-2:].sum()
        return names, scores


def fit(docs: DataFrame, max_rows: int = MAX_ROWS) -> Filters | None:
    """Learns from rows with text and lang; leave held-out rows out of docs."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL")
    count = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not count:
        return None
    languages = sorted(count)
    number = {lang: k for k, lang in enumerate(languages)}
    share = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, max_rows / len(languages) / count[lang]))])

    @lean
    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            data, offsets = _words.buffers(part.column(0))
            langs = [number[x] for x in part.column(1).to_pylist()]
            keys: dict[int, list[np.ndarray]] = {}
            for row, lo, hi in _pieces(data, offsets):
                for _, k in _grams(data, lo, hi):
                    keys.setdefault(langs[row], []).append(k)
            for lang, parts in keys.items():
                k, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), lang, np.int32)), pa.array(k.astype(np.int64)), pa.array(n)], ["lang", "key", "n"])

    some = rows.filter(even("doc_id") <= share[F.col("lang")]).select("text", "lang")
    counts = some.mapInArrow(tally, "lang int, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    by_key = counts.groupBy("key").agg(F.collect_list(F.struct("lang", "n")).alias("seen")).filter("exists(seen, x -> x.n >= 2)")

    @lean
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_numpy().tobytes()]), pa.array([part.column(1).to_numpy().tobytes()]), pa.array([part.column(2).to_numpy().tobytes()])], ["key", "lang", "n"])

    packed = by_key.select("key", F.explode("seen").alias("s")).select("key", F.col("s.lang").alias("lang"), F.col("s.n").alias("n")).mapInArrow(pack, "key binary, lang binary, n binary").collect()
    key, lang, n = (np.concatenate([np.frombuffer(r[i], t) for r in packed] or [np.zeros(0, t)]) for i, t in ((0, U), (1, np.int32), (2, np.int64)))
    totals = np.maximum(np.bincount(lang, n, len(languages)), 1)
    rate = n / totals[lang]
    order = np.argsort(key, kind="stable")
    key, lang, n, rate = key[order], lang[order], n[order], rate[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    first = np.flatnonzero(new)
    most = np.maximum.reduceat(rate, first)[np.cumsum(new) - 1] if len(key) else rate
    seen = (n >= 2) & (rate >= RATIO * most)
    masks = np.zeros((len(first), -(-len(languages) // 64)), U)
    np.bitwise_or.at(masks, ((np.cumsum(new) - 1)[seen], lang[seen] // 64), U(1) << (lang[seen] % 64).astype(U))
    some_bits = masks.any(1)
    return Filters(languages, key[first][some_bits], masks[some_bits], max(languages, key=lambda x: (count[x], x)))


def predict(docs: DataFrame, filters: Filters | None) -> DataFrame:
    """doc_id, lang_pred, score of every row."""
    text_batches(docs.sparkSession)
    given = docs.sparkSession.sparkContext.broadcast(filters)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            names, scores = given.value.predict(part.column(1)) if given.value else (["und"] * len(part), np.zeros(len(part)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double")
