"""Toxicity by compression distance: two zstandard dictionaries, one compared with the other by windows.

Words (runs of letters, A-Z lower-cased) are written as 16-byte codes, so that a word a dictionary holds
costs about 3 bytes and any other word 16: the difference of two compressed lengths counts words that only
one dictionary explains, with almost no coding noise (on plain letters the noise of literals hid single
words: README, notes on methods). Both
dictionaries are raw content: the ordinary one the codes that save most over ordinary documents; the toxic one the same content and, behind it, the codes that save most over toxic
documents and that ordinary text leaves unexplained. What a code saves is counted over its distinct
preceding words, so that copies of one document count once. A document's features are the excess of ordinary
over toxic length summed over its windows, the number of windows whose excess passes a threshold, and the
largest excess. A logistic curve over them, fitted on labelled documents that trained neither dictionary,
gives the score; the toxic dictionary's size and the windows' threshold are those with the least log loss there.

Bounds: at most about `max_rows` labelled documents of each class are used (their whole texts); the
dictionaries hold ORDINARY_WORDS and EXTRA_WORDS codes at most. Scores read every window of every text.

Defined results: null and empty texts have no windows and get the score of a text without any excess;
labels that are null or have no document are ignored; of repeated labels the larger counts; with labels of
one class only, every score is that class's share (0 without labels); repeated rows are scored one by one;
other columns are kept by `reject` and ignored by `score`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm import _words
from barloom.llm._store import cut, even, lean, own_names, text_batches

MAX_ROWS = 4000
WINDOW = 16
CODE = 16
#: Bytes that a window must lose under the toxic dictionary to count: the choices.
EXCESS = (4, 6, 9, 12)
ORDINARY_WORDS = 1 << 15
EXTRA_WORDS = (16, 24, 32, 48, 64, 96, 128, 192, 256, 384, 512, 1024)
THRESHOLD = 0.3
U = np.uint64


def _codes(column: pa.Array) -> Iterator[np.ndarray]:
    """For each row the 64-bit hashes of its words."""
    data, offsets = _words.buffers(column)
    for lo, hi in _words.groups(offsets):
        starts, ends, first = _words.letter_runs(data, offsets[lo : hi + 1])
        words = _words.hashes(data, int(offsets[lo]), starts, ends, lower=True)
        for k in range(hi - lo):
            yield words[first[k] : first[k + 1]]


def _spell(words: np.ndarray) -> bytes:
    """16 bytes a word."""
    out = np.empty((len(words), 2), U)
    out[:, 0] = words
    out[:, 1] = _words.mix(words ^ U(0x5BF03635AB1C77E9))
    return out.tobytes()


def _compressor(content: bytes):
    import zstandard as z

    given = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT) if content else None
    params = z.ZstdCompressionParameters.from_level(1, format=z.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0)
    return z.ZstdCompressor(dict_data=given, compression_params=params).compress


def contents(ordinary: list[int], toxic: list[int]) -> tuple[bytes, list[bytes]]:
    """(ordinary content, what the toxic dictionary adds at each size) from word hashes, most frequent first.

    zstandard spends fewer bits on near offsets, so frequent codes stand last.
    """
    spell = lambda words: _spell(np.array(words[::-1], np.int64).view(U))
    return spell(ordinary), [spell(toxic[:n]) for n in EXTRA_WORDS if n == EXTRA_WORDS[0] or n <= 2 * len(toxic)] if toxic else []


def _features(words: np.ndarray, plain, toxic: list, excess: tuple[int, ...]) -> list[tuple[float, float, float, float]]:
    """(summed excess, windows past the threshold, largest excess, windows) for each toxic compressor and threshold."""
    text = memoryview(_spell(words))
    step = WINDOW * CODE
    parts = [text[i : i + step] for i in range(0, len(text), step)]
    base = np.array([len(plain(p)) for p in parts], np.int64)
    out = []
    for c in toxic:
        gain = base - np.array([len(c(p)) for p in parts], np.int64)
        for least in excess:
            over = gain >= least
            out.append((float(gain[over].sum()), float(over.sum()), float(gain.max()) if len(gain) else 0.0, float(len(parts))))
    return out


def _design(f: np.ndarray) -> np.ndarray:
    """Columns for the logistic curve: words in excess, whether any, their share, and length."""
    excess, over, most, n = f.T
    words = excess / (CODE - 3)
    return np.column_stack([np.ones(len(f)), np.log1p(words), over > 0, np.maximum(most, 0) / CODE, np.log1p(words) / np.log(n + 2), np.log1p(n) / 5])


def _curve(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 0.5) -> np.ndarray:
    """Weighted logistic regression by Newton's method."""
    beta = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (w * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(beta))
        move = np.linalg.solve(h, x.T @ (w * (y - p)) - ridge * beta)
        beta += np.clip(move, -4, 4)
        if np.abs(move).max() < 1e-8:
            break
    return beta


class Model:
    """The two dictionaries and the curve; a constant where there was nothing to compare."""

    def __init__(self, base: bytes = b"", extra: bytes = b"", beta: np.ndarray | None = None, constant: float = 0.0, excess: int = EXCESS[0]) -> None:
        self.base, self.extra, self.beta, self.constant, self.excess = base, extra, beta, constant, excess

    def scorer(self):
        if self.beta is None:
            return lambda column: np.full(len(column), self.constant)
        plain, toxic = _compressor(self.base), [_compressor(self.base + self.extra)]

        def score(column: pa.Array) -> np.ndarray:
            f = np.array([_features(w, plain, toxic, (self.excess,))[0] for w in _codes(column)]).reshape(-1, 4)
            return 1 / (1 + np.exp(-np.clip(_design(f) @ self.beta, -30, 30)))

        return score


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """Learns from the labels given; leave held-out rows out of them."""
    text_batches(docs.sparkSession)
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).alias("label"))
    count = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    total = sum(count.values())
    if len(count) < 2:
        return Model(constant=count.get(True, 0) / total if total else 0.0)
    share = {k: min(1.0, max_rows / n) for k, n in count.items()}
    some = known.filter(even("doc_id") <= F.when(F.col("label"), share[True]).otherwise(share[False]))

    @lean
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            words = pa.array([w.tobytes() for w in _codes(part.column(2))], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), words], ["fold", "label", "words"])

    fold = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(3)).cast("int").alias("fold")
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = cut(text.join(F.broadcast(some), "doc_id").select(fold, "label", "text").mapInArrow(code, "fold int, label boolean, words binary"))

    @lean
    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for label, raw in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                words = np.frombuffer(raw, U)
                before = _words.mix(words ^ (np.concatenate([[U(0)], words[:-1]]) >> U(1)))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(words), label)), pa.array(words.view(np.int64)), pa.array(before.view(np.int64))], ["label", "word", "pair"])

    pairs = rows.filter("fold > 0").select("label", "words").mapInArrow(distinct, "label boolean, word long, pair long").groupBy("word", "pair").agg(F.bool_or("label").alias("t"), F.bool_or(~F.col("label")).alias("o"))
    seen_in = cut(pairs.groupBy("word").agg(F.count_if("t").alias("t"), F.count_if("o").alias("o")).filter("t + o > 1"))
    plain_words = [r.word for r in seen_in.filter("o > 0").orderBy(F.desc("o"), "word").select("word").limit(ORDINARY_WORDS).collect()]
    some_words = seen_in.filter("t > 1 AND t > 2 * o").orderBy(F.expr("o - t"), "word").select("word").limit(EXTRA_WORDS[-1] + ORDINARY_WORDS).collect()
    held = set(plain_words)
    base, extras = contents(plain_words, [r.word for r in some_words if r.word not in held][: EXTRA_WORDS[-1]])
    if not extras:
        return Model(constant=count[True] / total)

    @lean
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain, toxic = _compressor(base), [_compressor(base + x) for x in extras]
        for part in batches:
            f = [np.array(_features(np.frombuffer(raw, U), plain, toxic, EXCESS)).ravel().tolist() for raw in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(f, pa.list_(pa.float64()))], ["label", "f"])

    seen = sorted((r.label, tuple(r.f)) for r in rows.filter("fold = 0").select("label", "words").mapInArrow(measure, "label boolean, f array<double>").collect())
    if len({label for label, _ in seen}) < 2:
        return Model(constant=count[True] / total)
    y = np.array([label for label, _ in seen], float)
    f = np.array([x for _, x in seen]).reshape(len(seen), len(extras) * len(EXCESS), 4)
    w = np.where(y > 0, 1 / share[True], 1 / share[False])
    w *= len(w) / w.sum()
    best = None
    for k in range(len(extras) * len(EXCESS)):
        x = _design(f[:, k])
        beta = _curve(x, y, w)
        p = np.clip(1 / (1 + np.exp(-np.clip(x @ beta, -30, 30))), 1e-6, 1 - 1e-6)
        loss = -(w * (y * np.log(p) + (1 - y) * np.log(1 - p))).mean()
        if best is None or loss < best[0] - 1e-6:
            best = (loss, k, beta)
    return Model(base, extras[best[1] // len(EXCESS)], best[2], excess=EXCESS[best[1] % len(EXCESS)])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted of every row."""
    text_batches(docs.sparkSession)
    given = docs.sparkSession.sparkContext.broadcast(model)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rate = given.value.scorer()
        for part in batches:
            s = rate(part.column(1))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s, pa.float64()), pa.array((s >= THRESHOLD).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double, predicted int")


@own_names
def reject(docs: DataFrame, model: Model) -> DataFrame:
    """docs without the rows predicted toxic; every column stays."""
    text_batches(docs.sparkSession)
    given = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.schema
    at = docs.columns.index("text")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rate = given.value.scorer()
        for part in batches:
            yield part.filter(pa.array(rate(part.column(at).cast(pa.string())) < THRESHOLD))

    return docs.mapInArrow(run, schema)
