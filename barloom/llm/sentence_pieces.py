"""SentencePiece models on the tokenizers library: encoding, decoding, and parity with the original.

The model's protobuf is parsed here (no generated code), and its parts are rebuilt: the normaliser
(precompiled character map, extra white space, dummy prefix), the metaspace marker, BPE merges ranked by
piece score or unigram scores, and byte fallback. Texts are cut before every run of markers that follows
another character, which is exact because no piece of the model has a marker behind another character
(checked; otherwise texts stay whole). Batches are encoded by the library's threads.

`encode(verify=True)` encodes every text with the sentencepiece library as well and tells whether the ids agree.

Defined results: null and empty texts have no ids (and decode to an empty text); strings such as `<s>` in a
text are ordinary text; repeated rows are encoded one by one; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import os
import struct
import sys
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm._store import kept_in_worker, lean, text_batches

MODEL = "piece_bpe_32k.model"
THREADS = 2
#: Words held in each of two generations by a Python worker, about 150 bytes each.
WORDS = 400_000
TOGETHER = 512
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def fields(data: bytes) -> Iterator[tuple[int, int | float | bytes]]:
    """(field number, value) of a protobuf message; nested messages and strings stay bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        wire = key & 7
        if wire == 0:
            yield key >> 3, varint()
        elif wire == 2:
            size = varint()
            yield key >> 3, data[at : at + size]
            at += size
        elif wire in (1, 5):
            size = 8 if wire == 1 else 4
            yield key >> 3, struct.unpack("<d" if wire == 1 else "<f", data[at : at + size])[0]
            at += size
        else:
            raise ValueError(f"wire type {wire}")


@dataclass(frozen=True)
class Model:
    pieces: tuple[tuple[str, float, int], ...]
    kind: int
    byte_fallback: bool
    unk_id: int
    charsmap: bytes
    dummy_prefix: bool
    squeeze: bool
    escape: bool

    @staticmethod
    def parse(data: bytes) -> Model:
        pieces, trainer, normalizer = [], {}, {}
        for number, value in fields(data):
            if number == 1:
                piece = dict(fields(value))
                pieces.append((piece[1].decode(), piece.get(2, 0.0), piece.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                normalizer = dict(fields(value))
        unk = next((k for k, p in enumerate(pieces) if p[2] == UNKNOWN), 0)
        flag = lambda n: bool(normalizer.get(n, 1))
        return Model(tuple(pieces), trainer.get(3, UNIGRAM), bool(trainer.get(35, 0)), unk, normalizer.get(2, b""), flag(3), flag(4), flag(5))

    def merges(self) -> list[tuple[str, str]]:
        """Every split of a piece into two pieces, by the piece's score; at equal scores longer left parts
        first, which is how runs of markers grow from the left."""
        score = {p: s for p, s, t in self.pieces if t in (NORMAL, USER)}
        out = []
        for piece, s in score.items():
            for k in range(1, len(piece)):
                left, right = piece[:k], piece[k:]
                if left in score and right in score:
                    out.append((-s, -len(left) if s <= -1e8 else 0, left, right))
        out.sort(key=lambda x: x[:2])
        return [(left, right) for _, _, left, right in out]


def build(model: Model):
    """A tokenizers.Tokenizer that encodes and decodes as the model does."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    unk = model.pieces[model.unk_id][0]
    if model.kind == BPE:
        vocab = {p: k for k, (p, _, _) in enumerate(model.pieces)}
        core = models.BPE(vocab, model.merges(), unk_token=unk, fuse_unk=True, byte_fallback=model.byte_fallback)
    elif model.kind == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], model.unk_id, model.byte_fallback)
    else:
        raise ValueError("only BPE and unigram models")
    out = Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.squeeze:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip()]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(MARK if model.escape else " "))
    if model.escape:
        steps.append(normalizers.Replace(" ", MARK))
    out.normalizer = normalizers.Sequence(steps)
    if not any(MARK in p.lstrip(MARK) for p, _, t in model.pieces if t in (NORMAL, USER)):
        out.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*"), "isolated")
    out.add_tokens([AddedToken(p, normalized=False) for p, _, t in model.pieces if t == USER])
    tail = [decoders.Strip(" ", 1, 0)] if model.dummy_prefix else []
    out.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *tail])
    return out


class Coder:
    """Encodes batches; words between single spaces are looked up, and a batch's new ones are encoded together by the
    library's threads. That is exact where texts are cut before markers and nothing else is normalised."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            model = Model.parse(f.read())
        self.tokenizer = build(model)
        self.by_word = self.tokenizer.pre_tokenizer is not None and model.dummy_prefix and model.escape and not (model.charsmap or model.squeeze)
        self.begins = np.array([p.startswith(MARK) for p, _, _ in model.pieces])
        self.words: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.broken: set[str] = set()  # words that decoding doesn't give back

    def _encode(self, texts: list[str]) -> Iterator[bytes]:
        for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False):
            yield array("I", e.ids).tobytes()

    def _encode_words(self, words: list[str]) -> Iterator[bytes]:
        """The ids of each word behind a marker: many words in one text, cut where a piece begins with the marker,
        as a word holds none and its first piece always has it."""
        texts = [words[i : i + TOGETHER] for i in range(0, len(words), TOGETHER)]
        for part, raw in zip(texts, self._encode([" ".join(t) for t in texts]), strict=True):
            first = np.flatnonzero(self.begins[np.frombuffer(raw, np.uint32)]).tolist()
            if len(first) != len(part):
                yield from self._encode(part)
                continue
            for a, b in zip(first, [*first[1:], len(raw) // 4], strict=True):
                yield raw[4 * a : 4 * b]

    def _broken(self, words: list[str], ids: list[bytes]) -> Iterator[str]:
        """Words that decoding doesn't give back. Many are decoded in one text: where each one's ids begin with a marker, it
        is the words joined by spaces only if each word comes back. Where it isn't, words are decoded one by one."""
        lists = lambda some: [np.frombuffer(x, np.uint32).tolist() for x in some]
        at = range(0, len(words), TOGETHER)
        texts = self.decode(lists(b"".join(ids[i : i + TOGETHER]) for i in at))
        for i, text in zip(at, texts, strict=True):
            part, own = words[i : i + TOGETHER], ids[i : i + TOGETHER]
            if text != " ".join(part) or not all(own) or not self.begins[np.frombuffer(b"".join(x[:4] for x in own), np.uint32)].all():
                yield from (w for w, back in zip(part, self.decode(lists(own)), strict=True) if w != back)

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as native uint32 bytes."""
        parts = self._parts(texts)
        need = {w for p in parts if p for w in p}.difference(self.words)
        if len(self.words) + len(need) > WORDS:  # words still in use come back from the older generation
            self.old, self.words = self.words, {}
            self.broken.intersection_update(self.old)
            need = {w for p in parts if p for w in p}
        new = list(need.difference(self.old))
        self.words.update((w, self.old[w]) for w in need.intersection(self.old))
        ids = list(self._encode_words(new))
        self.words.update(zip(new, ids, strict=True))
        self.broken.update(self._broken(new, ids))
        whole = self._encode([t for t, p in zip(texts, parts, strict=True) if p is None])
        look = self.words.__getitem__
        return [next(whole) if p is None else b"".join(map(look, p)) for p in parts]

    def _parts(self, texts: list[str]) -> list[list[str] | None]:
        """The words of texts with single spaces only; None for the others."""
        parts = [t.split(" ") if self.by_word and t and MARK not in t else None for t in texts]
        return [None if p is None or "" in p else p for p in parts]

    def round_trips(self, texts: list[str], coded: list[bytes]) -> list[bool]:
        """Whether decoding gives each text back: by word where texts are encoded by word."""
        parts = self._parts(texts)
        back = iter(self.decode([np.frombuffer(c, np.uint32).tolist() for c, p in zip(coded, parts, strict=True) if p is None]))
        return [next(back) == t if p is None else self.broken.isdisjoint(p) for t, p in zip(texts, parts, strict=True)]

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.tokenizer.decode_batch(ids, skip_special_tokens=False)


def little_endian(ids: bytes) -> bytes:
    return ids if sys.byteorder == "little" else np.frombuffer(ids, np.uint32).astype("<u4").tobytes()


@kept_in_worker
def _loaded(path: str, threads: int) -> Coder:
    """One coder, with its words, for all tasks of a Python worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
    os.environ["RAYON_NUM_THREADS"] = str(threads)
    return Coder(path)


@kept_in_worker
def _original(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def _path(model: str | None) -> str:
    if model:
        return model
    import public_tokenizers

    return public_tokenizers.path(MODEL)


def encode(docs: DataFrame, model: str | None = None, threads: int = THREADS, verify: bool = False) -> DataFrame:
    """doc_id, ids (array of int) and, with `verify`, parity (the ids equal the sentencepiece library's)."""
    path = _path(model)
    text_batches(docs.sparkSession)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _loaded(path, threads)
        for part in batches:
            texts = [x or "" for x in part.column(1).to_pylist()]
            ids = [np.frombuffer(x, np.uint32).tolist() for x in coder(texts)]
            columns = [part.column(0), pa.array(ids, pa.list_(pa.int32()))]
            if verify:
                columns.append(pa.array([a == b for a, b in zip(ids, _original(path).encode(texts, num_threads=1), strict=True)], pa.bool_()))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "parity"][: len(columns)])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>" + ", parity boolean" * verify)


def decode(coded: DataFrame, model: str | None = None, threads: int = THREADS) -> DataFrame:
    """coded with its column `ids` decoded into a last column `text`, in place of one of that name; null ids give null."""
    coded = coded.drop("text")
    path, names = _path(model), [*coded.columns, "text"]
    at = coded.columns.index("ids")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _loaded(path, threads)
        for part in batches:
            lists = part.column(at).to_pylist()
            texts = iter(coder.decode([x for x in lists if x is not None]))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([None if x is None else next(texts) for x in lists], pa.string())], names)

    return coded.mapInArrow(run, _with_text(coded))


def _with_text(coded: DataFrame):
    from pyspark.sql import types as T

    return T.StructType([*coded.schema.fields, T.StructField("text", T.StringType())])


def digest(docs: DataFrame, model: str | None = None, threads: int = THREADS) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (little-endian uint32 ids), parity, round_trip (decoding gives the text back)."""
    path = _path(model)
    text_batches(docs.sparkSession)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, original = _loaded(path, threads), _original(path)
        for part in batches:
            texts = [x or "" for x in part.column(1).to_pylist()]
            coded = coder(texts)
            same = [a == array("I", b).tobytes() for a, b in zip(coded, original.encode(texts, num_threads=1), strict=True)]
            back = coder.round_trips(texts, coded)
            crc = [zlib.crc32(little_endian(x)) for x in coded]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) // 4 for x in coded], pa.int64()), pa.array(crc, pa.int64()), pa.array(same, pa.bool_()), pa.array(back, pa.bool_())], ["doc_id", "n_tokens", "ids_crc32", "parity", "round_trip"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, parity boolean, round_trip boolean")
