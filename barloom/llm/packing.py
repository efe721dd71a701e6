"""Packing by power-of-two decomposition.

Every document becomes its token ids plus an end id. The id sequence is cut into whole pieces of
`max_tokens` and then into the binary digits of the rest, longest first, so every piece has a
power-of-two length, holds ids of one document, and is a training sequence by itself: no padding, no
attention across documents. Equal lengths share a bucket; a batch takes sequences of one bucket.
The work is one narrow pass: nothing is shuffled, whatever the sources or the copies.

Defined results: null text counts as empty (one piece: the end id); a null id stays null; repeated rows
are packed one by one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm._store import kept_in_worker, lean, text_batches

MAX_TOKENS = 1024
TOKENIZER = "byte_bpe_50k.json"
#: Words held in each of two generations by a Python worker, about 150 bytes each.
CACHE = 300_000
SIGNS = "#*$%&|<>.,!?;:"


def _byte_letters() -> dict[int, int]:
    """Byte-level vocabularies write printable Latin-1 bytes as themselves and the others from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in shown]
    return {b: 256 + k for k, b in enumerate(rest)}


class _Words(dict):
    """Little-endian ids of ' ' + word. Before a single space followed by a character that is no white
    space, this vocabulary's pre-tokenizer always cuts, so texts can be encoded by space-separated parts;
    a part that begins with white space has no entry and sends its text to the tokenizer as a whole."""

    def __init__(self, encode, letters) -> None:
        super().__init__()
        self.encode, self.letters, self.tails, self.old = encode, letters, {}, {}

    def __missing__(self, word: str) -> bytes:
        if not word or word[0].isspace():
            raise LookupError
        if len(self) >= CACHE:  # words still in use come back from the older generation
            self.old = dict(self)
            self.clear()
        ids = self.old.get(word)
        if ids is not None:
            self[word] = ids
            return ids
        head = word.rstrip(SIGNS)
        if head.isalpha() and max(head) < "\u0250":  # letters, then signs: two pre-tokens
            ids = self[head] + self.tail(word[len(head) :]) if len(head) < len(word) else self.letters(word)
        else:
            ids = self.encode(" " + word)
        self[word] = ids
        return ids

    def tail(self, signs: str) -> bytes:
        ids = self.tails.get(signs)
        if ids is None:
            ids = self.encode(signs)
            if len(self.tails) < CACHE:
                self.tails[signs] = ids
        return ids


def pack_ids(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class Encoder:
    """Text to the bytes of its uint32 ids, equal to the tokenizer's on the whole text."""

    def __init__(self, path: str) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.tokenize, self.bytes = self.tokenizer.model.tokenize, _byte_letters()
        self.words = _Words(self.whole, self.letters)

    def letters(self, word: str) -> bytes:
        """Ids of ' ' + a word of letters, straight from the model."""
        shown = word if word.isascii() else word.encode().decode("latin-1").translate(self.bytes)
        return pack_ids([t.id for t in self.tokenize("\u0120" + shown)])

    def whole(self, text: str) -> bytes:
        return pack_ids(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def __call__(self, text: str) -> bytes:
        if any(t in text for t in self.special):  # one id wherever it stands
            return self.whole(text)
        parts = text.split(" ")
        try:
            return self.whole(parts[0]) + b"".join(map(self.words.__getitem__, parts[1:])) if len(parts) > 1 else self.whole(text)
        except LookupError:
            return self.whole(text)


@kept_in_worker
def encoder(path: str) -> Encoder:
    """One encoder, with its words, for all tasks of a Python worker."""
    return Encoder(path)


def decompose(totals: np.ndarray, most: int = MAX_TOKENS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length) of the pieces of documents of these lengths, in order: whole pieces of `most`, then the
    binary digits of the rest, highest first."""
    whole, rest = totals // most, totals % most
    count = whole + np.bitwise_count(rest)
    first = np.cumsum(count) - count
    length = np.full(int(count.sum()), most, np.int64)
    for bit in range(most.bit_length() - 2, -1, -1):
        docs = np.flatnonzero((rest >> bit) & 1)
        length[first[docs] + whole[docs] + np.bitwise_count(rest[docs] >> (bit + 1))] = 1 << bit
    doc = np.repeat(np.arange(len(totals)), count)
    start = np.cumsum(length) - length
    return doc, start - (np.cumsum(totals) - totals)[doc], length


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, bucket int"


def pack(docs: DataFrame, tokenizer: str | None = None, max_tokens: int = MAX_TOKENS, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """One row per piece; `with_ids` adds the ids (binary, little-endian uint32) as column `ids`.

    sequence_id is unique; offset is always 0, as a sequence is one piece; bucket is log2(length).
    """
    if max_tokens & (max_tokens - 1) or max_tokens < 1:
        raise ValueError("max_tokens must be a power of two")
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path(TOKENIZER)
    end = end_id.to_bytes(4, "little")
    text_batches(docs.sparkSession)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, number = encoder(tokenizer), TaskContext.get().partitionId() << 40
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket"] + ["ids"] * with_ids
        for part in batches:
            for lo in range(0, part.num_rows, 256):
                some = part.slice(lo, 256)
                coded = [encode(text.as_py() or "") + end for text in some.column(1)]
                totals = np.array([len(x) // 4 for x in coded], np.int64)
                doc, start, length = decompose(totals, max_tokens)
                pieces = [coded[d][4 * s : 4 * (s + n)] for d, s, n in zip(doc.tolist(), start.tolist(), length.tolist(), strict=True)]
                crc = pa.array([zlib.crc32(x) for x in pieces], pa.int64())
                sequence = number + np.arange(len(doc))
                number += len(doc)
                bucket = np.bitwise_count(length - 1).astype(np.int32)
                cols = [some.column(0).take(pa.array(doc)), pa.array(start), pa.array(length), crc, pa.array(totals[doc]), pa.array(sequence), pa.array(np.zeros(len(doc), np.int64)), pa.array(bucket)]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(pieces, pa.binary())] * with_ids, names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA + ", ids binary" * with_ids)


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Sequences in one folder per length, so that a reader draws batches of equal lengths."""
    pieces.write.mode("overwrite").partitionBy("bucket").parquet(path)
