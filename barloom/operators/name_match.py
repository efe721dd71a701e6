"""The best row of a list of names for each wanted name, by matching-blocks similarity, asked best first.

The similarity 2 * matches / length of two texts can't exceed the same with every shared letter counted as a match. Within
a block of names (one first word) a task holds up to HELD wanted names, streams the block's list past them in chunks, and
computes those bounds for a chunk at once; only rows whose bound reaches a name's best similarity so far are compared
exactly, the highest bounds first. Larger blocks are split by their wanted names, and their list goes to each part.
"""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

C = F.col
HELD, CHUNK = 512, 2048
#: Similarity, at least, of two names of which one begins with the words of the other.
PREFIX = 0.95
LETTERS = " &0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def letter_counts(names: list[str]) -> np.ndarray:
    """How often each of LETTERS, and anything else, is in each name."""
    place = np.full(256, len(LETTERS))
    place[[ord(c) for c in LETTERS]] = np.arange(len(LETTERS))
    data = np.frombuffer("".join(names).encode("latin-1", "replace"), np.uint8)
    row = np.repeat(np.arange(len(names)), [len(n) for n in names])
    out = np.zeros((len(names), len(LETTERS) + 1), np.int16)
    np.add.at(out, (row, place[data]), 1)
    return out


def begins(a: str, b: str) -> bool:
    """Whether the words of one name begin those of the other, two words at least."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    return " " in short and (long == short or long.startswith(short + " "))


class Wanted:
    """The wanted names of one part of a block and the best row of each so far; `compared` counts exact comparisons."""

    def __init__(self, codes: list[str], names: list[str]) -> None:
        self.codes, self.names, self.compared = codes, names, 0
        self.counts, self.sizes = letter_counts(names), np.array([len(n) for n in names])
        self.best = [(0.0, 0, None, None)] * len(names)  # score, -pos, symbol, token

    def see(self, names: list[str], pos: list[int], symbols: list, tokens: list) -> None:
        counts, sizes = letter_counts(names), np.array([len(n) for n in names])
        for lo in range(0, len(self.names), 64):
            mine = slice(lo, lo + 64)
            shared = np.minimum(self.counts[mine, None, :], counts[None, :, :]).sum(2)
            bound = 2.0 * shared / (self.sizes[mine, None] + sizes[None, :])
            inside = shared == np.minimum(self.sizes[mine, None], sizes[None, :])
            bound = np.where(inside, np.maximum(bound, PREFIX), bound)
            floor = np.array([b[0] for b in self.best[mine]])
            for i in np.flatnonzero((bound >= floor[:, None]).any(1)):
                self._compare(lo + i, bound[i], inside[i], names, pos, symbols, tokens)

    def _compare(self, i: int, bound: np.ndarray, inside: np.ndarray, names, pos, symbols, tokens) -> None:
        name, best = self.names[i], self.best[i]
        for j in np.argsort(-bound, kind="stable").tolist():
            if bound[j] < best[0] or bound[j] == 0:
                break
            if bound[j] == best[0] and -pos[j] < best[1]:
                continue
            prefix = bool(inside[j]) and begins(name, names[j])
            if not prefix and inside[j] and 2.0 * min(len(name), len(names[j])) / (len(name) + len(names[j])) < best[0]:
                continue
            self.compared += 1
            score = difflib.SequenceMatcher(None, name, names[j]).ratio()
            score = max(score, PREFIX) if prefix else score
            if (score, -pos[j]) > best[:2] and score > 0:
                best = (score, -pos[j], symbols[j], tokens[j])
        self.best[i] = best


def parted(wanted: DataFrame, listed: DataFrame, held: int = HELD) -> tuple[DataFrame, DataFrame]:
    """Both sides with block and part: blocks of more than `held` wanted names are split, their list is repeated."""
    first = lambda c: F.substring_index(c, " ", 1)
    wanted = wanted.withColumn("block", first("name"))
    parts = wanted.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / held).cast("int").alias("parts"))
    split = wanted.join(parts, "block").withColumn("part", F.pmod(F.xxhash64("security_code"), C("parts")).cast("int")).drop("parts")
    spread = listed.withColumn("block", first("name")).join(parts, "block").withColumn("part", F.explode(F.sequence(F.lit(0), C("parts") - 1))).drop("parts")
    return split, spread


def closest(wanted: DataFrame, listed: DataFrame, held: int = HELD) -> DataFrame:
    """security_code, sym, token, score, compared: for wanted(security_code, name) the most similar row of listed(name, pos,
    sym, token) with the same first word, the least pos among equals; names similar to none are left out. `compared` is how
    many exact comparisons its part made."""
    split, spread = parted(wanted, listed, held)
    kinds = dict(listed.dtypes)
    none = lambda c: F.lit(None).cast(kinds[c])
    rows = split.select("block", "part", F.lit(0).alias("side"), C("security_code").cast("string").alias("code"), "name", none("pos").alias("pos"), none("sym").alias("sym"), none("token").alias("token"))
    rows = rows.unionByName(spread.select("block", "part", F.lit(1).alias("side"), F.lit(None).cast("string").alias("code"), "name", "pos", "sym", "token"))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, names, now = None, ([], []), None

        def out() -> pa.RecordBatch:
            found = [(code, *b[2:], b[0], now.compared) for code, b in zip(now.codes, now.best, strict=True) if b[0] > 0]
            cols = list(zip(*found, strict=True)) or [()] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.float64(), pa.int64()), strict=True)], ["security_code", "sym", "token", "score", "compared"])

        for batch in batches:
            block, part, side, code, name, pos, sym, token = (c.to_pylist() for c in batch.columns)
            i = 0
            while i < len(block):
                key, j = (block[i], part[i], side[i]), i + 1
                while j < len(block) and j - i < CHUNK and (block[j], part[j], side[j]) == key:
                    j += 1
                if key[:2] != at:
                    if now is not None:
                        yield out()
                    at, names, now = key[:2], ([], []), None
                if key[2] == 0:
                    names[0].extend(code[i:j])
                    names[1].extend(name[i:j])
                elif names[0]:
                    now = now or Wanted(*names)
                    now.see(name[i:j], pos[i:j], sym[i:j], token[i:j])
                i = j
        if now is not None:
            yield out()

    placed = rows.repartition("block", "part").sortWithinPartitions("block", "part", "side", "pos")
    return placed.mapInArrow(match, "security_code string, sym string, token long, score double, compared long")
