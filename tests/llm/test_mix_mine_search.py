"""Mixing, hard negatives and lexical search against brute force, on edge cases and on hot groups."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import hard_negatives, lexical_search, mixing
from barloom.llm._order import running

WORD, TERM = re.compile(rb"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
TABLE = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


# --- running sums


@pytest.mark.parametrize("parts", [1, 7])
def test_running_sums(spark, parts):
    rows = [(random.Random(k).randrange(50), k, k % 11) for k in range(500)]
    df = spark.createDataFrame(rows, "a int, b int, v long").repartition(5)
    got = {r.b: r.upto for r in running(df, [F.col("a"), F.col("b")], {"upto": "v"}, parts).collect()}
    total = 0
    for _, b, v in sorted(rows):
        total += v
        assert got[b] == total


# --- mixing


def mixed(spark, rows, **more):
    """rows: (doc_id, text, source); columns whose names the operator uses itself."""
    wide = [(i, t, s, 5, 7, "x", 1.5) for i, t, s in rows]
    df = spark.createDataFrame(wide, "doc_id long, text string, source string, size int, rank int, key string, taken double").repartition(3)
    return mixing.mix(df, **more).collect()


def level(sizes, weights, most=3):
    """Targets by sharing out and capping until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, full, out = sum(sizes.values()), set(), {}
    while True:
        left = total - sum(most * sizes[s] for s in full)
        share = sum(w[s] for s in names if s not in full)
        out = {s: most * sizes[s] if s in full else left * w[s] / share for s in names}
        over = {s for s in names if s not in full and out[s] >= most * sizes[s]}
        if not over or len(full | over) == len(names):
            return out
        full |= over


def test_mix_meets_targets(spark):
    rng = random.Random(3)
    rows = []
    for k in range(3000):
        source = rng.choice(["hot"] * 10 + ["a", "b", "é", "zz", None])
        rows.append((k, " ".join(["w"] * int(rng.lognormvariate(3, 1.5))), source))
    rows += [(-1, None, "hot"), (None, "", "a"), (9000, "tiny source", "only"), (9001, " \n ", "blank")]
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(WORD.findall((t or "").encode()))
    want = level(sizes, (5, 2, 1))
    got = mixed(spark, rows)
    assert Counter(r.doc_id for r in got) == Counter(i for i, _, _ in rows)
    source, taken = {i: s for i, _, s in rows}, defaultdict(int)
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and math.isclose(r.target, want[s], rel_tol=1e-12)
        assert r.taken == r.copies * r.size and r.copies <= 3
        if r.size:
            assert math.floor(r.target / r.source_size) <= r.copies <= math.ceil(r.target / r.source_size)
        taken[s] += r.taken
    assert want["only"] == 6 and taken["only"] == 6
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(1, 0.005 * want[s])
    again = {(r.doc_id, r.taken) for r in mixed(spark, rows[::-1])}
    assert again == {(r.doc_id, r.taken) for r in got}
    assert {(r.doc_id, r.taken) for r in mixed(spark, rows, seed="other")} != again


@pytest.mark.parametrize("unit", [10**6, 10**8, 10**17])
def test_targets_of_large_sources(spark, unit):
    """Words times weights pass 32 bits, and words times the sum of weights 64."""
    sizes = {"a": 5 * unit, "b": 3 * unit, "c": 4 * unit, "d": 1 * unit, None: 7 * unit}
    sizes |= {f"e{k}": unit // 1000 for k in range(40)}
    got = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    want = level(sizes, (5, 2, 1))
    assert {r.source for r in got} == set(sizes)
    assert all(math.isclose(r.target, want[r.source], rel_tol=1e-12) for r in got)


def test_mix_draws_by_inclusion_probability(spark):
    """Probabilities double with three powers of two of length; over seeds every document has its turn."""
    rows = [(k, " ".join(["w"] * (8 if k % 2 else 64)), "s" if k < 400 else "t") for k in range(800)]
    drawn = Counter()
    for seed in range(5):
        drawn.update({r.doc_id: r.copies for r in mixed(spark, rows, seed=str(seed), weights=(1, 3))})
    short, long = (sum(drawn[k] for k in range(400) if k % 2 == odd) / 200 / 5 for odd in (1, 0))
    assert abs(short - 0.265) < 0.03 and abs(long - 0.53) < 0.01
    assert len({k for k in range(400) if drawn[k]}) > 300


def test_mix_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(empty).count() == 0
    got = mixed(spark, [(1, None, None), (2, "", None), (3, " ", "x")])
    assert {(r.doc_id, r.size, r.target, r.taken) for r in got} == {(1, 0, 0.0, 0), (2, 0, 0.0, 0), (3, 0, 0.0, 0)}
    got = mixed(spark, [(7, "same text here", "x")] * 6 + [(None, "no id", "y")] * 4)
    assert len(got) == 10 and sum(r.taken for r in got) <= 26
    assert mixed(spark, [(1, "w " * 60_000, "x")])[0].taken == 60_000


# --- hard negatives


def negatives(rows, every=50, relabel=7, classes=10):
    """Brute force over (vec_id, label, vector)."""
    ok = [(i, y, v) for i, y, v in rows if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    one = {}
    for i, y, v in sorted(ok):
        one.setdefault(i, (y, v))
    dims = max((len(v) for _, v in one.values()), default=0)
    ids = sorted(one)
    y = np.array([(one[i][0] + 1) % classes if i % relabel == 0 else one[i][0] for i in ids])
    x = np.zeros((len(ids), dims))
    for k, i in enumerate(ids):
        x[k, : len(one[i][1])] = np.floor(256 * np.array(one[i][1], float))
    out = set()
    for a, i in enumerate(ids):
        if i % every:
            continue
        s = x @ x[a]
        order = np.lexsort((ids, -s))
        for p in [j for j in order if j != a and y[j] == y[a]][:5]:
            fit = [j for j in order if y[j] != y[a] and 50 * s[p] <= 100 * s[j] <= 95 * s[p]][:3]
            out |= {(i, ids[p], k + 1, ids[j], int(s[p]), int(s[j])) for k, j in enumerate(fit)}
    return out


def mined(spark, rows):
    wide = [(i, v, y, "x", 3, 1.0) for i, y, v in rows]
    df = spark.createDataFrame(wide, "vec_id long, embedding array<float>, label int, id string, shard int, score double").repartition(3)
    got = hard_negatives.mine(df).collect()
    assert len(got) == len(set(got))
    return {tuple(r) for r in got}


@pytest.mark.parametrize("seed", range(3))
def test_mining_matches_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(hard_negatives, "LEAF", 8)
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 12))
    rows = []
    for i in rng.permutation(1200):
        v = centres[i % 6] + rng.normal(size=12) * (0.0 if i % 5 == 0 else 0.6)  # a fifth are copies of a centre: ties
        rows.append((int(i), int(rng.integers(0, 3)) if seed else int(i % 10), [float(np.float32(x)) for x in v / np.linalg.norm(v)]))
    assert mined(spark, rows) == negatives(rows)


def test_mining_in_small_shards(spark):
    """Many cells and shards: both rounds, salts and cell bounds are at work."""
    rng = np.random.default_rng(9)
    rows = [(int(i), int(i % 4), [float(np.float32(x)) for x in rng.normal(size=6)]) for i in range(2000)]
    cleaned = hard_negatives.cleaned(spark.createDataFrame([(i, v, y) for i, y, v in rows], "vec_id long, embedding array<float>, label int"))
    at = hard_negatives.index(cleaned, sample=300, shard=1)
    assert at.shards.sum() >= 2 and at.rows.count() == 2000
    inf = float("inf")
    asks = cleaned.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("id"), "label", "vec", F.array(F.lit(-inf), F.lit(-20_000.0)).alias("lo"), F.array(F.lit(inf), F.lit(9_000.0)).alias("hi"))
    got = {(r.anchor_id, r.slot, r.place): (r.id, r.score) for r in hard_negatives.nearest(asks, at, 4, False).collect()}
    all_ = {r.vec_id: (r.label, np.array(r.vec)) for r in cleaned.collect()}
    for i in range(0, 2000, 100):
        s = sorted((-int(v @ all_[i][1]), j) for j, (y, v) in all_.items() if y != all_[i][0])
        for slot, fit in ((0, s), (1, [(a, j) for a, j in s if -20_000 <= -a <= 9_000])):
            assert [got.get((i, slot, k + 1)) for k in range(4)] == [(j, -a) for a, j in fit[:4]]


def test_mining_edges(spark):
    nan = float("nan")
    rows = [(0, 1, [1.0, 0.0]), (50, 1, [0.5, 0.5]), (1, 2, [0.4, 0.4]), (2, 2, [0.9, 0.1]), (3, None, [1.0, 1.0]), (4, 1, None), (5, 1, [None, 1.0]), (6, 2, [nan, 1.0]), (8, 2, [float("inf"), 0.0]), (9, 2, []), (10, 2, [0.3])]
    rows += [(None, 1, [0.1, 0.1]), (1, 2, [0.4, 0.4]), (11, 2, [0.3, 0.2]), (12, 2, [0.3, 0.2])]
    assert mined(spark, rows) == negatives(rows) != set()
    assert mined(spark, [(0, 1, [1.0])]) == set()
    assert hard_negatives.mine(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    same = [(i, i % 2, [0.1, 0.2]) for i in range(300)]
    assert mined(spark, same) == negatives(same)


# --- lexical search


def terms(text):
    return TERM.findall((text or "").encode().translate(TABLE).decode())


def ranked(docs, items, k=20):
    """Brute force: item -> [(score, doc_id)], the best first."""
    docs = [(i, Counter(terms(t))) for i, t in docs]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    n, total = len(docs), sum(x for _, _, x in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    w = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for t, d in df.items()}
    asked = defaultdict(list)
    for i, t in items:
        asked[i] += terms(t)
    out = {}
    for item, ts in asked.items():
        s = [(sum(w[t] * (10**9 * c[t] // (1000 * c[t] + 12 * (75 + 25 * m * n // total))) for t in ts if t in c), i) for i, c, m in docs]
        out[item] = sorted(((-x, i is None, i) for x, i in s if x > 0), key=lambda r: (r[0], r[1], r[2] or 0))[:k]
    return {i: [(-x, d) for x, _, d in r] for i, r in out.items() if r}


def searched(spark, docs, items, restrict=True, k=20):
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, shard int, term string").repartition(3)
    q = spark.createDataFrame([(i, t, 4) for i, t in items], "item_id long, text string, weight int")
    got = defaultdict(list)
    for r in lexical_search.search(lexical_search.index(d, q if restrict else None), q, k).orderBy("item_id", "rank").collect():
        got[r.item_id].append((r.score, r.doc_id))
        assert r.rank == len(got[r.item_id])
    return dict(got)


@pytest.mark.parametrize("seed", range(3))
def test_search_matches_brute_force(spark, seed, monkeypatch):
    for name, value in (("DOCS", 100), ("SPAN", 16), ("HELD", 5000), ("QUERIES", 60)):
        monkeypatch.setattr(lexical_search, name, value)
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé日") for _ in range(rng.randrange(1, 20))) for _ in range(200)] + ["THE"] * 60
    text = lambda n: rng.choice([" ", "-", "\n", "_"]).join(rng.choice(vocabulary) for _ in range(n))
    docs = [(i, text(rng.randrange(0, 60))) for i in rng.sample(range(10_000), 600)]
    docs += [(20_000 + i, "the same long text " * 40) for i in range(80)]  # ties
    items = [(i, text(rng.randrange(0, 30))) for i in range(25)] + [(3, "second part of three"), (99, "nothing that matches zzzzzz")]
    assert searched(spark, docs, items, restrict=seed != 1) == ranked(docs, items)


def test_search_edges(spark):
    long = "x1234567 middle abcdefgh x1234567 other! abcdefgh " * 300
    docs = [(1, None), (2, ""), (3, " .,; "), (4, "Äpfel ÄPFEL äpfel"), (5, "a" * 70_000 + " b"), (6, long), (None, "apple pie"), (7, "apple pie"), (7, "apple pie"), (8, "Apple, PIE"), (9, "x1234567aaaaabcdefgh x1234567bbbbabcdefgh")]
    items = [(0, None), (1, ""), (2, "ÄPFEL"), (3, "apple apple PIE"), (4, "a" * 70_000), (5, "x1234567bbbbabcdefgh"), (6, "abcdefgh other")]
    got = searched(spark, docs, items)
    assert got == ranked(docs, items) and set(got) == {2, 3, 4, 5, 6}
    assert [d for _, d in got[3]] == [7, 7, 8, None]
    assert searched(spark, [(1, None)], items) == {} == searched(spark, docs, [(0, None)])
    empty = spark.createDataFrame([], "doc_id long, text string")
    asked = spark.createDataFrame([], "item_id long, text string")
    assert lexical_search.search(lexical_search.index(empty, asked), asked).count() == 0


def test_two_terms_of_one_hash(spark, monkeypatch):
    """Terms that share their hash are told apart by length and ends."""
    real = lexical_search.term_keys

    def clash(texts):
        hashed, spans, row, first = real(texts)
        return hashed & np.uint64(7), spans, row, first

    monkeypatch.setattr(lexical_search, "term_keys", clash)
    import pyarrow as pa

    texts = pa.array(["one two three four", "two two six", "seven one"])
    hashed, spans, row, first = lexical_search.term_keys(texts)
    keys = lexical_search.whole_keys(texts, hashed, spans)
    held = [(np.array([5, 3, 9]), np.diff(first), keys, row)]
    rows = [r for b in lexical_search._written(0, held) for r in b.to_pylist()]
    assert len({r["term"] for r in rows}) == 7 and rows[0]["n"] == 3 and sum(r["n"] for r in rows[1:]) == 8
