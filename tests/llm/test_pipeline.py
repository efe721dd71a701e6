"""The pipeline's stages, and its SQL equivalents, at the smallest scale."""

from __future__ import annotations

import os
import random
import zlib

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from barloom.llm import queries, toxicity
from test_operators import LOWER, docs, linked, removed, stars, words


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "ngram_join", "substring_dedup", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), docs.schema)
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        assert docs.columns == columns and now <= ids and len(now) >= 0.6 * len(ids), name
        ids = now
    packed = corpus_pipeline.run(spark, sf)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == ids


def test_one_of_each_group_of_near_copies_stays(spark, sf):
    texts = stars(3)
    left = dict(corpus_pipeline.STAGES)["ngram_join"](spark, docs(spark, texts), sf)
    assert {r.doc_id for r in left.collect()} == {root for _, _, root in linked(list(enumerate(texts)))}


def test_stages_take_empty_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_duckdb(spark, sf, name):
    con = duckdb.connect()
    for t in os.listdir(sf):
        con.sql(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{t}'")
    df, want = queries.queries()[name](spark, sf), con.sql(queries.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    assert sorted(tuple(r[c] for c in cols) for r in df.collect()) == sorted(tuple(r[k] for k in at) for r in want.fetchall())


def corpus(spark):
    """Copies, near copies, shared passages, toxic texts, null ids and ids that repeat, with labels."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("bcdfghjklmnp") + rng.choice("aeiou") for _ in range(rng.randrange(2, 5)))
    vocabulary = [word() for _ in range(400)]
    passage = " ".join(word() for _ in range(70))
    texts = []
    for k in range(300):
        w = [rng.choice(vocabulary) for _ in range(rng.randrange(20, 160))]
        if k % 5 == 0:
            for _ in range(4):
                w[rng.randrange(len(w))] = rng.choice(["vile", "scorn", "wretch"])
        if k % 9 == 0:
            at = rng.randrange(len(w))
            w[at:at] = passage.split()
        texts.append(" ".join(w))
    near = [t.split() for t in texts[:40]]
    for w in near:
        w[-1] = "changed"
    texts += [" ".join(w) for w in near] + [t.upper() for t in texts[40:60]] + ["", None, "one two"]
    ids = rng.sample(range(10_000), len(texts))
    toxic = spark.createDataFrame([(i, int(k % 5 == 0)) for k, i in enumerate(ids[:300])], "doc_id long, toxic int")
    return docs(spark, texts, ids), toxic


def test_run_matches_brute_force(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    frame, toxic = corpus(spark)
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    toxic.write.parquet(str(tmp_path / "labels.parquet"))
    frame = spark.read.parquet(str(tmp_path / "documents.parquet"))
    scores = toxicity.score(frame, toxicity.fit(frame, toxic.filter(~queries.held_out()))).collect()
    bad = {r.doc_id for r in scores if r.predicted}
    assert 40 <= len(bad) <= 80
    left = {r.doc_id: r.text for r in frame.collect() if r.doc_id not in bad}
    best = {}
    for i, t in left.items():
        key = (t or "").encode().translate(LOWER)
        best[key] = max(best.get(key, i), i)
    left = {i: left[i] for i in best.values()}
    left = {root: left[root] for root in {root for _, _, root in linked(list(left.items()))}}
    gone = {i: (n, sha) for i, _, n, sha in removed(list(left.items()), 50)}
    assert any(n for n, _ in gone.values())
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    cut = {i: text for i, text in left.items()} | {i: kept(left, i) for i, (n, _) in gone.items() if n}
    want = set()
    for i, text in cut.items():
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        at = 0
        for size in [1024] * (len(ids) // 1024) + [1 << b for b in range(9, -1, -1) if (len(ids) % 1024) >> b & 1]:
            want.add((i, at, size, zlib.crc32(ids[at : at + size].tobytes()), len(ids)))
            at += size
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(got) == len(want) and {(r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got} == want


def kept(rows, i, size=50):
    """The text of row i without windows that also start in a row with a smaller id."""
    first = {}
    for j in sorted(rows):
        w = words(rows[j])
        for k in range(len(w) - size + 1):
            first.setdefault(tuple(w[k : k + size]), j)
    w = words(rows[i])
    lost = {j for k in range(len(w) - size + 1) if first[tuple(w[k : k + size])] != i for j in range(k, k + size)}
    return b" ".join(x for k, x in enumerate(w) if k not in lost).decode()
