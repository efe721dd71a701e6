"""The training-data operators against brute force, on edge cases and on the smallest tables."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from barloom.llm import _sketch, _words, chat_format, exact_dedup, html_extraction, language_id, ngram_join, packing, quality_rules, queries, sentence_pieces, substring_dedup, toxicity
from barloom.llm._components import components

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, a string, id string, start int, text_sha256 string, bucket int"


def docs(spark, texts, ids=None):
    """Documents with extra columns whose names the operators use themselves."""
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, "en", "s", len(t or ""), 1, "x", "y", 2, "z", 3) for i, t in zip(ids, texts, strict=True)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


LONG = " ".join(f"w{k % 977} v{k % 31}" for k in range(40_000))
EDGE = [None, "", " \n\t ", "one", "One two  three\n\nfour", LONG, LONG, "é|ß # 日本 \x0b x", "a " * 300, "a b c d e f a b c d e", "tie tie tie tie tie tie"]


def edge(spark):
    """Edge texts, a null id, and repeated rows."""
    return docs(spark, [*EDGE, "null id row", "twice", "twice"], [*range(len(EDGE)), None, 70, 70])


def words(text, lower=False):
    data = (text or "").encode()
    return WORD.findall(data.translate(LOWER) if lower else data)


# --- shared parts


def test_word_hashes_do_not_depend_on_batches():
    texts = pa.array([*EDGE, "x" * 3_000_000 + " y", "tail"])
    data, offsets = _words.buffers(texts)
    starts, ends, first = _words.spans(data, offsets)
    whole = _words.hashes(data, int(offsets[0]), starts, ends)
    for k, t in enumerate(texts.to_pylist()):
        one, off = _words.buffers(pa.array([t], pa.string()))
        s, e, f = _words.spans(one, off)
        assert (_words.hashes(one, 0, s, e) == whole[first[k] : first[k + 1]]).all() and len(s) == len(words(t))


def test_slide_min_and_windows():
    x = np.random.default_rng(1).integers(0, 1000, 200).astype(np.uint64)
    for w in (1, 2, 3, 7, 25):
        assert _words.slide_min(x, w).tolist() == [min(x[i : i + w]) for i in range(len(x) - w + 1)]
    h = _words.windows(np.array([1, 2, 3, 1, 2, 3, 1, 2], np.uint64), 3)
    assert h[0] == h[3] and h[1] == h[4] and len(set(h.tolist())) == 3


def test_sketch_never_misses_a_repeat(spark):
    keys = np.random.default_rng(2).integers(1, 1 << 62, 3000)
    data = [(int(k),) for k in keys] + [(int(k),) for k in keys[:500]]
    df = spark.createDataFrame(data, "k long").repartition(5)
    seen = _sketch.build(df, lambda part: _words.mix(part.column(0).to_numpy().astype(np.uint64)), 1 << 20)
    hit = _sketch.repeated(seen.value, _words.mix(keys.astype(np.uint64)), 1 << 20)
    assert hit[:500].all() and hit[500:].mean() < 0.02


def test_components_of_a_chain_a_star_and_a_loop(spark):
    links = [(k, k + 1) for k in range(20)] + [(100, 100 + k) for k in range(1, 15)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(21)) and all(got[100 + k] == 100 for k in range(15)) and {got[k] for k in (200, 201, 202)} == {200} and 300 not in got


# --- 1


def test_packing_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    frame = edge(spark).unionByName(docs(spark, ["it's  x\xa0 y z  1²", "  a   b ", "<|endoftext|> b", "\x1c \x1c a"], [90, 91, 92, 93]))
    rows = packing.pack(frame, with_ids=True).collect()
    want = Counter((r.doc_id, tuple(t.encode(r.text or "", add_special_tokens=False).ids + [0])) for r in frame.collect())
    parts = defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length == 1 << r.bucket <= 1024 and r.offset == 0 and zlib.crc32(bytes(r.ids)) == r.ids_crc32
        parts[r.doc_id].append((r.start, tuple(ids.tolist()), r.doc_tokens))
    assert len({r.sequence_id for r in rows}) == len(rows)
    for (doc, ids), n in want.items():
        mine = [p for p in parts[doc] if p[2] == len(ids)]
        assert len(mine) == n * (len(ids) // 1024 + (len(ids) % 1024).bit_count())
        assert sum((p[1] for p in sorted(set(mine))), ()) == ids
    assert packing.pack(docs(spark, [])).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 1023, 1024, 1025, 5000])
def test_decomposition(n):
    doc, starts, lengths = packing.decompose(np.array([n, 3, n]))
    for d, total in enumerate((n, 3, n)):
        pieces = [(s, size) for x, s, size in zip(doc.tolist(), starts.tolist(), lengths.tolist(), strict=True) if x == d]
        assert sum(size for _, size in pieces) == total and all(size & (size - 1) == 0 and size <= 1024 for _, size in pieces)
        assert [s for s, _ in pieces] == [sum(size for _, size in pieces[:k]) for k in range(len(pieces))]
        assert [size for _, size in pieces] == sorted((size for _, size in pieces), reverse=True)


def test_buckets_hold_equal_lengths(spark, tmp_path):
    packing.write_buckets(packing.pack(edge(spark), with_ids=True), str(tmp_path / "b"))
    back = spark.read.parquet(str(tmp_path / "b")).collect()
    assert Counter(r.length for r in back) == Counter(r.length for r in packing.pack(edge(spark)).collect())
    assert all(r.length == 1 << r.bucket and len(r.ids) == 4 * r.length for r in back)


# --- 2


def features(text):
    w, lines = words(text), [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    marked = {j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(w), sum(len(x.decode()) for x in w), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(marked)


def test_quality_features_match_brute_force(spark):
    frame = edge(spark)
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality_rules.features(frame).collect())
    assert got == Counter((r.doc_id, *features(r.text)) for r in frame.collect())


def test_rules_are_learned_and_applied(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = quality_rules.judge(d, labels).join(labels.groupBy("doc_id").agg(F.max("quality").alias("q")), "doc_id").collect()
    good = [r for r in out if r.q == 1 and not r.base_failed]
    bad = [r for r in out if r.q == 0 and not r.base_failed]
    assert sum(r.kept for r in good) >= 0.98 * len(good) and sum(r.kept for r in bad) <= 0.3 * len(bad)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert all(r.kept == (not r.base_failed) for r in quality_rules.judge(edge(spark), none).collect())
    assert quality_rules.judge(docs(spark, []), labels).count() == 0


def test_verdicts_match_the_printed_rules(spark, sf):
    """The rules read as text, applied in Python to features that brute force checks above."""
    sf = sf.replace("sf0.001", "sf0.01")
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality_rules.features(d)
    rules = quality_rules.learn(rows, labels)
    assert rules.rules
    tests = {">": lambda x, y: x > y, "<=": lambda x, y: x <= y}
    want = {}
    for r in rows.collect():
        reject = any(all(tests[t.split()[1]](float(r[t.split()[0]]), float(t.split()[2])) for t in line.removeprefix("reject if ").split(" and ")) for line in str(rules).split("\n"))
        want[r.doc_id] = not (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not reject
    assert {r.doc_id: r.kept for r in quality_rules.judge(d, labels).collect()} == want


def test_covering_finds_a_conjunction():
    cells = [((a, b), 20 * (a > 2 and b <= 1), 20 * (not (a > 2 and b <= 1))) for a in range(5) for b in range(5)]
    rules = quality_rules.cover(cells, cells, 2)
    assert len(rules) == 1 and {(k, above) for k, above, _ in rules[0]} == {(0, True), (1, False)}


# --- 3

PAGE = """<html><body class=home><div id=wrap><header><h1>Site</h1><nav><a href=#>x</a></nav></header><div class="sidebar-1"><p>side text here</p></div><div class="post-content"><h2>T&eacute; &lt;b&gt;</h2>
<p>One <b>bold</b>
 text<p>Two&nbsp;x<br>y<ul><li>a<li>b <ul><li>c</ul><li>d</ul><script>if(a<b){}</script><form><p>mail</p></form></div><div id="comments"><p>reader says</p></div></div><footer>f</footer>"""


def test_extraction(spark):
    rows = [(1, "http://a.example/1", PAGE), (2, "http://a.example/2", PAGE.replace("post-content", "post-content wide")), (3, None, None), (4, "x", ""), (5, "http://b.example", "<p>only"), (1, "http://a.example/1", PAGE), (6, "http://c.example", "<div>" * 3000 + "deep")]
    out = html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("paths", F.lit(1))).collect()
    text = "Té <b>\nOne bold text\nTwo x y\na\nb\nc\nd"
    assert Counter((r.page_id, r.text) for r in out) == Counter({(1, text): 2, (2, text): 1, (3, ""): 1, (4, ""): 1, (5, "only"): 1, (6, "deep"): 1})
    assert all(r.n_chars == len(r.text) for r in out)
    assert html_extraction.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_closing_tags_count_at_any_depth(spark):
    rows = [(d, f"http://d{d}.example/", "<div>" * d + "<nav><section>menu</nav><p>the story") for d in (3, 198, 250, 2000)]
    out = html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in out} == dict.fromkeys((3, 198, 250, 2000), "the story")


def test_consensus_beats_an_odd_page(spark):
    usual = "<body><div class=story><p>{}</p></div><div class=links><p>{}</p></div>"
    rows = [(k, "http://h.example/x", usual.format("long story text " * 20, "short")) for k in range(5)] + [(9, "http://h.example/y", usual.format("tiny story", "a much longer list of other things " * 9))]
    out = {r.page_id: r.text for r in html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out[9] == "tiny story"


def test_articles_of_the_tables(spark, sf):
    from html import unescape

    html = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in queries.op3_html_extraction(spark, sf).collect():
        body = re.search(r"<article>(.*?)</article>", html[r.page_id], re.S)[1]
        blocks = [" ".join(unescape(re.sub("<br>|</?b>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", body)]
        assert r.text == "\n".join(b for b in blocks if b)


# --- 4


def removed(rows, size):
    first = {}
    for i, t in sorted(((i, t) for i, t in rows), key=lambda x: (x[0] is None, x[0])):
        w = words(t)
        for k in range(len(w) - size + 1):
            first.setdefault(tuple(w[k : k + size]), i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = {j for k in range(len(w) - size + 1) if first[tuple(w[k : k + size])] != i for j in range(k, k + size)}
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def test_substrings_match_brute_force(spark):
    rng = random.Random(4)
    passage = [f"p{k}" for k in range(80)]
    texts = []
    for _ in range(60):
        w = [f"x{rng.randrange(5000)}" for _ in range(rng.randrange(200))]
        if rng.random() < 0.6:
            cut = rng.randrange(30)
            at = rng.randrange(len(w) + 1)
            w[at:at] = passage[cut : cut + rng.choice([45, 50, 55])]
        texts.append(" ".join(w))
    texts += texts[:5] + ["loop me " * 60]
    frame = docs(spark, texts, rng.sample(range(1000), len(texts)))
    got = Counter(tuple(r) for r in substring_dedup.digest(frame).collect())
    assert got == removed([(r.doc_id, r.text) for r in frame.collect()], 50)


def test_substrings_on_edge_cases(spark):
    frame = edge(spark)
    got = Counter(tuple(r) for r in substring_dedup.digest(frame).collect())
    assert got == removed([(r.doc_id, r.text) for r in frame.collect()], 50)
    cut = {r.doc_id: r for r in substring_dedup.remove(frame).collect()}
    assert cut[5].text == LONG and cut[6].text == "" and cut[6].n_chars == 0 and cut[0].text is None and cut[2].text == EDGE[2]
    assert substring_dedup.remove(frame).columns == frame.columns and substring_dedup.remove(docs(spark, [])).count() == 0


# --- 5


def test_toxicity_on_held_out_documents(spark):
    rng = random.Random(5)
    bad = ["vile", "scorn", "wretch"]
    rows, labels = [], []
    for k in range(600):
        w = [f"{rng.choice('abcde')}{rng.choice('fghij')}{rng.randrange(40)}" for _ in range(60)]
        w = [re.sub(r"\d", lambda m: "klmnopqrst"[int(m[0])], x) for x in w]
        toxic = k % 4 == 0
        for _ in range(3 * toxic):
            w[rng.randrange(len(w))] = rng.choice(bad)
        rows.append(" ".join(w))
        labels.append((k, int(toxic)))
    frame = docs(spark, rows)
    model = toxicity.fit(frame, spark.createDataFrame([x for x in labels if x[0] % 3], "doc_id long, toxic int"))
    got = {r.doc_id: r for r in toxicity.score(frame, model).collect()}
    held = [(k, t) for k, t in labels if k % 3 == 0]
    assert sum(got[k].predicted == t for k, t in held) >= 0.97 * len(held) and all(0 <= r.score <= 1 for r in got.values())
    kept = {r.doc_id for r in toxicity.reject(frame, model).collect()}
    assert kept == {k for k, r in got.items() if r.predicted == 0} and toxicity.reject(frame, model).columns == frame.columns
    same = toxicity.score(edge(spark), model).collect()
    assert len(same) == len(EDGE) + 3 and len({r.score for r in same if r.doc_id in (0, 1, 2)}) == 1
    assert toxicity.score(docs(spark, []), model).count() == 0


def test_toxicity_scores_match_brute_force(spark, sf):
    """Compressed lengths of every window by zstandard itself, then the curve."""
    import zstandard as z

    sf = sf.replace("sf0.001", "sf0.01")
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    m = toxicity.fit(d, labels.filter(~queries.held_out()))
    params = z.ZstdCompressionParameters.from_level(1, format=z.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0)
    plain, toxic = (z.ZstdCompressor(dict_data=z.ZstdCompressionDict(c, dict_type=z.DICT_TYPE_RAWCONTENT), compression_params=params) for c in (m.base, m.base + m.extra))
    code = {}
    want = {}
    for r in d.limit(300).collect():
        found = re.findall(rb"[A-Za-z\x80-\xff]+", (r.text or "").encode())
        for w in found:
            if w not in code:
                code[w] = toxicity._spell(next(toxicity._codes(pa.array([w.decode()]))))
        parts = [b"".join(code[w] for w in found[i : i + 16]) for i in range(0, len(found), 16)]
        gain = [len(plain.compress(p)) - len(toxic.compress(p)) for p in parts]
        over = [g for g in gain if g >= m.excess]
        f = np.array([[sum(over), len(over), max(gain, default=0), len(parts)]], float)
        want[r.doc_id] = 1 / (1 + np.exp(-np.clip(toxicity._design(f) @ m.beta, -30, 30)))[0]
    got = {r.doc_id: r for r in toxicity.score(d, m).collect()}
    assert want and all(abs(got[i].score - x) < 1e-9 and got[i].predicted == int(x >= 0.3) for i, x in want.items())


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(edge(spark), none)
    assert {r.score for r in toxicity.score(edge(spark), model).collect()} == {0.0}


# --- 6


def test_exact_copies(spark):
    frame = edge(spark).unionByName(docs(spark, ["ONE", "ÉA", "Éa", "éa", "Twice"], [80, 81, 82, 83, 84]))
    rows = [(r.doc_id, hashlib.sha256((r.text or "").encode().translate(LOWER)).hexdigest()) for r in frame.collect()]
    groups = defaultdict(list)
    for i, h in rows:
        groups[h].append(i)
    best = {h: max(ids, key=lambda i: -1 if i is None else i) for h, ids in groups.items()}
    want = Counter((i, best[h], len(groups[h]), i == best[h], h) for i, h in rows)
    got = exact_dedup.mark(frame)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got.collect()) == want
    left = exact_dedup.drop_copies(frame)
    assert left.columns == frame.columns and Counter(r.doc_id for r in left.collect()) == Counter(i for i, h in rows if i == best[h])
    assert exact_dedup.mark(docs(spark, [])).count() == 0


# --- 7


def read_back(turns, got):
    groups = defaultdict(list)
    for c, t, role, text in turns:
        groups[c].append((t, role or "", text or ""))
    assert len(got) == len(groups)
    for r in got:
        ts = sorted(groups[r.conv_id], key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        whole, loss = "".join(f"{a}\n{b}\n" for _, a, b in ts), "".join(b for _, a, b in ts if a == "assistant")
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(ts), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_round_trip(spark):
    rng = random.Random(7)
    bits = ["</s>", "<|", "|>", "\\", "<", "|", ">", "[INST]", "\n", "é", "x ", "<s>", "/s>", "<<SYS>>", "<</SYS>>", "[", "INST]", " "]
    turns = []
    for c, n in ((1, 1), (2, 3), (3, 200), (None, 70), (5, 64)):
        for k in range(n):
            role = "system" if k == 0 and c != 2 else rng.choice(["user", "assistant", None, "a|", "<|x|>"])
            turns.append((c, k if rng.random() < 0.97 else None, role, "".join(rng.choice(bits) for _ in range(rng.randrange(40))) if rng.random() < 0.9 else None))
    turns += [turns[5]] * 3
    df = spark.createDataFrame([(*t, 1) for t in turns], "conv_id long, turn long, role string, text string, window int").repartition(3)
    for budget, history, most in ((1024, 2, 256), (60, 2, 40), (1, 0, 0)):
        w = chat_format.windows(df, budget, history, most)
        read_back(turns, chat_format.digest(w).collect())
        single = {r.n_turns - r.n_repeated for r in w.filter(F.col("n_tokens") > budget).collect()}
        assert single <= {1}
    assert chat_format.digest(chat_format.windows(df.limit(0))).count() == 0


def test_chat_windows_keep_the_system_turn(spark):
    turns = [(1, 0, "system", "rules")] + [(1, k, "user" if k % 2 else "assistant", "word " * 30) for k in range(1, 40)]
    w = chat_format.windows(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"), 150, 1, 60).orderBy("window").collect()
    assert len(w) > 5 and all(r.formatted.startswith("<|system|>\nrules</s>") for r in w) and w[0].n_repeated == 0 and all(r.n_repeated >= 1 for r in w[1:])


# --- 8


def test_sentence_pieces_agree_with_the_original(spark):
    frame = edge(spark).unionByName(docs(spark, [" " * 40 + "x" + " " * 33, "<s>hello</s> <unk>", "日本語 🎉 zxq́", "▁a▁▁b", "a\x00b", "<0x0A>", "aaaaaaaaaaaaaa"], range(90, 97)))
    coded = sentence_pieces.encode(frame, verify=True)
    assert all(r.parity for r in coded.collect())
    back = {r.doc_id: r.text for r in sentence_pieces.decode(coded.select("doc_id", "ids")).collect()}
    assert all(back[r.doc_id] == (r.text or "") for r in frame.collect() if r.doc_id != 93 and r.doc_id is not None)
    assert all(r.parity for r in sentence_pieces.digest(frame).collect()) and sentence_pieces.digest(docs(spark, [])).count() == 0


def test_sentence_pieces_keep_words_in_use(monkeypatch):
    """A full cache doesn't send words that are still in use to the library again, and spoilt words stay known."""
    monkeypatch.setattr(sentence_pieces, "WORDS", 8)
    path = sentence_pieces._path(None)
    coder, asked = sentence_pieces.Coder(path), []
    encode, decode, original = coder._encode_words, coder.decode, sentence_pieces._original(path)
    monkeypatch.setattr(coder, "_encode_words", lambda words: (asked.extend(words), encode(words))[1])
    monkeypatch.setattr(coder, "decode", lambda ids: [t.replace("spoilt", "spoiled") for t in decode(ids)])
    for texts in (["the cat and the dog", "x1 x2 spoilt"], ["the cat x3 x4 x5", "spoilt"], ["the x6 x7 x8 x9", "a  b spoilt"], ["", "the end"]):
        coded = coder(texts)
        assert [np.frombuffer(x, np.uint32).tolist() for x in coded] == original.encode(texts)
        assert coder.round_trips(texts, coded) == ["spoilt" not in t for t in texts]
    assert {asked.count(w) for w in asked} == {1} and {"the", "spoilt", "x9", "end"} <= set(asked)


def test_unigram_models_are_rebuilt():
    pieces = (("<unk>", 0.0, 2), ("▁ab", -1.0, 1), ("▁a", -2.0, 1), ("b", -2.5, 1), ("c", -3.0, 1), ("▁", -4.0, 1))
    t = sentence_pieces.build(sentence_pieces.Model(pieces, sentence_pieces.UNIGRAM, False, 0, b"", True, True, True))
    assert t.encode("ab  abc", add_special_tokens=False).tokens == ["▁ab", "▁ab", "c"] and t.decode([1, 1, 4]) == "ab abc"


# --- 9


def linked(rows):
    sets = []
    for i, t in rows:
        w = words(t, True)
        sets.append((i, frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])))
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for x in range(len(sets)):
        for y in range(x):
            a, b = sets[x][1], sets[y][1]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                up[root(x)] = root(y)
    least = {}
    for k, (i, _) in enumerate(sets):
        least[root(k)] = min(least.get(root(k), i), i)
    return Counter((i, len(s), least[root(k)]) for k, (i, s) in enumerate(sets))


def test_similar_sets_match_brute_force(spark):
    rng = random.Random(9)
    common = [f"c{k}" for k in range(50)]
    texts = []
    for _ in range(12):
        base = [f"x{rng.randrange(9000)}" for _ in range(rng.choice([4, 6, 30, 80, 200]))] + rng.choice([[], common])
        for _ in range(rng.randrange(1, 9)):
            w = list(base)
            for _ in range(rng.randrange(len(w) // 12 + 2)):
                w[rng.randrange(len(w))] = f"y{rng.randrange(9000)}"
            texts.append(" ".join(x.upper() if rng.random() < 0.1 else x for x in w))
    frame = docs(spark, texts, rng.sample(range(1000), len(texts)))
    got = Counter(tuple(r) for r in ngram_join.classes(frame).collect())
    assert got == linked([(r.doc_id, r.text) for r in frame.collect()])


def test_similar_sets_on_edge_cases(spark):
    frame = docs(spark, [*EDGE, "twice", "twice"], [*range(len(EDGE)), 70, 71])
    assert Counter(tuple(r) for r in ngram_join.classes(frame).collect()) == linked([(r.doc_id, r.text) for r in frame.collect()])
    left = ngram_join.representatives(frame)
    assert left.columns == frame.columns and 6 not in {r.doc_id for r in left.collect()} and 5 in {r.doc_id for r in left.collect()}
    assert [tuple(r) for r in ngram_join.classes(docs(spark, ["a b c d e f"], [None])).collect()] == [(None, 2, None)]
    assert ngram_join.classes(docs(spark, [])).count() == 0


def stars(seed):
    """Groups whose copies link to their base only (each lacks other words), some bridged by a text between two bases."""
    rng = random.Random(seed)
    texts = []
    for g in range(24):
        base = [f"s{g}x{k}" for k in range(304)]
        order = rng.sample(range(6, 298, 6), 48)
        group = [base, *([w for k, w in enumerate(base) if k not in order[c * 6 : c * 6 + 6]] for c in range(rng.choice((2, 4, 8))))]
        if g % 6 == 0:
            group += [base[:275] + [f"t{g}x{k}" for k in range(29)], base[:246] + [f"t{g}x{k}" for k in range(58)]]
        texts += [" ".join(x) for x in rng.sample(group, len(group))]
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_copies_linked_through_one_base_only(spark, seed):
    texts = stars(seed)
    got = Counter(tuple(r) for r in ngram_join.classes(docs(spark, texts)).collect())
    assert got == linked(list(enumerate(texts)))


@pytest.mark.parametrize("drop, stays", [(exact_dedup.drop_copies, 9), (ngram_join.representatives, 3)])
def test_null_and_repeated_ids_drop_no_other_text(spark, drop, stays):
    copy, other = "a b c d e f g h", ["p q r s t u v w", "k l m n o p q r", "g f e d c b a z"]
    rows = [(None, other[0]), (None, copy), (3, copy), (5, other[1]), (5, copy), (9, copy), (9, other[2])]
    frame = docs(spark, [t for _, t in rows], [i for i, _ in rows])
    left = drop(frame)
    assert left.columns == frame.columns
    assert Counter((r.doc_id, r.text) for r in left.collect()) == Counter([(None, other[0]), (5, other[1]), (9, other[2]), (stays, copy)])


def test_tree_search_loses_no_pair():
    rng = np.random.default_rng(3)
    base = [np.unique(rng.integers(1, 1 << 62, 60).astype(np.uint64)) for _ in range(30)]
    sets = [np.unique(np.concatenate([b[rng.random(len(b)) > 0.06], rng.integers(1, 1 << 62, 3).astype(np.uint64)])) for b in base for _ in range(6)]
    points, sizes, fine = np.stack([ngram_join.point(s) for s in sets]), np.array([len(s) for s in sets]), np.stack([ngram_join.fine_point(s) for s in sets])
    found = {frozenset((int(a), int(b))) for x, y, _ in ngram_join._search(np.ones(len(sets), np.uint64), sizes, points, fine) for a, b in zip(x, y, strict=True)}
    want = {frozenset((a, b)) for a in range(len(sets)) for b in range(a) if ngram_join._alike(sets[a], sets[b])}
    assert want <= found and len(found) < len(sets) ** 2 / 8


# --- 10


def test_language_on_held_out_documents(spark, sf):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = [r for r in queries.op10_language_id(spark, sf).collect() if r.held_out]
    assert sum(lang[r.doc_id] == r.lang_pred for r in got) >= 0.95 * len(got) and all(0 <= r.score <= 1 for r in got)


def test_language_edge_cases(spark):
    frame = spark.createDataFrame([(k, t, la) for k, (t, la) in enumerate([("the house is here " * 9, "en"), ("das haus ist hier " * 9, "de"), (None, "en"), ("x", None)])], "doc_id long, text string, lang string")
    filters = language_id.fit(frame)
    asked = docs(spark, ["the house", "das haus", None, "", "12 34 !", "qqqq", "日本", LONG * 3])
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(asked, filters).collect()}
    assert got[0][0] == "en" and got[1][0] == "de" and {got[k] for k in (2, 3, 4)} == {("und", 0.0)} and got[5][1] == 0.0 and got[6][0] in ("en", "de")
    assert language_id.fit(frame.filter("lang IS NULL")) is None
    assert {r.lang_pred for r in language_id.predict(asked, None).collect()} == {"und"} and language_id.predict(docs(spark, []), filters).count() == 0


def test_filters_never_forget_an_ngram():
    keys = _words.mix(np.arange(1, 5001, dtype=np.uint64))
    masks = np.array([1 << (k % 5) for k in range(5000)], np.uint64)
    f = language_id.Filters(list("abcde"), keys, masks, "a")
    assert ((f.masks(keys).astype(np.uint64) & masks) == masks).all() and f.false_rate.max() < 0.01


def letters(k):
    return "".join("bcdfghjklmnp"[int(c)] + "aeiou"[(k + j) % 5] for j, c in enumerate(f"{k * 7919:06d}"))


def test_more_languages_than_a_mask_word_has_bits(spark):
    rows = [(k * 3 + j, " ".join(letters(k * 40 + w) for w in range(30)), f"l{k:03d}") for k in range(70) for j in range(3)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_id.predict(frame, language_id.fit(frame)).collect()
    want = {i: la for i, _, la in rows}
    assert sum(r.lang_pred == want[r.doc_id] for r in got) >= 0.98 * len(rows) and len({r.lang_pred for r in got}) >= 68


def test_language_scores_match_plain_sets(spark, sf):
    """Masks, popcounts and scores by sets of n-grams, where the filter has no false positive in the texts asked."""
    frame = spark.read.parquet(f"{sf}/documents.parquet").filter("lang IS NOT NULL AND text IS NOT NULL")
    filters = language_id.fit(frame)
    counts, docs_ = defaultdict(Counter), frame.collect()
    grams = lambda t: [int(k) for _, keys in language_id._grams(np.frombuffer(t.encode(), np.uint8), 0, len(t.encode())) for k in keys]
    for r in docs_:
        counts[r.lang].update(grams(r.text))
    totals = {}
    kept = {k for k in {k for c in counts.values() for k in c} if max(c[k] for c in counts.values()) >= 2}
    for la, c in counts.items():
        totals[la] = max(1, sum(n for k, n in c.items() if k in kept))
    knows = {la: {k for k in kept if c[k] >= 2 and c[k] / totals[la] >= language_id.RATIO * max(d[k] / totals[x] for x, d in counts.items())} for la, c in counts.items()}
    asked = docs_[::17]
    for r in asked:
        g = grams(r.text)
        if not g:
            continue
        masks = filters.masks(np.array(g, np.uint64))
        names, scores = filters.predict(pa.array([r.text]))
        share = []
        for k, la in enumerate(filters.languages):
            found = filters._bit(masks, k).astype(bool)
            assert all(found[i] for i, x in enumerate(g) if x in knows[la])  # the filter forgets nothing
            hits = sum(x in knows[la] for x in g)
            assert abs(int(found.sum()) - hits) <= 0.02 * len(g) + 2
            share.append(max(0.0, (found.sum() / len(g) - filters.false_rate[k]) / (1 - filters.false_rate[k])))
        best = int(np.argmax(share))
        assert names == [filters.languages[best]] and abs(scores[0] - share[best] / sum(sorted(share)[-2:])) < 1e-9


@pytest.mark.parametrize("drop", [exact_dedup.drop_copies, ngram_join.representatives, substring_dedup.remove, lambda d: toxicity.reject(d, toxicity.Model(constant=0.0))])
def test_columns_of_any_name_come_back(spark, drop):
    names = ["__id", "__row", "__runs", "__digest", "__sum", "__gone", "__node", "node", "component_id", "own0", "key", "bits", "least", "w", "a", "b", "rep", "__text", "r"]
    base = " ".join(f"w{k}" for k in range(80))
    rows = [(k, t, *[f"{n}{k}" for n in names]) for k, t in enumerate([base, base, base + " tail", "alone", None, ""])]
    frame = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    got = drop(frame).collect()
    assert got and got[0].__fields__ == ["doc_id", "text", *names]
    for r in got:
        assert [r[n] for n in names] == [f"{n}{r.doc_id}" for n in names]


def test_decoding_replaces_a_text_column(spark):
    coded = sentence_pieces.encode(docs(spark, ["one two", None])).withColumn("text", F.lit("old"))
    assert sorted(r.text for r in sentence_pieces.decode(coded).collect()) == ["", "one two"]


def test_long_chains_settle(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(300)], "a long, b long")
    assert {r.root for r in components(links).collect()} == {0}
