"""Bars by fetch or cache, answers kept for a time, state versions with several writers, name matching, long Supertrends."""

from __future__ import annotations

import difflib
import json
import os
import random
import subprocess
import sys
import time
from collections import defaultdict
from datetime import datetime, timedelta
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from barloom.config import load_yaml
from barloom.operators import name_match, supertrend
from barloom.sources import fetched, keyed_cache, state

SERVICE = '''
import os, pathlib, json
HOME = pathlib.Path(__file__).parent
def note(key):
    with open(HOME / "calls", "a") as f:
        f.write(key + "\\n")
def bars(key, first, last, interval):
    note(key)
    if key == "empty":
        return []
    if key == "down":
        raise RuntimeError("no answer from " + key)
    if key == "flaky" and (HOME / "calls").read_text().split().count("flaky") < 2:
        raise RuntimeError("try again")
    return [{"date": f"2024-01-0{d} 00:00:00", "open": 1, "high": 2, "low": 0.5, "close": d, "volume": 10} for d in (3, 1, 2)]
def answer(key):
    note(key)
    if key.startswith("bad"):
        raise RuntimeError("unknown " + key)
    return {"marketCap": float(len(key)), "trailingPE": None}
def dump(key):
    note(key)
    return [{"tradingsymbol": "A", "instrument_token": 7, "instrument_type": "EQ"}, {"tradingsymbol": "B", "instrument_token": 8, "instrument_type": "FUT"}]
'''


@pytest.fixture
def service(tmp_path, monkeypatch):
    """A module that notes its calls, importable here and in Python workers."""
    name = f"service_{tmp_path.name}".replace("-", "_")
    (tmp_path / f"{name}.py").write_text(SERVICE)
    monkeypatch.syspath_prepend(str(tmp_path))
    calls = tmp_path / "calls"
    return name, lambda: calls.read_text().split() if calls.exists() else []


def call(name, function):
    """A service for Python workers that don't have the module on their path."""

    def ask(key, home=str(Path(sys.modules[name].__file__).parent) if name in sys.modules else None, name=name, function=function):
        import importlib

        if home and home not in sys.path:
            sys.path.insert(0, home)
        return getattr(importlib.import_module(name), function)(key)

    return ask


def reader(path, service, **options):
    return fetched.FilteringReader({"path": str(path), "fetch": f"{service}:bars", "requests_per_second": "0", "retries": "2", "today": "2024-02-01", **options})


def rows(read):
    return [r for p in read.partitions() for b in read.read(p) for r in b.to_pylist()]


def test_fresh_expired_empty_and_broken_files(tmp_path, service):
    name, calls = service
    one = fetched.normal(pa.table({"date": [datetime(2020, 1, 1)], **{c: [5.0] for c in fetched.PRICES}}))
    for key in ("fresh", "old", "flaky"):
        fetched.save(str(tmp_path / "c"), key, "day", one)
    for key in ("old", "flaky"):
        os.utime(tmp_path / "c" / f"{key}_day.parquet", (time.time() - 7 * 3600,) * 2)
    (tmp_path / "c" / "broken_day.parquet").write_text("no parquet")
    pq.write_table(one.slice(0, 0), tmp_path / "c" / "hollow_day.parquet")
    got = defaultdict(list)
    for r in rows(reader(tmp_path / "c", name, keys=json.dumps(["fresh", "old", "flaky", "broken", "hollow", "new", "empty", "down"]), partitions="3")):
        got[r["security_code"]].append(r)
    assert [r["close"] for r in got["fresh"]] == [5.0]
    for key in ("old", "flaky", "broken", "hollow", "new"):
        assert [r["close"] for r in got[key]] == [1.0, 2.0, 3.0] and all(r["error"] is None for r in got[key])
    assert [(r["error"], r["close"]) for r in got["empty"]] == [("empty answer", None)] and got["down"][0]["error"] == "no answer from down"
    assert {k: calls().count(k) for k in set(calls())} == {"old": 1, "flaky": 2, "broken": 1, "hollow": 1, "new": 1, "empty": 2, "down": 2}
    again = rows(reader(tmp_path / "c", name, keys=json.dumps(["old", "new"])))  # what was fetched is kept
    assert len(again) == 6 and calls().count("old") == 1
    assert {r["security_code"] for r in rows(reader(tmp_path / "c", name))} == {"fresh", "old", "flaky", "broken", "hollow", "new"}


def test_filters_leave_securities_unread(tmp_path, service):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    name, calls = service
    read = reader(tmp_path / "c", name, keys=json.dumps(["a", "b", "c"]))
    kept = GreaterThan(("close",), 1.0)
    assert list(read.pushFilters([In(("security_code",), ("a", "b")), kept, EqualTo(("security_code",), "b")])) == [kept]
    assert {r["security_code"] for r in rows(read)} == {"b"} and calls() == ["b"]


def test_a_failed_security_does_not_stop_the_others(spark, tmp_path):
    day = lambda k: datetime(2024, 1, 1) + timedelta(days=k)
    stored = spark.createDataFrame([(c, day(k), 1.0, 2.0, 0.5, float(k), 3.0) for c in ("1", "2") for k in (2, 0, 1)], "security_code string, date timestamp, open double, high double, low double, close double, volume double")
    assert fetched.write_files(stored, str(tmp_path / "c")) == 2
    df = fetched.history(spark, str(tmp_path / "c"), ["1", "2", "3"], partitions=2)
    bars, failed = fetched.split(df)
    assert bars.count() == 6 and [tuple(r) for r in failed.collect()] == [("3", "no service")]
    assert [r.close for r in bars.filter("security_code = '2'").orderBy("date").collect()] == [0.0, 1.0, 2.0]
    mapping = spark.createDataFrame([("1", "A", "NSE", True), ("3", "C", "BSE", True), ("4", "D", "NSE", False)], "security_code string, tradingsymbol string, exchange string, resolved boolean")
    assert sorted(tuple(r) for r in fetched.outcomes(df, mapping).collect()) == [("1", "A", "NSE", True, 3, None), ("3", "C", "BSE", False, 0, "no service")]


@pytest.mark.parametrize(("kept", "calls_of_bad"), [(keyed_cache.quotes, 2), (keyed_cache.statements, 1)])
def test_errors_are_asked_again_or_kept(spark, tmp_path, service, kept, calls_of_bad):
    name, calls = service
    __import__(name)
    keys = spark.createDataFrame([("AA",), ("bad1",), (None,), ("AA",)], "symbol string")
    for _ in range(2):
        got = {r.key: (r.marketCap, r.trailingPE, r.error) for r in kept(keys, str(tmp_path / "t"), call(name, "answer"), "marketCap DOUBLE, trailingPE DOUBLE").collect()}
        assert got == {"AA": (2.0, None, None), "bad1": (None, None, "unknown bad1")}
    assert calls().count("AA") == 1 and calls().count("bad1") == calls_of_bad
    more = spark.createDataFrame([("AA",), ("BBB",)], "symbol string")
    assert {r.key for r in kept(more, str(tmp_path / "t"), call(name, "answer"), "marketCap DOUBLE").collect()} == {"AA", "BBB"}
    assert calls().count("AA") == 1 and calls().count("BBB") == 1
    old = time.time() - 40 * 24 * 3600
    for f in (tmp_path / "t").glob("*.parquet"):
        os.utime(f, (old, old))
    kept(keys, str(tmp_path / "t"), call(name, "answer"), "marketCap DOUBLE").collect()
    assert calls().count("AA") == 2


def test_dumps_are_kept_for_a_day(spark, tmp_path, service):
    name, calls = service
    __import__(name)
    kinds = "tradingsymbol STRING, instrument_token LONG, instrument_type STRING"
    for refresh, n in ((False, 1), (False, 1), (True, 2)):
        got = keyed_cache.dump(spark, "NSE", str(tmp_path / "d"), call(name, "dump"), kinds, refresh=refresh)
        assert sorted(tuple(r) for r in got.collect()) == [("A", 7, "EQ"), ("B", 8, "FUT")] and calls().count("NSE") == n


# --- state

KINDS = {"who": "string", "n": "int"}
WRITER = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from barloom.sources import state
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "1").getOrCreate()
for n in range(4):
    state.update(spark, {home!r}, {kinds!r}, lambda d: d.unionByName(spark.createDataFrame([({who!r}, n)], "who string, n int")).coalesce(1))
"""


def test_two_writers_lose_and_double_nothing(spark, tmp_path):
    root, home = str(Path(__file__).resolve().parent.parent), str(tmp_path / "s")
    running = [subprocess.Popen([sys.executable, "-c", WRITER.format(root=root, home=home, kinds=KINDS, who=w)], stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL) for w in "ab"]
    assert [p.wait(timeout=240) for p in running] == [0, 0]
    got, version = state.latest(spark, home, KINDS)
    assert version == 8 and sorted(tuple(r) for r in got.collect()) == [(w, n) for w in "ab" for n in range(4)]


def test_a_version_has_one_writer(spark, tmp_path):
    home, one = str(tmp_path / "s"), spark.createDataFrame([("a", 1)], "who string, n int")
    got, version = state.latest(spark, home, KINDS)
    assert (version, got.count()) == (0, 0)
    state.commit(one, home, 1)
    with pytest.raises(state.Conflict):
        state.commit(one.limit(0), home, 1)
    assert [tuple(r) for r in state.latest(spark, home, KINDS)[0].collect()] == [("a", 1)]
    tries = []

    def change(df):
        """Another writer comes first once."""
        tries.append(df.count())
        if len(tries) == 1:
            state.commit(df.unionByName(df), home, 2)
        return df.unionByName(one)

    assert state.update(spark, home, KINDS, change) == 3 and tries == [1, 2] and state.latest(spark, home, KINDS)[0].count() == 3


def test_what_keeps_a_copy_back_is_reported(spark, tmp_path):
    (tmp_path / "file").write_text("")
    add = lambda df: df.unionByName(spark.createDataFrame([("a", 1)], "who string, n int"))
    assert state.mirrored(spark, str(tmp_path / "s"), str(tmp_path / "m"), KINDS, add) is None
    assert state.latest(spark, str(tmp_path / "m"), KINDS)[0].count() == 1
    error = state.mirrored(spark, str(tmp_path / "s"), str(tmp_path / "file" / "m"), KINDS, add)
    assert error.startswith("version 2: ") and state.latest(spark, str(tmp_path / "s"), KINDS)[0].count() == 2


# --- names


def test_matching_asks_few_pairs_and_finds_the_best(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("ABCDEFGHIJKLMNOPRSTUVY") for _ in range(rng.randrange(3, 9))) for _ in range(300)]
    name = lambda k: " ".join(["TATA" if k % 2 == 0 else rng.choice(words), *(rng.choice(words) for _ in range(rng.randrange(1, 4)))])
    wanted, listed = [(str(k), name(k)) for k in range(600)], [(name(k), k) for k in range(600)]
    for k in range(0, 600, 3):
        listed[k] = (wanted[k][1][:-1] + "X" if k % 2 else wanted[k][1] + " HOLDINGS", k)
    listed += [(listed[0][0], 900), ("TATA É日", 901)]
    w = spark.createDataFrame(wanted, "security_code string, name string").repartition(3)
    d = spark.createDataFrame([(n, k, f"S{k}", k) for n, k in listed], "name string, pos long, sym string, token long").repartition(3)
    blocks, want, pairs = defaultdict(list), {}, 0
    for n, k in listed:
        blocks[n.split(" ")[0]].append((n, k))
    for code, n in wanted:
        best = (0.0, 0, None)
        for other, k in blocks[n.split(" ")[0]]:
            pairs += 1
            s = difflib.SequenceMatcher(None, n, other).ratio()
            s = max(s, 0.95) if name_match.begins(n, other) else s
            best = max(best, (s, -k, f"S{k}")) if s > 0 else best
        if best[2]:
            want[code] = (best[2], best[0])
    found = name_match.closest(w, d, held=100).collect()
    assert {r.security_code: (r.sym, r.score) for r in found} == want
    counts = name_match.Wanted([c for c, n in wanted if n.startswith("TATA ")], [n for _, n in wanted if n.startswith("TATA ")])
    hot = blocks["TATA"]
    counts.see([n for n, _ in hot], [k for _, k in hot], [None] * len(hot), [0] * len(hot))
    assert counts.compared < 0.1 * len(hot) * len(counts.names) and pairs > 90_000


# --- Supertrend


def loop(u, low, close, period):
    """Bar by bar: (line, bullish)."""
    line, bull = [None] * len(u), [False] * len(u)
    if len(u) > period:
        fu, fl, upper = u[period], low[period], True
        line[period] = fu
        for i in range(period + 1, len(u)):
            nu = u[i] if u[i] < fu or close[i - 1] > fu else fu
            nl = low[i] if low[i] > fl or close[i - 1] < fl else fl
            upper = close[i] <= nu if upper or fu == fl else close[i] < nl
            fu, fl = nu, nl
            line[i], bull[i] = (fu, False) if upper else (fl, True)
    return line, bull


@pytest.mark.parametrize("block", [4, 64])
@pytest.mark.parametrize("wild", [0.001, 0.02, 0.3])
def test_supertrend_in_blocks_equals_the_loop(spark, block, wild):
    rng = np.random.default_rng(int(wild * 1000) + block)
    data, n = [], 3000
    for code in "abc":
        close = np.round(100 * np.exp(np.cumsum(rng.normal(0, wild, n))), 2) + 1
        close[500:900] = close[500]  # long stretches without a change, and bands that meet
        high, low = close * (1 + wild * rng.random(n)), close * (1 - wild * rng.random(n))
        high[600:800] = low[600:800] = close[600:800]
        size = n if code != "c" else 7
        data += [(code, datetime(2000, 1, 1) + timedelta(hours=k), float(close[k]), float(high[k]), float(low[k]), float(close[k]), 1.0) for k in range(size)]
    df = spark.createDataFrame(data, "security_code string, date timestamp, open double, high double, low double, close double, volume double").repartition(4)
    bands = defaultdict(list)
    for r in supertrend.bands(df, 10, 3.0).orderBy("security_code", "date").collect():
        bands[r.security_code].append((r.u, r.l, r.close))
    got = defaultdict(list)
    for r in supertrend.series(df, block=block).orderBy("security_code", "date").collect():
        got[r.security_code].append((r.supertrend, r.supertrend_bullish))
    for code, b in bands.items():
        assert got[code] == list(zip(*loop(*zip(*b, strict=True), 10), strict=True))
    assert "Python" not in supertrend.series(df)._jdf.queryExecution().executedPlan().toString()


def test_yaml(tmp_path, monkeypatch):
    try:
        import yaml  # noqa: F401
    except ImportError:
        from types import SimpleNamespace

        monkeypatch.setitem(sys.modules, "yaml", SimpleNamespace(safe_load=lambda f: {"filters": {"rsi": {"period": 9}}} if f.read() else None))
    (tmp_path / "c.yaml").write_text("filters:\n  rsi:\n    period: 9\n")
    assert load_yaml(str(tmp_path / "c.yaml"))["filters"]["rsi"]["period"] == 9
