"""Picks re-checked as a stream equal the chain of batch updates."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from barloom.config import settings
from barloom.operators import tracking
from barloom.sources import state
from barloom.sources.tables import with_columns
from barloom.streaming import tracked

BARS = "security_code string, date date, open double, high double, low double, close double, volume double"
D0 = dt.date(2024, 1, 1)


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, tracked.ROCKS)
    yield spark
    spark.conf.set(name, before)


def made_bars(seed: int, n: int = 100) -> list[tuple]:
    """Random walks, a flat series, one with missing prices and one shorter than every average."""
    r, out = random.Random(seed), []
    for code, length in (("a", n), ("b", n), ("flat", n), ("gaps", n), ("short", 8)):
        close = 100.0
        for k in range(length):
            close = 100.0 if code == "flat" else max(1.0, close * (1 + r.uniform(-0.05, 0.05)))
            high, low = close * (1 + r.uniform(0, 0.03)), close * (1 - r.uniform(0, 0.03))
            missing = code == "gaps" and k % 9 == 4
            out.append((code, D0 + dt.timedelta(days=k), close, high, low, None if missing else close, 1000.0))
    return out


def made_picks(spark, bars: list[tuple], every: int = 13):
    """Picks with close and far levels on many days, two at a time, some without levels."""
    rows = []
    for i, (code, day, _, _, _, close, _) in enumerate(bars):
        if i % every == 0 and close is not None:
            for j, width in enumerate((0.04, 0.5)):
                stop = None if i % 3 == 0 and j else close * (1 - width)
                rows.append((f"{code}_{day}_{j}", day, code, close, stop, close * (1 + width), 60.0, i % 2 == 0, True, "OPEN", "none yet"))
    df = spark.createDataFrame(rows, "pick_id string, date_logged date, security_code string, entry_price double, stop_loss double, target double, entry_rsi double, entry_supertrend_bullish boolean, entry_price_above_50 boolean, status string, signal_notes string")
    return with_columns(df, tracking.PICKS)


def feed(home: str, kind: str, df) -> None:
    df.coalesce(1).write.mode("append").parquet(f"{home}/{kind}")


def run(spark, home: str) -> None:
    read = lambda kind, schema: spark.readStream.schema(schema).parquet(f"{home}/{kind}")
    picks = read("picks", ", ".join(f"{c} {k}" for c, k in tracking.PICKS.items()))
    stream = tracked.track(picks, read("bars", BARS), settings(), read("failed", "security_code string, error string"))
    q = stream.writeStream.foreachBatch(tracked.picks_sink(spark, f"{home}/state")).outputMode("update").option("checkpointLocation", f"{home}/cp").trigger(availableNow=True).start()
    q.awaitTermination()


def begin(spark, home: str, picks) -> None:
    state.commit(picks, f"{home}/state", 1)
    for kind, schema in (("picks", picks.schema), ("bars", BARS), ("failed", "security_code string, error string")):
        spark.createDataFrame([], schema).write.parquet(f"{home}/{kind}")


def shown(df) -> dict:
    """By pick, floats to 9 digits; picks are compared by all columns."""
    return {r["pick_id"]: tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()}


def test_equals_chain_of_batches(rocks, tmp_path):
    spark, home = rocks, str(tmp_path)
    bars = made_bars(1)
    picks = made_picks(spark, bars)
    begin(spark, home, picks)
    feed(home, "picks", picks)
    batch = tracking._cast(picks, tracking.PICKS)
    cuts = [0, 37, 52, 53, 100]
    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        # each time the stream starts anew from its checkpoint
        part = [r for r in bars if a <= (r[1] - D0).days < b]
        random.Random(k).shuffle(part)
        feed(home, "bars", spark.createDataFrame(part, BARS))
        run(spark, home)
        so_far = spark.createDataFrame([r for r in bars if (r[1] - D0).days < b], BARS)
        # a batch sees picks of days to come too; as they have no bars it leaves them
        fresh = spark.createDataFrame(part, BARS).select("security_code").distinct()
        after = shown(tracking.recheck(batch.join(fresh, "security_code", "left_semi"), so_far, settings()))
        rest = shown(batch.join(fresh, "security_code", "left_anti").select(*tracking.PICKS))
        batch = tracking._cast(spark.createDataFrame(list((after | rest).values()), picks.schema), tracking.PICKS)
        assert shown(state.latest(spark, f"{home}/state", tracking.PICKS)[0]) == shown(batch), b
    status = {r.status for r in batch.collect()}
    assert status == {"OPEN", "HIT_TARGET", "HIT_STOPLOSS", "EXPIRED"}


def test_defined_cases(rocks, tmp_path):
    spark, home = rocks, str(tmp_path)
    bars = [r for r in made_bars(2, 90) if r[0] in ("a", "b", "flat")]
    day = lambda k: D0 + dt.timedelta(days=k)
    pick = lambda name, code, k: (name, day(k), code, 100.0, 1.0, 1000.0, "OPEN", "none yet")
    few = "pick_id string, date_logged date, security_code string, entry_price double, stop_loss double, target double, status string, signal_notes string"
    early = with_columns(spark.createDataFrame([pick("a1", "a", 79), pick("b1", "b", 79), pick("none1", "none", 3), pick("flat1", "flat", 84)], few), tracking.PICKS)
    late = with_columns(spark.createDataFrame([pick("b2", "b", 82), pick("b3", "b", 2), pick("b1", "b", 85)], few), tracking.PICKS)
    begin(spark, home, early.unionByName(late.filter("pick_id <> 'b1'")))
    feed(home, "picks", early)
    feed(home, "bars", spark.createDataFrame([r for r in bars if r[0] == "b" or r[1] < day(82)], BARS))
    run(spark, home)
    feed(home, "picks", late)
    feed(home, "bars", spark.createDataFrame([r for r in bars if r[0] == "a" and r[1] == day(40)] + [(None, day(99), 1.0, 1.0, 1.0, 1.0, 1.0)], BARS))
    feed(home, "failed", spark.createDataFrame([("none", "no service"), ("flat", None), (None, "x")], "security_code string, error string"))
    run(spark, home)
    got = {r.pick_id: r for r in state.latest(spark, f"{home}/state", tracking.PICKS)[0].collect()}
    assert (got["a1"].days_held, got["a1"].signal_notes) == (2, "Update failed: a bar came after a later one")
    assert (got["none1"].days_held, got["none1"].status, got["none1"].signal_notes) == (None, "OPEN", "Update failed: no service")
    assert (got["flat1"].days_held, got["flat1"].signal_notes) == (None, "none yet")
    assert got["b1"].days_held == 10 and got["b2"].days_held == 7 and got["b2"].last_checked_date == day(89)
    assert (got["b3"].status, got["b3"].days_held, got["b3"].signal_notes) == ("OPEN", None, "Update failed: bars after its day came before it")


def test_batch_run_again(rocks, tmp_path):
    """The sink may see a micro-batch twice."""
    spark, home = rocks, str(tmp_path)
    picks = made_picks(spark, made_bars(3, 40))
    begin(spark, home, picks)
    one = spark.createDataFrame([(picks.first().pick_id, "EXPIRED", D0, 5.0, 1.0, D0, 5.0, 1.0, 15, "x")], "pick_id string, status string, exit_date date, exit_price double, realized_pct double, last_checked_date date, last_checked_price double, unrealized_pct double, days_held long, signal_notes string")
    sink = tracked.picks_sink(spark, f"{home}/state")
    sink(one, 0)
    first = shown(state.latest(spark, f"{home}/state", tracking.PICKS)[0])
    sink(one, 0)
    assert shown(state.latest(spark, f"{home}/state", tracking.PICKS)[0]) == first
    assert sum(r[17] == "EXPIRED" for r in first.values()) == 1
