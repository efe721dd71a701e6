"""Tracked picks as a stream: each new bar costs one update of its security's state (an extension).

The state of a security is what its signals need of the past (ends of the averages, Supertrend's bands, the last 64 bars)
and its open picks. A micro-batch gives what tracking.update gives when it is called with the bars so far: the first
bar of the batch that touches stop or target closes a pick, else bar number `horizon` does, else it stays open. Run bar by
bar, a touch after the horizon can't count any more, as the pick has expired by then.

Defined cases: picks come before bars of the same micro-batch, wherever they stand. A bar that isn't later than the last one
of its security, and a row with an error, only add a note to the open picks; of bars of one day in a micro-batch the one with the
least close counts. A pick that comes late is evaluated on the bars kept; if they don't reach back to its day it stays
open with a note and is left to a batch (tracking.recheck). A pick without id, security or day is not tracked; one whose id is open already doesn't replace it.
A security's bars of one micro-batch are held together.

Needs the RocksDB state store: spark.sql.streaming.stateStore.providerClass.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from barloom.config import Settings
from barloom.operators import tracking
from barloom.sources import state
from barloom.sources.tables import read_state

C = F.col
NAN = math.nan
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PICK, BAR, ERROR = 0, 1, 2

#: Bars kept with a security: 50 for the moving average, the others for picks that come late.
KEPT = 64
CARRY = (
    "day long, n long, close double, gain double, loss double, moves long, gap long, range double, ranges long, range_gap long, upper_band double, lower_band double, side int, "
    "days array<long>, highs array<double>, lows array<double>, closes array<double>"
)
START = (-(1 << 40), 0, NAN, NAN, NAN, 0, 0, NAN, 0, 0, NAN, NAN, 0, [], [], [], [])
OPEN_PICK = "logged long, entry double, stop double, target double, bars long, rsi double, bullish boolean, above boolean"
FOUND = "pick_id string, security_code string, status string, exit_day long, exit_price double, entry double, last_day long, last_close double, days_held long, entry_rsi double, entry_bullish boolean, entry_above boolean, rsi double, bullish boolean, above boolean, error string"


def averaged(y: float, gap: int, x: float, alpha: float) -> tuple[float, int]:
    """(average, values missing since the last one) after x; a missing x leaves the average as it is."""
    if math.isnan(x):
        return y, gap + 1
    if math.isnan(y):
        return x, 0
    old = (1 - alpha) ** (gap + 1)
    return (y * old + alpha * x) / (old + alpha), 0


class Signals:
    """RSI, Supertrend's side and the side of the 50 bar average, one bar after the other, NaN for what is missing."""

    def __init__(self, past: tuple, rsi: int, period: int, multiplier: float):
        (self.day, self.n, self.close, self.gain, self.loss, self.moves, self.gap, self.range, self.ranges, self.range_gap, self.fu, self.fl, self.side) = past[:13]
        self.days, self.highs, self.lows, self.closes = (list(x) for x in past[13:])
        self.rsi_n, self.period, self.multiplier = rsi, period, multiplier

    def add(self, day: int, high: float, low: float, close: float) -> None:
        move = close - self.close
        some = not math.isnan(move)
        old_gap = self.gap
        self.gain, self.gap = averaged(self.gain, old_gap, max(move, 0.0) if some else NAN, 1 / self.rsi_n)
        self.loss, _ = averaged(self.loss, old_gap, max(-move, 0.0) if some else NAN, 1 / self.rsi_n)
        self.moves += some
        spans = [x for x in (high - low, abs(high - self.close), abs(low - self.close)) if not math.isnan(x)]
        self.range, self.range_gap = averaged(self.range, self.range_gap, max(spans, default=NAN), 1 / self.period)
        self.ranges += bool(spans)
        width = self.multiplier * self.range if self.ranges >= self.period else NAN
        self._bands((high + low) / 2 + width, (high + low) / 2 - width, close)
        self.day, self.n, self.close = day, self.n + 1, close
        for kept, x in ((self.days, day), (self.highs, high), (self.lows, low), (self.closes, close)):
            kept.append(x)
            del kept[:-KEPT]

    def _bands(self, upper: float, lower: float, close: float) -> None:
        """side: 1 below the upper band, 2 above the lower one (bullish), 0 unknown."""
        if self.n < self.period:
            return
        if self.n == self.period:
            self.fu, self.fl, self.side = upper, lower, 1
            return
        above = self.side == 1 or self.fu == self.fl  # equal bands count as the upper one
        if upper < self.fu or self.close > self.fu:
            self.fu = upper
        if lower > self.fl or self.close < self.fl:
            self.fl = lower
        band = self.fu if above else self.fl
        if math.isnan(close) or math.isnan(band):
            self.side = 0
        else:
            self.side = 1 if close < band or above and close == band else 2

    def now(self) -> tuple[float, bool, bool]:
        known = self.moves >= self.rsi_n and self.loss != 0
        rsi = 100 - 100 / (1 + self.gain / self.loss) if known else 100.0
        last = self.closes[-50:]
        return rsi, self.side == 2, len(last) == 50 and self.close > math.fsum(last) / 50

    def past(self) -> tuple:
        return (self.day, self.n, self.close, self.gain, self.loss, self.moves, self.gap, self.range, self.ranges, self.range_gap, self.fu, self.fl, self.side, self.days, self.highs, self.lows, self.closes)


def touched(pick: tuple, bars: list[tuple], horizon: int) -> tuple[str, int | None, float, int]:
    """(status, day and price of the exit, bars held) of a pick after these bars, which follow those it has counted."""
    _, _, stop, target, before, *_ = pick
    for k, (day, high, low, _) in enumerate(bars, 1):
        if low <= stop:
            return "HIT_STOPLOSS", day, stop, before + k
        if high >= target:
            return "HIT_TARGET", day, target, before + k
    if before + len(bars) >= horizon:
        day, _, _, close = bars[horizon - before - 1]
        return "EXPIRED", day, close, horizon
    return tracking.OPEN, None, NAN, before + len(bars)


class Tracker(StatefulProcessor):
    def __init__(self, horizon: int, rsi: int, period: int, multiplier: float):
        self.horizon, self.rules = horizon, (rsi, period, multiplier)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.carry = handle.getValueState("carry", CARRY)
        self.open = handle.getMapState("open", "pick_id string", OPEN_PICK)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        df = pd.concat(list(rows), ignore_index=True)
        signals = Signals(self.carry.get() if self.carry.exists() else START, *self.rules)
        picks = {k[0]: tuple(v) for k, v in self.open.iterator()}
        added = self._added(df[df.kind == PICK], picks)
        fresh, error = self._bars(df, signals.day)
        kept = list(zip(signals.days, signals.highs, signals.lows, signals.closes, strict=True))
        # a pick needs every bar after its day: those kept reach back to it, or none has been left out
        whole = signals.n <= KEPT
        for bar in fresh:
            signals.add(*bar)
        if fresh:
            self.carry.update(signals.past())
        out = []
        for name, pick in picks.items():
            new = name in added
            late = [b for b in kept if b[0] > pick[0]] if new else []
            if new and not whole and kept[0][0] > pick[0]:
                out.append(self._row(name, key, pick, None, signals, "bars after its day came before it"))
                continue
            bars = late + [b for b in fresh if b[0] > pick[0]]
            found = touched(pick, bars, self.horizon) if bars else None
            if found or error:
                out.append(self._row(name, key, pick, found, signals, error))
            if found and found[0] != tracking.OPEN:
                if not new:
                    self.open.removeKey((name,))
            elif new or bars:
                self.open.updateValue((name,), (*pick[:4], pick[4] + len(bars), *pick[5:]))
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in FOUND.split(", ")], dtype=object)

    def close(self) -> None:
        pass

    @staticmethod
    def _added(rows: pd.DataFrame, picks: dict) -> set[str]:
        added = set()
        for r in rows.sort_values(["day", "pick_id"]).itertuples(index=False):
            if r.pick_id not in picks:
                number = lambda x: NAN if x is None else float(x)
                flag = lambda x: None if x is None or x != x else bool(x)
                picks[r.pick_id] = (int(r.day), number(r.entry), number(r.stop), number(r.target), 0, number(r.rsi), flag(r.bullish), flag(r.above))
                added.add(r.pick_id)
        return added

    @staticmethod
    def _bars(df: pd.DataFrame, last: int) -> tuple[list[tuple], str | None]:
        """(bars after the last one, one a day, in order; the first of the errors)."""
        bars = df[df.kind == BAR].sort_values(["day", "close", "high", "low"]).drop_duplicates("day")
        late = bars[bars.day <= last]
        errors = sorted(str(x) for x in df[df.kind == ERROR].error)
        if len(late):
            errors.append("a bar came after a later one")
        fresh = bars[bars.day > last]
        return [(int(d), float(h), float(lo), float(c)) for d, h, lo, c in zip(fresh.day, fresh.high, fresh.low, fresh.close, strict=True)], errors[0] if errors else None

    @staticmethod
    def _row(name: str, key: tuple, pick: tuple, found: tuple | None, signals: Signals, error: str | None) -> tuple:
        status, day, price, held = found or (None, None, None, None)
        return (name, key[0], status, day, price, pick[1], signals.day, signals.close, held, *pick[5:8], *signals.now(), error)


def _rows(df: DataFrame, kind: int, **columns: Column) -> DataFrame:
    kinds = {"security_code": "string", "kind": "int", "day": "long", "high": "double", "low": "double", "close": "double", "error": "string", "pick_id": "string", "entry": "double", "stop": "double", "target": "double", "rsi": "double", "bullish": "boolean", "above": "boolean"}
    given = {"kind": F.lit(kind)} | columns
    return df.select(*[given.get(n, C("security_code") if n == "security_code" else F.lit(None)).cast(k).alias(n) for n, k in kinds.items()])


def track(picks: DataFrame, bars: DataFrame, cfg: Settings, failed: DataFrame | None = None) -> DataFrame:
    """A stream of the new values of open picks (pick_id, what tracking.evaluate returns, signal_notes) from streams of picks, of
    bars and, where given, of failed(security_code, error). Where an error came without bars only signal_notes is given."""
    day = lambda c: F.unix_date(C(c).cast("date"))
    number = lambda c: F.when(~F.isnan(C(c).cast("double")), C(c).cast("double"))
    p = picks.filter((C("status") == tracking.OPEN) & C("pick_id").isNotNull() & C("security_code").isNotNull() & C("date_logged").isNotNull())
    rows = _rows(p, PICK, day=day("date_logged"), pick_id=C("pick_id"), entry=C("entry_price"), stop=C("stop_loss"), target=C("target"), rsi=C("entry_rsi"), bullish=C("entry_supertrend_bullish"), above=C("entry_price_above_50"))
    rows = rows.unionByName(_rows(bars.filter(C("security_code").isNotNull() & C("date").isNotNull()), BAR, day=day("date"), high=number("high"), low=number("low"), close=number("close")))
    if failed is not None:
        rows = rows.unionByName(_rows(failed.filter(C("security_code").isNotNull() & C("error").isNotNull()), ERROR, error=C("error")))
    f = cfg["filters"]
    tracker = Tracker(cfg["conviction"]["target_horizon_days"][1], f["rsi"]["period"], f["supertrend"]["period"], f["supertrend"]["multiplier"])
    found = rows.groupBy("security_code").transformWithStateInPandas(tracker, FOUND, "Update", "None")
    return _values(found)


def _values(found: DataFrame) -> DataFrame:
    """Prices, gains and notes by the same rules as in a batch."""
    some = lambda c: F.when(~F.isnan(c), C(c))
    d = found.withColumns({c: some(c) for c in ("exit_price", "entry", "last_close", "entry_rsi", "rsi")})
    gain = lambda p: F.when(C("entry") != 0, F.round((p - C("entry")) / C("entry") * 100, 2))
    ok, closed = C("status").isNotNull(), C("status") != tracking.OPEN
    told = F.concat_ws(" | ", F.when(ok, tracking.health_notes()), F.when(C("error").isNotNull(), F.concat(F.lit(tracking.FAILED), C("error"))))
    notes = d.select(
        "*", C("bullish").alias("supertrend_bullish"), C("above").alias("price_above_50"), C("entry_bullish").alias("entry_supertrend_bullish"), C("entry_above").alias("entry_price_above_50")
    ).withColumn("signal_notes", told)
    return notes.select(
        "pick_id", "status", F.date_from_unix_date(C("exit_day").cast("int")).alias("exit_date"), F.round("exit_price", 2).alias("exit_price"), gain(C("exit_price")).alias("realized_pct"),
        F.when(ok, F.date_from_unix_date(C("last_day").cast("int"))).alias("last_checked_date"), F.when(ok, C("last_close")).alias("last_checked_price"),
        F.when(ok, gain(F.when(closed, C("exit_price")).otherwise(C("last_close")))).alias("unrealized_pct"), "days_held", "signal_notes",
    )


def merged(picks: DataFrame, found: DataFrame) -> DataFrame:
    """picks with the stream's values; errors change the notes alone, closed picks nothing."""
    now = [c for c in found.columns if c != "pick_id"]
    j = picks.join(found.select("pick_id", *[C(c).alias(f"__{c}") for c in now]), "pick_id", "left")
    noted = C("__signal_notes").isNotNull()
    return tracking._cast(j.withColumns({c: F.when(noted & (C("__status").isNotNull() | F.lit(c == "signal_notes")), C(f"__{c}")).otherwise(C(c)) for c in now}), tracking.PICKS)


def picks_sink(spark: SparkSession, home: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that commits a micro-batch to the state of picks at home (see sources.state). The batch is
    written once, so a commit that is made again doesn't ask the stream's state again; a batch that is run again sets
    the same values."""

    def merge(batch: DataFrame, number: int) -> None:
        at = f"{home}/updates/{number:012d}"
        batch.write.mode("overwrite").parquet(at)
        kinds = dict(batch.dtypes)
        state.update(spark, home, tracking.PICKS, lambda before: merged(before, read_state(spark, at, kinds)))

    return merge


def follow(spark: SparkSession, home: str, bars: str, cfg: Settings) -> StreamingQuery:
    """Takes what is new in the folders of picks (home/picks) and of bars into the state of picks at home, from where the last
    call ended; the query ends when all is taken. It runs in a session of its own with the RocksDB state store."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    read = lambda path: own.readStream.schema(own.read.parquet(path).schema).parquet(path)
    out = track(read(f"{home}/picks"), read(bars), cfg).writeStream.foreachBatch(picks_sink(own, home))
    return out.outputMode("update").option("checkpointLocation", f"{home}/progress").trigger(availableNow=True).start()


__all__ = ["ROCKS", "follow", "merged", "picks_sink", "track"]
