"""Streamed bars equal the batch ones, and history merges batch by batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import tracking
from barloom.sources.tables import bars_from_events, read_state, with_columns
from barloom.streaming.incremental import event_bars, history_sink


def test_streamed_bars(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = event_bars(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("bars_now").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.security_code, r.date): (r.open, r.high, r.low, r.close, r.volume) for r in spark.table("bars_now").collect()}
    assert got == {(r.security_code, r.date): (r.open, r.high, r.low, r.close, r.volume) for r in bars_from_events(spark, sf).collect()}


def test_history_batches(spark, tmp_path):
    kinds = {"security_code": "string", "tradingsymbol": "string", "company_name": "string", "universe": "string", "as_of": "date", "close": "double", "conviction_score": "double", "conviction_tier": "string", "supertrend_bullish": "boolean", "pct_above_sma50": "double", "passes_all_filters": "boolean"}
    row = with_columns(spark.createDataFrame([("1", True)], "security_code string, passes_all_filters boolean"), kinds).withColumn("close", F.lit(1.0))
    sink = history_sink(spark, str(tmp_path / "h"))
    for number in (0, 1, 1):
        sink(row, number)
    assert [r.times_seen for r in read_state(spark, str(tmp_path / "h" / "v000002"), tracking.HISTORY).collect()] == [2]
