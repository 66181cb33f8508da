"""Structured Streaming forms: event-time windows with watermarks, and keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SUMS = lambda: (F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums a window and type; works on streams and batches alike."""
    return _flat(events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(*_SUMS()))


def sliding(events: DataFrame, width: str = "2 hours", hop: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return _flat(events.withWatermark("ts", late).groupBy(F.window("ts", width, hop).alias("w"), "event_type").agg(*_SUMS()))


def sessions(events: DataFrame, gap: str | Column = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return _flat(events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(*_SUMS()))


def _flat(df: DataFrame) -> DataFrame:
    return df.select(F.col("w.start").alias("start_ts"), F.col("w.end").alias("end_ts"), *(c for c in df.columns if c != "w"))


def peak_meter(blocks: DataFrame, decay: float = 0.82) -> DataFrame:
    """(key, seq, peak) of a stream of (key, seq, level): peak = max(level, decay x the peak before), kept as state a key between micro-batches."""

    def step(key, frames: Iterator[pd.DataFrame], state):
        peak = state.get[0] if state.exists else 0.0
        rows = pd.concat(list(frames)).sort_values("seq")
        out = []
        for seq, level in zip(rows.seq, rows.level, strict=True):
            peak = max(float(level), decay * peak)
            out.append((key[0], seq, peak))
        state.update((peak,))
        yield pd.DataFrame(out, columns=["key", "seq", "peak"])

    return blocks.groupBy("key").applyInPandasWithState(step, "key long, seq long, peak double", "peak double", "append", "NoTimeout")


def drained(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """All that a bounded stream gives, through the memory sink: for tests and small results only."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
