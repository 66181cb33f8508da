"""The canonical interval table: any table that can be projected to it works with every operator.

Columns: track_id, note_id (unique; the last key of every order), pitch, vel, start_ms, dur_ms, ntype.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table

EPOCH_US = 1_704_067_200_000_000
DRUM = 99
#: Articulation code of each event type.
TYPES = {"click": 0, "view": 1, "purchase": 2, "signup": 3, "error": DRUM}


def notes(spark: SparkSession, sf_dir: str, tracks: int | None = None) -> DataFrame:
    """``events`` as intervals; ``tracks`` folds users into so many tracks."""
    kind = F.create_map(*(F.lit(x) for kv in TYPES.items() for x in kv))
    return table(spark, sf_dir, "events").select(
        (F.pmod("user_id", F.lit(tracks)) if tracks else F.col("user_id")).cast("long").alias("track_id"),
        F.col("event_id").alias("note_id"),
        (36 + F.regexp_extract("props", r'"k": *([0-9]+)', 1).cast("int") % 48).alias("pitch"),
        (1 + F.col("event_id") % 127).cast("int").alias("vel"),
        ((F.unix_micros(F.col("ts").cast("timestamp")) - EPOCH_US).cast("double") / 1000000.0 / 100.0).alias("start_ms"),
        F.col("value").alias("dur_ms"),
        kind[F.col("event_type")].alias("ntype"),
    )


def notes_sql(tracks: int | None = None) -> str:
    """The same projection as a DuckDB common table expression ``n``."""
    cases = " ".join(f"WHEN '{k}' THEN {v}" for k, v in TYPES.items())
    return (
        f"n AS (SELECT CAST({f'user_id % {tracks}' if tracks else 'user_id'} AS BIGINT) AS track_id, event_id AS note_id, "
        "CAST(36 + CAST(regexp_extract(props, '\"k\": *([0-9]+)', 1) AS INTEGER) % 48 AS INTEGER) AS pitch, "
        "CAST(1 + event_id % 127 AS INTEGER) AS vel, "
        f"CAST(epoch_us(ts) - {EPOCH_US} AS DOUBLE) / CAST(1000000.0 AS DOUBLE) / CAST(100.0 AS DOUBLE) AS start_ms, "
        f"value AS dur_ms, CASE event_type {cases} END AS ntype FROM events)"
    )
