"""Validation: each rule is a query that gives issue rows; the report is their union."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..notes import DRUM


def issue(rows: DataFrame, code: str, severity: str, note: bool) -> DataFrame:
    return rows.select(F.lit(code).alias("code"), F.lit(severity).alias("severity"), "track_id", (F.col("note_id") if note else F.lit(-1).cast("long")).alias("note_id"))


def onset_peaks(notes: DataFrame, ms: float = 1.0) -> DataFrame:
    return notes.groupBy("track_id", S.half_even(F.col("start_ms") / ms).alias("at")).count().groupBy("track_id").agg(F.max("count").alias("onset_peak"))


def validate_tracks(notes: DataFrame, shortest: float = 1.0, highest_drum: int = 81, least_vel: int = 3, most_notes: int = 10_000, most_onsets: int = 24, onset_ms: float = 1.0) -> DataFrame:
    """(code, severity, track_id, note_id) of every broken rule (note_id -1 for rules of a track); row rules are one pass that explodes, track rules are aggregates."""
    rules = F.array_compact(F.array(
        F.when(F.col("dur_ms") <= shortest, F.struct(F.lit("bad_duration").alias("code"), F.lit("error").alias("severity"))),
        F.when((F.col("ntype") == DRUM) & (F.col("pitch") > highest_drum), F.struct(F.lit("drum_pitch").alias("code"), F.lit("error").alias("severity"))),
        F.when(F.col("vel") < least_vel, F.struct(F.lit("low_velocity").alias("code"), F.lit("warning").alias("severity"))),
    ))
    rows = notes.select("track_id", "note_id", F.explode(rules).alias("r")).select("r.code", "r.severity", "track_id", "note_id")
    onsets = notes.groupBy("track_id", S.half_even(F.col("start_ms") / onset_ms).alias("at")).count()
    tracks = onsets.groupBy("track_id").agg(F.sum("count").alias("n"), F.max("count").alias("peak"))
    broken = F.array_compact(F.array(
        F.when(F.col("n") > most_notes, F.struct(F.lit("too_many_notes").alias("code"), F.lit("error").alias("severity"))),
        F.when(F.col("peak") >= most_onsets, F.struct(F.lit("dense_onsets").alias("code"), F.lit("warning").alias("severity"))),
    ))
    whole = tracks.select("track_id", F.explode(broken).alias("r")).select("r.code", "r.severity", "track_id", F.lit(-1).cast("long").alias("note_id"))
    return rows.unionByName(whole)


def validate_groups(tracks: DataFrame, notes: DataFrame, most_notes: int) -> DataFrame:
    """(code, severity, instrument, n): rules of the tracks (track_id, instrument, volume, sends) that share an instrument, and of its merged notes.

    Several tracks are reported as merged; they must agree in volume and in effect sends; their notes together have a bound.
    """
    sizes = notes.groupBy("track_id").agg(F.count("*").alias("notes"))
    groups = tracks.join(sizes, "track_id", "left").groupBy("instrument").agg(F.count("*").alias("tracks"), F.count_distinct("volume").alias("volumes"), F.count_distinct("sends").alias("sends"), F.sum("notes").alias("notes"))

    def rule(holds, code: str, severity: str, n: str):
        return F.when(holds, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.col(n).cast("long").alias("n")))

    several = F.col("tracks") > 1
    found = F.array_compact(F.array(
        rule(several, "tracks_merge", "info", "tracks"), rule(several & (F.col("volumes") > 1), "volume_conflict", "error", "volumes"),
        rule(several & (F.col("sends") > 1), "effects_conflict", "error", "sends"), rule(F.col("notes") > most_notes, "instrument_capacity", "warning", "notes"),
    ))
    return groups.select("instrument", F.explode(found).alias("r")).select("r.code", "r.severity", "instrument", "r.n")


def assess_draft(notes: DataFrame, instruments: DataFrame, on: str = "track_id") -> DataFrame:
    """(track_id, notes, bad_pitch, bad_type, bad_timing, bad_velocity, legal): a read-only report against each track's instrument (track_id, low, high, types); nothing is changed."""
    met = notes.join(instruments, on, "left")
    pitch = ~F.col("pitch").between(0, 127) | F.coalesce(~F.col("pitch").between(F.col("low"), F.col("high")), F.lit(False))
    kind = F.coalesce((F.size("types") > 0) & ~F.array_contains("types", F.col("ntype")), F.lit(False)) | ~F.col("ntype").between(0, 255)
    timing, vel = (F.col("start_ms") < 0) | (F.col("dur_ms") <= 0), ~F.col("vel").between(0, 127)
    counts = {"bad_pitch": pitch, "bad_type": kind, "bad_timing": timing, "bad_velocity": vel}
    return met.groupBy(on).agg(F.count("*").alias("notes"), *(F.count_if(c).alias(n) for n, c in counts.items()), F.count_if(~(pitch | kind | timing | vel)).alias("legal"))


def validate_document(chunks: DataFrame, most: int = 730) -> DataFrame:
    """(code, severity, track_id, chunk, n) of physical tracks (track_id, chunk, instrument, notes): too many notes, mixed instruments in a track, notes out of range."""
    notes = F.col("notes")
    counts = {
        "note_limit": F.when(F.size(notes) > most, F.size(notes)), "note_pitch": F.size(F.filter(notes, lambda n: ~n["pitch"].between(0, 127))),
        "note_type": F.size(F.filter(notes, lambda n: ~n["ntype"].between(0, 255))), "note_velocity": F.size(F.filter(notes, lambda n: ~n["vel"].between(0, 127))),
    }
    found = F.array_compact(F.array(*(F.when(c > 0, F.struct(F.lit(code).alias("code"), c.cast("long").alias("n"))) for code, c in counts.items())))
    own = chunks.select("track_id", "chunk", F.explode(found).alias("r")).select("r.code", "track_id", "chunk", "r.n")
    mixed = chunks.groupBy("track_id").agg(F.count_distinct("instrument").alias("n")).filter("n > 1").select(F.lit("instrument_mixed").alias("code"), "track_id", F.lit(-1).cast("long").alias("chunk"), "n")
    return own.unionByName(mixed).select("code", F.lit("error").alias("severity"), "track_id", "chunk", "n")


def diagnose_authoring(notes: DataFrame, most: int = 730, shortest: float = 0.0) -> DataFrame:
    """(track_id, chunks, bad_durations, onset_peak) a track."""
    own = notes.groupBy("track_id").agg(F.ceil(F.count("*") / most).alias("chunks"), F.count_if(F.col("dur_ms") <= shortest).alias("bad_durations"))
    return own.join(onset_peaks(notes), "track_id")
