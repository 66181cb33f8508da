"""Row-wise transforms and filters: no shuffle, all Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..notes import DRUM


def end_ms() -> Column:
    return F.col("start_ms") + F.col("dur_ms")


def transpose(notes: DataFrame, by: int) -> DataFrame:
    return notes.withColumn("pitch", F.col("pitch") + by)


def clamp_pitch(notes: DataFrame, low: int = S.LOWEST_PITCH, high: int = S.HIGHEST_PITCH) -> DataFrame:
    return notes.withColumn("pitch", S.bounded(F.col("pitch"), low, high))


def pitch_plan(notes: DataFrame, overrides: DataFrame, everywhere: int = 0) -> DataFrame:
    """``pitch`` moved by ``everywhere`` plus the track's own offset (track_id, offset); drum notes stay."""
    joined = notes.join(overrides, "track_id", "left")
    moved = F.col("pitch") + everywhere + F.coalesce("offset", F.lit(0))
    return joined.withColumn("pitch", F.when(F.col("ntype") == DRUM, F.col("pitch")).otherwise(moved).cast("int")).drop("offset")


def drum_map(notes: DataFrame, mapping: DataFrame, rolls: tuple[int, ...] = (), longest: float = 80.0, shortest: float = 1.0) -> DataFrame:
    """Drum keys replaced by ``mapping`` (pitch, to_pitch): at most ``longest`` long unless the new key is a roll. An unmapped key is an error."""
    joined = notes.join(mapping, "pitch", "left")
    to = F.when(F.col("to_pitch").isNull(), F.raise_error(F.concat(F.lit("unmapped drum key "), F.col("pitch")))).otherwise(F.col("to_pitch"))
    capped = F.greatest(F.lit(shortest), F.when(F.col("to_pitch").isin(*rolls) if rolls else F.lit(False), F.col("dur_ms")).otherwise(F.least(F.lit(longest), F.col("dur_ms"))))
    return joined.withColumn("dur_ms", capped).withColumn("pitch", to).select(*notes.columns)


def program_map(rows: DataFrame, ranges: list[tuple[int, int, str]], column: str = "program", to: str = "instrument", default: str = "other") -> DataFrame:
    """A name for each inclusive range of numbers; the first range that fits."""
    out = F.lit(default)
    for low, high, name in reversed(ranges):
        out = F.when(F.col(column).between(low, high), F.lit(name)).otherwise(out)
    return rows.withColumn(to, out)


def quantize_starts(notes: DataFrame, grid: float, origin: float = 0.0) -> DataFrame:
    return notes.withColumn("start_ms", S.on_grid(F.col("start_ms"), grid, origin))


def soft_quantize(notes: DataFrame, grid: float, strength: float = 0.5, within: float = 18.0, least: float = 0.5) -> DataFrame:
    """Starts moved by a share of the way to the grid if it lies ``within``; ``moved`` marks moves of ``least`` or more."""
    delta = S.half_even(F.col("start_ms") / grid) * grid - F.col("start_ms")
    shift = F.when(F.abs(delta) <= within, delta * strength).otherwise(0.0)
    return notes.withColumns({"start_ms": F.greatest(F.lit(0.0), F.col("start_ms") + shift), "moved": F.abs(shift) >= least})


def region_filter(notes: DataFrame, a: float, b: float, offset: float = 0.0) -> DataFrame:
    """Starts within [a, b) once shifted."""
    return notes.filter((F.col("start_ms") + offset >= a) & (F.col("start_ms") + offset < b))


def overlap_filter(notes: DataFrame, a: float, b: float) -> DataFrame:
    """Half-open overlap: touching intervals don't."""
    return notes.filter((F.col("start_ms") < b) & (end_ms() > a))


def viewport_query(notes: DataFrame, a: float, b: float) -> DataFrame:
    """Closed overlap: touching intervals do."""
    return notes.filter((F.col("start_ms") <= b) & (end_ms() >= a))


def eligible_candidates(rows: DataFrame, selected: DataFrame, gone: DataFrame, a: float, b: float) -> DataFrame:
    """The ``selected`` rows (note_id) if there are any, else those starting in [a, b); without those in ``gone`` (note_id)."""
    some = selected.limit(1).agg((F.count("*") > 0).alias("some"))
    marked = rows.join(selected.select("note_id", F.lit(True).alias("is_selected")).distinct(), "note_id", "left").crossJoin(F.broadcast(some))  # one row
    wanted = F.when(F.col("some"), F.coalesce("is_selected", F.lit(False))).otherwise((F.col("start_ms") >= a) & (F.col("start_ms") < b))
    return marked.filter(wanted).join(gone.select("note_id").distinct(), "note_id", "left_anti").select(*rows.columns)


def preview_filter(tracks: DataFrame) -> DataFrame:
    """Tracks that sound: with any solo track, those that are solo and not muted, else those not muted."""
    any_solo = tracks.agg(F.coalesce(F.max("solo"), F.lit(False)).alias("any_solo"))
    return tracks.crossJoin(F.broadcast(any_solo)).filter(~F.col("muted") & (~F.col("any_solo") | F.col("solo"))).select(*tracks.columns)  # one row


def pitch_supported(notes: DataFrame, limits: DataFrame) -> DataFrame:
    """``supported``: the pitch lies in the track's limits (track_id, low, high); tracks without limits, and drums, fail."""
    ok = F.coalesce(F.col("pitch").between(F.col("low"), F.col("high")) & (F.col("ntype") != DRUM), F.lit(False))
    return notes.join(limits, "track_id", "left").withColumn("supported", ok).drop("low", "high")


def articulation_supported(notes: DataFrame, ranges: DataFrame) -> DataFrame:
    """``supported``: the pitch lies in the articulation's range (ntype, low, high); articulations without one aren't restricted."""
    ok = F.coalesce(F.col("pitch").between(F.col("low"), F.col("high")), F.lit(True))
    return notes.join(ranges, "ntype", "left").withColumn("supported", ok).drop("low", "high")
