"""Alignment of notes to a grid of beats: positions through a piecewise tempo map, and back to the same clock."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..shared import written
from . import intervals as I
from .curves import onset_refine
from .folds import anchor_cluster
from .runs import islands
from .walks import join_keys, over_groups

#: Steps of the grid in beats, the first that is near enough is taken, with their divisors.
STEPS = ((1.0, 1), (1 / 2, 2), (1 / 3, 3), (1 / 4, 4), (1 / 6, 6), (1 / 8, 8), (1 / 12, 12), (1 / 16, 16))
STRICT = (1 / 16, 16)
#: The most that a bound moves, the share of a step that counts as near, the reach of a chord, and the evidence that moves an onset.
MOST_SHIFT, NEAR, CHORD_MS, RADIUS, LEAST_ONSET = 45.0, 0.35, 35.0, 2, 0.35
TINY = 1e-9


def _beat(at: str) -> Column:
    return F.round(F.col("beat_at_start") + (F.col(at) - F.col("from_ms")) * F.col("bpm") / 60000.0, 9)


def snapped(notes: DataFrame, segments: DataFrame, evidence: DataFrame, profile: str = "auto", on: Sequence[str] = ("track_id",)) -> DataFrame:
    """(*on, note_id, pitch, confidence, raw_start, raw_dur, start_ms, dur_ms, divisor, sixteenth_ms): each note by itself on its grid."""
    keys = list(on)
    refined = onset_refine(notes, evidence, radius=RADIUS, least=LEAST_ONSET).select("note_id", F.col("start_ms").alias("onset_ms"))
    rows = notes.filter("start_ms >= 0 AND dur_ms > 0").select(*keys, "note_id", "pitch", "confidence", F.col("start_ms").alias("raw_start"), F.col("dur_ms").alias("raw_dur"), (F.col("start_ms") + F.col("dur_ms")).alias("raw_end")).join(refined, "note_id")
    tempo = ("from_ms", "bpm", "beat_at_start")

    def placed(df: DataFrame, at: str) -> DataFrame:
        own = segments.select(*keys, F.col("start_ms").alias(at), F.col("start_ms").alias("from_ms"), "bpm", "beat_at_start")
        return I.asof(df, own, at, on, tempo, first_if_none=True)

    first = placed(rows, "onset_ms").withColumn("beat", _beat("onset_ms")).withColumn("beat_ms", 60000.0 / F.col("bpm"))
    grid = F.array(*(F.struct(F.lit(s).alias("step"), F.lit(d).alias("divisor")) for s, d in STEPS))
    nearest = lambda beat, step: S.half_even(F.round(beat / step, 9)) * step
    near = F.filter(grid, lambda g: F.abs(F.col("beat") - nearest(F.col("beat"), g["step"])) * F.col("beat_ms") <= F.least(F.lit(MOST_SHIFT), g["step"] * F.col("beat_ms") * NEAR) + TINY)
    finest = F.struct(F.lit(STRICT[0]).alias("step"), F.lit(STRICT[1]).alias("divisor"))
    chosen = finest if profile == "strict" else F.coalesce(F.get(near, 0), finest)
    first = first.withColumn("grid", chosen).withColumns({"snap": nearest(F.col("beat"), F.col("grid.step")), "start_at": F.col("from_ms"), "start_beat": F.col("beat_at_start")}).drop(*tempo)
    both = placed(first, "raw_end").withColumn("end_snap", nearest(_beat("raw_end"), F.col("grid.step")))
    end_snap = F.when(F.col("end_snap") <= F.col("snap"), F.col("snap") + F.col("grid.step")).otherwise(F.col("end_snap"))
    bound = lambda x, raw: F.greatest(F.col(raw) - MOST_SHIFT, F.least(F.col(raw) + MOST_SHIFT, x))
    start = F.greatest(F.lit(0.0), bound(F.col("start_at") + (F.col("snap") - F.col("start_beat")) * F.col("beat_ms"), "raw_start"))
    end = bound(F.col("from_ms") + (end_snap - F.col("beat_at_start")) * 60000.0 / F.col("bpm"), "raw_end")
    moved = both.withColumns({"start": F.round(start, 6), "end": F.round(end, 6)})
    whole = F.col("end") > F.col("start")
    return moved.select(
        *keys, "note_id", "pitch", "confidence", "raw_start", "raw_dur", F.when(whole, F.col("start")).otherwise(F.col("raw_start")).alias("start_ms"), F.when(whole, F.round(F.col("end") - F.col("start"), 6)).otherwise(F.col("raw_dur")).alias("dur_ms"),
        F.col("grid.divisor").alias("divisor"), (F.col("beat_ms") / 16).alias("sixteenth_ms"),
    )


def rhythm_align(notes: DataFrame, segments: DataFrame, evidence: DataFrame, profile: str = "auto", on: Sequence[str] = ("track_id",)) -> DataFrame:
    """(*on, note_id, start_ms, dur_ms, divisor): notes on the grid of their tempo ``segments`` (*on, start_ms, bpm, beat_at_start).

    A start goes to the strongest onset beside it, then, like the end, to the nearest step of its beat: the coarsest
    that is near, or always the sixteenth (``strict``). No bound moves by more than MOST_SHIFT, and a note that would
    lose its length stays. Notes of a chord take the place of its most confident member (ties: first, then id), but
    those of that one's own pitch. Of one pitch, a note that would begin with the one before or earlier moves on by a
    sixteenth, and the one before ends where it begins, where their shifts allow it. Notes that lack a value, and keys
    without segments, take no part.
    """
    if profile not in ("auto", "strict"):
        raise ValueError(f"unknown profile {profile}")
    keys = list(on)
    known = notes.dropna(subset=["note_id", "start_ms", "dur_ms", "pitch", "confidence"])
    own = written(snapped(known, segments, evidence, profile, on).filter("start_ms IS NOT NULL"), "align-snapped")
    chords = anchor_cluster(own.select(*keys, "note_id", F.col("raw_start").alias("start_ms")), CHORD_MS, on)
    rows = join_keys(own, chords, [*keys, "note_id"])
    lead = F.first(F.struct("note_id", "pitch", "start_ms")).over(Window.partitionBy(*keys, "anchor_ms").orderBy(F.desc("confidence"), "raw_start", "note_id"))
    rows = rows.withColumn("lead", lead)
    follows = (F.col("pitch") != F.col("lead.pitch")) & (F.abs(F.col("lead.start_ms") - F.col("raw_start")) <= MOST_SHIFT + TINY)
    rows = rows.withColumn("start_ms", F.when(follows, F.col("lead.start_ms")).otherwise(F.col("start_ms"))).drop("lead", "anchor_ms")
    pitch = Window.partitionBy(*keys, "pitch").orderBy("start_ms", "note_id")
    rows = rows.withColumn("next", F.lead("start_ms").over(pitch))
    # a note moves to less than twice the shift behind its place, so what begins later than that is no concern
    parts = islands(rows, [*keys, "pitch"], 2 * MOST_SHIFT)

    def solve(g: dict) -> tuple:
        start, length, raw, raw_end, further = g["start_ms"].copy(), g["dur_ms"].copy(), g["raw_start"], g["raw_start"] + g["raw_dur"], g["next"]
        n = len(start)
        for i in range(n):
            if i + 1 < n:
                if start[i + 1] <= start[i] and abs((later := start[i] + g["sixteenth_ms"][i + 1]) - raw[i + 1]) <= MOST_SHIFT + TINY:
                    start[i + 1] = later
                room = start[i + 1] - start[i]
            else:
                room = further[i] - start[i]
            if room > 0 and length[i] > room and abs(start[i] + room - raw_end[i]) <= MOST_SHIFT + TINY:
                length[i] = room
        return *(g[k] for k in keys), g["note_id"], np.round(start, 6), np.round(length, 6), g["divisor"]

    kinds = dict(own.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "note_id long, start_ms double, dur_ms double, divisor int"])
    columns = ["dur_ms", "raw_start", "raw_dur", "sixteenth_ms", "next", "divisor"]
    return over_groups(parts, [*keys, "pitch", "island"], columns, ["start_ms", "note_id"], solve, schema, nullable=["next"])
