"""Queries over fragment contexts and clean-up."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..notes import notes, notes_sql
from ..operators import cleanup as C
from ..shared import written
from .base import query

#: Notes of eight tracks as frame events ``e``.
_E = """{N8}, e AS (SELECT track_id, note_id, pitch, note_id % 100 / 100.0::DOUBLE AS confidence, CAST(floor(start_ms / 10.0) AS BIGINT) AS s,
greatest(CAST(floor(start_ms / 10.0) AS BIGINT) + 1, CAST(floor((start_ms + dur_ms) / 10.0) AS BIGINT)) AS t FROM n)"""
_SEQ = "sq AS (SELECT DISTINCT a.note_id FROM e a JOIN e b ON a.track_id = b.track_id AND a.note_id <> b.note_id AND abs(a.pitch - b.pitch) <= 12 AND b.s <= a.t + 8 AND b.t >= a.s - 8)"
_FLICK = "fl AS (SELECT DISTINCT a.note_id FROM e a JOIN e b ON a.track_id = b.track_id AND abs(a.pitch - b.pitch) BETWEEN 1 AND 2 AND a.t - a.s <= 8 AND b.t - b.s >= a.t - a.s + 2 AND b.s <= a.t + 1 AND b.t >= a.s - 1)"
_CHORD = "ch AS (SELECT note_id, min(pitch) OVER w <> max(pitch) OVER w AS y FROM e WINDOW w AS (PARTITION BY track_id ORDER BY s RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING))"
_REPEAT = """rs AS (SELECT DISTINCT track_id, pitch, s FROM e), rw AS (SELECT *, s - lag(s) OVER w AS b, lead(s) OVER w - s AS f, lag(s) OVER w - lag(s, 2) OVER w AS p FROM rs WINDOW w AS (PARTITION BY track_id, pitch ORDER BY s)),
rr AS (SELECT track_id, pitch, s FROM rw WHERE b IS NOT NULL AND f IS NOT NULL AND (abs(f - b) <= greatest(1, round_even(b * 0.2::DOUBLE, 0)) OR coalesce(abs(p - b) <= greatest(1, round_even(b * 0.2::DOUBLE, 0)), false)))"""
_FLAGS = f"""WITH {_E}, {_SEQ}, {_FLICK}, {_CHORD}, {_REPEAT}, g AS (SELECT e.*, CASE WHEN e.t - e.s <= 6 THEN 'severe_fragment' END AS f1, CASE WHEN e.t - e.s <= 8 THEN 'review_fragment' END AS f2, CASE WHEN e.t - e.s <= 11 THEN 'short_density' END AS f3,
CASE WHEN fl.note_id IS NOT NULL THEN 'pitch_flicker' END AS f4, CASE WHEN ch.y THEN 'chord_supported' END AS f5, CASE WHEN sq.note_id IS NOT NULL THEN 'sequence_supported' END AS f6, CASE WHEN rr.s IS NOT NULL THEN 'regular_repeat' END AS f7
FROM e JOIN ch USING (note_id) LEFT JOIN fl ON fl.note_id = e.note_id LEFT JOIN sq ON sq.note_id = e.note_id LEFT JOIN rr ON rr.track_id = e.track_id AND rr.pitch = e.pitch AND rr.s = e.s)"""


def _events(spark, sf):
    return C.frame_events(notes(spark, sf, 8).withColumn("confidence", F.col("note_id") % 100 / 100.0))


@query(f"WITH {_E}, {_SEQ} SELECT e.note_id, sq.note_id IS NOT NULL AS supported FROM e LEFT JOIN sq ON sq.note_id = e.note_id")
def sequence_support(spark, sf):
    return C.sequence_support(_events(spark, sf))


@query(f"WITH {_E}, {_FLICK} SELECT note_id FROM fl")
def pitch_flicker(spark, sf):
    return C.pitch_flicker(_events(spark, sf))


@query(f"{_FLAGS} SELECT note_id, concat_ws(',', f1, f2, f3, f4, f5, f6, f7) AS flags FROM g")
def fragment_flags(spark, sf):
    return C.fragment_flags(_events(spark, sf)).select("note_id", F.array_join("flags", ",").alias("flags"))


@query(f"""{_FLAGS}, ev AS (SELECT track_id, pitch, s AS frame, max(note_id % 97) / 97.0::DOUBLE AS fv, max(note_id % 89) / 120.0::DOUBLE AS ov FROM e GROUP BY 1, 2, 3),
a AS (SELECT * FROM g WHERE f1 IS NOT NULL AND confidence < 0.3 AND f4 IS NULL AND f5 IS NULL AND f6 IS NULL AND f7 IS NULL),
fr AS (SELECT a.note_id, a.track_id, a.pitch, a.s, a.t, unnest(range(a.s - 3, greatest(a.t, a.s + 4))) AS frame FROM a),
sm AS (SELECT note_id, sum(CASE WHEN frame >= s AND frame < t THEN coalesce(fv, 0) ELSE 0 END) / max(t - s) AS support, max(CASE WHEN abs(frame - s) <= 1 THEN coalesce(ov, 0) END) AS peak, avg(CASE WHEN abs(frame - s) <= 3 THEN coalesce(ov, 0) END) AS around
FROM fr LEFT JOIN ev USING (track_id, pitch, frame) GROUP BY 1)
SELECT g.note_id, coalesce(round(peak, 9) < 0.5 AND round(peak - around, 9) < 0.1 AND round(support, 9) < 0.35, false) AS hidden FROM g LEFT JOIN sm ON sm.note_id = g.note_id""")
def clean_suppress(spark, sf):
    events = _events(spark, sf)
    evidence = events.groupBy("track_id", "pitch", F.col("start_frame").alias("frame")).agg((F.max(F.col("note_id") % 97) / 97.0).alias("frame_value"), (F.max(F.col("note_id") % 89) / 120.0).alias("onset_value"))
    return C.clean_suppress(C.fragment_flags(events), evidence).select("note_id", "hidden")


@query()
def cleanup_pipeline(spark, sf):
    events = _events(spark, sf)
    evidence = events.groupBy("track_id", "pitch", F.col("start_frame").alias("frame")).agg((F.max(F.col("note_id") % 97) / 97.0).alias("frame_value"), (F.max(F.col("note_id") % 89) / 120.0).alias("onset_value"))
    twins = events.filter("note_id % 6 = 0").withColumn("note_id", F.col("note_id") + 1_000_000_000)
    return C.cleanup(events.unionByName(twins), evidence)


#: Evidence that goes on two frames after each event, and weak onsets.
_DENSE = """ex AS (SELECT track_id, pitch, note_id, unnest(range(s, t + 2)) AS frame, s FROM e),
dv AS (SELECT track_id, pitch, frame, max(0.3::DOUBLE + note_id % 7 / 100.0::DOUBLE) AS fv, max(CASE WHEN frame = s THEN note_id % 11 / 60.0::DOUBLE ELSE 0 END) AS ov FROM ex GROUP BY 1, 2, 3)"""


def _dense(events):
    frames = events.select("track_id", "pitch", "note_id", F.explode(F.sequence("start_frame", F.col("end_frame") + 1)).alias("frame"), "start_frame")
    return frames.groupBy("track_id", "pitch", "frame").agg(F.max(0.3 + F.col("note_id") % 7 / 100.0).alias("frame_value"), F.max(F.when(F.col("frame") == F.col("start_frame"), F.col("note_id") % 11 / 60.0).otherwise(0.0)).alias("onset_value"))


#: 64 tracks of two pitches, so that events of a pitch follow each other closely and chords are few.
_E64 = _E.replace("{N8}", notes_sql(64)).replace("note_id, pitch,", "note_id, 48 + 12 * (pitch % 2) AS pitch,")


@query(f"""WITH RECURSIVE {_E64}, {_DENSE}, {_FLICK}, {_CHORD},
ar AS (SELECT note_id, track_id, pitch, s, unnest(range(-3, 4)) AS d FROM e),
mt AS (SELECT ar.note_id, d, coalesce(fv, 0) AS fv, coalesce(ov, 0) AS ov FROM ar LEFT JOIN dv ON dv.track_id = ar.track_id AND dv.pitch = ar.pitch AND dv.frame = ar.s + d WHERE ar.s + d >= 0),
sm AS (SELECT note_id, round(max(CASE WHEN abs(d) <= 1 THEN ov END), 9) AS peak, round(greatest(0, max(CASE WHEN abs(d) <= 1 THEN ov END) - coalesce(median(CASE WHEN abs(d) > 1 THEN ov END), 0)), 9) AS prominence,
round(greatest(0, max(CASE WHEN d IN (0, 1) THEN fv END) - coalesce(median(CASE WHEN d < 0 THEN fv END), 0)), 9) AS attack,
[round(min(CASE WHEN d BETWEEN -1 AND 1 THEN fv END), 9), round(min(CASE WHEN d BETWEEN -2 AND 1 THEN fv END), 9), round(min(CASE WHEN d BETWEEN -3 AND 1 THEN fv END), 9)] AS still FROM mt GROUP BY 1),
ak AS (SELECT DISTINCT track_id, pitch, s FROM e),
ai AS (SELECT *, s - lag(s) OVER w AS b, lag(s) OVER w - lag(s, 2) OVER w AS p, lead(s) OVER w - s AS f FROM ak WINDOW w AS (PARTITION BY track_id, pitch ORDER BY s)),
rg AS (SELECT track_id, pitch, s, coalesce(abs(p - b) <= greatest(1, round_even(b * 0.2::DOUBLE, 0)), false) OR coalesce(abs(f - b) <= greatest(1, round_even(b * 0.2::DOUBLE, 0)), false) AS regular FROM ai),
sp AS (SELECT a.note_id, max(b.t) AS spanned FROM e a JOIN e b ON a.track_id = b.track_id AND abs(a.pitch - b.pitch) BETWEEN 1 AND 2 AND b.s <= a.s + 1 AND b.t >= a.s - 3 JOIN fl ON fl.note_id = b.note_id GROUP BY 1),
k AS (SELECT e.*, peak, still, coalesce(spanned, -1) AS spanned, prominence < 0.1 AND attack < 0.1 AND NOT ch.y AND NOT regular AS may, row_number() OVER (PARTITION BY e.track_id, e.pitch ORDER BY e.s, e.t, e.note_id) AS i
FROM e JOIN sm USING (note_id) JOIN ch USING (note_id) JOIN rg ON rg.track_id = e.track_id AND rg.pitch = e.pitch AND rg.s = e.s LEFT JOIN sp ON sp.note_id = e.note_id),
f AS (SELECT track_id, pitch, i, note_id, s, t, confidence, note_id AS first_id, t AS reach, peak AS top FROM k WHERE i = 1 UNION ALL
SELECT track_id, pitch, i, note_id, s, t, confidence, CASE WHEN goes THEN was ELSE note_id END, CASE WHEN goes THEN greatest(reach, t) ELSE t END, CASE WHEN goes THEN top ELSE peak END FROM (
SELECT k.track_id, k.pitch, k.i, k.note_id, k.s, k.t, k.confidence, k.peak, f.first_id AS was, f.reach, f.top,
k.may AND k.s - f.reach BETWEEN 0 AND 2 AND (k.peak = 0 OR k.peak < f.top) AND k.still[k.s - f.reach + 1] >= 0.24 AND k.spanned < f.reach - 1 AS goes FROM f JOIN k ON k.track_id = f.track_id AND k.pitch = f.pitch AND k.i = f.i + 1))
SELECT track_id, first_id AS note_id, pitch, max(confidence) AS confidence, min(s) AS start_frame, max(t) AS end_frame, count(*) AS members FROM f GROUP BY 1, 2, 3""")
def merge_gaps_evidence(spark, sf):
    events = written(C.frame_events(notes(spark, sf, 64).withColumns({"confidence": F.col("note_id") % 100 / 100.0, "pitch": 48 + 12 * (F.col("pitch") % 2)})), "merge-events")
    return C.merge_same_pitch(events, _dense(events))
