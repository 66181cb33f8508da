"""Cleaning up detected events: contexts that speak for a short event, flags, and what is then hidden.

Events are notes in frames: track_id, note_id, pitch, confidence, start_frame, end_frame (exclusive). Support by other
events is counted, not paired: per pitch, those that began early enough less those that ended too early.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..shared import written
from .runs import running_maxima
from .sequential import nms
from .walks import join_keys, over_groups

#: Longest spans, in frames, of severe and review fragments and of those that count for density.
SEVERE, REVIEW, DENSITY = 6, 8, 11
#: Reach of the contexts in frames and semitones.
SEQUENCE_GAP, SEQUENCE_PITCH, FLICKER_GAP, FLICKER_PITCH, CHORD_RADIUS = 8, 12, 1, 2, 2
#: What hides a severe fragment: confidence, frame support and onset below these.
LEAST_CONFIDENCE, LEAST_SUPPORT, STRONG_ONSET, WEAK_PROMINENCE = 0.30, 0.35, 0.5, 0.10
#: Longest gap, in frames, over which events merge, frames of evidence around a start, and the frame value that goes on
#: (at least 0.18, or 0.80 of the threshold of frames, 0.3).
MERGE_GAP, AROUND, CONTINUITY = 2, 3, max(0.18, 0.80 * 0.3)


def frame_events(notes: DataFrame, frame_ms: float = 10.0) -> DataFrame:
    """Notes as frame events of one frame at least; ``confidence`` is taken from the caller's column."""
    start = F.floor(F.col("start_ms") / frame_ms)
    end = F.greatest(start + 1, F.floor((F.col("start_ms") + F.col("dur_ms")) / frame_ms))
    return notes.select("track_id", "note_id", "pitch", "confidence", start.alias("start_frame"), end.alias("end_frame"))


def sequence_support(events: DataFrame, gap: int = SEQUENCE_GAP, pitch: int = SEQUENCE_PITCH) -> DataFrame:
    """(note_id, supported): another event within ``pitch`` semitones comes within ``gap`` frames of this one's span.

    Events of a pitch and frame are counted, and the counts dealt to the pitches that they support, where they are
    summed before they leave their task; one running count a pitch then answers all.
    """
    near = F.explode(F.sequence(F.col("pitch") - pitch, F.col("pitch") + pitch))

    def dealt(at: str) -> DataFrame:
        counts = events.select("track_id", "pitch", F.col(at).alias("at")).repartition("track_id", "at").groupBy("track_id", "pitch", "at").agg(F.count("*").alias("n"))
        return counts.select("track_id", near.alias("pitch"), "at", "n").groupBy("track_id", "pitch", "at").agg(F.sum("n").alias("n"))

    none = F.lit(None).cast("long")
    # at equal frames a start still counts for the question after it, an end doesn't yet for the one before it
    starts = dealt("start_frame").select("track_id", "pitch", "at", F.lit(0).alias("ord"), F.col("n").alias("d"), none.alias("note_id"))
    ends = dealt("end_frame").select("track_id", "pitch", "at", F.lit(2).alias("ord"), (-F.col("n")).alias("d"), none.alias("note_id"))
    begun = events.select("track_id", "pitch", (F.col("end_frame") + gap).alias("at"), F.lit(1).alias("ord"), F.lit(0).alias("d"), F.col("note_id"))
    gone = events.select("track_id", "pitch", (F.col("start_frame") - gap).alias("at"), F.lit(1).alias("ord"), F.lit(0).alias("d"), F.col("note_id"))
    w = Window.partitionBy("track_id", "pitch").orderBy("at", "ord")
    asked = starts.unionByName(begun).withColumn("n", F.sum("d").over(w)).filter("note_id IS NOT NULL").select("note_id", "n")
    less = ends.unionByName(gone).withColumn("n", F.sum("d").over(w)).filter("note_id IS NOT NULL").select("note_id", F.coalesce("n", F.lit(0)).alias("n"))
    return asked.unionByName(less).groupBy("note_id").agg((F.sum("n") > 1).alias("supported"))  # itself is one


def pitch_flicker(events: DataFrame, gap: int = FLICKER_GAP, pitch: int = FLICKER_PITCH, longest: int = REVIEW, width: float | None = None) -> DataFrame:
    """(note_id) of short events with a neighbour, one or ``pitch`` semitones away and two frames longer at least, within ``gap`` frames.

    Of the neighbours long enough that begin in time, the one that ends last tells; that is a running maximum for each
    length of a short event. Lengths are not negative; ``width`` forces buckets of time.
    """
    span, none = F.col("end_frame") - F.col("start_frame"), F.lit(None).cast("long")
    short = events.filter(span <= longest).select("track_id", F.explode(F.array(*(F.col("pitch") + d for d in range(-pitch, pitch + 1) if d))).alias("pitch"), (F.col("end_frame") + gap).alias("at"), F.lit(1).alias("ord"), "note_id", (F.col("start_frame") - gap).alias("low"), span.alias("span"), none.alias("to"))
    other = events.filter(span >= 2).select("track_id", "pitch", F.col("start_frame").alias("at"), F.lit(0).alias("ord"), none.alias("note_id"), none.alias("low"), span.alias("span"), F.col("end_frame").alias("to"))
    ends = {f"end_{n}": F.when(F.col("span") >= n + 2, F.col("to")) for n in range(longest + 1)}
    met = running_maxima(short.unionByName(other), ["track_id", "pitch"], "at", ["ord"], ends, width).filter("ord = 1")
    return met.filter(reduce(lambda a, n: a | ((F.col("span") == n) & (F.col(f"end_{n}") >= F.col("low"))), range(longest + 1), F.lit(False))).select("note_id").distinct()


def chord_supported(events: DataFrame, radius: int = CHORD_RADIUS) -> DataFrame:
    """(note_id, supported): an event of another pitch starts within ``radius`` frames; frames look around, not events."""
    w = Window.partitionBy("track_id").orderBy("start_frame").rangeBetween(-radius, radius)
    frames = events.groupBy("track_id", "start_frame").agg(F.min("pitch").alias("low"), F.max("pitch").alias("high"))
    known = frames.select("track_id", "start_frame", (F.min("low").over(w) != F.max("high").over(w)).alias("supported"))
    return join_keys(events.select("track_id", "start_frame", "note_id"), known, ["track_id", "start_frame"]).select("note_id", "supported")


def spanned_by(events: DataFrame, spans: DataFrame, width: float | None = None) -> DataFrame:
    """(note_id, spanned): the latest end of ``spans`` (track_id, pitch, f_from, f_to) of an event's pitch that reach what lies about its start, where there is one; a running maximum."""
    none = F.lit(None).cast("long")
    asked = events.select("track_id", "pitch", (F.col("start_frame") + FLICKER_GAP).alias("at"), F.lit(1).alias("ord"), "note_id", (F.col("start_frame") - MERGE_GAP - FLICKER_GAP).alias("low"), none.alias("to"))
    given = spans.select("track_id", "pitch", F.col("f_from").alias("at"), F.lit(0).alias("ord"), none.alias("note_id"), none.alias("low"), F.col("f_to").alias("to"))
    met = running_maxima(asked.unionByName(given), ["track_id", "pitch"], "at", ["ord"], {"spanned": F.col("to")}, width)
    return met.filter("ord = 1 AND spanned >= low").select("note_id", "spanned")


def regular_repeats(events: DataFrame, ratio: float = 0.20, least: int = 1) -> DataFrame:
    """(track_id, pitch, start_frame) of same-pitch onsets whose distance before is, within a tolerance, that after or the one before it; first and last never are."""
    starts = events.select("track_id", "pitch", "start_frame").distinct()
    w = Window.partitionBy("track_id", "pitch").orderBy("start_frame")
    before, after = F.col("start_frame") - F.lag("start_frame").over(w), F.lead("start_frame").over(w) - F.col("start_frame")
    earlier = F.lag("start_frame").over(w) - F.lag("start_frame", 2).over(w)
    known = starts.withColumns({"before": before, "after": after, "earlier": earlier})
    tol = F.greatest(F.lit(least), S.half_even(F.col("before") * ratio))
    hit = (F.abs(F.col("after") - F.col("before")) <= tol) | F.coalesce(F.abs(F.col("earlier") - F.col("before")) <= tol, F.lit(False))
    return known.filter("before IS NOT NULL AND after IS NOT NULL").filter(hit).select("track_id", "pitch", "start_frame")


def fragment_flags(events: DataFrame) -> DataFrame:
    """``events`` with ``flags``, an array in fixed order: how short the event is, and which contexts speak for it."""
    span = F.col("end_frame") - F.col("start_frame")
    repeats = regular_repeats(events).withColumn("regular", F.lit(True))
    flicker = pitch_flicker(events).withColumn("flicker", F.lit(True))
    chord = chord_supported(events).withColumnRenamed("supported", "chord")
    sequence = sequence_support(events).withColumnRenamed("supported", "sequence")
    known = events.join(flicker, "note_id", "left").join(chord, "note_id").join(sequence, "note_id").join(repeats, ["track_id", "pitch", "start_frame"], "left")
    names = {
        "severe_fragment": span <= SEVERE, "review_fragment": span <= REVIEW, "short_density": span <= DENSITY,
        "pitch_flicker": F.col("flicker"), "chord_supported": F.col("chord"), "sequence_supported": F.col("sequence"), "regular_repeat": F.col("regular"),
    }
    return known.withColumn("flags", F.array_compact(F.array(*(F.when(c, n) for n, c in names.items())))).select(*events.columns, "flags")


def clean_suppress(flagged: DataFrame, evidence: DataFrame) -> DataFrame:
    """``flagged`` with ``hidden``: severe fragments of low confidence that no context, onset or frame evidence speaks for.

    ``evidence`` (track_id, pitch, frame, frame_value, onset_value) has a row where a frame has any; missing values are
    zero. A severe fragment has six frames at most, so its frames are exploded and meet the evidence by equality. The
    onset counts within a frame of the start, its prominence against the mean of the three frames around.
    """
    excused = F.arrays_overlap("flags", F.array(*map(F.lit, ("chord_supported", "pitch_flicker", "regular_repeat", "sequence_supported"))))
    asked = flagged.filter(F.array_contains("flags", "severe_fragment") & (F.col("confidence") < LEAST_CONFIDENCE) & ~excused)
    frames = asked.select("track_id", "pitch", "note_id", "start_frame", "end_frame", F.explode(F.sequence(F.col("start_frame") - 3, F.greatest(F.col("end_frame") - 1, F.col("start_frame") + 3))).alias("frame"))
    met = frames.join(evidence, ["track_id", "pitch", "frame"], "left").fillna(0.0, ["frame_value", "onset_value"])
    inside = F.col("frame") >= F.col("start_frame")
    near = F.abs(F.col("frame") - F.col("start_frame"))
    sums = met.groupBy("note_id").agg(
        (F.sum(F.when(inside & (F.col("frame") < F.col("end_frame")), F.col("frame_value")).otherwise(0.0)) / F.max(F.col("end_frame") - F.col("start_frame"))).alias("support"),
        F.max(F.when(near <= 1, F.col("onset_value"))).alias("peak"),
        F.avg(F.when(near <= 3, F.col("onset_value"))).alias("around"),
    )
    weak = (F.round(F.col("peak"), 9) < STRONG_ONSET) & (F.round(F.col("peak") - F.col("around"), 9) < WEAK_PROMINENCE) & (F.round(F.col("support"), 9) < LEAST_SUPPORT)
    return flagged.join(sums.filter(weak).select("note_id", F.lit(True).alias("hidden")), "note_id", "left").withColumn("hidden", F.coalesce("hidden", F.lit(False)))


def event_evidence(events: DataFrame, evidence: DataFrame) -> DataFrame:
    """``events`` with what the evidence around their start says, from three frames before it to three after.

    ``peak`` is the onset within a frame, ``prominence`` by how much it exceeds the median of the two frames beyond on
    either side, ``attack`` by how much the frame value of the first two frames exceeds the median of the three before;
    ``still_0`` to ``still_2`` are the least frame values from the last frame of a note that ended so many frames
    before, to the second of this one. Frames without a row of ``evidence`` are zero, those before the first don't count.
    """
    around = events.select("track_id", "pitch", "note_id", F.explode(F.sequence(F.lit(-AROUND), F.lit(AROUND))).alias("d"), "start_frame").withColumn("frame", F.col("start_frame") + F.col("d")).filter("frame >= 0")
    met = join_keys(around, evidence.select("track_id", "pitch", "frame", "frame_value", "onset_value"), ["track_id", "pitch", "frame"], "left").fillna(0.0, ["frame_value", "onset_value"])
    d, frame, onset = F.col("d"), F.col("frame_value"), F.col("onset_value")
    above = lambda top, base: F.round(F.greatest(F.lit(0.0), top - F.coalesce(base, F.lit(0.0))), 9)
    peak = F.max(F.when(F.abs(d) <= 1, onset))
    sums = met.groupBy("note_id").agg(
        F.round(peak, 9).alias("peak"), above(peak, F.median(F.when(F.abs(d) > 1, onset))).alias("prominence"), above(F.max(F.when(d.isin(0, 1), frame)), F.median(F.when(d < 0, frame))).alias("attack"),
        *(F.round(F.min(F.when(d.between(-g - 1, 1), frame)), 9).alias(f"still_{g}") for g in range(MERGE_GAP + 1)),
    )
    return events.join(sums, "note_id")


def merged_into(events: DataFrame, evidence: DataFrame, continuity: float = CONTINUITY) -> DataFrame:
    """(note_id, first_id): the first event of the one that each event is merged into, its own where it isn't.

    Events of a pitch are taken by start, end and id. One goes on what is before it if it begins 0 to 2 frames after
    its latest end, the frame evidence between them doesn't fall below ``continuity``, no short neighbour of another
    pitch spans the gap, and it is no attack of its own: its onset is weak and lower than that of the first, its frame
    value doesn't rise, no chord begins with it and it doesn't go on a regular repetition. Only rows without a gap
    before them depend on each other; those are walked.
    """
    known = event_evidence(events, evidence).join(chord_supported(events), "note_id")
    key = ["track_id", "pitch"]
    attacks = Window.partitionBy(*key).orderBy("start_frame")
    distinct = events.select(*key, "start_frame").distinct()
    before = F.col("start_frame") - F.lag("start_frame").over(attacks)
    sides = (F.lag("start_frame").over(attacks) - F.lag("start_frame", 2).over(attacks), F.lead("start_frame").over(attacks) - F.col("start_frame"))
    timed = distinct.withColumns({"before": before, "earlier": sides[0], "after": sides[1]})
    near = lambda c: F.coalesce(F.abs(F.col(c) - F.col("before")) <= F.greatest(F.lit(1), S.half_even(F.col("before") * 0.20)), F.lit(False))
    known = join_keys(known, timed.select(*key, "start_frame", (near("earlier") | near("after")).alias("regular")), [*key, "start_frame"])
    short = events.join(pitch_flicker(events), "note_id", "left_semi")
    spans = short.select("track_id", F.explode(F.array(*(F.col("pitch") + k for k in range(-FLICKER_PITCH, FLICKER_PITCH + 1) if k))).alias("pitch"), F.col("start_frame").alias("f_from"), F.col("end_frame").alias("f_to"))
    reach = spanned_by(events, spans)
    known = known.join(reach, "note_id", "left").withColumn("spanned", F.coalesce("spanned", F.lit(-1)))
    may = (F.col("prominence") < WEAK_PROMINENCE) & (F.col("attack") < WEAK_PROMINENCE) & ~F.col("supported") & ~F.col("regular")
    order = Window.partitionBy(*key).orderBy("start_frame", "end_frame", "note_id")
    reached = F.max("end_frame").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(may & F.coalesce(F.col("start_frame") - reached <= MERGE_GAP, F.lit(False)), 0).otherwise(1)
    cut = known.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(order))
    stills = [f"still_{g}" for g in range(MERGE_GAP + 1)]

    def solve(g: dict) -> tuple:
        start, end, peak, spanned, ids = g["start_frame"], g["end_frame"], g["peak"], g["spanned"], g["note_id"]
        first, reach, out = 0, end[0], np.zeros(len(ids), np.int64)
        for i in range(1, len(ids)):
            gap = start[i] - reach
            weaker = peak[i] == 0 or peak[i] < peak[first]
            if 0 <= gap <= MERGE_GAP and weaker and g[stills[gap]][i] >= continuity and spanned[i] < reach - FLICKER_GAP:
                reach = max(reach, end[i])
            else:
                first, reach = i, end[i]
            out[i] = first
        return ids, ids[out]

    return over_groups(cut, [*key, "run"], ["peak", "spanned", *stills], ["start_frame", "end_frame", "note_id"], solve, "note_id long, first_id long")


def merge_same_pitch(events: DataFrame, evidence: DataFrame, continuity: float = CONTINUITY) -> DataFrame:
    """(track_id, note_id, pitch, confidence, start_frame, end_frame, members): ``events`` as merged_into joins them, under the id of their first, with the highest confidence."""
    return _joined(events, merged_into(events, evidence, continuity))


def _joined(events: DataFrame, firsts: DataFrame) -> DataFrame:
    own = events.join(firsts, "note_id")
    return own.groupBy("track_id", F.col("first_id").alias("note_id"), "pitch").agg(F.max("confidence").alias("confidence"), F.min("start_frame").alias("start_frame"), F.max("end_frame").alias("end_frame"), F.count("*").alias("members"))


def cleanup(events: DataFrame, evidence: DataFrame, profile: str = "clean", frame_ms: float = 10.0) -> DataFrame:
    """(note_id, status, by): every event with what the clean-up made of it, and by which event.

    In six steps: an event without length, or with a pitch or confidence out of range, or a missing value, is
    ``invalid``; exact copies are ``duplicate`` of the smallest id; ``suppressed`` go to a more confident one of their
    pitch, ``merged`` ones into what they go on; the rest get flags, and in profile ``clean`` weak severe fragments are
    ``hidden``; all else is ``kept``. Profile ``raw`` takes the first two steps, ``balanced`` hides nothing. The audit
    has a row an event.
    """
    if profile not in ("raw", "balanced", "clean"):
        raise ValueError(f"unknown profile {profile}")
    sound = F.coalesce((F.col("start_frame") >= 0) & (F.col("end_frame") > F.col("start_frame")) & F.col("pitch").between(0, 127) & F.col("confidence").between(0, 1), F.lit(False))
    none = F.lit(None).cast("long").alias("by")
    audit = [events.filter(~sound).select("note_id", F.lit("invalid").alias("status"), none)]
    first = F.min("note_id").over(Window.partitionBy("track_id", "pitch", "start_frame", "end_frame", "confidence"))
    marked = events.filter(sound).withColumn("first", first)
    audit.append(marked.filter("first != note_id").select("note_id", F.lit("duplicate").alias("status"), F.col("first").alias("by")))
    alive = marked.filter("first = note_id").drop("first")
    if profile != "raw":
        timed = alive.withColumns({"start_ms": F.col("start_frame") * frame_ms, "dur_ms": (F.col("end_frame") - F.col("start_frame")) * frame_ms})
        judged = written(nms(timed, 2 * frame_ms), "cleanup-judged")
        audit.append(judged.filter("kept_by != note_id").select("note_id", F.lit("suppressed").alias("status"), F.col("kept_by").alias("by")))
        left = written(alive.join(judged.filter("kept_by = note_id").select("note_id"), "note_id", "left_semi"), "cleanup-left")
        joined = written(merged_into(left, evidence), "cleanup-merged")
        audit.append(joined.filter("first_id != note_id").select("note_id", F.lit("merged").alias("status"), F.col("first_id").alias("by")))
        alive = written(_joined(left, joined).drop("members"), "cleanup-alive")
    status = F.lit("kept")
    if profile == "clean":
        alive = clean_suppress(fragment_flags(alive), evidence)
        status = F.when(F.col("hidden"), "hidden").otherwise("kept")
    audit.append(alive.select("note_id", status.alias("status"), none))
    return reduce(DataFrame.unionByName, audit)
