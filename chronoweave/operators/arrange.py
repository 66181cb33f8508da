"""Arranging intervals on a timeline: orders, merges, boundaries, free places, contours and voices of fragments."""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import aggregates as A
from . import intervals as I
from .blocks import shared_pairs
from .projections import end_ms
from .sequential import over_groups

ORDER = ("start_ms", "pitch", "dur_ms", "vel", "ntype", "note_id")
#: Straight and triplet subdivisions of a beat, and common lengths in beats.
SUBDIVISIONS = tuple(sorted({*(i / 16 for i in range(17)), *(i / 12 for i in range(13))}))
LENGTHS = (0.0625, 1 / 12, 0.125, 1 / 6, 0.25, 1 / 3, 0.5, 2 / 3, 0.75, 1.0, 1.5, 2.0, 3.0, 4.0)


def canonical_sort(notes: DataFrame, on: Sequence[str] = ("track_id",)) -> DataFrame:
    """``notes`` with ``place``, their number in the total order of a track."""
    return notes.withColumn("place", F.row_number().over(Window.partitionBy(*on).orderBy(*ORDER)))


def kway_merge(events: DataFrame, song: str, lane: str, order: str, at: str) -> DataFrame:
    """``events`` with ``place``: lanes of a song merged by time, ties by lane, then the order in it."""
    return events.withColumn("place", F.row_number().over(Window.partitionBy(song).orderBy(at, lane, order)))


def newest(rows: DataFrame, at: str, key: str, n: int) -> DataFrame:
    """The ``n`` newest rows of all, with their place: each task keeps its best ``n``, and only those meet."""
    top = rows.orderBy(F.desc(at), key).limit(n)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc(at), key)))  # n rows


def bucket_cluster(notes: DataFrame, tol: float = 12.0, on: Sequence[str] = ("track_id",)) -> DataFrame:
    """(*on, bucket, n, first_id): notes by their start, rounded to multiples of ``tol``."""
    return notes.groupBy(*on, F.bround(F.col("start_ms") / tol).cast("long").alias("bucket")).agg(F.count("*").alias("n"), F.min("note_id").alias("first_id"))


def bar_position(notes: DataFrame, segments: DataFrame, on: Sequence[str] = ("track_id",)) -> DataFrame:
    """(note_id, beat, phase, distance, fit): where each note lies in its tempo segment, and how near its length is to a common one.

    ``segments`` (*on, start_ms, bpm, beat_at_start); before the first segment the first one holds.
    """
    placed = I.asof(notes.select(*on, "note_id", "start_ms", "dur_ms"), segments.withColumn("from_ms", F.col("start_ms")), "start_ms", on, ("from_ms", "bpm", "beat_at_start"), first_if_none=True)
    beat = F.col("beat_at_start") + (F.col("start_ms") - F.col("from_ms")) * F.col("bpm") / 60000.0
    known = placed.withColumn("beat", F.round(beat, 9)).withColumn("phase", F.round(F.col("beat") - F.floor("beat"), 9))
    nearest = F.array_min(F.transform(F.array(*map(F.lit, SUBDIVISIONS)), lambda s: F.abs(F.col("phase") - s)))
    beats = F.col("dur_ms") * F.col("bpm") / 60000.0
    away = F.array_min(F.transform(F.array(*map(F.lit, LENGTHS)), lambda s: F.abs(beats - s)))
    fit = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - away / F.greatest(F.lit(0.125), beats * 0.25)))
    return known.select("note_id", "beat", "phase", F.round(nearest, 6).alias("distance"), F.round(fit, 6).alias("fit"))


def neighbor_boundary(probes: DataFrame, boundaries: DataFrame, on: Sequence[str] = ("track_id",), eps: float = 1e-6) -> DataFrame:
    """``probes`` (*on, probe_id, at) with ``previous`` and ``next``, the boundaries (*on, at) beside them, the ends where there is none.

    Boundaries are rounded to six places and distinct; those within ``eps`` of the probe are passed over. One union
    and running windows a key, no pairs.
    """
    marks = boundaries.filter((F.col("at") >= 0) & (F.col("at") < float("inf"))).select(*on, (F.floor(F.col("at") * 1e6 + 0.5) / 1e6).alias("at")).distinct()
    none = F.lit(None).cast("double")
    rows = marks.select(*on, F.lit(None).cast("long").alias("probe_id"), F.col("at").alias("mark"), F.col("at").alias("sort"), F.lit(1).alias("ord"))
    low = probes.select(*on, "probe_id", none.alias("mark"), (F.greatest(F.lit(0.0), "at") - eps).alias("sort"), F.lit(0).alias("ord"))
    high = probes.select(*on, "probe_id", none.alias("mark"), (F.greatest(F.lit(0.0), "at") + eps).alias("sort"), F.lit(2).alias("ord"))
    w, every = Window.partitionBy(*on).orderBy("sort", "ord"), Window.partitionBy(*on)
    seen = rows.unionByName(low).unionByName(high).withColumns({
        "previous": F.last("mark", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)),
        "next": F.last("mark", ignorenulls=True).over(Window.partitionBy(*on).orderBy(F.desc("sort"), F.desc("ord")).rowsBetween(Window.unboundedPreceding, 0)),
        "first": F.min("mark").over(every), "last": F.max("mark").over(every),
    }).filter("probe_id IS NOT NULL")
    ends = seen.groupBy(*on, "probe_id").agg(F.max(F.when(F.col("ord") == 0, F.coalesce("previous", "first"))).alias("previous"), F.max(F.when(F.col("ord") == 2, F.coalesce("next", "last"))).alias("next"))
    return probes.join(ends, [*on, "probe_id"])


def marker_normalize(markers: DataFrame, on: Sequence[str], order: str, most: int = 512, longest: float = 86_400_000.0) -> DataFrame:
    """(*on, marker_id, label, time_ms): valid markers, the first of each id, the first ``most`` of a key, times bounded."""
    label = F.trim("label")
    valid = markers.filter((F.trim("marker_id") != "") & (label != "") & F.col("time_ms").isNotNull() & ~F.isnan("time_ms") & (F.abs("time_ms") < float("inf")))
    first = valid.withColumn("__i", F.row_number().over(Window.partitionBy(*on, "marker_id").orderBy(order))).filter("__i = 1")
    kept = first.withColumn("__i", F.row_number().over(Window.partitionBy(*on).orderBy(order))).filter(F.col("__i") <= most)
    return kept.select(*on, "marker_id", label.alias("label"), F.least(F.greatest("time_ms", F.lit(0.0)), F.lit(longest)).alias("time_ms"))


def overview_contour(notes: DataFrame, beat_ms: float = 500.0, step: float = 7.0, on: Sequence[str] = ("track_id",)) -> DataFrame:
    """(*on, start_ms, end_ms, start_pitch, end_pitch, confidence): a contour of weighted points, one in each half beat of a phrase.

    A phrase ends where a note starts late after the end of the one before it; its buckets are counted from its first
    note. Steps of more than ``step`` semitones are left out; a phrase of one point is a level line over its notes.
    """
    bucket_ms, gap = max(90.0, beat_ms * 0.5), max(80.0, min(220.0, beat_ms * 0.35))
    w = Window.partitionBy(*on).orderBy("start_ms", "note_id")
    fresh = F.when(F.col("start_ms") - F.lag(end_ms()).over(w) <= gap, 0).otherwise(1)
    cut = notes.withColumns({"end_ms": end_ms(), "phrase": fresh}).withColumn("phrase", F.sum("phrase").over(w))
    anchored = cut.withColumn("anchor", F.min("start_ms").over(Window.partitionBy(*on, "phrase")))
    weight = 0.25 + F.col("confidence")
    points = anchored.groupBy(*on, "phrase", F.floor((F.col("start_ms") - F.col("anchor")) / bucket_ms).alias("bucket")).agg(
        F.round(F.sum(F.col("start_ms") * weight) / F.sum(weight), 9).alias("at"), F.round(F.sum(F.col("pitch") * weight) / F.sum(weight), 6).alias("pitch"),
        F.round(F.avg("confidence"), 6).alias("confidence"), F.min("start_ms").alias("low"), F.max("end_ms").alias("high"),
    )
    inside = Window.partitionBy(*on, "phrase")
    linked = points.withColumns({"n": F.count("*").over(inside), **{f"{c}_next": F.lead(c).over(inside.orderBy("bucket")) for c in ("at", "pitch", "confidence")}})
    alone = linked.filter("n = 1").select(*on, F.col("low").alias("start_ms"), F.col("high").alias("end_ms"), F.col("pitch").alias("start_pitch"), F.col("pitch").alias("end_pitch"), "confidence")
    steps = linked.filter((F.col("n") > 1) & (F.abs(F.col("pitch") - F.col("pitch_next")) <= step))
    return alone.unionByName(steps.select(*on, F.col("at").alias("start_ms"), F.col("at_next").alias("end_ms"), F.col("pitch").alias("start_pitch"), F.col("pitch_next").alias("end_pitch"), F.least("confidence", "confidence_next").alias("confidence")))


def predictive_clusters(fragments: DataFrame, gap: float, pitch: int, on: Sequence[str] = ("track_id",)) -> DataFrame:
    """(*on, fragment_id, cluster): runs of fragments (start_ms, end_ms, fragment_id, role, pitches) in which each continues the one just before.

    It does with the same role, a pause of 0 to ``gap`` and a pitch within ``pitch`` of one of the other's. Pitches are
    distinct, so an array holds 128 at most. A cluster has the number of its place in the key.
    """
    w = Window.partitionBy(*on).orderBy("start_ms", "end_ms", "fragment_id")
    before = {c: F.lag(c).over(w) for c in ("role", "end_ms", "pitches")}
    known = fragments.withColumns({f"{c}_before": v for c, v in before.items()})
    pause = F.col("start_ms") - F.col("end_ms_before")
    close = F.exists("pitches", lambda p: F.exists("pitches_before", lambda q: F.abs(p - q) <= pitch))
    goes_on = F.coalesce((F.col("role") == F.col("role_before")) & pause.between(0, gap) & close, F.lit(False))
    return known.withColumn("fresh", F.when(goes_on, 0).otherwise(1)).select(*on, "fragment_id", F.sum("fresh").over(w).alias("cluster"))


def free_slot(wanted: DataFrame, occupied: DataFrame, on: Sequence[str] = ("track_id",)) -> DataFrame:
    """(*on, clip_id, start_ms): each wanted clip (clip_id, start_ms, dur_ms) at the place nearest to its own where it overlaps no occupied one.

    ``occupied`` (start_ms, end_ms) don't overlap within a key; what they leave free from zero on are gaps, the last
    without end. Clips are placed apart from each other, ties go to the smaller start, and clips without length stay.
    Clips come by falling length and meet the gaps that hold them in one sorted list, so the nearest is a search. Ends
    and sums are compared as they are, never differences made of them: a clip that just fits is not lost to rounding.
    """
    rows = occupied.select(*on, F.lit(-1).cast("long").alias("clip_id"), "start_ms", "end_ms", F.lit(0.0).alias("dur_ms")).unionByName(
        wanted.select(*on, F.col("clip_id").cast("long"), F.greatest(F.lit(0.0), "start_ms").alias("start_ms"), F.greatest(F.lit(0.0), "dur_ms").alias("dur_ms")).withColumn("end_ms", F.col("start_ms") + F.col("dur_ms"))
    )

    def solve(g: dict) -> tuple:
        there = g["clip_id"] < 0
        start, end, length = (g[c] for c in ("start_ms", "end_ms", "dur_ms"))
        low, high = np.r_[0.0, end[there]], np.r_[start[there], np.inf]  # gap k ends where interval k starts
        slack = 4 * np.spacing(end.max())
        by_size = np.argsort(low - high, kind="stable").tolist()
        last = np.searchsorted(start[there], end) - 1  # of the intervals that start before the clip ends
        out, roomy, taken = start.copy(), [], 0
        for i in sorted(np.flatnonzero(~there & (length > 0)).tolist(), key=lambda i: -length[i]):
            long = length[i]
            while taken < len(by_size) and high[k := by_size[taken]] - low[k] >= long - slack:
                insort(roomy, k)
                taken += 1
            if last[i] < 0 or low[last[i] + 1] <= start[i]:
                continue
            at = bisect_right(roomy, last[i])
            right = next(low[roomy[j]] for j in range(at, len(roomy)) if low[roomy[j]] + long <= high[roomy[j]])
            left = next((high[roomy[j]] - long for j in range(at - 1, -1, -1) if high[roomy[j]] - low[roomy[j]] >= long), None)
            out[i] = left if left is not None and left >= 0 and abs(left - start[i]) <= abs(right - start[i]) else right
        return *(g[k][~there] for k in on), g["clip_id"][~there], out[~there]

    types = dict(wanted.dtypes)
    return over_groups(rows, on, ["clip_id", "end_ms", "dur_ms"], ["start_ms", "clip_id"], solve, ", ".join([*(f"{k} {types[k]}" for k in on), "clip_id long, start_ms double"]))


def clip_controls(controls: DataFrame, clips: DataFrame, width: float) -> DataFrame:
    """(track_id, control_id, clip_id, at_ms): point events in a clip's content and its window, shifted with it; one event may be in several clips."""
    window = clips.select("track_id", "clip_id", "content_start_ms", "content_end_ms", "offset_ms", (F.col("clip_start_ms") - F.col("offset_ms")).alias("from_ms"), (F.col("clip_end_ms") - F.col("offset_ms")).alias("to_ms"))
    bounded = window.withColumns({"low": F.greatest("content_start_ms", "from_ms"), "high": F.least("content_end_ms", "to_ms")}).filter("low < high")
    pairs = I.range_join(controls.select("track_id", "control_id", F.col("at_ms").alias("own_ms")), bounded, ("own_ms", "own_ms"), ("low", "high"), width, ("track_id",), F.col("own_ms") < F.col("high"))
    return pairs.select("track_id", "control_id", "clip_id", (F.col("own_ms") + F.col("offset_ms")).alias("at_ms"))


def merge_report(a: DataFrame, b: DataFrame, on: Sequence[str] = ("pair",), most: int = 730) -> DataFrame:
    """A row a key: counts of both sides and together, strictly overlapping pairs, those of one pitch, exact duplicates, common regions and their length, the peak, chunks.

    Pairs are counted by sweeps, not made.
    """
    keys = list(on)
    counts = a.groupBy(*keys).agg(F.count("*").alias("n_a")).join(b.groupBy(*keys).agg(F.count("*").alias("n_b")), keys, "full").fillna(0)
    pairs = I.overlap_count(a, b, on).withColumnRenamed("pairs", "overlap_pairs")
    same = I.overlap_count(a, b, (*on, "pitch")).groupBy(*keys).agg(F.sum("pairs").alias("same_pitch_pairs"))
    fields = [*keys, "pitch", "vel", "start_ms", "dur_ms", "ntype"]
    times = [df.groupBy(*fields).agg(F.count("*").alias(n)) for df, n in ((a, "ca"), (b, "cb"))]
    exact = times[0].join(times[1], fields).groupBy(*keys).agg(F.sum(F.least("ca", "cb")).alias("exact_duplicates"))
    regions = A.sweep_regions(a, b, on).groupBy(*keys).agg(F.count("*").alias("regions"), F.round(F.sum(F.col("end_ms") - F.col("start_ms")), 6).alias("overlap_ms"))
    peak = A.peak_concurrency(a.unionByName(b), on)
    out = counts
    for part in (pairs, same, exact, regions, peak):
        out = out.join(part, keys, "left")
    return out.fillna(0).withColumns({"n": F.col("n_a") + F.col("n_b"), "chunks": F.greatest(F.lit(1).cast("long"), F.ceil((F.col("n_a") + F.col("n_b")) / most))})


def nearest_level(value: Column, levels: Sequence[float]) -> Column:
    """The level nearest to ``value``, the first of ties."""
    return F.array_min(F.transform(F.array(*map(F.lit, levels)), lambda x: F.struct(F.abs(value - x).alias("away"), x.alias("level"))))["level"]


def effect_rules(notes: DataFrame, levels: Sequence[float] = (0.0, 15.0, 30.0, 45.0, 60.0), on: Sequence[str] = ("track_id",)) -> DataFrame:
    """(*on, density, long_ratio, reverb, delay): allowed effect levels from notes a second and the share of long notes."""
    span = F.greatest(F.lit(1.0), F.max(end_ms()) - F.min("start_ms"))
    stats = notes.groupBy(*on).agg(F.round(F.count("*") * 1000.0 / span, 6).alias("density"), F.round(F.avg(F.when(F.col("dur_ms") >= 60.0, 1.0).otherwise(0.0)), 6).alias("long_ratio"))
    return stats.withColumns({"reverb": nearest_level(F.round(60.0 * F.col("long_ratio"), 6), levels), "delay": nearest_level(F.round(45.0 / (1 + F.col("density")), 6), levels)})


def suggestions(notes: DataFrame, top: int = 3, on: str = "song") -> DataFrame:
    """(song, place, code, priority): the ``top`` suggestions of each song: many low tracks, rhythms that coincide in one register, bass off the drums.

    Tracks meet block by block, in products of their onset buckets of 24 ms; only tracks whose mean pitch differs by
    less than an octave count as one register. A block's pairs leave one number.
    """
    tracks = notes.groupBy(on, "track_id").agg(F.avg("pitch").alias("mean"), F.countDistinct(F.floor(F.col("start_ms") / 24.0)).alias("onsets"))
    low = tracks.filter("mean < 58").groupBy(on).agg(F.count("*").alias("n")).filter("n >= 3").select(on, F.lit("low_tracks").alias("code"), F.col("n").cast("double").alias("priority"))
    onsets = notes.select(on, "track_id", F.floor(F.col("start_ms") / 24.0).alias("bucket")).distinct()

    def finish(p: dict) -> tuple:
        near = np.abs(np.subtract(*p["mean"])) < 12
        return (np.max(p["shared"] / np.minimum(*p["onsets"]), where=near, initial=0.0, keepdims=True),)

    close = shared_pairs(onsets, tracks, [on], finish, "ratio double")
    rhythm = close.groupBy(on).agg(F.round(F.max("ratio"), 6).alias("priority")).filter("priority > 0").select(on, F.lit("rhythm_overlap").alias("code"), "priority")
    drums = notes.filter("ntype = 99").select(on, F.floor(F.col("start_ms") / 45.0).alias("bucket")).distinct()
    bass = notes.filter("ntype != 99 AND pitch < 48").select(on, F.explode(F.array(*(F.floor(F.col("start_ms") / 45.0) + d for d in (-1, 0, 1)))).alias("bucket"), "note_id")
    met = bass.join(drums, [on, "bucket"], "left_semi").select(on, "note_id").distinct().groupBy(on).agg(F.count("*").alias("met"))
    off = notes.filter("ntype != 99 AND pitch < 48").groupBy(on).agg(F.count("*").alias("n")).join(met, on, "left").select(on, F.lit("bass_off_drums").alias("code"), F.round(1 - F.coalesce("met", F.lit(0)) / F.col("n"), 6).alias("priority")).filter("priority > 0")
    place = F.row_number().over(Window.partitionBy(on).orderBy(F.desc("priority"), "code"))
    return low.unionByName(rhythm).unionByName(off).withColumn("place", place).filter(F.col("place") <= top)
