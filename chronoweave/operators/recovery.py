"""Short notes that a decoder left out of dense regular runs, and how far notes crowd each other."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..shared import written
from .projections import end_ms
from .walks import join_keys, over_groups

#: Frames of a short note at least, of a gap between peaks at most, and how much gaps may differ.
LEAST_FRAMES, MOST_GAP, REGULAR = 2, 8, 0.35
#: What is added to the thresholds of onsets (within bounds) and frames, and the weights of a note's confidence.
STRONGER, STRONG_BOUNDS, SUPPORT, SUPPORT_BOUND, ONSET_WEIGHT, FRAME_WEIGHT = 0.12, (0.68, 0.92), 0.08, 0.95, 0.55, 0.45
#: Sounding notes from which a place counts as dense, the load that does too, and the distance of onsets that compete.
MOST_ACTIVE, DENSE_LOAD, ONSET_MS = 64, 2.5, 35.0
PLACES = 9


def dense_peaks(onsets: DataFrame, strong: float, on: Sequence[str] = ("track_id",)) -> DataFrame:
    """(*on, frame, frames): frames where the strongest onset of all pitches peaks, within three peaks at regular short distances, and the key's last frame of all plus one.

    ``onsets`` (*on, frame, onset_value) has every onset of ``strong`` or more, and a row at each key's last frame;
    weaker ones change no peak.
    """
    keys = list(on)
    w = Window.partitionBy(*keys).orderBy("frame")
    top = onsets.groupBy(*keys, "frame").agg(F.max("onset_value").alias("top"))
    beside = lambda side, d: F.when(side("frame").over(w) == F.col("frame") + d, side("top").over(w)).otherwise(0.0)
    told = top.withColumns({"before": beside(F.lag, -1), "after": beside(F.lead, 1), "frames": F.max("frame").over(Window.partitionBy(*keys)) + 1})
    peaks = told.filter((F.col("top") >= strong) & (F.col("top") >= F.col("before")) & (F.col("top") >= F.col("after")))
    gaps = {f"g{i}": F.lag("frame", i).over(w) - F.lag("frame", i + 1).over(w) if i >= 0 else F.lead("frame", -i).over(w) - (F.lead("frame", -i - 1).over(w) if i < -1 else F.col("frame")) for i in (-2, -1, 1)}
    near = peaks.withColumns({**gaps, "g0": F.col("frame") - F.lag("frame").over(w)})

    def regular(a: str, b: str):
        x, y = F.col(a), F.col(b)
        tol = F.greatest(F.lit(1), S.half_even(F.greatest(x, y) * REGULAR))
        return F.coalesce(x.between(LEAST_FRAMES, MOST_GAP) & y.between(LEAST_FRAMES, MOST_GAP) & (F.abs(x - y) <= tol), F.lit(False))

    return near.filter(regular("g-1", "g-2") | regular("g0", "g-1") | regular("g1", "g0")).select(*keys, "frame", "frames")


def followed(rows: Column, start: Column, strong: float, frame_threshold: float) -> Column:
    """How a note from ``start`` goes on over ``rows`` (frame, frame_value, onset_value), the later ones of its pitch in order: struct<k, weak, inside, before, span, total>.

    ``span`` is where a strong onset or a second weak frame ends it, null if none does, and ``total`` the frame values
    inside. Up to there ``k`` is the last row's distance, ``weak`` says whether that is weak, ``inside`` adds up the
    frame values, and ``before`` those without the last row's. Frames without a row are weak if zero is.
    """
    missing = F.lit(0.0 < frame_threshold)

    def step(acc: Column, x: Column) -> Column:
        k = (x["frame"] - start).cast("int")
        gap = k - acc["k"] - 1
        weak, weak_before = x["frame_value"] < frame_threshold, F.when(gap > 0, missing).otherwise(acc["weak"])
        faded = missing & (gap >= F.when(acc["weak"], 1).otherwise(2))
        ends = (x["onset_value"] >= strong) | (weak & weak_before)
        span = F.when(faded, acc["k"] + F.when(acc["weak"], 0).otherwise(1)).when(ends, k - weak_before.cast("int"))
        total = F.when(F.when(faded, acc["weak"]).otherwise((gap == 0) & acc["weak"]), acc["before"]).otherwise(acc["inside"])
        went_on = F.struct(k.alias("k"), weak.alias("weak"), (acc["inside"] + x["frame_value"]).alias("inside"), acc["inside"].alias("before"), span.cast("int").alias("span"), total.alias("total"))
        return F.when(acc["span"].isNotNull(), acc).otherwise(went_on)

    none = F.struct(F.lit(0).alias("k"), F.lit(False).alias("weak"), F.lit(0.0).alias("inside"), F.lit(0.0).alias("before"), F.lit(None).cast("int").alias("span"), F.lit(0.0).alias("total"))
    return F.aggregate(rows, none, step)


def recover_dense(evidence: DataFrame, events: DataFrame, onset_threshold: float = 0.5, frame_threshold: float = 0.3, longest: int = 11, on: Sequence[str] = ("track_id",)) -> DataFrame:
    """(*on, pitch, start_frame, end_frame, confidence): notes that begin at dense peaks with a strong onset of their pitch and no event of it beside.

    ``evidence`` (*on, pitch, frame, frame_value, onset_value) is sparse, with one row a pitch and frame at most: missing
    values are zero, and a key's frames end with its last row. A note lasts until the next strong onset of its pitch,
    less a weak frame just before it, or until two weak frames, the second left out; notes under LEAST_FRAMES or over
    ``longest`` frames, or of low frame values, are none. The evidence is read once, dealt by pitch: a start looks at
    the rows of the ``longest`` frames after it, and frames without a row cost nothing. After that only strong onsets
    move, to their peaks and back to their pitch.
    """
    keys, longest = list(on), max(LEAST_FRAMES, longest)
    strong = max(STRONG_BOUNDS[0], min(STRONG_BOUNDS[1], onset_threshold + STRONGER))
    own = [*keys, "pitch"]
    w = Window.partitionBy(*own).orderBy("frame")
    after = F.collect_list(F.struct("frame", "frame_value", "onset_value")).over(w.rangeBetween(1, longest))
    heard = evidence.select(*own, "frame", F.coalesce("frame_value", F.lit(0.0)).alias("frame_value"), F.coalesce("onset_value", F.lit(0.0)).alias("onset_value"))
    told = heard.withColumns({"after": after, "last": F.lead("frame").over(w).isNull()}).filter((F.col("onset_value") >= strong) | F.col("last"))
    firm = written(told.withColumn("way", followed(F.col("after"), F.col("frame"), strong, frame_threshold)).select(*own, "frame", "frame_value", "onset_value", "way.*"), "dense-starts")
    starts = join_keys(firm.filter(F.col("onset_value") >= strong), dense_peaks(firm, strong, on).filter("frames >= 5"), [*keys, "frame"])
    # behind a pitch's last row come weak frames, as far as the key has any
    tail = F.col("k") + F.when(F.col("weak"), 0).otherwise(1)
    fades = F.lit(0.0 < frame_threshold) & (tail < longest) & (F.col("frame") + tail + 1 < F.col("frames"))
    past = F.least(F.col("frames") - F.col("frame"), F.lit(longest + 1))
    total = F.when(F.col("span").isNotNull(), F.col("total")).when(fades & F.col("weak"), F.col("before")).otherwise(F.col("inside"))
    known = starts.withColumns({"total": total, "span": F.coalesce("span", F.when(fades, tail).otherwise(past))}).filter(F.col("span").between(LEAST_FRAMES, longest))
    known = known.withColumn("support", F.round((F.col("frame_value") + F.col("total")) / F.col("span"), PLACES)).filter(F.col("support") >= min(SUPPORT_BOUND, frame_threshold + SUPPORT))
    confidence = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ONSET_WEIGHT * F.col("onset_value") + FRAME_WEIGHT * F.col("support"))), PLACES)
    sure = known.select(*own, F.col("frame").alias("start_frame"), (F.col("frame") + F.col("span")).alias("end_frame"), confidence.alias("confidence"))
    # events of the pitch take part for their places; two peaks side by side belong to two runs: the later one gives way
    there = events.select(*own, F.col("start_frame").cast("long").alias("start_frame")).distinct()
    begun = Window.partitionBy(*own).orderBy("start_frame")
    free = sure.unionByName(there, allowMissingColumns=True).withColumn("there", F.max(F.col("end_frame").isNull()).over(begun.rangeBetween(-1, 1))).filter("NOT there")
    beside = F.coalesce(F.lag("start_frame").over(begun) == F.col("start_frame") - 1, F.lit(False))
    return free.withColumn("beside", beside).filter("NOT beside").select(*own, "start_frame", "end_frame", "confidence")


def crowding(notes: DataFrame, most: int = MOST_ACTIVE, near: float = ONSET_MS, load: float = DENSE_LOAD, on: Sequence[str] = ("track_id",)) -> DataFrame:
    """(note_id, overlap_load, onset_competitors, dense): how much of a note other pitches cover, and how many begin with it.

    Notes come by start, then id. One that meets ``most`` sounding notes or more is dense and counts no overlaps; the
    first such note marks those that sound then, too, and a load of ``load`` is dense as well. A key is cut where
    nothing sounds; a step looks at fewer than ``most`` notes, so no pairs are made. Rows without start or length take
    no part.
    """
    w = Window.partitionBy(*on).orderBy("start_ms", "note_id")
    reached = F.max("end_ms").over(w.rowsBetween(Window.unboundedPreceding, -1))
    sound = notes.dropna(subset=["start_ms", "dur_ms"]).withColumn("end_ms", end_ms())
    parts = sound.withColumn("fresh", F.when(F.col("start_ms") < reached, 0).otherwise(1)).withColumn("part", F.sum("fresh").over(w))

    def solve(g: dict) -> tuple:
        start, end, pitch = g["start_ms"], g["end_ms"], g["pitch"]
        n = len(start)
        total, rivals, dense = np.zeros(n), np.zeros(n, np.int64), np.zeros(n, bool)
        active, saturated = np.zeros(0, np.int64), False
        for i in range(n):
            active = active[end[active] > start[i]]
            if len(active) >= most:
                dense[i] = True
                if not saturated:
                    dense[active] = saturated = True
            else:
                saturated = False
                other = active[pitch[active] != pitch[i]]
                both = np.minimum(end[other], end[i]) - start[i]
                other, both = other[both > 0], both[both > 0]
                if len(other):
                    total[other] += np.minimum(1.0, both / (end[other] - start[other]))
                    total[i] += np.minimum(1.0, both / (end[i] - start[i])).sum()
                    close = other[start[i] - start[other] <= near]
                    rivals[close] += 1
                    rivals[i] += len(close)
            active = np.append(active, i)
        total = np.round(total, 6)
        return g["note_id"], total, rivals, dense | (total >= load)

    return over_groups(parts, [*on, "part"], ["end_ms", "pitch"], ["start_ms", "note_id"], solve, "note_id long, overlap_load double, onset_competitors long, dense boolean", nullable=["pitch"])
