"""Ordered analytics: sessions, roles, trims and the velocity family, as window functions.

Every order ends in note_id, so results don't depend on how rows are dealt. Whole-table extremes are one-row
aggregates joined back, never a window without a key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .projections import end_ms

TRACK = ("track_id",)


def by_start(*keys: str):
    return Window.partitionBy(*keys).orderBy("start_ms", "note_id")


def phrase_numbers(notes: DataFrame, gap: float = 420.0, on: Sequence[str] = TRACK) -> DataFrame:
    """``phrase``: numbered from 0; a new one starts ``gap`` or more after the latest end of all earlier notes."""
    w = by_start(*on)
    reached = F.max(end_ms()).over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = notes.withColumn("__fresh", F.when(F.col("start_ms") - reached >= gap, 1).otherwise(0))
    return fresh.withColumn("phrase", F.sum("__fresh").over(w)).drop("__fresh")


def event_roles(notes: DataFrame, near: int = 12, low: int = 48, quick: float = 250.0) -> DataFrame:
    """``role``: chord with two or more onsets within ``near``; else bass_riff for a low mean of five rows, rhythm if the next onset comes quickly, melody."""
    onsets = F.count("*").over(Window.partitionBy("track_id").orderBy("start_ms").rangeBetween(-near, near))
    w = by_start("track_id")
    around = F.avg("pitch").over(w.rowsBetween(-2, 2))
    gap = F.lead("start_ms").over(w) - F.col("start_ms")
    return notes.withColumn("role", F.when(onsets >= 2, "chord").when(around < low, "bass_riff").when(gap < quick, "rhythm").otherwise("melody"))


def overlap_trim(notes: DataFrame, gap: float = 1.0, shortest: float = 1.0) -> DataFrame:
    """Same-pitch notes of a track end ``gap`` before the next starts, but last ``shortest``."""
    following = F.lead("start_ms").over(by_start("track_id", "pitch"))
    cut = F.greatest(F.lit(shortest), F.least(F.col("dur_ms"), following - gap - F.col("start_ms")))
    return notes.withColumn("dur_ms", F.when(following.isNull(), F.col("dur_ms")).otherwise(cut))


def drum_timing(notes: DataFrame, longest: float = 80.0) -> DataFrame:
    """One drum hit a (pitch, microsecond, articulation), the loudest, first of ties; capped, and ending 1 ms before the next."""
    at = S.half_even(F.col("start_ms") * 1000).cast("long")
    first = F.row_number().over(Window.partitionBy("track_id", "pitch", at, "ntype").orderBy(F.desc("vel"), "note_id"))
    kept = notes.withColumn("__r", first).filter("__r = 1").drop("__r")
    following = F.lead("start_ms").over(by_start("track_id", "pitch"))
    capped = F.least(F.col("dur_ms"), F.lit(longest))
    return kept.withColumn("dur_ms", F.when(following.isNull(), capped).otherwise(F.greatest(F.lit(1.0), F.least(capped, following - 1 - F.col("start_ms")))))


def gap_fill_legato(notes: DataFrame, most: float = 45.0, least: float = 120.0) -> DataFrame:
    """Notes of at least ``least`` reach the next onset if that is of another pitch and at most ``most`` away."""
    w = by_start("track_id")
    gap = F.lead("start_ms").over(w) - end_ms()
    fill = (F.lead("pitch").over(w) != F.col("pitch")) & (gap > 0) & (gap <= most) & (F.col("dur_ms") >= least)
    return notes.withColumn("dur_ms", F.when(fill, F.lead("start_ms").over(w) - F.col("start_ms")).otherwise(F.col("dur_ms")))


def regular_repeat(notes: DataFrame, tol: float = 12.0) -> DataFrame:
    """Distinct same-pitch onsets whose distances before and after differ by ``tol`` at most."""
    starts = notes.select("track_id", "pitch", "start_ms").distinct()
    w = Window.partitionBy("track_id", "pitch").orderBy("start_ms")
    before, after = F.col("start_ms") - F.lag("start_ms").over(w), F.lead("start_ms").over(w) - F.col("start_ms")
    return starts.withColumn("regular", F.coalesce(F.abs(before - after) <= tol, F.lit(False)))


def motif_repeat(notes: DataFrame, tol: float = 60.0) -> DataFrame:
    """``motif``: the step to the next row repeats the step two rows before, in pitch and, within ``tol``, in time."""
    w = by_start("track_id")
    step, earlier = F.lead("pitch").over(w) - F.col("pitch"), F.lag("pitch", 1).over(w) - F.lag("pitch", 2).over(w)
    time, earlier_time = F.lead("start_ms").over(w) - F.col("start_ms"), F.lag("start_ms", 1).over(w) - F.lag("start_ms", 2).over(w)
    return notes.withColumn("motif", F.coalesce((step == earlier) & (F.abs(time - earlier_time) <= tol), F.lit(False)))


def chord_support(notes: DataFrame, near: int = 2, frame_ms: float = 10.0) -> DataFrame:
    """``supported``: a note of another pitch starts within ``near`` frames."""
    w = Window.partitionBy("track_id").orderBy("frame").rangeBetween(-near, near)
    framed = notes.withColumn("frame", F.floor(F.col("start_ms") / frame_ms))
    return framed.withColumn("supported", F.min("pitch").over(w) != F.max("pitch").over(w)).drop("frame")


def same_onset_expand(notes: DataFrame, selected: Column, near: int = 12) -> DataFrame:
    """Rows within ``near`` of a selected row's onset."""
    w = Window.partitionBy("track_id").orderBy("start_ms").rangeBetween(-near, near)
    return notes.withColumn("__hit", F.max(selected.cast("int")).over(w)).filter("__hit = 1").drop("__hit")


def segment_merge(rows: DataFrame, on: Sequence[str], start: str, end: str, state: Sequence[str], value: str, touch: float = 0.001) -> DataFrame:
    """(*on, *state, start, end, n, mean): runs of consecutive rows of equal state that touch within ``touch``."""
    w = Window.partitionBy(*on).orderBy(start)
    same = F.lit(True)
    for s in state:
        same = same & F.col(s).eqNullSafe(F.lag(s).over(w))
    fresh = F.when(same & (F.abs(F.col(start) - F.lag(end).over(w)) <= touch), 0).otherwise(1)
    runs = rows.withColumn("__fresh", fresh).withColumn("__run", F.sum("__fresh").over(w))
    return runs.groupBy(*on, "__run", *state).agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean")).drop("__run")


def velocity_rescale(notes: DataFrame, low: int = 40, high: int = 110) -> DataFrame:
    """Plain notes (articulation 0) of a track stretched to [low, high]; a flat track goes to the middle."""
    plain = F.when(F.col("ntype") == 0, F.col("vel"))
    w = Window.partitionBy("track_id")
    a, b = F.min(plain).over(w), F.max(plain).over(w)
    new = F.when(a == b, F.lit((low + high) // 2)).otherwise(S.half_even(low + (F.col("vel") - a) * F.lit(float(high - low)) / F.nullif(b - a, F.lit(0))).cast("int"))
    return notes.withColumn("vel", F.when(F.col("ntype") == 0, new).otherwise(F.col("vel")))


def velocity_floor(notes: DataFrame, floor: int = 30) -> DataFrame:
    """A track's velocities multiplied so that the least reaches ``floor``, 127 at most; nothing if it is zero or already there."""
    least = F.min("vel").over(Window.partitionBy("track_id"))
    raised = F.least(F.lit(127), S.half_even(F.col("vel") * F.lit(float(floor)) / F.nullif(least, F.lit(0))).cast("int"))
    return notes.withColumn("vel", F.when((least > 0) & (least < floor), raised).otherwise(F.col("vel")))


def velocity_step(notes: DataFrame, base: int = 40, step: int = 3) -> DataFrame:
    """Each distinct velocity of a track by rank: ``base`` and a ``step`` a rank; the highest is 127."""
    rank = F.dense_rank().over(Window.partitionBy("track_id").orderBy("vel"))
    down = F.dense_rank().over(Window.partitionBy("track_id").orderBy(F.desc("vel")))
    return notes.withColumn("vel", F.when(down == 1, 127).otherwise(F.least(F.lit(127), base + (rank - 1) * step)).cast("int"))


def velocity_layers(notes: DataFrame, palette: Sequence[int] = (30, 60, 90, 120)) -> DataFrame:
    """Each distinct velocity of a track by rank to the palette's entry at the same quantile."""
    rank = F.dense_rank().over(Window.partitionBy("track_id").orderBy("vel")) - 1
    ranked = notes.withColumn("__rank", rank)
    n = F.max("__rank").over(Window.partitionBy("track_id"))
    at = F.when(n == 0, 0).otherwise(S.half_even(F.col("__rank") * F.lit(float(len(palette) - 1)) / F.nullif(n, F.lit(0))))
    return ranked.withColumn("vel", F.element_at(F.array(*map(F.lit, palette)), (at + 1).cast("int"))).drop("__rank")


def velocity_base_map(notes: DataFrame, delta: int = 10, equalize: float = 0.5) -> DataFrame:
    """Moved by ``delta`` and drawn to the middle of the track's range by ``equalize``; halves up, 1 to 127."""
    w = Window.partitionBy("track_id")
    middle = (F.min("vel").over(w) + F.max("vel").over(w)) / 2.0
    return notes.withColumn("vel", S.bounded(S.half_up(F.col("vel") + (middle - F.col("vel")) * equalize + delta).cast("int"), 1, 127))


def velocity_percent(notes: DataFrame, baselines: DataFrame, percent: int) -> DataFrame:
    """Percent of the stored baseline (note_id, baseline), else of the velocity itself; halves up, 127 at most."""
    v = F.coalesce("baseline", "vel")
    return notes.join(baselines, "note_id", "left").withColumn("vel", F.least(F.lit(127), F.floor((v * percent + 50) / 100)).cast("int")).drop("baseline")


def velocity_ramp(notes: DataFrame, low: float = 0.6, high: float = 1.2, shape: str = "linear") -> DataFrame:
    """A gain from ``low`` at the track's first start to ``high`` at its last; shapes linear, in, out, smooth."""
    w = Window.partitionBy("track_id")
    a, b = F.min("start_ms").over(w), F.max("start_ms").over(w)
    x = F.coalesce((F.col("start_ms") - a) / F.nullif(b - a, F.lit(0.0)), F.lit(0.0))
    y = {"linear": x, "in": x * x, "out": 1 - (1 - x) * (1 - x), "smooth": S.smoothstep(x)}[shape]
    return notes.withColumn("vel", S.bounded(S.half_even(F.col("vel") * (low + (high - low) * y)).cast("int"), 1, 127))


def velocity_falloff(notes: DataFrame, centre: float, radius: float, delta: float) -> DataFrame:
    d = F.abs(F.col("start_ms") - centre) / radius
    weight = F.when(d < 1, (1 - d * d) * (1 - d * d)).otherwise(0.0)
    return notes.withColumn("vel", S.bounded(S.half_even(F.col("vel") + delta * weight).cast("int"), 1, 127))


def polish_velocity(notes: DataFrame, beat_ms: float = 500.0) -> DataFrame:
    """Velocity by beat strength, size of the chord at the onset and duration, within 1 to 127."""
    size = F.count("*").over(Window.partitionBy("track_id", S.half_even(F.col("start_ms") / 12)))
    chord = F.when(size >= 4, 0.88).when(size >= 2, 0.94).otherwise(1.0)
    long = F.when(F.col("dur_ms") >= beat_ms, 1.04).otherwise(1.0)
    beat = 0.9 + 0.14 * S.beat_strength(F.col("start_ms"), beat_ms)
    return notes.withColumn("vel", S.bounded(S.half_even(F.col("vel") * beat * chord * long).cast("int"), 1, 127))


def strum(notes: DataFrame, step: float = 8.0) -> DataFrame:
    """Notes of one tenth of a millisecond start one after another by pitch, keep their ends and get softer."""
    rank = F.row_number().over(Window.partitionBy("track_id", S.half_even(F.col("start_ms") * 10)).orderBy("pitch", "note_id")) - 1
    moved = notes.withColumns({"__rank": rank, "__end": end_ms()}).withColumn("start_ms", F.col("start_ms") + F.col("__rank") * step)
    return moved.withColumns({"dur_ms": F.greatest(F.lit(1.0), F.col("__end") - F.col("start_ms")), "vel": F.greatest(F.lit(1), F.col("vel") - F.col("__rank")).cast("int")}).drop("__rank", "__end")


def humanize(notes: DataFrame, seed: int = 7, grid: float = 125.0, vel: int = 4) -> DataFrame:
    """Starts and velocities moved by a hash of the note, evenly within min(12, max(2, 8 % of the grid)) ms and ``vel``: the same rows always move alike."""
    most = min(12.0, max(2.0, 0.08 * grid))

    def unit(salt: int) -> Column:
        h = F.sha2(F.concat_ws(":", F.lit(seed), F.lit(salt), "note_id", "pitch"), 256)
        return F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / float(1 << 32) * 2 - 1

    return notes.withColumns({"start_ms": F.greatest(F.lit(0.0), F.col("start_ms") + unit(0) * most), "vel": S.bounded(F.col("vel") + S.half_even(unit(1) * vel).cast("int"), 1, 127)})


def chunk_split(notes: DataFrame, most: int = 730) -> DataFrame:
    """``chunk``: rows of a track in order, at most ``most`` each."""
    return notes.withColumn("chunk", F.floor((F.row_number().over(by_start("track_id")) - 1) / most))


def pattern_detect(notes: DataFrame) -> DataFrame:
    """(note_id, pattern): legato, staccato, accent, flam and roll by rules over up to four consecutive rows."""
    w = by_start("track_id")
    gap = F.lead("start_ms").over(w) - end_ms()
    ioi = F.lead("start_ms").over(w) - F.col("start_ms")
    mean = F.avg("vel").over(Window.partitionBy("track_id"))
    same = (F.lead("pitch", 1).over(w) == F.col("pitch")) & (F.lead("pitch", 2).over(w) == F.col("pitch")) & (F.lead("pitch", 3).over(w) == F.col("pitch"))
    rules = F.array_compact(F.array(
        F.when(gap.between(-20, 20), F.lit("legato")), F.when(F.col("dur_ms") < 0.5 * ioi, F.lit("staccato")), F.when(F.col("vel") > mean + 30, F.lit("accent")),
        F.when((F.lead("pitch").over(w) == F.col("pitch")) & (ioi <= 45), F.lit("flam")), F.when(same & (F.lead("start_ms", 3).over(w) - F.col("start_ms") <= 500), F.lit("roll")),
    ))
    return notes.select("note_id", rules.alias("p")).select("note_id", F.explode("p").alias("pattern"))
