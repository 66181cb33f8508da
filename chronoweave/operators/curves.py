"""Level curves over time: shape-preserving envelopes, their reduction to few points, onsets refined by evidence."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import intervals as I
from .walks import join_keys, over_groups


def envelope_slopes(points: DataFrame, on: Sequence[str] = ("track_id",)) -> DataFrame:
    """``points`` (*on, at, level) with ``slope``, and ``next_at``, ``next_level`` and ``next_slope`` of the point after: a cubic that never overshoots.

    Inner slopes are weighted harmonic means, zero at local extremes; end slopes are bounded; two points make a line.
    """
    w = Window.partitionBy(*on).orderBy("at")
    width, delta = F.lead("at").over(w) - F.col("at"), (F.lead("level").over(w) - F.col("level")) / (F.lead("at").over(w) - F.col("at"))
    known = points.withColumns({"w": width, "d": delta})
    lagged = {f"{c}{-k}" if k < 0 else f"{c}_{k}": (F.lag(c, k) if k > 0 else F.lead(c, -k)).over(w) for c in "wd" for k in (1, 2, -1)}
    known = known.withColumns(lagged)  # w_1 is the width before, w1 the width after the own one

    def end(w0: Column, w1: Column, d0: Column, d1: Column) -> Column:
        slope = ((2 * w0 + w1) * d0 - w0 * d1) / (w0 + w1)
        steep = (d0 * d1 < 0) & (F.abs(slope) > F.abs(3 * d0))
        return F.when(slope * d0 <= 0, 0.0).when(steep, 3 * d0).otherwise(slope)

    before, after = 2 * F.col("w") + F.col("w_1"), F.col("w") + 2 * F.col("w_1")
    inner = F.when(F.col("d_1") * F.col("d") > 0, (before + after) / (before / F.col("d_1") + after / F.col("d"))).otherwise(0.0)
    first = F.when(F.col("w1").isNull(), F.col("d")).otherwise(end(F.col("w"), F.col("w1"), F.col("d"), F.col("d1")))
    last = F.when(F.col("w_2").isNull(), F.col("d_1")).otherwise(end(F.col("w_1"), F.col("w_2"), F.col("d_1"), F.col("d_2")))
    slope = F.when(F.col("w_1").isNull(), first).when(F.col("w").isNull(), last).otherwise(inner)
    sloped = known.select(*on, "at", "level", F.coalesce(slope, F.lit(0.0)).alias("slope"))
    return sloped.withColumns({f"next_{c}": F.lead(c).over(w) for c in ("at", "level", "slope")})


def velocity_envelope(notes: DataFrame, points: DataFrame, on: Sequence[str] = ("track_id",)) -> DataFrame:
    """(note_id, vel): each onset group is scaled so that its mean velocity lies on the envelope through ``points`` (*on, at in 0 to 1, level).

    Groups are starts rounded to a thousandth; 0 and 1 are the key's first and last start; levels hold beyond the ends.
    """
    edges = notes.groupBy(*on).agg(F.min("start_ms").alias("lo"), F.max("start_ms").alias("hi"))
    onset = (F.floor(F.col("start_ms") * 1000 + 0.5) / 1000).alias("onset")
    groups = notes.groupBy(*on, onset).agg(F.avg("vel").alias("mean")).join(edges, list(on))
    placed = groups.withColumn("at", F.when(F.col("hi") > F.col("lo"), F.least(F.greatest((F.col("onset") - F.col("lo")) / (F.col("hi") - F.col("lo")), F.lit(0.0)), F.lit(1.0))).otherwise(0.0))
    sloped = envelope_slopes(points, on).withColumn("point_at", F.col("at"))
    met = I.asof(placed, sloped, "at", on, ("point_at", "level", "slope", "next_at", "next_level", "next_slope"), first_if_none=True, width=0.05)
    h = F.col("next_at") - F.col("point_at")
    s = F.greatest(F.lit(0.0), F.col("at") - F.col("point_at")) / h
    cubic = (2 * s * s * s - 3 * s * s + 1) * F.col("level") + (s * s * s - 2 * s * s + s) * h * F.col("slope") + (3 * s * s - 2 * s * s * s) * F.col("next_level") + (s * s * s - s * s) * h * F.col("next_slope")
    target = met.select(*on, "onset", "mean", F.round(F.when(F.col("next_at").isNull(), F.col("level")).otherwise(cubic), 9).alias("target"))
    scaled = notes.withColumn("onset", onset).join(target, [*on, "onset"])
    vel = F.when(F.col("mean") <= 0, F.col("target")).otherwise(F.round(F.col("vel") * F.col("target") / F.col("mean"), 6))
    return scaled.select("note_id", F.least(F.greatest(S.half_even(vel).cast("int"), F.lit(0)), F.lit(127)).alias("vel"))


def envelope_simplify(points: DataFrame, most: int = 64, tol: float = 1.5, on: str = "track_id") -> DataFrame:
    """(track_id, at, level): the points that keep a polyline within ``tol`` of all ``points``, the worst first, ``most`` at most.

    The worst point of each span is kept beside it, so a chosen point costs a pass over its own span.
    """

    def solve(g: dict) -> tuple:
        at, level = g["at"], g["level"]
        n = len(at)
        if n <= max(2, most):
            return g[on], at, level

        def worst(a: int, b: int) -> tuple[float, int, int, int]:
            if b - a < 2:
                return (0.0, -1, a, b)
            own = np.arange(a + 1, b)
            line = level[a] + (level[b] - level[a]) * ((at[own] - at[a]) / max(1e-9, at[b] - at[a]))
            error = np.abs(level[own] - line)
            k = int(error.argmax())
            return (float(error[k]), int(own[k]), a, b)

        spans, chosen = [worst(0, n - 1)], {0, n - 1}
        while len(chosen) < max(2, most):
            i = max(range(len(spans)), key=lambda k: (spans[k][0], -spans[k][1]))
            error, k, a, b = spans[i]
            if k < 0 or error <= tol:
                break
            chosen.add(k)
            spans[i : i + 1] = [worst(a, k), worst(k, b)]
        own = np.array(sorted(chosen))
        return g[on][own], at[own], level[own]

    return over_groups(points, [on], ["level"], ["at"], solve, f"{on} long, at double, level double")


def onset_refine(notes: DataFrame, evidence: DataFrame, frame_ms: float = 10.0, radius: int = 3, least: float = 0.3, most_shift: float = 30.0) -> DataFrame:
    """(note_id, start_ms, support): each start moved to the frame of strongest onset evidence of its pitch within ``radius`` frames, if it is strong and near enough.

    ``evidence`` (track_id, pitch, frame, value) has a row where there is any; frames are explored by equality, the
    earliest of equal ones is taken.
    """
    centre = F.ceil(F.col("start_ms") / frame_ms)
    near = notes.select("track_id", "note_id", "pitch", "start_ms", F.explode(F.sequence(centre - radius, centre + radius)).alias("frame"))
    met = join_keys(near, evidence, ["track_id", "pitch", "frame"], "left").groupBy("note_id").agg(F.any_value("start_ms").alias("raw"), F.max(F.struct(F.coalesce("value", F.lit(0.0)).alias("value"), (-F.col("frame")).alias("back"))).alias("best"))
    moved = -F.col("best.back") * frame_ms
    good = (F.col("best.value") >= least) & (F.abs(moved - F.col("raw")) <= most_shift)
    return met.select("note_id", F.when(good, moved).otherwise(F.col("raw")).alias("start_ms"), F.col("best.value").alias("support"))


def tempo_estimate(notes: DataFrame, frame_ms: float = 10.0, slowest: float = 30.0, fastest: float = 300.0, typical: float = 120.0, spread: float = 0.9, least: float = 0.1, on: Sequence[str] = ("track_id",)) -> DataFrame:
    """(*on, bpm, score, phase_ms): the beat whose lag the onsets repeat at, weighted by a log-normal prior around ``typical``; null bpm below ``least``.

    The autocorrelation is a self-join of onset frames at each lag between the two tempos, a constant number of rows a
    frame; the phase is the remainder by the beat that holds most onsets.
    """
    low, high = round(60000.0 / fastest / frame_ms), round(60000.0 / slowest / frame_ms)
    frames = notes.groupBy(*on, F.floor(F.col("start_ms") / frame_ms).alias("frame")).agg(F.count("*").alias("x"))
    energy = frames.groupBy(*on).agg(F.sum(F.col("x") * F.col("x")).alias("energy"))
    shifted = frames.select(*on, F.explode(F.sequence(F.lit(low), F.lit(high))).alias("lag"), (F.col("frame")).alias("at"), F.col("x").alias("y")).select(*on, "lag", (F.col("at") + F.col("lag")).alias("frame"), "y")
    both = shifted.join(frames, [*on, "frame"]).groupBy(*on, "lag").agg(F.sum(F.col("x") * F.col("y")).alias("c"))
    bpm = 60000.0 / (F.col("lag") * frame_ms)
    prior = F.exp(-0.5 * F.pow(F.log2(bpm / typical) / spread, F.lit(2.0)))
    scored = both.join(energy, list(on)).withColumns({"bpm": F.round(bpm, 6), "score": F.round(F.col("c") / F.col("energy") * prior, 9)})
    best = scored.groupBy(*on).agg(F.max(F.struct("score", (-F.col("lag")).alias("short"), "bpm")).alias("b"))
    phases = frames.join(best, list(on)).groupBy(*on, F.pmod(F.col("frame"), -F.col("b.short")).alias("phase")).agg(F.sum("x").alias("x"))
    phase = phases.groupBy(*on).agg(F.max(F.struct("x", (-F.col("phase")).alias("back"))).alias("p"))
    known = energy.join(best, list(on), "left").join(phase, list(on), "left")
    sure = F.col("b.score") >= least
    return known.select(*on, F.when(sure, F.col("b.bpm")).alias("bpm"), F.coalesce("b.score", F.lit(0.0)).alias("score"), F.when(sure, -F.col("p.back") * frame_ms).alias("phase_ms"))
