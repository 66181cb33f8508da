"""Aggregations over intervals: features, sweeps, histograms and scores. Partial sums are made before each shuffle."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .blocks import rounded, shared_pairs
from .projections import end_ms
from .runs import running_sums

#: The steps of the major and the natural minor scale.
MAJOR, MINOR = (0, 2, 4, 5, 7, 9, 11), (0, 2, 3, 5, 7, 8, 10)


def bounds(notes: DataFrame, on: Sequence[str] = ("track_id",)) -> DataFrame:
    return notes.groupBy(*on).agg(F.min("start_ms").alias("start_ms"), F.max(end_ms()).alias("end_ms"))


def concurrency(notes: DataFrame, on: Sequence[str] = ("track_id",), width: float | None = None) -> DataFrame:
    """(*on, at, active): how many notes sound from each boundary on. Ends come before starts, so touching notes don't add up."""
    steps = notes.filter("dur_ms > 0").select(*on, F.explode(F.array(F.struct(F.col("start_ms").alias("at"), F.lit(1).alias("d")), F.struct(end_ms().alias("at"), F.lit(-1).alias("d")))).alias("x"))
    summed = steps.groupBy(*on, F.col("x.at").alias("at")).agg(F.sum("x.d").alias("d"))
    return running_sums(summed, on, "at", (), {"active": F.col("d")}, width).drop("d")


def peak_concurrency(notes: DataFrame, on: Sequence[str] = ("track_id",)) -> DataFrame:
    return concurrency(notes, on).groupBy(*on).agg(F.max("active").alias("peak"))


def sweep_regions(a: DataFrame, b: DataFrame, on: Sequence[str] = ("track_id",), width: float | None = None) -> DataFrame:
    """(*on, start_ms, end_ms): maximal times in which both sides sound, by a sweep over their boundaries."""
    steps = None
    for df, side in ((a, "a"), (b, "b")):
        x = F.explode(F.array(F.struct(F.col("start_ms").alias("at"), F.lit(1).alias("d")), F.struct(end_ms().alias("at"), F.lit(-1).alias("d"))))
        own = df.filter("dur_ms > 0").select(*on, x.alias("x")).select(*on, "x.at", *(F.when(F.lit(side == s), F.col("x.d")).otherwise(0).alias(s) for s in "ab"))
        steps = own if steps is None else steps.unionByName(own)
    w = Window.partitionBy(*on).orderBy("at")
    summed = running_sums(steps.groupBy(*on, "at").agg(F.sum("a").alias("a"), F.sum("b").alias("b")), on, "at", (), {"on_a": F.col("a"), "on_b": F.col("b")}, width)
    active = summed.select(*on, "at", ((F.col("on_a") > 0) & (F.col("on_b") > 0)).alias("both"), F.lead("at").over(w).alias("next"))
    runs = active.withColumn("fresh", F.when(F.col("both") & ~F.coalesce(F.lag("both").over(w), F.lit(False)), 1).otherwise(0)).withColumn("run", F.sum("fresh").over(w))
    return runs.filter("both").groupBy(*on, "run").agg(F.min("at").alias("start_ms"), F.max("next").alias("end_ms")).drop("run")


def key_histogram(notes: DataFrame, least_notes: int = 5, on: Sequence[str] = ("track_id",)) -> DataFrame:
    """(*on, tonic, mode, score): the key whose scale holds most of the duration-weighted pitch classes; ties to the lower tonic, major first."""
    weight = F.greatest(F.lit(1.0), F.least(F.col("dur_ms"), F.lit(1600.0)) / 120)
    classes = notes.groupBy(*on, F.pmod("pitch", F.lit(12)).alias("pc")).agg(F.sum(weight).alias("w"), F.count("*").alias("n"))
    keys = F.explode(F.array(*(F.struct(F.lit(t).alias("tonic"), F.lit(m).alias("mode"), F.array(*(F.lit((t + s) % 12) for s in scale)).alias("scale")) for t in range(12) for m, scale in (("major", MAJOR), ("minor", MINOR)))))
    scored = classes.select(*on, "pc", "w", "n", keys.alias("k")).groupBy(*on, "k.tonic", "k.mode").agg(F.round(F.sum(F.when(F.array_contains("k.scale", F.col("pc")), F.col("w")).otherwise(0)) / F.sum("w"), 6).alias("score"), F.sum("n").alias("n"))
    best = F.min(F.struct((-F.col("score")).alias("s"), "tonic", "mode")).alias("b")
    return scored.filter(F.col("n") >= least_notes).groupBy(*on).agg(best).select(*on, "b.tonic", "b.mode", (-F.col("b.s")).alias("score"))


def track_features(notes: DataFrame, on: Sequence[str] = ("track_id",), short: float = 120.0) -> DataFrame:
    span = F.max(end_ms()) - F.min("start_ms")
    return notes.groupBy(*on).agg(
        F.count("*").alias("n"), F.round(F.avg("pitch"), 9).alias("mean_pitch"), F.round(F.avg("dur_ms"), 9).alias("mean_dur"), F.round(F.avg(F.when(F.col("dur_ms") < short, 1.0).otherwise(0.0)), 6).alias("short_ratio"),
        F.round(F.count_distinct("pitch") / F.count("*"), 6).alias("pitch_ratio"), span.alias("span_ms"), F.round(F.count("*") * 1000.0 / F.nullif(span, F.lit(0.0)), 6).alias("density"),
    )


def velocity_points(notes: DataFrame, on: Sequence[str] = ("track_id",)) -> DataFrame:
    """(*on, at_us, members, mean_vel): notes that start in one microsecond."""
    return notes.groupBy(*on, S.half_even(F.col("start_ms") * 1000).cast("long").alias("at_us")).agg(F.array_sort(F.collect_list("note_id")).alias("members"), F.avg("vel").alias("mean_vel"))


def onset_density_peak(notes: DataFrame, on: Sequence[str] = ("track_id",), ms: float = 1.0) -> DataFrame:
    return notes.groupBy(*on, S.half_even(F.col("start_ms") / ms).alias("at")).count().groupBy(*on).agg(F.max("count").alias("peak"))


def first_seen(rows: DataFrame, value: str, position: str) -> DataFrame:
    """Distinct values in the order they were first seen, numbered from 0 by that order's position column."""
    return rows.groupBy(value).agg(F.min(position).alias("first_at"))


def median_profile(vectors: DataFrame, on: str, order: str, vector: str, most: int = 32) -> DataFrame:
    """(on, dim, median): element-wise medians of the ``most`` rows of smallest ``order`` a key (a top-k feature)."""
    first = vectors.withColumn("__r", F.row_number().over(Window.partitionBy(on).orderBy(order))).filter(F.col("__r") <= most)
    return first.select(on, F.posexplode(vector).alias("dim", "x")).groupBy(on, "dim").agg(F.median(F.col("x").cast("double")).alias("median"))


def voice_stats(notes: DataFrame, on: Sequence[str] = ("track_id",), leap: int = 7) -> DataFrame:
    w = Window.partitionBy(*on).orderBy("start_ms", "note_id")
    step = F.abs(F.col("pitch") - F.lag("pitch").over(w))
    return notes.withColumn("step", step).groupBy(*on).agg(F.median("pitch").alias("median_pitch"), F.round(F.avg("dur_ms"), 6).alias("mean_dur"), F.count_if(F.col("step") > leap).alias("leaps"), F.round(F.avg(F.when(F.col("step") <= 2, 1.0).when(F.col("step") > 2, 0.0)), 6).alias("continuity"))


def role_inference(stats: DataFrame) -> DataFrame:
    """(track_id, role) of track_features rows: bass for the lowest mean pitches, melody for the highest with few short notes, drone for few pitches, else inner. The whole-table extremes are one row."""
    extremes = stats.agg(F.min("mean_pitch").alias("lo"), F.max("mean_pitch").alias("hi"))
    third = (F.col("hi") - F.col("lo")) / 3
    role = F.when(F.col("pitch_ratio") < 0.05, "drone").when(F.col("mean_pitch") < F.col("lo") + third, "bass").when((F.col("mean_pitch") > F.col("hi") - third) & (F.col("short_ratio") < 0.5), "melody").otherwise("inner")
    return stats.crossJoin(F.broadcast(extremes)).select("track_id", role.alias("role"))


def label_majority(votes: DataFrame, on: str, label: str, weight: Column, share: float = 0.5, least: int = 3) -> DataFrame:
    """(on, label, share): the heaviest label where it has ``share`` of the weight and the key ``least`` votes; ties to the smaller label."""
    by_label = votes.groupBy(on, label).agg(F.sum(weight).alias("w"), F.count("*").alias("n"))
    best = by_label.groupBy(on).agg(F.min(F.struct((-F.col("w")).alias("w"), F.col(label).alias("label"))).alias("b"), F.sum("w").alias("all"), F.sum("n").alias("n"))
    out = best.select(on, F.col("b.label").alias(label), F.round(-F.col("b.w") / F.col("all"), 6).alias("share"), "n")
    return out.filter((F.col("share") >= share) & (F.col("n") >= least)).drop("n")


def prf_metrics(rows: DataFrame, truth: Column, guess: Column, on: Sequence[Column] = ()) -> DataFrame:
    """Precision, recall and F1; empty denominators count as 1."""
    both, g, t = F.count_if(truth & guess), F.count_if(guess), F.count_if(truth)
    p, r = both / F.greatest(F.lit(1), g), both / F.greatest(F.lit(1), t)
    out = rows.groupBy(*on).agg(both.alias("matched"), F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(2.0 * both / F.greatest(F.lit(1), g + t), 6).alias("f1"))
    return out


def coverage_report(rows: DataFrame, on: str, status: str, values: Sequence[str]) -> DataFrame:
    """A column of counts for each status; the values are given, so no extra pass finds them."""
    return rows.groupBy(on).agg(*(F.count_if(F.col(status) == v).alias(v) for v in values))


def readiness_score(issues: DataFrame, on: str, penalty: Column) -> DataFrame:
    return issues.groupBy(on).agg(F.greatest(F.lit(0), 100 - F.sum(penalty)).cast("long").alias("score"))


def style_syncopation(notes: DataFrame, beat_ms: float = 500.0, on: Sequence[str] = ("track_id",)) -> DataFrame:
    """(*on, off_grid, swing): the share of distinct starts farther than 0.07 beat from a quarter of it; the mean long-to-short ratio of neighbouring gaps, if in 1.25 to 3.2 and within 1.15 beats."""
    starts = notes.select(*on, (S.half_even(F.col("start_ms") * 1000) / 1000.0).alias("s")).distinct()
    w = Window.partitionBy(*on).orderBy("s")
    x = F.col("s") / beat_ms * 4
    off = F.abs(x - S.half_even(x)) / 4 > 0.07
    g1, g2 = F.col("s") - F.lag("s").over(w), F.lead("s").over(w) - F.col("s")
    ratio = F.greatest(g1, g2) / F.least(g1, g2)
    marked = starts.withColumns({"off": F.when(off, 1.0).otherwise(0.0), "ratio": F.when((g1 + g2 <= 1.15 * beat_ms) & ratio.between(1.25, 3.2), ratio)})
    return marked.groupBy(*on).agg(F.round(F.avg("off"), 6).alias("off_grid"), F.round(F.avg("ratio"), 6).alias("swing"))


def beat_percentile(notes: DataFrame, beat_ms: float = 500.0, on: Sequence[str] = ("track_id",)) -> DataFrame:
    """(*on, beat, pc, p90): the 90th percentile of velocity a pitch and beat, summed over the octaves of a pitch class."""
    by_pitch = notes.groupBy(*on, F.floor(F.col("start_ms") / beat_ms).alias("beat"), "pitch").agg(F.percentile("vel", 0.9).alias("p"))
    return by_pitch.groupBy(*on, "beat", F.pmod("pitch", F.lit(12)).alias("pc")).agg(F.round(F.sum("p"), 6).alias("p90"))


def triad_scores(notes: DataFrame, beat_ms: float = 2000.0, on: Sequence[str] = ("track_id",)) -> DataFrame:
    """(*on, beat, root, quality, score): the best of 24 triads for the pitch classes of each beat: coverage of the weight, completeness of the triad."""
    shapes = {"major": (0, 4, 7), "minor": (0, 3, 7)}
    pcs = notes.groupBy(*on, F.floor(F.col("start_ms") / beat_ms).alias("beat"), F.pmod("pitch", F.lit(12)).alias("pc")).agg(F.sum("dur_ms").alias("w"))
    triads = F.explode(F.array(*(F.struct(F.lit(r).alias("root"), F.lit(q).alias("quality"), F.array(*(F.lit((r + s) % 12) for s in own)).alias("tones")) for r in range(12) for q, own in shapes.items())))
    inside = F.array_contains("t.tones", F.col("pc"))
    rows = pcs.select(*on, "beat", "pc", "w", triads.alias("t")).groupBy(*on, "beat", "t.root", "t.quality")
    scored = rows.agg(F.round(0.7 * F.sum(F.when(inside, F.col("w")).otherwise(0)) / F.sum("w") + 0.1 * F.count_if(inside), 6).alias("score"))
    return scored.groupBy(*on, "beat").agg(F.min(F.struct((-F.col("score")).alias("s"), "root", "quality")).alias("b")).select(*on, "beat", "b.root", "b.quality", (-F.col("b.s")).alias("score"))


def pairwise_tracks(notes: DataFrame, bucket_ms: float = 24.0) -> DataFrame:
    """(a, b, shared, ratio, registers): tracks that share onset buckets, with the share of the smaller one's buckets and of the smaller pitch range that both cover.

    Tracks meet block by block, in products of their buckets; the result has a row for each pair that shares any.
    """
    onsets = notes.select("track_id", F.floor(F.col("start_ms") / bucket_ms).alias("bucket")).distinct()
    ranges = notes.groupBy("track_id").agg(F.min("pitch").alias("lo"), F.max("pitch").alias("hi"))
    sizes = onsets.groupBy("track_id").agg(F.count("*").alias("n")).join(ranges, "track_id")

    def finish(p: dict) -> tuple:
        (lo_a, lo_b), (hi_a, hi_b) = p["lo"], p["hi"]
        both = np.fmax(0, np.fmin(hi_a, hi_b) - np.fmax(lo_a, lo_b)) / np.fmax(1, np.fmin(hi_a - lo_a, hi_b - lo_b))
        return p["a"], p["b"], p["shared"], rounded(p["shared"] / np.minimum(*p["n"])), rounded(both)

    return shared_pairs(onsets, sizes, (), finish, f"a {dict(notes.dtypes)['track_id']}, b {dict(notes.dtypes)['track_id']}, shared long, ratio double, registers double")
