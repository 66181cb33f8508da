"""Harmony: chroma of windows, scores of chord and key states, decisions a beat. States are fixed literal tables, so all is row-wise expressions over aggregates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .aggregates import MAJOR, MINOR
from .folds import anchor_cluster
from .intervals import range_join
from .projections import end_ms
from .walks import join_keys

#: The chord qualities with their tones above the root, in the order of ties.
QUALITIES = {
    "major": (0, 4, 7),
    "minor": (0, 3, 7),
    "dim": (0, 3, 6),
    "sus2": (0, 2, 7),
    "sus4": (0, 5, 7),
    "maj7": (0, 4, 7, 11),
    "7": (0, 4, 7, 10),
    "min7": (0, 3, 7, 10),
    "half_diminished7": (0, 3, 6, 10),
}
#: Qualities of a sounding set, the first whose tones are all there is taken.
WINDOW_QUALITIES = {
    "major7": (0, 4, 7, 11),
    "dominant7": (0, 4, 7, 10),
    "minor7": (0, 3, 7, 10),
    "half_diminished7": (0, 3, 6, 10),
    "major": (0, 4, 7),
    "minor": (0, 3, 7),
    "diminished": (0, 3, 6),
    "sus4": (0, 5, 7),
}
#: Weights of the sources, and thresholds of a decision.
SOURCES = {"audio": 0.55, "candidates": 0.20, "notes": 0.25}
ACTIVE = 0.18
LEAST_SCORE, LEAST_MARGIN, CONFLICT_MARGIN = 0.60, 0.035, 0.08
#: Scores are rounded to so many places before they are ranked: sums in another order then give the same ties.
PLACES = 9


def harmony_windows(notes: DataFrame, tol: float = 12.0, width: float = 500.0, on: Sequence[str] = ("track_id",)) -> DataFrame:
    """(*on, start_ms, pcs, root, quality): the pitch classes that sound ``tol`` after each onset cluster, and the first chord they hold.

    Roots are tried from the lowest sounding note on, then upwards; fewer than three classes have no chord.
    """
    anchors = anchor_cluster(notes, tol, on).select(*on, F.col("anchor_ms").alias("start_ms")).distinct()
    probes = anchors.select(*on, F.col("start_ms").alias("anchor_ms"), (F.col("start_ms") + tol).alias("probe"))
    sounding = notes.select(*on, "pitch", "start_ms", end_ms().alias("end_ms")).filter("end_ms > start_ms")
    pairs = range_join(probes, sounding, ("probe", "probe"), ("start_ms", "end_ms"), width, on, F.col("end_ms") > F.col("probe"))
    held = pairs.groupBy(*on, F.col("anchor_ms").alias("start_ms")).agg(F.array_sort(F.collect_set(F.pmod("pitch", F.lit(12)))).alias("pcs"), F.pmod(F.min("pitch"), F.lit(12)).alias("bass"))
    full = join_keys(anchors, held, [*on, "start_ms"], "left").withColumn("pcs", F.coalesce("pcs", F.array().cast("array<int>")))
    shapes = F.array(*(F.struct(F.lit(q).alias("quality"), F.array(*map(F.lit, own)).alias("tones")) for q, own in WINDOW_QUALITIES.items()))
    roots = F.concat(F.array("bass"), F.array_remove("pcs", F.col("bass")))

    def chord(root):
        return F.transform(shapes, lambda s: F.when(F.forall(s["tones"], lambda t: F.array_contains(F.col("pcs"), F.pmod(root + t, F.lit(12)))), F.struct(root.alias("root"), s["quality"].alias("quality"))))

    found = F.get(F.array_compact(F.flatten(F.transform(roots, chord))), 0)
    return full.withColumn("chord", F.when(F.size("pcs") >= 3, found)).select(*on, "start_ms", "pcs", F.col("chord.root").alias("root"), F.col("chord.quality").alias("quality"))


def chord_classify(notes: DataFrame, tol: float = 12.0, on: Sequence[str] = ("track_id",)) -> DataFrame:
    """(*on, anchor_ms, n, triad): ``major`` or ``minor`` for onset clusters of three notes or more that hold such a triad, major first."""
    clustered = join_keys(anchor_cluster(notes, tol, on), notes.select(*on, "note_id", "pitch"), [*on, "note_id"])
    groups = clustered.groupBy(*on, "anchor_ms").agg(F.count("*").alias("n"), F.collect_set(F.pmod("pitch", F.lit(12))).alias("pcs"))

    def holds(third):
        return F.exists("pcs", lambda root: F.array_contains(F.col("pcs"), F.pmod(root + third, F.lit(12))) & F.array_contains(F.col("pcs"), F.pmod(root + 7, F.lit(12))))

    return groups.select(*on, "anchor_ms", "n", F.when(F.col("n") < 3, F.lit(None)).when(holds(4), "major").when(holds(3), "minor").alias("triad"))


def chroma(notes: DataFrame, weight: Column, beat_ms: float, on: Sequence[str] = ("track_id",)) -> DataFrame:
    """(*on, beat, chroma, bass): weights of the twelve pitch classes a beat, the largest 1, and the class of its lowest pitch."""
    beat = F.floor(F.col("start_ms") / beat_ms).alias("beat")
    sums = (F.coalesce(F.sum(F.when(F.pmod("pitch", F.lit(12)) == pc, weight)), F.lit(0.0)) for pc in range(12))
    found = notes.groupBy(*on, beat).agg(F.array(*sums).alias("raw"), F.pmod(F.min("pitch"), F.lit(12)).alias("bass"))
    return found.select(*on, "beat", normal("raw").alias("chroma"), "bass")


def normal(values: str) -> Column:
    """``values`` over their largest; all zero if that is."""
    return F.transform(values, lambda x: F.round(F.coalesce(F.try_divide(x, F.array_max(values)), F.lit(0.0)), PLACES))


def states() -> Column:
    """The 108 chord states as array<struct<root, rank, quality, tones>>, by root, then order of qualities."""
    return F.array(*(F.struct(F.lit(r).alias("root"), F.lit(i).alias("rank"), F.lit(q).alias("quality"), F.array(*(F.lit((r + t) % 12) for t in own)).alias("tones")) for r in range(12) for i, (q, own) in enumerate(QUALITIES.items())))


def state_scores(values: Column, bass: Column) -> Column:
    """array<struct<root, rank, quality, score>> over the states for one chroma; null where fewer than three classes are active.

    A state's score blends the share of weight on its tones, the share of its tones that are active, its root's weight
    and the bass, less the share of active classes that it lacks and a little for four tones; without enough of its
    tones it stays low.
    """
    active = F.transform(values, lambda x: F.when(x >= ACTIVE, 1.0).otherwise(0.0))

    def total(items):
        return F.aggregate(items, F.lit(0.0), lambda a, x: a + x)

    def score(s):
        inside = total(F.transform(s["tones"], lambda t: F.get(active, t)))
        complete = inside / F.size(s["tones"])
        bass_fit = F.when(s["root"] == bass, 1.0).when(F.array_contains(s["tones"], bass), 0.42).otherwise(0.0)
        raw = 0.52 * total(F.transform(s["tones"], lambda t: F.get(values, t))) / total(values) + 0.28 * complete + 0.12 * F.get(values, s["root"]) + 0.08 * bass_fit
        raw = raw - 0.10 * (total(active) - inside) / total(active) - F.when(F.size(s["tones"]) == 4, 0.018).otherwise(0.0)
        bounded = F.least(F.greatest(F.when(complete < 0.74, F.least(raw, F.lit(0.56))).otherwise(raw), F.lit(0.0)), F.lit(1.0))
        return F.struct(s["root"].alias("root"), s["rank"].alias("rank"), s["quality"].alias("quality"), F.round(bounded, PLACES).alias("score"))

    return F.when(total(active) >= 3, F.transform(states(), score))


def ranked(scores: Column) -> Column:
    """State scores with the best first; ties by root, then order of qualities."""
    return F.array_sort(F.transform(scores, lambda s: F.struct((-s["score"]).alias("down"), s["root"].alias("root"), s["rank"].alias("rank"), s["quality"].alias("quality"), s["score"].alias("score"))))


def chord_scores(notes: DataFrame, beat_ms: float = 2000.0, on: Sequence[str] = ("track_id",)) -> DataFrame:
    """(*on, beat, root, quality, score, margin): the best of the 108 states for each beat with three active classes, and its lead."""
    scored = chroma(notes, F.col("dur_ms"), beat_ms, on).withColumn("ranked", ranked(state_scores(F.col("chroma"), F.col("bass")))).filter("ranked IS NOT NULL")
    best, second = F.get("ranked", 0), F.get("ranked", 1)
    return scored.select(*on, "beat", best["root"].alias("root"), best["quality"].alias("quality"), best["score"].alias("score"), F.round(best["score"] - second["score"], PLACES).alias("margin"))


def beat_decide(sources: Mapping[str, DataFrame], on: Sequence[str] = ("track_id",)) -> DataFrame:
    """(*on, beat, root, quality, confidence, margin, conflicts, source, emissions) from the chroma of each source of SOURCES.

    Scores of sources with three active classes are averaged by weight. A low best score or a small lead decides for
    no chord (quality N, root null); ``conflicts`` names sources that disagree and low leads; ``emissions`` has no chord
    first, then the states, for a decoder.
    """
    both = None
    for name, df in sources.items():
        own = df.select(*on, "beat", F.struct(F.lit(name).alias("name"), F.lit(SOURCES[name]).alias("weight"), state_scores(F.col("chroma"), F.col("bass")).alias("scores")).alias("s"))
        both = own if both is None else both.unionByName(own)
    gathered = both.groupBy(*on, "beat").agg(F.array_sort(F.collect_list("s"), lambda a, b: F.when(a["name"] < b["name"], -1).otherwise(1)).alias("all")).withColumn("live", F.filter("all", lambda s: s["scores"].isNotNull()))
    weight = F.aggregate("live", F.lit(0.0), lambda a, s: a + s["weight"])
    mixed = F.transform(states(), lambda s, i: F.struct(s["root"].alias("root"), s["rank"].alias("rank"), s["quality"].alias("quality"), F.round(F.aggregate("live", F.lit(0.0), lambda a, x: a + x["weight"] * F.get(x["scores"], i)["score"]) / F.col("weight"), PLACES).alias("score")))
    found = gathered.withColumn("weight", weight).withColumn("mixed", F.when(F.size("live") > 0, mixed)).withColumn("ranked", ranked(F.col("mixed")))
    own_best = F.transform("live", lambda s: F.struct(s["name"].alias("name"), F.get(ranked(s["scores"]), 0).alias("best")))
    found = found.withColumn("own", own_best)
    audio = F.get(F.filter("own", lambda s: (s["name"] == "audio") & (s["best"]["score"] >= LEAST_SCORE)), 0)["best"]
    symbolic = F.get(F.array_sort(F.transform(F.filter("own", lambda s: (s["name"] != "audio") & (s["best"]["score"] >= LEAST_SCORE)), lambda s: s["best"])), 0)
    differ = F.coalesce((audio["root"] != symbolic["root"]) | (audio["rank"] != symbolic["rank"]), F.lit(False))
    found = found.withColumns({"best": F.get("ranked", 0), "margin": F.round(F.get("ranked", 0)["score"] - F.get("ranked", 1)["score"], PLACES), "differ": differ})
    closed = F.col("mixed").isNull() | (F.col("best.score") < LEAST_SCORE) | (F.col("margin") < LEAST_MARGIN)
    conflicts = F.array_join(F.array_compact(F.array(F.when(F.col("differ"), "audio_symbolic"), F.when(F.col("margin") < CONFLICT_MARGIN, "low_margin"))), ",")
    confidence = F.when(F.col("mixed").isNull(), 1.0).when(closed, F.greatest(F.lit(0.55), 1 - F.col("margin"))).otherwise(F.col("best.score") * (0.72 + F.least(F.lit(0.28), F.col("margin") * 2.5)))
    source = F.when(F.size("live") > 1, "combined").otherwise(F.coalesce(F.get("live", 0)["name"], F.lit("none")))
    none = F.when(F.col("mixed").isNull(), 1.0).when(closed, F.greatest(F.lit(0.72), F.col("best.score") + 0.06)).otherwise(0.12)
    chords = F.when(F.col("mixed").isNull(), F.array_repeat(F.lit(0.0), 108)).when(closed, F.array_repeat(F.lit(-1e9), 108)).otherwise(F.transform("mixed", lambda s: s["score"]))
    return found.select(
        *on, "beat", F.when(~closed, F.col("best.root")).alias("root"), F.when(closed, "N").otherwise(F.col("best.quality")).alias("quality"), F.round(F.least(F.greatest(confidence, F.lit(0.0)), F.lit(1.0)), 6).alias("confidence"),
        "margin", conflicts.alias("conflicts"), source.alias("source"), F.concat(F.array(F.round(none, PLACES)), chords).alias("emissions"),
    )


def top_alternatives(notes: DataFrame, beat_ms: float = 2000.0, beats: int = 4, keep: int = 2, on: Sequence[str] = ("track_id",)) -> DataFrame:
    """(*on, segment, place, root, quality, bass, confidence): over segments of ``beats``, the ``keep`` states of highest mean among each beat's two best."""
    scored = chroma(notes, F.col("dur_ms"), beat_ms, on).withColumn("x", F.explode(F.slice(ranked(state_scores(F.col("chroma"), F.col("bass"))), 1, 2)))
    means = scored.groupBy(*on, F.floor(F.col("beat") / beats).alias("segment"), "x.root", "x.rank", "x.quality", "bass").agg(F.round(F.avg("x.score"), PLACES).alias("confidence"))
    place = F.row_number().over(Window.partitionBy(*on, "segment").orderBy(F.desc("confidence"), "root", "rank", "bass"))
    return means.withColumn("place", place).filter(F.col("place") <= keep).select(*on, "segment", "place", "root", "quality", "bass", "confidence")


def key_estimate(sources: Mapping[str, DataFrame], on: Sequence[str] = ("track_id",)) -> DataFrame:
    """(*on, tonic, mode, confidence, alternatives, source) from pitch-class weights (*on, pc, w) of each source of SOURCES.

    Each source is scaled to its largest class and counts by its weight if five classes are active. A key's score
    blends coverage of its scale with the weights of root, fifth and third; a low best score or lead leaves the key open.
    """
    both = None
    for name, df in sources.items():
        sums = df.groupBy(*on).agg(F.array(*(F.coalesce(F.sum(F.when(F.col("pc") == pc, F.col("w"))), F.lit(0.0)) for pc in range(12))).alias("raw"))
        own = sums.select(*on, F.struct(F.lit(name).alias("name"), F.lit(SOURCES[name]).alias("weight"), normal("raw").alias("chroma")).alias("s"))
        both = own if both is None else both.unionByName(own)
    gathered = both.groupBy(*on).agg(F.array_sort(F.collect_list("s"), lambda a, b: F.when(a["name"] < b["name"], -1).otherwise(1)).alias("all"))
    live = F.filter("all", lambda s: F.size(F.filter(s["chroma"], lambda x: x >= ACTIVE)) >= 5)
    found = gathered.withColumn("live", live).withColumn("weight", F.aggregate("live", F.lit(0.0), lambda a, s: a + s["weight"]))
    mixed = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda pc: F.aggregate("live", F.lit(0.0), lambda a, s: a + s["weight"] * F.get(s["chroma"], pc)) / F.col("weight"))
    found = found.withColumn("mixed", F.when(F.size("live") > 0, mixed)).withColumns({"top": F.array_max("mixed"), "total": F.aggregate("mixed", F.lit(0.0), lambda a, x: a + x)})
    keys = F.array(*(F.struct(F.lit(t).alias("tonic"), F.lit(m).alias("mode"), F.array(*(F.lit((t + s) % 12) for s in scale)).alias("scale"), F.lit((t + third) % 12).alias("third")) for t in range(12) for m, scale, third in (("major", MAJOR, 4), ("minor", MINOR, 3))))

    def score(k):
        cover = F.aggregate(F.transform(k["scale"], lambda pc: F.get("mixed", pc)), F.lit(0.0), lambda a, x: a + x) / F.col("total")
        raw = 0.62 * cover + (0.18 * F.get("mixed", k["tonic"]) + 0.12 * F.get("mixed", F.pmod(k["tonic"] + 7, F.lit(12))) + 0.08 * F.get("mixed", k["third"])) / F.col("top")
        value = F.round(F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0)), PLACES)
        return F.struct((-value).alias("down"), k["tonic"].alias("tonic"), k["mode"].alias("mode"), value.alias("score"))

    found = found.withColumn("ranked", F.when(F.col("mixed").isNotNull(), F.array_sort(F.transform(keys, score))))
    best = F.get("ranked", 0)
    margin = best["score"] - F.get("ranked", 1)["score"]
    sure = (best["score"] >= 0.62) & (F.round(margin, PLACES) >= 0.015)
    shown = F.array_join(F.transform(F.slice("ranked", 1, 3), lambda k: F.concat_ws(":", k["tonic"], k["mode"])), ",")
    source = F.when(F.size("live") > 1, "combined").otherwise(F.coalesce(F.get("live", 0)["name"], F.lit("none")))
    confidence = F.coalesce(F.round(F.least(best["score"] * (0.75 + F.least(F.lit(0.25), margin * 3.0)), F.lit(1.0)), 6), F.lit(0.0))
    return found.select(*on, F.when(sure, best["tonic"]).alias("tonic"), F.when(sure, best["mode"]).alias("mode"), confidence.alias("confidence"), F.coalesce(shown, F.lit("")).alias("alternatives"), source.alias("source"))
