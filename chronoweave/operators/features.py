"""Features of tracks and songs, and what follows from them: keys, roles, styles, playing techniques, strata of matches, ranks of guides."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .aggregates import MAJOR, MINOR
from .folds import anchor_cluster
from .projections import end_ms
from .walks import join_keys

#: Scores are rounded to so many places before they are ranked.
PLACES = 9


def song_features(notes: DataFrame, beat_ms: float = 500.0, on: Sequence[str] = ("track_id",), tol: float = 12.0) -> DataFrame:
    """(*on, mean_pitch, density, polyphony, mean_dur, short, variety, pitch_span): notes a beat, the share of onset clusters with several notes, and shares of short notes and distinct pitches."""
    clusters = anchor_cluster(notes, tol, on).groupBy(*on, "anchor_ms").agg(F.count("*").alias("n"))
    many = clusters.groupBy(*on).agg(F.round(F.avg(F.when(F.col("n") > 1, 1.0).otherwise(0.0)), 6).alias("polyphony"))
    own = notes.groupBy(*on).agg(
        F.round(F.avg("pitch"), PLACES).alias("mean_pitch"), F.round(F.count("*") / F.greatest(F.lit(1.0), F.max(end_ms()) / max(1.0, beat_ms)), 6).alias("density"), F.round(F.avg("dur_ms"), PLACES).alias("mean_dur"),
        F.round(F.avg(F.when(F.col("dur_ms") <= beat_ms * 0.35, 1.0).otherwise(0.0)), 6).alias("short"), F.round(F.count_distinct("pitch") / F.count("*"), 6).alias("variety"), (F.max("pitch") - F.min("pitch")).alias("pitch_span"),
    )
    return join_keys(own, many, on)


def key_confidence(notes: DataFrame, least_notes: int = 5, gate: float = 0.72, on: Sequence[str] = ("track_id",)) -> DataFrame:
    """(*on, tonic, mode, confidence): the key whose scale and tonic hold most of the duration-weighted classes; open below ``gate``, ties to the higher tonic, minor first."""
    weight = F.greatest(F.lit(1.0), F.least(F.col("dur_ms"), F.lit(1600.0)) / 120.0)
    sums = notes.groupBy(*on).agg(F.count("*").alias("n"), F.sum(weight).alias("all"), F.array(*(F.coalesce(F.sum(F.when(F.pmod("pitch", F.lit(12)) == pc, weight)), F.lit(0.0)) for pc in range(12))).alias("w"))
    keys = F.array(*(F.struct(F.lit(t).alias("tonic"), F.lit(m).alias("mode"), F.array(*(F.lit((t + s) % 12) for s in scale)).alias("scale")) for t in range(12) for m, scale in (("major", MAJOR), ("minor", MINOR))))

    def score(k):
        inside = F.aggregate(F.transform(k["scale"], lambda pc: F.get("w", pc)), F.lit(0.0), lambda a, x: a + x)
        return F.struct(F.round((inside + 0.18 * F.get("w", k["tonic"])) / F.col("all"), PLACES).alias("score"), k["tonic"].alias("tonic"), k["mode"].alias("mode"))

    best = sums.withColumn("best", F.array_max(F.transform(keys, score)))
    sure = F.when(F.col("n") < least_notes, 0.0).otherwise(F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("best.score") - 0.60) / 0.38)), 6))
    known = best.withColumn("confidence", sure)
    held = F.col("confidence") >= gate
    return known.select(*on, F.when(held, F.col("best.tonic")).alias("tonic"), F.when(held, F.col("best.mode")).alias("mode"), "confidence")


def track_roles(features: DataFrame, song: str, beat_ms: float = 500.0) -> DataFrame:
    """(song, track_id, role) of ``song_features`` rows with ``song`` and ``is_percussion``: by thresholds, and among the rest by rank in their song."""
    plain = (
        F.when(F.col("is_percussion"), "percussion").when((F.col("mean_pitch") < 49) & (F.col("polyphony") < 0.18), "bass").when(F.col("polyphony") >= 0.32, "harmony")
        .when((F.col("mean_dur") >= beat_ms * 1.35) & (F.col("density") <= 1.1), "pad").when((F.col("short") >= 0.68) & (F.col("variety") <= 0.45), "rhythm")
    )
    score = F.round(F.col("mean_pitch") * 0.015 + F.col("variety") + F.least("pitch_span", F.lit(24)) * 0.015 - F.col("polyphony") * 0.8, PLACES)
    scored = features.withColumns({"plain": plain, "score": score})
    place = F.row_number().over(Window.partitionBy(song, F.col("plain").isNull()).orderBy(F.desc("score"), F.desc("track_id")))
    melodic = F.when(F.col("place") == 1, "primary_melody").when(F.col("place") == 2, "secondary_melody").otherwise("ornament")
    return scored.withColumn("place", place).select(song, "track_id", F.coalesce("plain", melodic).alias("role"))


#: Instrument numbers that speak for a style, with their weight.
STYLE_INSTRUMENTS = {"orchestral": ((8, 11, 15, 16, 18, 39, 40), 0.48), "rock": ((36, 37, 38), 0.62), "electronic": ((20, 24, 28, 32), 0.65)}


def style_tags(songs: DataFrame, song: str, keep: int = 3) -> DataFrame:
    """(song, place, style, confidence): the ``keep`` best styles of songs (instruments, roles, off_grid, swing, mean_dur); neutral where nothing speaks for any."""
    has = lambda role: F.array_contains("roles", role)
    parts = {name: F.when(F.arrays_overlap("instruments", F.array(*map(F.lit, own))), F.lit(w)) for name, (own, w) in STYLE_INSTRUMENTS.items()}
    parts |= {
        "rhythm_section": F.when(has("percussion") & has("bass"), F.lit(0.45)), "jazz_swing": F.when(F.col("swing") >= 1.45, F.least(F.lit(0.82), 0.4 + (F.col("swing") - 1.0) * 0.25)),
        "funk": F.when((F.col("off_grid") >= 0.28) & has("bass"), F.least(F.lit(0.78), 0.35 + F.col("off_grid"))), "ambient": F.when(F.col("mean_dur") >= 700, F.lit(0.48)),
    }
    found = F.array_compact(F.array(*(F.when(c.isNotNull(), F.struct((-F.round(c, 6)).alias("down"), F.lit(i).alias("i"), F.lit(n).alias("style"))) for i, (n, c) in enumerate(parts.items()))))
    best = F.slice(F.array_sort(F.when(F.size(found) > 0, found).otherwise(F.array(F.struct(F.lit(-0.5).alias("down"), F.lit(99).alias("i"), F.lit("neutral").alias("style"))))), 1, keep)
    return songs.select(song, F.posexplode(best).alias("at", "x")).select(song, (F.col("at") + 1).alias("place"), "x.style", (-F.col("x.down")).alias("confidence"))


def upper_median(rows: DataFrame, value: str, on: Sequence[str]) -> DataFrame:
    """(*on, median): the value at place n // 2 of its sorted rows, from counts of values, so a hot key is as many rows as it has values."""
    counts = rows.groupBy(*on, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*on)
    upto = counts.withColumns({"upto": F.sum("n").over(w.orderBy(value)), "all": F.sum("n").over(w)})
    return upto.filter(F.col("upto") > F.floor(F.col("all") / 2)).groupBy(*on).agg(F.min(value).alias("median"))


def techniques(notes: DataFrame, beat: float = 500.0, on: Sequence[str] = ("track_id",)) -> DataFrame:
    """(note_id, technique): playing techniques that one to four consecutive notes of a track of the given ``family`` suggest.

    A note is matched with the next three by windows over the track; loudness is against the track's upper median.
    """
    w = Window.partitionBy(*on).orderBy("start_ms", "pitch", "note_id")
    nxt = {f"{c}{i}": F.lead(c, i).over(w) for c in ("start_ms", "pitch") for i in (1, 2, 3)}
    rows = join_keys(notes, upper_median(notes, "vel", on), on).withColumns(nxt)
    family = lambda *names: F.col("family").isin(*names)
    more = F.col("start_ms1").isNotNull()
    gap, ioi = F.coalesce(F.col("start_ms1") - end_ms(), F.lit(beat)), F.coalesce(F.col("start_ms1") - F.col("start_ms"), F.lit(beat))
    rows = rows.withColumns({"gap": gap, "ioi": ioi, "gate": F.col("dur_ms") / F.greatest(F.lit(1.0), ioi)})
    gap, ioi, gate, dur, vel = (F.col(c) for c in ("gap", "ioi", "gate", "dur_ms", "vel"))
    detached = more & (gate <= 0.45) & (gap >= beat * 0.06)
    step = F.col("pitch1") - F.col("pitch")
    steps = [F.col("pitch1") - F.col("pitch"), F.col("pitch2") - F.col("pitch1"), F.col("pitch3") - F.col("pitch2")]
    spaces = [F.col("start_ms1") - F.col("start_ms"), F.col("start_ms2") - F.col("start_ms1"), F.col("start_ms3") - F.col("start_ms2")]
    one_way = F.coalesce((F.least(*steps) >= 1) & (F.greatest(*steps) <= 2) | (F.greatest(*steps) <= -1) & (F.least(*steps) >= -2), F.lit(False)) & F.col("pitch3").isNotNull()
    four = F.array("pitch", "pitch1", "pitch2", "pitch3")
    close = more & gap.between(-20, beat * 0.18) & F.abs(step).between(1, 4)
    soft = ("strings", "wind", "brass", "keys")
    rules: dict[str, Column] = {
        "legato": more & gap.between(-0.08 * beat, 0.06 * beat) & family("strings", "wind", "brass", "synth"),
        "tenuto": more & gate.between(0.78, 0.98) & (gap >= 0) & family(*soft),
        "staccatissimo": detached & (gate <= 0.22) & family(*soft),
        "marcato": (vel >= F.col("median") + 18) & ~family("synth") & detached,
        "accent": (vel >= F.col("median") + 18) & ~family("synth") & ~detached,
        "spiccato": detached & family("strings") & (dur <= beat * 0.28),
        "staccato": detached & family(*soft) & ~(family("strings") & (dur <= beat * 0.28)),
        "hammer_on": close & family("guitar", "bass") & (step > 0),
        "pull_off": close & family("guitar", "bass") & (step < 0),
        "slide": close & family("strings", "wind", "brass"),
        "palm_mute": family("guitar", "bass") & detached & (F.col("pitch") < 64),
        "slap_pop": family("bass") & (dur <= beat * 0.36) & (vel >= 104),
        "ghost_note": family("bass", "drums", "hand_percussion") & (dur <= beat * 0.25) & (vel <= 55),
        "tremolo": family("strings", "synth") & (dur >= beat * 1.7),
        "breath_phrase": family("wind", "brass") & more & (gap >= beat * 0.55),
        "synth_filter_sustain": family("synth") & (dur >= beat * 1.4),
        "harp_gliss": family("harp") & one_way,
        "strum_up": family("guitar") & (F.col("start_ms2") - F.col("start_ms") <= 85) & (steps[0] > 0) & (steps[1] > 0),
        "strum_down": family("guitar") & (F.col("start_ms2") - F.col("start_ms") <= 85) & (steps[0] < 0) & (steps[1] < 0),
        "double_tongue": family("wind", "brass") & F.col("start_ms3").isNotNull() & (F.greatest(*spaces) <= beat * 0.28) & (F.size(F.array_distinct(four)) <= 2),
        "flam": family("drums", "hand_percussion") & more & (step == 0) & (ioi > 0) & (ioi <= 45),
        "roll": family("drums", "hand_percussion") & F.col("start_ms3").isNotNull() & (F.size(F.array_distinct(four)) == 1) & (F.col("start_ms3") - F.col("start_ms") <= beat),
    }
    return rows.select("note_id", F.explode(F.array_compact(F.array(*(F.when(c, n) for n, c in rules.items())))).alias("technique"))


def strata_metrics(truth: DataFrame, guess: DataFrame, pairs: DataFrame, on: Sequence[str] = ()) -> DataFrame:
    """(*on, stratum, truth, guess, matched, precision, recall, f1) for all spans and those of up to 6, up to 8 and 9 to 11 frames; empty denominators are 1.

    ``truth`` and ``guess`` (*on, id, span), ``pairs`` (truth_id, guess_id) one to one; a match belongs to the stratum
    of its truth for recall, and of its guess for precision.
    """
    names = F.explode(F.array_compact(F.array(F.lit("all"), F.when(F.col("span") <= 6, "to_6"), F.when(F.col("span") <= 8, "to_8"), F.when(F.col("span").between(9, 11), "9_to_11")))).alias("stratum")

    def side(rows: DataFrame, own: str, name: str) -> DataFrame:
        hit = rows.join(pairs.select(F.col(own).alias("id"), F.lit(1).alias("hit")), "id", "left")
        return hit.select(*on, names, "hit").groupBy(*on, "stratum").agg(F.count("*").alias(name), F.count("hit").alias(f"hit_{name}"))

    both = side(truth, "truth_id", "truth").join(side(guess, "guess_id", "guess"), [*on, "stratum"], "full").fillna(0)
    p, r = F.col("hit_guess") / F.greatest(F.lit(1), "guess"), F.col("hit_truth") / F.greatest(F.lit(1), "truth")
    return both.select(*on, "stratum", "truth", "guess", F.col("hit_truth").alias("matched"), F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)), 6).alias("f1"))


def guidance_ranks(scores: DataFrame) -> DataFrame:
    """(group_id, place, notes, total): groups by the sum of the scores that each note gives them, of ``guidance_scores`` rows."""
    sums = scores.groupBy("group_id").agg(F.count("*").alias("notes"), F.round(F.sum("score"), 6).alias("total"))
    return sums.withColumn("place", F.row_number().over(Window.orderBy(F.desc("total"), "group_id")))  # a row a group
