"""Queries over boundary decoding, maximum matchings, guide voices and clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..notes import notes
from ..operators import alignment as L
from ..operators import bipartite as B
from ..operators import clustering as K
from ..operators import guides as G
from ..operators import rhythm as R
from .base import query

#: Notes as boundary observations ``o``: lengths, distances and gaps in beats of 500 ms, the rest from the ids.
_OBSERVED = """o AS (SELECT track_id, pitch, note_id, start_ms, note_id * 7 % 101 / 100.0::DOUBLE AS confidence, dur_ms / 500.0::DOUBLE AS beats,
least(start_ms % 125.0, 125.0 - start_ms % 125.0) / 500.0::DOUBLE AS grid_distance, note_id * 13 % 97 / 192.0::DOUBLE AS onset, 0.4::DOUBLE + note_id * 5 % 61 / 100.0::DOUBLE AS continuity,
note_id * 11 % 89 / 88.0::DOUBLE AS contour, CASE WHEN note_id % 9 = 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS chord, CASE WHEN note_id % 4 = 1 THEN 0.6 ELSE 0.1 END::DOUBLE AS voice, note_id * 3 % 71 / 70.0::DOUBLE AS interval_fit,
round((start_ms - lag(start_ms + dur_ms) OVER (PARTITION BY track_id, pitch ORDER BY start_ms, note_id)) / 5000.0::DOUBLE, 6) AS gap, note_id % 8 = 3 AS repeat FROM n)"""


def _observed(spark, sf) -> DataFrame:
    n, w = notes(spark, sf, 8), Window.partitionBy("track_id", "pitch").orderBy("start_ms", "note_id")
    i, phase = F.col("note_id"), F.col("start_ms") % 125.0
    return n.select(
        "track_id", "pitch", "note_id", "start_ms", (i * 7 % 101 / 100.0).alias("confidence"), (F.col("dur_ms") / 500.0).alias("beats"), (F.least(phase, 125.0 - phase) / 500.0).alias("grid_distance"), (i * 13 % 97 / 192.0).alias("onset"),
        (0.4 + i * 5 % 61 / 100.0).alias("continuity"), (i * 11 % 89 / 88.0).alias("contour"), F.when(i % 9 == 0, 0.5).otherwise(0.0).alias("chord"), F.when(i % 4 == 1, 0.6).otherwise(0.1).alias("voice"), (i * 3 % 71 / 70.0).alias("interval_fit"),
        F.round((F.col("start_ms") - F.lag(F.col("start_ms") + F.col("dur_ms")).over(w)) / 5000.0, 6).alias("gap"), (i % 8 == 3).alias("repeat"),
    )


def _sum(spec: tuple, terms: dict[str, str]) -> str:
    parts = " + ".join([f"{spec[0]}::DOUBLE", *(f"({w}::DOUBLE) * ({terms[n]})" for n, w in spec[1].items())])
    return f"round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, {parts})), 9)"


_TERMS = {c: c for c in ("confidence", "onset", "contour", "interval_fit", "chord", "voice", "continuity")} | {f"no_{c}": f"1 - {c}" for c in ("confidence", "onset", "contour", "voice")} | {
    "support": "greatest(chord, voice)", "grid_fit": "greatest(0, 1 - grid_distance / 0.125::DOUBLE)", "off_grid": "least(1, grid_distance / 0.125::DOUBLE)", "repeat": "CASE WHEN repeat THEN 1 ELSE 0 END",
    "gap_fit": "greatest(0, 1 - greatest(0, coalesce(gap, 0)) / 0.125::DOUBLE)", "shortness": "greatest(0, 1 - beats / 0.125::DOUBLE)",
}
_CHOICES = f"""{_OBSERVED}, sc AS (SELECT *, CASE WHEN gap IS NULL THEN {_sum(R.FIRST, _TERMS)} ELSE {_sum(R.AGAIN, _TERMS)} END AS keep, {_sum(R.MERGE, _TERMS)} AS mg, {_sum(R.SUPPRESS, _TERMS)} AS sp,
row_number() OVER (PARTITION BY track_id, pitch ORDER BY start_ms, note_id) AS i, count(*) OVER (PARTITION BY track_id, pitch) AS len FROM o),
oc AS (SELECT *, CASE WHEN gap BETWEEN -0.05 AND 0.125 AND continuity >= 0.55 AND onset <= 0.48 AND chord <= 0.01 AND NOT repeat AND mg >= 0.62 AND round(mg - keep - 0.08::DOUBLE, 9) >= 0 THEN mg END AS merge,
CASE WHEN confidence <= 0.35 AND onset <= 0.3 AND beats <= 0.125 AND grid_distance >= 0.1 AND chord <= 0.01 AND voice <= 0.2 AND sp >= 0.68 AND round(sp - keep - 0.08::DOUBLE, 9) >= 0 THEN sp END AS suppress FROM sc)"""
#: The best sum that ends in each choice, with the choice before; then the path from the end.
_FORWARD = """f AS (SELECT track_id, pitch, i, keep AS tk, merge AS tm, suppress AS ts, 0 AS bk, 0 AS bm FROM oc WHERE i = 1 UNION ALL
SELECT c.track_id, c.pitch, c.i, round(c.keep + greatest(f.tk, f.tm, f.ts), 9), round(c.merge + greatest(f.tk, f.tm), 9), round(c.suppress + greatest(f.tk, f.tm, f.ts), 9),
CASE WHEN f.tk = greatest(f.tk, f.tm, f.ts) THEN 0 WHEN f.tm = greatest(f.tk, f.tm, f.ts) THEN 1 ELSE 2 END, CASE WHEN f.tk = greatest(f.tk, f.tm) THEN 0 ELSE 1 END
FROM f JOIN oc c ON c.track_id = f.track_id AND c.pitch = f.pitch AND c.i = f.i + 1),
p AS (SELECT f.track_id, f.pitch, f.i, CASE WHEN tk = greatest(tk, tm, ts) THEN 0 WHEN tm = greatest(tk, tm, ts) THEN 1 ELSE 2 END AS choice FROM f JOIN oc USING (track_id, pitch, i) WHERE i = len UNION ALL
SELECT f.track_id, f.pitch, f.i - 1, CASE WHEN p.choice = 1 THEN f.bm ELSE f.bk END FROM p JOIN f ON f.track_id = p.track_id AND f.pitch = p.pitch AND f.i = p.i AND p.i > 1)"""


@query(f"""WITH RECURSIVE {{N8}}, {_CHOICES}, {_FORWARD}, d AS (SELECT oc.*, choice, CASE choice WHEN 0 THEN keep WHEN 1 THEN merge ELSE suppress END AS score FROM p JOIN oc USING (track_id, pitch, i))
SELECT track_id, pitch, note_id, CASE choice WHEN 1 THEN 'MERGE_CONTINUATION' WHEN 2 THEN 'SUPPRESS_EXTRA' ELSE CASE WHEN gap IS NULL THEN 'KEEP_SINGLE' ELSE 'KEEP_REATTACK' END END AS state, score,
round(least(0.95::DOUBLE, greatest(0.5::DOUBLE, 0.5 + greatest(0, score - CASE WHEN choice = 0 THEN 0 ELSE keep END) * 0.75::DOUBLE)), 6) AS confidence FROM d""")
def viterbi_rhythm(spark, sf):
    return R.rhythm_decode(_observed(spark, sf))


@query()
def eval_match(spark, sf):
    n = B.framed(notes(spark, sf, 8))
    moved = n.filter("note_id % 5 != 0").withColumns({"start_ms": F.greatest(F.lit(0.0), F.col("start_ms") + F.col("note_id") % 9 - 4), "dur_ms": F.greatest(F.lit(1.0), F.col("dur_ms") + F.col("note_id") % 7 - 3)})
    return B.evaluate(n, moved)


@query()
def note_matching_full(spark, sf):
    n = notes(spark, sf, 8).withColumn("vel_b", (F.floor(F.col("note_id") / 2) % 3).cast("int")).withColumns({"vel": F.col("vel") % 2, "pitch": F.col("pitch") % 6})
    early, late = n.filter("note_id % 2 = 0"), n.filter("note_id % 2 = 1")
    return B.match_notes(early, late, 60.0, 60.0, identity=("pitch", "ntype", "vel", "vel_b"))


@query()
def path_beam(spark, sf):
    return G.continuity_path(notes(spark, sf, 8).withColumn("confidence", F.col("note_id") * 7 % 101 / 100.0))


@query()
def guide_voices(spark, sf):
    return G.guide_voices(notes(spark, sf, 8).withColumn("confidence", F.col("note_id") * 7 % 101 / 100.0))


@query()
def cluster_complete_link(spark, sf):
    """Groups are a track's notes in two seconds, with means of pitch, velocity and length as features."""
    n = notes(spark, sf, 64)
    at = F.floor(F.col("start_ms") / 2000.0)
    groups = n.groupBy("track_id", at.alias("slot"), F.when(F.col("pitch") < 60, "low").otherwise("high").alias("role")).agg(
        F.count("*").alias("samples"), F.array(F.round(F.avg("pitch") / 6, 6), F.round(F.avg("vel") / 16, 6), F.round(F.avg("dur_ms") / 40, 6)).alias("features"),
        F.min("start_ms").alias("start_ms"), F.max(F.col("start_ms") + F.col("dur_ms")).alias("end_ms"),
    )
    groups = groups.select(F.col("track_id").alias("song"), F.concat_ws("-", "slot", "role").alias("group_id"), "features", F.least(F.lit(1.0), F.col("samples") / 6.0).alias("reliability"), "samples", F.col("samples").alias("members"), "role", "start_ms", "end_ms")
    return K.timbre_clusters(groups)


@query()
def rhythm_align(spark, sf):
    n = notes(spark, sf, 8).withColumn("confidence", F.col("note_id") * 7 % 101 / 100.0)
    tempo = [(t, a, b, c) for t in range(8) for a, b, c in ((100.0, 90.0, 0.0), (5000.0, 120.0, 7.35), (12000.0, 140.0, 21.35), (20000.0, 75.0, 40.0))]
    segments = spark.createDataFrame(tempo, "track_id long, start_ms double, bpm double, beat_at_start double")
    evidence = n.groupBy("track_id", "pitch", (F.floor(F.col("start_ms") / 10) + F.col("note_id") % 5 - 2).alias("frame")).agg((F.max(F.col("note_id") % 97) / 97.0).alias("value"))
    return L.rhythm_align(n, segments, evidence)
