"""Queries over features, roles, styles, techniques and validation of groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..notes import notes
from ..operators import aggregates as A
from ..operators import features as E
from ..operators import intervals as I
from ..operators import rules as V
from ..sources import documents as D
from .base import query
from .harmony_queries import ANCHORS

_FEATURES = f"""{ANCHORS}, gr AS (SELECT track_id, anchor_ms, count(*) AS k FROM f GROUP BY 1, 2), po AS (SELECT track_id, round(avg(CASE WHEN k > 1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS polyphony FROM gr GROUP BY 1),
ft AS (SELECT track_id, round(avg(pitch), 9) AS mean_pitch, round(count(*) / greatest(1, max(start_ms + dur_ms) / 500), 6) AS density, any_value(polyphony) AS polyphony, round(avg(dur_ms), 9) AS mean_dur, round(avg(CASE WHEN dur_ms <= 175 THEN 1.0::DOUBLE ELSE 0 END), 6) AS short,
round(count(DISTINCT pitch) / count(*)::DOUBLE, 6) AS variety, max(pitch) - min(pitch) AS pitch_span FROM n JOIN po USING (track_id) GROUP BY 1)"""
_ROLES = """pl AS (SELECT *, track_id % 8 AS song, CASE WHEN track_id % 10 = 9 THEN 'percussion' WHEN mean_pitch < 49 AND polyphony < 0.18 THEN 'bass' WHEN polyphony >= 0.32 THEN 'harmony' WHEN mean_dur >= 675 AND density <= 1.1 THEN 'pad' WHEN short >= 0.68 AND variety <= 0.45 THEN 'rhythm' END AS plain,
round(mean_pitch * 0.015::DOUBLE + variety + least(pitch_span, 24) * 0.015::DOUBLE - polyphony * 0.8::DOUBLE, 9) AS score FROM ft), rk AS (SELECT *, row_number() OVER (PARTITION BY song, plain IS NULL ORDER BY score DESC, track_id DESC) AS i FROM pl),
ro AS (SELECT song, track_id, coalesce(plain, CASE i WHEN 1 THEN 'primary_melody' WHEN 2 THEN 'secondary_melody' ELSE 'ornament' END) AS role FROM rk)"""


@query(f"WITH RECURSIVE {{N}}, {_FEATURES} SELECT * FROM ft")
def song_features(spark, sf):
    return E.song_features(notes(spark, sf))


def _roles(spark, sf):
    features = E.song_features(notes(spark, sf)).withColumns({"song": F.col("track_id") % 8, "is_percussion": F.col("track_id") % 10 == 9})
    return E.track_roles(features, "song")


@query(f"WITH RECURSIVE {{N}}, {_FEATURES}, {_ROLES} SELECT * FROM ro")
def track_roles(spark, sf):
    return _roles(spark, sf)


@query("""WITH {N}, c AS (SELECT track_id, pitch % 12 AS pc, sum(greatest(1.0::DOUBLE, least(dur_ms, 1600.0::DOUBLE) / 120)) AS w, count(*) AS n FROM n GROUP BY 1, 2),
k AS (SELECT t AS tonic, m AS mode, list_transform(s, lambda x: (x + t) % 12) AS scale FROM range(12) r(t), (VALUES ('major', [0,2,4,5,7,9,11]), ('minor', [0,2,3,5,7,8,10])) v(m, s)),
s AS (SELECT track_id, tonic, mode, sum(n) AS n, round((sum(CASE WHEN list_contains(scale, pc) THEN w ELSE 0 END) + 0.18::DOUBLE * coalesce(sum(w) FILTER (pc = tonic), 0)) / sum(w), 9) AS score FROM c, k GROUP BY 1, 2, 3),
b AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY score DESC, tonic DESC, mode DESC) AS r FROM s), g AS (SELECT *, CASE WHEN n < 5 THEN 0 ELSE round(least(1, greatest(0, (score - 0.6::DOUBLE) / 0.38::DOUBLE)), 6) END AS confidence FROM b WHERE r = 1)
SELECT track_id, CASE WHEN confidence >= 0.72 THEN CAST(tonic AS INTEGER) END AS tonic, CASE WHEN confidence >= 0.72 THEN mode END AS mode, confidence FROM g""")
def key_confidence(spark, sf):
    return E.key_confidence(notes(spark, sf))


@query(f"""WITH RECURSIVE {{N}}, {_FEATURES}, {_ROLES}, m AS (SELECT *, track_id % 8 AS song FROM n), st AS (SELECT DISTINCT song, round_even(start_ms * 1000, 0) / 1000.0::DOUBLE AS s FROM m),
g AS (SELECT *, s / 500.0::DOUBLE * 4 AS x, s - lag(s) OVER w AS g1, lead(s) OVER w - s AS g2 FROM st WINDOW w AS (PARTITION BY song ORDER BY s)), rt AS (SELECT *, greatest(g1, g2) / least(g1, g2) AS ratio FROM g),
sy AS (SELECT song, round(avg(CASE WHEN abs(x - round_even(x, 0)) / 4 > 0.07 THEN 1.0::DOUBLE ELSE 0 END), 6) AS off_grid, round(avg(CASE WHEN g1 IS NOT NULL AND g2 IS NOT NULL AND g1 + g2 <= 575.0 AND ratio BETWEEN 1.25 AND 3.2 THEN ratio END), 6) AS swing FROM rt GROUP BY 1),
so AS (SELECT song, list(DISTINCT CAST(track_id % 41 AS INTEGER)) AS ins, avg(dur_ms) AS md FROM m GROUP BY 1), rl AS (SELECT song, list(DISTINCT role) AS roles FROM ro GROUP BY 1), a AS (SELECT * FROM so JOIN rl USING (song) JOIN sy USING (song)),
p AS (SELECT song, 0 AS i, 'orchestral' AS style, 0.48::DOUBLE AS v FROM a WHERE list_has_any(ins, [8, 11, 15, 16, 18, 39, 40]) UNION ALL SELECT song, 1, 'rock', 0.62 FROM a WHERE list_has_any(ins, [36, 37, 38]) UNION ALL SELECT song, 2, 'electronic', 0.65 FROM a WHERE list_has_any(ins, [20, 24, 28, 32])
UNION ALL SELECT song, 3, 'rhythm_section', 0.45 FROM a WHERE list_has_all(roles, ['percussion', 'bass']) UNION ALL SELECT song, 4, 'jazz_swing', round(least(0.82::DOUBLE, 0.4::DOUBLE + (swing - 1) * 0.25::DOUBLE), 6) FROM a WHERE swing >= 1.45
UNION ALL SELECT song, 5, 'funk', round(least(0.78::DOUBLE, 0.35::DOUBLE + off_grid), 6) FROM a WHERE off_grid >= 0.28 AND list_contains(roles, 'bass') UNION ALL SELECT song, 6, 'ambient', 0.48 FROM a WHERE md >= 700),
u AS (SELECT * FROM p UNION ALL SELECT song, 99, 'neutral', 0.5 FROM a WHERE song NOT IN (SELECT song FROM p)), o AS (SELECT *, CAST(row_number() OVER (PARTITION BY song ORDER BY v DESC, i) AS INTEGER) AS place FROM u)
SELECT song, place, style, v AS confidence FROM o WHERE place <= 3""")
def style_tags(spark, sf):
    n = notes(spark, sf).withColumn("song", F.col("track_id") % 8)
    base = n.groupBy("song").agg(F.collect_set((F.col("track_id") % 41).cast("int")).alias("instruments"), F.avg("dur_ms").alias("mean_dur"))
    roles = _roles(spark, sf).groupBy("song").agg(F.collect_set("role").alias("roles"))
    return E.style_tags(base.join(roles, "song").join(A.style_syncopation(n, on=("song",)), "song"), "song")


FAMILIES = ("strings", "wind", "brass", "keys", "synth", "guitar", "bass", "drums", "harp", "hand_percussion")
_RULES = {
    "legato": "more AND gap BETWEEN -40 AND 30 AND family IN ('strings', 'wind', 'brass', 'synth')", "tenuto": "more AND gate BETWEEN 0.78 AND 0.98 AND gap >= 0 AND soft", "staccatissimo": "det AND gate <= 0.22 AND soft",
    "marcato": "vel >= med + 18 AND family <> 'synth' AND det", "accent": "vel >= med + 18 AND family <> 'synth' AND NOT det", "spiccato": "det AND family = 'strings' AND dur_ms <= 140", "staccato": "det AND soft AND NOT (family = 'strings' AND dur_ms <= 140)",
    "hammer_on": "near AND family IN ('guitar', 'bass') AND p1 > pitch", "pull_off": "near AND family IN ('guitar', 'bass') AND p1 < pitch", "slide": "near AND family IN ('strings', 'wind', 'brass')",
    "palm_mute": "family IN ('guitar', 'bass') AND det AND pitch < 64", "slap_pop": "family = 'bass' AND dur_ms <= 180 AND vel >= 104", "ghost_note": "family IN ('bass', 'drums', 'hand_percussion') AND dur_ms <= 125 AND vel <= 55",
    "tremolo": "family IN ('strings', 'synth') AND dur_ms >= 850", "breath_phrase": "family IN ('wind', 'brass') AND more AND gap >= 275", "synth_filter_sustain": "family = 'synth' AND dur_ms >= 700",
    "harp_gliss": "family = 'harp' AND p3 IS NOT NULL AND ((p1 - pitch BETWEEN 1 AND 2 AND p2 - p1 BETWEEN 1 AND 2 AND p3 - p2 BETWEEN 1 AND 2) OR (pitch - p1 BETWEEN 1 AND 2 AND p1 - p2 BETWEEN 1 AND 2 AND p2 - p3 BETWEEN 1 AND 2))",
    "strum_up": "family = 'guitar' AND s2 - start_ms <= 85 AND p1 > pitch AND p2 > p1", "strum_down": "family = 'guitar' AND s2 - start_ms <= 85 AND p1 < pitch AND p2 < p1",
    "double_tongue": "family IN ('wind', 'brass') AND s3 IS NOT NULL AND greatest(s1 - start_ms, s2 - s1, s3 - s2) <= 140 AND len(list_distinct([pitch, p1, p2, p3])) <= 2",
    "flam": "family IN ('drums', 'hand_percussion') AND more AND p1 = pitch AND ioi > 0 AND ioi <= 45", "roll": "family IN ('drums', 'hand_percussion') AND s3 IS NOT NULL AND len(list_distinct([pitch, p1, p2, p3])) = 1 AND s3 - start_ms <= 500",
}


@query(f"""WITH {{N}}, b AS (SELECT *, CASE track_id % 10 {" ".join(f"WHEN {i} THEN '{f}'" for i, f in enumerate(FAMILIES))} END AS family, lead(start_ms, 1) OVER w AS s1, lead(start_ms, 2) OVER w AS s2, lead(start_ms, 3) OVER w AS s3, lead(pitch, 1) OVER w AS p1, lead(pitch, 2) OVER w AS p2, lead(pitch, 3) OVER w AS p3
FROM n WINDOW w AS (PARTITION BY track_id ORDER BY start_ms, pitch, note_id)), md AS (SELECT track_id, list_sort(list(vel))[len(list(vel)) // 2 + 1] AS med FROM n GROUP BY 1),
c AS (SELECT b.*, med, s1 IS NOT NULL AS more, coalesce(s1 - (start_ms + dur_ms), 500.0::DOUBLE) AS gap, coalesce(s1 - start_ms, 500.0::DOUBLE) AS ioi, dur_ms / greatest(1.0::DOUBLE, coalesce(s1 - start_ms, 500.0::DOUBLE)) AS gate, family IN ('strings', 'wind', 'brass', 'keys') AS soft FROM b JOIN md USING (track_id)),
d AS (SELECT *, more AND gate <= 0.45 AND gap >= 30 AS det, more AND gap BETWEEN -20 AND 90 AND abs(p1 - pitch) BETWEEN 1 AND 4 AS near FROM c)
""" + " UNION ALL ".join(f"SELECT note_id, '{k}' AS technique FROM d WHERE {v}" for k, v in _RULES.items()))
def pattern_detectors(spark, sf):
    family = F.element_at(F.array(*map(F.lit, FAMILIES)), (F.col("track_id") % 10 + 1).cast("int"))
    return E.techniques(notes(spark, sf).withColumn("family", family))


@query("""WITH {N}, m AS (SELECT note_id AS id, greatest(1, CAST(floor(dur_ms / 10) AS BIGINT)) AS span, start_ms FROM n), t AS (SELECT * FROM m WHERE id % 3 <> 0), g AS (SELECT id, CASE WHEN id % 4 = 1 THEN span + 2 ELSE span END AS span FROM m WHERE id % 5 <> 0),
s(stratum, lo, hi) AS (VALUES ('all', -1, 1000000000), ('to_6', -1, 6), ('to_8', -1, 8), ('9_to_11', 9, 11)), x AS (SELECT stratum, count(*) AS truth, count(*) FILTER (id % 5 <> 0) AS matched FROM t JOIN s ON span BETWEEN lo AND hi GROUP BY 1),
y AS (SELECT stratum, count(*) AS guess, count(*) FILTER (id % 3 <> 0) AS hit FROM g JOIN s ON span BETWEEN lo AND hi GROUP BY 1), z AS (SELECT stratum, coalesce(truth, 0) AS truth, coalesce(guess, 0) AS guess, coalesce(matched, 0) AS matched, coalesce(hit, 0) / greatest(1, coalesce(guess, 0))::DOUBLE AS p, coalesce(matched, 0) / greatest(1, coalesce(truth, 0))::DOUBLE AS r FROM x FULL JOIN y USING (stratum))
SELECT stratum, truth, guess, matched, round(p, 6) AS "precision", round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1 FROM z""")
def prf_strata(spark, sf):
    m = notes(spark, sf).select(F.col("note_id").alias("id"), F.greatest(F.lit(1), F.floor(F.col("dur_ms") / 10)).alias("span"))
    truth, guess = m.filter("id % 3 != 0"), m.filter("id % 5 != 0").withColumn("span", F.when(F.col("id") % 4 == 1, F.col("span") + 2).otherwise(F.col("span")))
    return E.strata_metrics(truth, guess, m.filter("id % 3 != 0 AND id % 5 != 0").select(F.col("id").alias("truth_id"), F.col("id").alias("guess_id")))


@query("""WITH {N8}, p AS (SELECT a.note_id, b.track_id AS group_id, round(((b.note_id % 100) / 100.0::DOUBLE) * (0.68::DOUBLE * coalesce(greatest(0.0::DOUBLE, least(a.start_ms + a.dur_ms, b.start_ms + b.dur_ms) - greatest(a.start_ms, b.start_ms)) / nullif(least(a.dur_ms, b.dur_ms), 0), 0)
+ 0.32::DOUBLE * greatest(0.0::DOUBLE, 1 - abs(a.start_ms - b.start_ms) / 180.0::DOUBLE)), 6) AS score FROM n a JOIN n b ON a.track_id % 2 = 0 AND b.track_id % 2 = 1 AND a.pitch = b.pitch AND abs(a.start_ms - b.start_ms) <= 120),
s AS (SELECT note_id, group_id, max(score) AS score FROM p WHERE score >= 0.42 GROUP BY 1, 2), t AS (SELECT group_id, count(*) AS notes, round(sum(score), 6) AS total FROM s GROUP BY 1)
SELECT group_id, CAST(row_number() OVER (ORDER BY total DESC, group_id) AS INTEGER) AS place, notes, total FROM t""")
def guidance_ranks(spark, sf):
    n = notes(spark, sf, 8)
    melody = n.filter("track_id % 2 = 1").withColumns({"group_id": F.col("track_id"), "confidence": F.col("note_id") % 100 / 100.0})
    return E.guidance_ranks(I.guidance_scores(n.filter("track_id % 2 = 0"), melody))


@query("""WITH {N}, t AS (SELECT track_id, track_id % 40 AS instrument, track_id % 3 AS volume, track_id // 40 % 2 AS sends, count(*) AS k FROM n GROUP BY 1), g AS (SELECT instrument, count(*) AS tracks, count(DISTINCT volume) AS volumes, count(DISTINCT sends) AS sends, CAST(sum(k) AS BIGINT) AS notes FROM t GROUP BY 1)
SELECT 'tracks_merge' AS code, 'info' AS severity, instrument, tracks AS n FROM g WHERE tracks > 1 UNION ALL SELECT 'volume_conflict', 'error', instrument, volumes FROM g WHERE tracks > 1 AND volumes > 1
UNION ALL SELECT 'effects_conflict', 'error', instrument, sends FROM g WHERE tracks > 1 AND sends > 1 UNION ALL SELECT 'instrument_capacity', 'warning', instrument, notes FROM g WHERE notes > 260""")
def validate_groups(spark, sf):
    n = notes(spark, sf)
    tracks = n.select("track_id").distinct().select("track_id", (F.col("track_id") % 40).alias("instrument"), (F.col("track_id") % 3).alias("volume"), (F.floor(F.col("track_id") / 40) % 2).alias("sends"))
    return V.validate_groups(tracks, n, 260)


@query("""WITH {N}, c AS (SELECT *, pitch < 0 OR pitch > 127 OR (track_id % 7 <> 0 AND (pitch < 40 OR pitch > 79)) AS bp, (track_id % 7 <> 0 AND ntype NOT IN (0, 1, 99)) AS bt, start_ms < 0 OR dur_ms <= 0 AS bm, vel < 0 OR vel > 127 AS bv FROM n)
SELECT track_id, count(*) AS notes, count(*) FILTER (bp) AS bad_pitch, count(*) FILTER (bt) AS bad_type, count(*) FILTER (bm) AS bad_timing, count(*) FILTER (bv) AS bad_velocity, count(*) FILTER (NOT (bp OR bt OR bm OR bv)) AS legal FROM c GROUP BY 1""")
def assess_draft(spark, sf):
    n = notes(spark, sf)
    instruments = n.filter("track_id % 7 != 0").select("track_id").distinct().select("track_id", F.lit(40).alias("low"), F.lit(79).alias("high"), F.array(F.lit(0), F.lit(1), F.lit(99)).alias("types"))
    return V.assess_draft(n, instruments)


@query("""WITH {N8}, r AS (SELECT *, CAST((row_number() OVER (PARTITION BY track_id ORDER BY start_ms, note_id) - 1) // 800 AS BIGINT) AS chunk FROM (SELECT track_id, note_id, pitch + CASE WHEN note_id % 50 = 0 THEN 90 ELSE 0 END AS pitch, vel, start_ms, ntype * CASE WHEN note_id % 40 = 0 THEN 3 ELSE 1 END AS ntype FROM n)),
g AS (SELECT track_id, chunk, count(*) AS k, count(*) FILTER (pitch > 127) AS bp, count(*) FILTER (ntype > 255) AS bt FROM r GROUP BY 1, 2)
SELECT 'note_limit' AS code, 'error' AS severity, track_id, chunk, k AS n FROM g WHERE k > 730 UNION ALL SELECT 'note_pitch', 'error', track_id, chunk, bp FROM g WHERE bp > 0 UNION ALL SELECT 'note_type', 'error', track_id, chunk, bt FROM g WHERE bt > 0
UNION ALL SELECT 'instrument_mixed', 'error', track_id, -1, count(DISTINCT chunk % 2 * (track_id % 2)) FROM g GROUP BY track_id HAVING count(DISTINCT chunk % 2 * (track_id % 2)) > 1""")
def validate_document(spark, sf):
    n = notes(spark, sf, 8).withColumns({"pitch": F.col("pitch") + F.when(F.col("note_id") % 50 == 0, 90).otherwise(0), "ntype": F.col("ntype") * F.when(F.col("note_id") % 40 == 0, 3).otherwise(1)})
    chunks = D.physical_tracks(n, 800)
    return V.validate_document(chunks.withColumn("instrument", F.col("chunk") % 2 * (F.col("track_id") % 2)))
