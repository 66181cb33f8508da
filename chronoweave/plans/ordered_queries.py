"""Queries over ordered analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..notes import DRUM, notes
from ..operators import ordered as O
from .base import query

_W = "PARTITION BY track_id ORDER BY start_ms, note_id"


@query(f"""WITH {{N}}, r AS (SELECT *, max(start_ms + dur_ms) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM n),
p AS (SELECT *, sum(CASE WHEN start_ms - reached >= 420 THEN 1 ELSE 0 END) OVER ({_W}) AS phrase FROM r)
SELECT track_id, CAST(max(phrase) + 1 AS BIGINT) AS phrases, count(*) AS notes, max(start_ms + dur_ms) - min(start_ms) AS span_ms FROM p GROUP BY 1""")
def phrase_numbers(spark, sf):
    p = O.phrase_numbers(notes(spark, sf))
    return p.groupBy("track_id").agg((F.max("phrase") + 1).alias("phrases"), F.count("*").alias("notes"), (F.max(F.col("start_ms") + F.col("dur_ms")) - F.min("start_ms")).alias("span_ms"))


@query(f"""WITH {{N}}, r AS (SELECT *, count(*) OVER (PARTITION BY track_id ORDER BY start_ms RANGE BETWEEN 12.0::DOUBLE PRECEDING AND 12.0::DOUBLE FOLLOWING) AS c,
avg(pitch) OVER ({_W} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m, lead(start_ms) OVER ({_W}) - start_ms AS gap FROM n)
SELECT note_id, CASE WHEN c >= 2 THEN 'chord' WHEN m < 48 THEN 'bass_riff' WHEN gap < 250 THEN 'rhythm' ELSE 'melody' END AS role FROM r""")
def event_roles(spark, sf):
    return O.event_roles(notes(spark, sf)).select("note_id", "role")


@query("""WITH {N8}, r AS (SELECT *, lead(start_ms) OVER (PARTITION BY track_id, pitch ORDER BY start_ms, note_id) AS nx FROM n)
SELECT note_id, CASE WHEN nx IS NULL THEN dur_ms ELSE greatest(1.0, least(dur_ms, nx - 1.0 - start_ms)) END AS dur_ms FROM r""")
def overlap_trim(spark, sf):
    return O.overlap_trim(notes(spark, sf, 8)).select("note_id", "dur_ms")


@query("""WITH {N8}, f AS (SELECT *, row_number() OVER (PARTITION BY track_id, pitch, CAST(round_even(start_ms * 1000, 0) AS BIGINT), ntype ORDER BY vel DESC, note_id) AS r FROM n WHERE ntype = 99),
l AS (SELECT *, lead(start_ms) OVER (PARTITION BY track_id, pitch ORDER BY start_ms, note_id) AS nx FROM f WHERE r = 1)
SELECT note_id, CASE WHEN nx IS NULL THEN least(dur_ms, 80.0) ELSE greatest(1.0, least(least(dur_ms, 80.0), nx - 1 - start_ms)) END AS dur_ms FROM l""")
def drum_timing(spark, sf):
    return O.drum_timing(notes(spark, sf, 8).filter(F.col("ntype") == DRUM)).select("note_id", "dur_ms")


@query(f"""WITH {{N8}}, r AS (SELECT *, lead(start_ms) OVER ({_W}) AS nx, lead(pitch) OVER ({_W}) AS np FROM n)
SELECT note_id, CASE WHEN np <> pitch AND nx - (start_ms + dur_ms) > 0 AND nx - (start_ms + dur_ms) <= 45 AND dur_ms >= 60 THEN nx - start_ms ELSE dur_ms END AS dur_ms FROM r""")
def gap_fill_legato(spark, sf):
    return O.gap_fill_legato(notes(spark, sf, 8), least=60.0).select("note_id", "dur_ms")


@query("""WITH {N8}, s AS (SELECT DISTINCT track_id, pitch, start_ms FROM n), r AS (SELECT *, start_ms - lag(start_ms) OVER w AS b, lead(start_ms) OVER w - start_ms AS f FROM s WINDOW w AS (PARTITION BY track_id, pitch ORDER BY start_ms))
SELECT track_id, pitch, start_ms, coalesce(abs(b - f) <= 12, false) AS regular FROM r""")
def regular_repeat(spark, sf):
    return O.regular_repeat(notes(spark, sf, 8))


@query(f"""WITH {{N8}} SELECT note_id, coalesce(lead(pitch) OVER w - pitch = lag(pitch, 1) OVER w - lag(pitch, 2) OVER w
AND abs(lead(start_ms) OVER w - start_ms - (lag(start_ms, 1) OVER w - lag(start_ms, 2) OVER w)) <= 60, false) AS motif FROM n WINDOW w AS ({_W})""")
def motif_repeat(spark, sf):
    return O.motif_repeat(notes(spark, sf, 8)).select("note_id", "motif")


@query("""WITH {N}, f AS (SELECT *, CAST(floor(start_ms / 10.0) AS BIGINT) AS frame FROM n)
SELECT note_id, min(pitch) OVER w <> max(pitch) OVER w AS supported FROM f WINDOW w AS (PARTITION BY track_id ORDER BY frame RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING)""")
def chord_support(spark, sf):
    return O.chord_support(notes(spark, sf)).select("note_id", "supported")


@query("""WITH {N} SELECT note_id FROM n a WHERE EXISTS (SELECT 1 FROM n b WHERE a.track_id = b.track_id AND b.vel > 120 AND b.start_ms BETWEEN a.start_ms - 12.0 AND a.start_ms + 12.0)""")
def same_onset_expand(spark, sf):
    return O.same_onset_expand(notes(spark, sf), F.col("vel") > 120).select("note_id")


@query("""WITH {N}, b AS (SELECT track_id, CAST(floor(start_ms / 500.0) AS BIGINT) AS beat, max(pitch) // 24 AS state, avg(vel) AS conf FROM n GROUP BY 1, 2),
r AS (SELECT *, CASE WHEN state = lag(state) OVER w AND beat * 500.0 = (lag(beat) OVER w + 1) * 500.0 THEN 0 ELSE 1 END AS fresh FROM b WINDOW w AS (PARTITION BY track_id ORDER BY beat)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY track_id ORDER BY beat) AS run FROM r)
SELECT track_id, state, min(beat * 500.0::DOUBLE) AS start_ms, max((beat + 1) * 500.0::DOUBLE) AS end_ms, count(*) AS n, round(avg(conf), 6) AS mean FROM g GROUP BY track_id, run, state""")
def segment_merge(spark, sf):
    beats = notes(spark, sf).groupBy("track_id", F.floor(F.col("start_ms") / 500.0).alias("beat")).agg(F.floor(F.max("pitch") / 24).cast("int").alias("state"), F.avg("vel").alias("conf"))
    rows = beats.select("track_id", "state", "conf", (F.col("beat") * 500.0).alias("start_ms"), ((F.col("beat") + 1) * 500.0).alias("end_ms"))
    return O.segment_merge(rows, ["track_id"], "start_ms", "end_ms", ["state"], "conf")


@query("""WITH {N}, r AS (SELECT *, min(vel) FILTER (ntype = 0) OVER w AS a, max(vel) FILTER (ntype = 0) OVER w AS b FROM n WINDOW w AS (PARTITION BY track_id))
SELECT note_id, CASE WHEN ntype <> 0 THEN vel WHEN a = b THEN 75 ELSE CAST(round_even(40 + (vel - a) * 70.0::DOUBLE / (b - a), 0) AS INTEGER) END AS vel FROM r""")
def velocity_rescale(spark, sf):
    return O.velocity_rescale(notes(spark, sf)).select("note_id", "vel")


@query("""WITH {N}, r AS (SELECT *, min(vel) OVER (PARTITION BY track_id) AS a FROM n)
SELECT note_id, CASE WHEN a > 0 AND a < 30 THEN least(127, CAST(round_even(vel * 30.0::DOUBLE / a, 0) AS INTEGER)) ELSE vel END AS vel FROM r""")
def velocity_floor(spark, sf):
    return O.velocity_floor(notes(spark, sf)).select("note_id", "vel")


@query("""WITH {N}, r AS (SELECT *, dense_rank() OVER (PARTITION BY track_id ORDER BY vel) AS k, dense_rank() OVER (PARTITION BY track_id ORDER BY vel DESC) AS d FROM n)
SELECT note_id, CAST(CASE WHEN d = 1 THEN 127 ELSE least(127, 40 + (k - 1) * 3) END AS INTEGER) AS vel FROM r""")
def velocity_step(spark, sf):
    return O.velocity_step(notes(spark, sf)).select("note_id", "vel")


@query("""WITH {N}, r AS (SELECT *, dense_rank() OVER (PARTITION BY track_id ORDER BY vel) - 1 AS k FROM n), m AS (SELECT *, max(k) OVER (PARTITION BY track_id) AS top FROM r)
SELECT note_id, list_extract([30, 60, 90, 120], CAST(CASE WHEN top = 0 THEN 1 ELSE round_even(k * 3.0::DOUBLE / top, 0) + 1 END AS BIGINT)) AS vel FROM m""")
def velocity_layers(spark, sf):
    return O.velocity_layers(notes(spark, sf)).select("note_id", "vel")


@query("""WITH {N}, r AS (SELECT *, (min(vel) OVER w + max(vel) OVER w) / 2.0::DOUBLE AS mid FROM n WINDOW w AS (PARTITION BY track_id))
SELECT note_id, greatest(1, least(127, CAST(floor(vel + (mid - vel) * 0.5 + 10 + 0.5) AS INTEGER))) AS vel FROM r""")
def velocity_base_map(spark, sf):
    return O.velocity_base_map(notes(spark, sf)).select("note_id", "vel")


@query("""WITH {N} SELECT note_id, CAST(least(127, ((CASE WHEN note_id % 4 = 0 THEN 64 ELSE vel END) * 85 + 50) // 100) AS INTEGER) AS vel FROM n""")
def velocity_percent(spark, sf):
    n = notes(spark, sf)
    return O.velocity_percent(n, n.filter("note_id % 4 = 0").select("note_id", F.lit(64).alias("baseline")), 85).select("note_id", "vel")


@query("""WITH {N}, r AS (SELECT *, coalesce((start_ms - min(start_ms) OVER w) / nullif(max(start_ms) OVER w - min(start_ms) OVER w, 0), 0) AS x FROM n WINDOW w AS (PARTITION BY track_id))
SELECT note_id, greatest(1, least(127, CAST(round_even(vel * (0.6::DOUBLE + (1.2::DOUBLE - 0.6::DOUBLE) * (x * x * (3 - 2 * x))), 0) AS INTEGER))) AS vel FROM r""")
def velocity_ramp(spark, sf):
    return O.velocity_ramp(notes(spark, sf), shape="smooth").select("note_id", "vel")


@query("""WITH {N}, r AS (SELECT *, abs(start_ms - 5000.0::DOUBLE) / 2000.0::DOUBLE AS d FROM n)
SELECT note_id, greatest(1, least(127, CAST(round_even(vel + 30.0::DOUBLE * CASE WHEN d < 1 THEN (1 - d * d) * (1 - d * d) ELSE 0.0::DOUBLE END, 0) AS INTEGER))) AS vel FROM r""")
def velocity_falloff(spark, sf):
    return O.velocity_falloff(notes(spark, sf), 5000.0, 2000.0, 30.0).select("note_id", "vel")


@query("""WITH {N}, r AS (SELECT *, count(*) OVER (PARTITION BY track_id, round_even(start_ms / 12, 0)) AS size, CAST(round_even(start_ms / 500.0, 0) AS BIGINT) % 4 AS beat FROM n)
SELECT note_id, greatest(1, least(127, CAST(round_even(vel * (0.9::DOUBLE + 0.14::DOUBLE * CASE beat WHEN 0 THEN 1.0::DOUBLE WHEN 2 THEN 0.72::DOUBLE ELSE 0.42::DOUBLE END)
* CASE WHEN size >= 4 THEN 0.88::DOUBLE WHEN size >= 2 THEN 0.94::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN dur_ms >= 500 THEN 1.04::DOUBLE ELSE 1.0::DOUBLE END, 0) AS INTEGER))) AS vel FROM r""")
def polish_velocity(spark, sf):
    return O.polish_velocity(notes(spark, sf)).select("note_id", "vel")


@query("""WITH {N8}, r AS (SELECT *, row_number() OVER (PARTITION BY track_id, round_even(start_ms * 10, 0) ORDER BY pitch, note_id) - 1 AS k FROM n)
SELECT note_id, start_ms + k * 8.0::DOUBLE AS start_ms, greatest(1.0::DOUBLE, start_ms + dur_ms - (start_ms + k * 8.0::DOUBLE)) AS dur_ms, CAST(greatest(1, vel - k) AS INTEGER) AS vel FROM r""")
def strum(spark, sf):
    return O.strum(notes(spark, sf, 8)).select("note_id", "start_ms", "dur_ms", "vel")


_U = "CAST(('0x' || substr(sha256('7:{s}:' || note_id || ':' || pitch), 1, 8)) AS BIGINT)::DOUBLE / 4294967296.0::DOUBLE * 2 - 1"


@query(f"""WITH {{N}} SELECT note_id, greatest(0.0::DOUBLE, start_ms + ({_U.format(s=0)}) * 10.0::DOUBLE) AS start_ms,
greatest(1, least(127, vel + CAST(round_even(({_U.format(s=1)}) * 4, 0) AS INTEGER))) AS vel FROM n""")
def humanize(spark, sf):
    return O.humanize(notes(spark, sf)).select("note_id", "start_ms", "vel")


@query(f"""WITH {{N8}}, c AS (SELECT track_id, (row_number() OVER ({_W}) - 1) // 730 AS chunk FROM n) SELECT track_id, CAST(chunk AS BIGINT) AS chunk, count(*) AS notes FROM c GROUP BY 1, 2""")
def chunk_split(spark, sf):
    return O.chunk_split(notes(spark, sf, 8)).groupBy("track_id", "chunk").agg(F.count("*").alias("notes"))


@query(f"""WITH {{N8}}, r AS (SELECT *, lead(start_ms) OVER w - (start_ms + dur_ms) AS gap, lead(start_ms) OVER w - start_ms AS ioi, avg(vel) OVER (PARTITION BY track_id) AS mean,
lead(pitch, 1) OVER w AS p1, lead(pitch, 2) OVER w AS p2, lead(pitch, 3) OVER w AS p3, lead(start_ms, 3) OVER w - start_ms AS t3 FROM n WINDOW w AS ({_W}))
SELECT note_id, 'legato' AS pattern FROM r WHERE gap BETWEEN -20 AND 20 UNION ALL SELECT note_id, 'staccato' FROM r WHERE dur_ms < 0.5 * ioi
UNION ALL SELECT note_id, 'accent' FROM r WHERE vel > mean + 30 UNION ALL SELECT note_id, 'flam' FROM r WHERE p1 = pitch AND ioi <= 45
UNION ALL SELECT note_id, 'roll' FROM r WHERE p1 = pitch AND p2 = pitch AND p3 = pitch AND t3 <= 500""")
def pattern_basic(spark, sf):
    return O.pattern_detect(notes(spark, sf, 8))
