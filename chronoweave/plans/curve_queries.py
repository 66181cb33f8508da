"""Queries over level curves and refined onsets, and matches that depend on order."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..notes import notes
from ..operators import aggregates as A
from ..operators import curves as K
from ..operators import matching as M
from ..tables import table
from .base import query

POINTS = ((0.0, 60.0), (0.2, 100.0), (0.5, 80.0), (0.7, 80.0), (0.9, 95.0), (1.0, 30.0))


def _end(w0, w1, d0, d1):
    slope = f"((2 * {w0} + {w1}) * {d0} - {w0} * {d1}) / ({w0} + {w1})"
    return f"CASE WHEN {slope} * {d0} <= 0 THEN 0 WHEN {d0} * {d1} < 0 AND abs({slope}) > abs(3 * {d0}) THEN 3 * {d0} ELSE {slope} END"


@query(f"""WITH {{N8}}, pt(at_, v) AS (VALUES {", ".join(f"({a}::DOUBLE, {b}::DOUBLE)" for a, b in POINTS)}), p1 AS (SELECT *, lead(at_) OVER (ORDER BY at_) - at_ AS w, (lead(v) OVER (ORDER BY at_) - v) / (lead(at_) OVER (ORDER BY at_) - at_) AS d FROM pt),
p2 AS (SELECT *, lag(w) OVER o AS wb, lag(d) OVER o AS db, lag(w, 2) OVER o AS wb2, lag(d, 2) OVER o AS db2, lead(w) OVER o AS wa, lead(d) OVER o AS da FROM p1 WINDOW o AS (ORDER BY at_)),
p3 AS (SELECT at_, v, CASE WHEN wb IS NULL THEN {_end("w", "wa", "d", "da")} WHEN w IS NULL THEN {_end("wb", "wb2", "db", "db2")} WHEN db * d > 0 THEN (3 * w + 3 * wb) / ((2 * w + wb) / db + (w + 2 * wb) / d) ELSE 0 END AS m FROM p2),
p4 AS (SELECT *, lead(at_) OVER o AS at2, lead(v) OVER o AS v2, lead(m) OVER o AS m2 FROM p3 WINDOW o AS (ORDER BY at_)),
e AS (SELECT track_id, min(start_ms) AS lo, max(start_ms) AS hi FROM n GROUP BY 1), g AS (SELECT track_id, floor(start_ms * 1000 + 0.5::DOUBLE) / 1000 AS onset, avg(vel) AS mean FROM n GROUP BY 1, 2),
x AS (SELECT g.*, CASE WHEN hi > lo THEN least(greatest((onset - lo) / (hi - lo), 0), 1) ELSE 0 END AS pos FROM g JOIN e USING (track_id)), y AS (SELECT x.*, p4.*, (pos - at_) / (at2 - at_) AS s, at2 - at_ AS h FROM x ASOF JOIN p4 ON x.pos >= p4.at_),
t AS (SELECT track_id, onset, mean, round(CASE WHEN at2 IS NULL THEN v ELSE (2 * s * s * s - 3 * s * s + 1) * v + (s * s * s - 2 * s * s + s) * h * m + (3 * s * s - 2 * s * s * s) * v2 + (s * s * s - s * s) * h * m2 END, 9) AS target FROM y)
SELECT note_id, least(greatest(CAST(round_even(round(vel * target / mean, 6), 0) AS INTEGER), 0), 127) AS vel FROM n JOIN t ON t.track_id = n.track_id AND t.onset = floor(start_ms * 1000 + 0.5::DOUBLE) / 1000""")
def velocity_envelope(spark, sf):
    points = spark.createDataFrame([(t, a, b) for t in range(8) for a, b in POINTS], "track_id long, at double, level double")
    return K.velocity_envelope(notes(spark, sf, 8), points)


@query()
def envelope_simplify(spark, sf):
    points = A.velocity_points(notes(spark, sf, 8)).select("track_id", (F.col("at_us") / 1000.0).alias("at"), F.col("mean_vel").alias("level"))
    return K.envelope_simplify(points)


@query("""WITH {N8}, ev AS (SELECT track_id, pitch, CAST(floor(start_ms / 10) AS BIGINT) + note_id % 5 - 2 AS frame, max(note_id % 97) / 97.0::DOUBLE AS value FROM n GROUP BY 1, 2, 3),
c AS (SELECT n.*, unnest(range(CAST(ceil(start_ms / 10) AS BIGINT) - 3, CAST(ceil(start_ms / 10) AS BIGINT) + 4)) AS frame FROM n),
m AS (SELECT note_id, start_ms, c.frame, coalesce(value, 0) AS value, row_number() OVER (PARTITION BY note_id ORDER BY coalesce(value, 0) DESC, c.frame) AS i FROM c LEFT JOIN ev ON ev.track_id = c.track_id AND ev.pitch = c.pitch AND ev.frame = c.frame)
SELECT note_id, CASE WHEN value >= 0.3 AND abs(frame * 10.0::DOUBLE - start_ms) <= 30 THEN frame * 10.0::DOUBLE ELSE start_ms END AS start_ms, value AS support FROM m WHERE i = 1""")
def onset_refine(spark, sf):
    n = notes(spark, sf, 8)
    evidence = n.groupBy("track_id", "pitch", (F.floor(F.col("start_ms") / 10) + F.col("note_id") % 5 - 2).alias("frame")).agg((F.max(F.col("note_id") % 97) / 97.0).alias("value"))
    return K.onset_refine(n, evidence)


@query()
def candidate_overlap(spark, sf):
    n = notes(spark, sf, 8)
    moved = n.filter("note_id % 7 != 0").withColumns({"note_id": F.when(F.col("note_id") % 3 == 0, F.col("note_id") + 10_000_000).otherwise(F.col("note_id")), "start_ms": F.col("start_ms") + F.col("note_id") % 4 * 8.0})
    return M.candidate_overlap(n, moved)


@query()
def beam_select(spark, sf):
    n = notes(spark, sf, 8)
    options = n.select("track_id", F.floor(F.col("start_ms") / 2000).alias("part"), F.col("note_id").alias("option_id"), (F.col("note_id") % 100 / 100.0).alias("confidence"), F.col("pitch").alias("conflict"))
    return M.beam_select(options, ("track_id", "part"))


@query("""SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def join_instrument_dim(spark, sf):
    dim = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return M.join_dim(table(spark, sf, "customer"), dim, "c_nationkey", "n_nationkey", ("n_name", "r_name")).select("c_custkey", "n_name", "r_name")


@query("""WITH {N8}, f AS (SELECT track_id, CAST(floor(start_ms / 10) AS BIGINT) AS frame, count(*) AS x FROM n GROUP BY 1, 2), e AS (SELECT track_id, sum(x * x) AS energy FROM f GROUP BY 1),
c AS (SELECT a.track_id, lag, sum(a.x * b.x) AS c FROM f a, range(20, 201) l(lag), f b WHERE b.track_id = a.track_id AND b.frame = a.frame + lag GROUP BY 1, 2),
s AS (SELECT track_id, lag, round(60000 / (lag * 10.0::DOUBLE), 6) AS bpm, round(c / energy * exp(-0.5::DOUBLE * pow(log2(60000 / (lag * 10.0::DOUBLE) / 120.0::DOUBLE) / 0.9::DOUBLE, 2)), 9) AS score FROM c JOIN e USING (track_id)),
b AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY score DESC, lag) AS i FROM s), p AS (SELECT f.track_id, frame % lag AS phase, sum(x) AS x FROM f JOIN b ON b.track_id = f.track_id AND i = 1 GROUP BY 1, 2),
q AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY x DESC, phase) AS j FROM p)
SELECT e.track_id, CASE WHEN score >= 0.1 THEN bpm END AS bpm, coalesce(score, 0) AS score, CASE WHEN score >= 0.1 THEN phase * 10.0::DOUBLE END AS phase_ms FROM e LEFT JOIN b ON b.track_id = e.track_id AND i = 1 LEFT JOIN q ON q.track_id = e.track_id AND j = 1""")
def tempo_estimate(spark, sf):
    return K.tempo_estimate(notes(spark, sf, 8))


@query("""WITH {N}, c AS (SELECT note_id AS candidate_id, pitch, start_ms, dur_ms FROM n WHERE note_id % 2 = 0), t AS (SELECT DISTINCT track_id, 40 AS low, 76 AS high FROM n WHERE track_id % 9 <> 0), o AS (SELECT track_id, pitch, start_ms + 5 AS s, dur_ms FROM n WHERE note_id % 3 = 0),
r AS (SELECT note_id AS candidate_id, track_id FROM n WHERE note_id % 5 <> 0), l AS (SELECT DISTINCT r.candidate_id, r.track_id FROM r JOIN c USING (candidate_id) JOIN t USING (track_id) JOIN o ON o.track_id = r.track_id AND o.pitch = c.pitch AND abs(o.s - c.start_ms) <= 35 AND abs(o.dur_ms - c.dur_ms) <= greatest(35, 0.25::DOUBLE * c.dur_ms))
SELECT r.candidate_id, r.track_id, CASE WHEN r.candidate_id % 11 = 0 THEN 'invalid' WHEN r.candidate_id % 13 = 0 THEN 'satisfied' WHEN c.pitch IS NULL OR low IS NULL THEN 'orphaned' WHEN NOT c.pitch BETWEEN low AND high THEN 'invalid' WHEN l.candidate_id IS NOT NULL THEN 'satisfied' ELSE 'created' END AS status
FROM r LEFT JOIN c ON c.candidate_id = r.candidate_id LEFT JOIN t ON t.track_id = r.track_id LEFT JOIN l ON l.candidate_id = r.candidate_id AND l.track_id = r.track_id""")
def candidate_commit_plan(spark, sf):
    n = notes(spark, sf)
    ids = n.withColumnRenamed("note_id", "candidate_id")
    tracks = n.filter("track_id % 9 != 0").select("track_id").distinct().select("track_id", F.lit(40).alias("low"), F.lit(76).alias("high"))
    placed = n.filter("note_id % 3 = 0").withColumn("start_ms", F.col("start_ms") + 5)
    routes = ids.filter("candidate_id % 5 != 0").select("candidate_id", "track_id")
    return M.commit_plan(routes, ids.filter("candidate_id % 2 = 0"), tracks, placed, ids.filter("candidate_id % 11 = 0"), ids.filter("candidate_id % 13 = 0").select("candidate_id", "track_id"))


@query()
def region_replace(spark, sf):
    n = notes(spark, sf)
    incoming = n.filter("note_id % 2 = 0").withColumns({"note_id": F.col("note_id") + 1_000_000_000, "start_ms": F.col("start_ms") + F.col("note_id") % 3 * 20.0})
    return M.region_replace(n.withColumn("reviewed", F.col("note_id") % 4 == 0), incoming, 5000.0, 15000.0)


@query()
def lyric_align(spark, sf):
    n = notes(spark, sf)
    tokens = n.filter("note_id % 4 = 1").select("track_id", F.col("note_id").alias("token_id"), F.when(F.col("note_id") % 3 != 0, F.col("start_ms") + F.col("note_id") % 7 * 10 - 30).alias("time"))
    return M.lyric_align(tokens, n.filter("note_id % 2 = 0"), "melismatic")
