"""Queries over arrangements: orders, boundaries, contours, free places, reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..notes import notes
from ..operators import arrange as R
from ..tables import table
from .base import query


@query("WITH {N} SELECT track_id, note_id, CAST(row_number() OVER (PARTITION BY track_id ORDER BY start_ms, pitch, dur_ms, vel, ntype, note_id) AS INTEGER) AS place FROM n")
def canonical_sort(spark, sf):
    return R.canonical_sort(notes(spark, sf)).select("track_id", "note_id", "place")


@query("WITH {N}, e AS (SELECT track_id % 8 AS song, track_id AS lane, note_id, CAST(round_even(start_ms, 0) AS BIGINT) AS tick FROM n) SELECT song, lane, note_id, CAST(row_number() OVER (PARTITION BY song ORDER BY tick, lane, note_id) AS INTEGER) AS place FROM e")
def kway_merge(spark, sf):
    events = notes(spark, sf).select((F.col("track_id") % 8).alias("song"), F.col("track_id").alias("lane"), "note_id", F.bround("start_ms").cast("long").alias("tick"))
    return R.kway_merge(events, "song", "lane", "note_id", "tick").drop("tick")


@query("SELECT o_orderkey, o_orderdate, CAST(row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS INTEGER) AS place FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20")
def topk_heap(spark, sf):
    return R.newest(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey", 20)


@query("WITH {N} SELECT track_id, CAST(round_even(start_ms / 12.0, 0) AS BIGINT) AS bucket, count(*) AS n, min(note_id) AS first_id FROM n GROUP BY 1, 2")
def bucket_cluster(spark, sf):
    return R.bucket_cluster(notes(spark, sf))


def _list(values) -> str:
    return "[" + ", ".join(f"{v!r}::DOUBLE" for v in values) + "]"


@query(f"""WITH {{N8}}, s(p0, bpm, b0) AS (VALUES (100.0::DOUBLE, 90.0::DOUBLE, 0.0::DOUBLE), (5000.0, 120.0, 7.35), (12000.0, 140.0, 21.35), (20000.0, 75.0, 40.0)),
p AS (SELECT n.*, s.* FROM n JOIN s ON s.p0 = coalesce((SELECT max(p0) FROM s WHERE p0 <= n.start_ms), 100.0)), b AS (SELECT *, round(b0 + (start_ms - p0) * bpm / 60000, 9) AS beat, dur_ms * bpm / 60000 AS len FROM p), f AS (SELECT *, round(beat - floor(beat), 9) AS phase FROM b)
SELECT note_id, beat, phase, round(list_min(list_transform({_list(R.SUBDIVISIONS)}, lambda x: abs(phase - x))), 6) AS distance,
round(least(1, greatest(0, 1 - list_min(list_transform({_list(R.LENGTHS)}, lambda x: abs(len - x))) / greatest(0.125::DOUBLE, len * 0.25::DOUBLE))), 6) AS fit FROM f""")
def bar_position(spark, sf):
    tempo = [(t, a, b, c) for t in range(8) for a, b, c in ((100.0, 90.0, 0.0), (5000.0, 120.0, 7.35), (12000.0, 140.0, 21.35), (20000.0, 75.0, 40.0))]
    return R.bar_position(notes(spark, sf, 8), spark.createDataFrame(tempo, "track_id long, start_ms double, bpm double, beat_at_start double"))


@query("""WITH {N8}, m AS (SELECT DISTINCT track_id, floor(start_ms * 1e6::DOUBLE + 0.5) / 1e6::DOUBLE AS x FROM n WHERE note_id % 5 = 0 AND start_ms >= 0), p AS (SELECT track_id, note_id AS probe_id, start_ms AS "at" FROM n),
e AS (SELECT track_id, min(x) AS lo, max(x) AS hi FROM m GROUP BY 1)
SELECT p.track_id, p.probe_id, p."at", coalesce((SELECT max(m.x) FROM m WHERE m.track_id = p.track_id AND m.x < p."at" - 1e-6::DOUBLE), lo) AS previous, coalesce((SELECT min(m.x) FROM m WHERE m.track_id = p.track_id AND m.x > p."at" + 1e-6::DOUBLE), hi) AS next
FROM p JOIN e ON e.track_id = p.track_id""")
def neighbor_boundary(spark, sf):
    n = notes(spark, sf, 8)
    return R.neighbor_boundary(n.select("track_id", F.col("note_id").alias("probe_id"), F.col("start_ms").alias("at")), n.filter("note_id % 5 = 0").select("track_id", F.col("start_ms").alias("at")))


@query("""WITH {N8}, m AS (SELECT track_id, note_id, CASE WHEN note_id % 9 = 0 THEN '' ELSE 'm' || CAST(note_id % 700 AS VARCHAR) END AS marker_id, CASE WHEN note_id % 8 = 1 THEN ' ' ELSE ' at ' || CAST(pitch AS VARCHAR) || ' ' END AS label,
CASE WHEN note_id % 7 = 2 THEN -start_ms WHEN note_id % 11 = 3 THEN NULL ELSE start_ms END AS time_ms FROM n),
v AS (SELECT *, row_number() OVER (PARTITION BY track_id, marker_id ORDER BY note_id) AS i FROM m WHERE trim(marker_id) <> '' AND trim(label) <> '' AND time_ms IS NOT NULL),
k AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY note_id) AS j FROM v WHERE i = 1)
SELECT track_id, marker_id, trim(label) AS label, least(greatest(time_ms, 0), 86400000) AS time_ms FROM k WHERE j <= 512""")
def marker_normalize(spark, sf):
    label = F.when(F.col("note_id") % 8 == 1, " ").otherwise(F.concat(F.lit(" at "), F.col("pitch").cast("string"), F.lit(" ")))
    at = F.when(F.col("note_id") % 7 == 2, -F.col("start_ms")).when(F.col("note_id") % 11 == 3, F.lit(None)).otherwise(F.col("start_ms"))
    marks = notes(spark, sf, 8).select("track_id", "note_id", F.when(F.col("note_id") % 9 == 0, "").otherwise(F.concat(F.lit("m"), (F.col("note_id") % 700).cast("string"))).alias("marker_id"), label.alias("label"), at.alias("time_ms"))
    return R.marker_normalize(marks, ("track_id",), "note_id")


@query("""WITH {N}, c AS (SELECT *, note_id % 100 / 100.0::DOUBLE AS confidence, start_ms + dur_ms AS e, CASE WHEN start_ms - lag(start_ms + dur_ms) OVER w <= 175 THEN 0 ELSE 1 END AS fr FROM n WINDOW w AS (PARTITION BY track_id ORDER BY start_ms, note_id)),
p AS (SELECT *, sum(fr) OVER (PARTITION BY track_id ORDER BY start_ms, note_id) AS phrase FROM c), a AS (SELECT *, min(start_ms) OVER (PARTITION BY track_id, phrase) AS anchor FROM p),
b AS (SELECT track_id, phrase, floor((start_ms - anchor) / 250) AS bucket, round(sum(start_ms * (0.25::DOUBLE + confidence)) / sum(0.25::DOUBLE + confidence), 9) AS x, round(sum(pitch * (0.25::DOUBLE + confidence)) / sum(0.25::DOUBLE + confidence), 6) AS pitch,
round(avg(confidence), 6) AS confidence, min(start_ms) AS low, max(e) AS high FROM a GROUP BY 1, 2, 3),
l AS (SELECT *, count(*) OVER (PARTITION BY track_id, phrase) AS k, lead(x) OVER w AS x2, lead(pitch) OVER w AS pitch2, lead(confidence) OVER w AS c2 FROM b WINDOW w AS (PARTITION BY track_id, phrase ORDER BY bucket))
SELECT track_id, CASE WHEN k = 1 THEN low ELSE x END AS start_ms, CASE WHEN k = 1 THEN high ELSE x2 END AS end_ms, pitch AS start_pitch, CASE WHEN k = 1 THEN pitch ELSE pitch2 END AS end_pitch, CASE WHEN k = 1 THEN confidence ELSE least(confidence, c2) END AS confidence
FROM l WHERE k = 1 OR abs(pitch - pitch2) <= 7""")
def overview_contour(spark, sf):
    return R.overview_contour(notes(spark, sf).withColumn("confidence", F.col("note_id") % 100 / 100.0))


@query("""WITH {N}, c AS (SELECT *, CASE WHEN start_ms - max(start_ms + dur_ms) OVER (PARTITION BY track_id ORDER BY start_ms, note_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 60 THEN 0 ELSE 1 END AS fr FROM n),
p AS (SELECT *, sum(fr) OVER (PARTITION BY track_id ORDER BY start_ms, note_id) AS ph FROM c),
g AS (SELECT track_id, ph, min(note_id) AS fragment_id, min(start_ms) AS s, max(start_ms + dur_ms) AS e, list(DISTINCT pitch) AS ps, CASE WHEN avg(pitch) < 60 THEN 'low' ELSE 'high' END AS role FROM p GROUP BY 1, 2),
l AS (SELECT *, s - lag(e) OVER w AS pause, role = lag(role) OVER w AS same, lag(ps) OVER w AS pp FROM g WINDOW w AS (PARTITION BY track_id ORDER BY s, e, fragment_id)),
f AS (SELECT *, CASE WHEN coalesce(same AND pause >= 0 AND pause <= 300 AND len(list_filter(ps, lambda x: len(list_filter(pp, lambda y: abs(x - y) <= 5)) > 0)) > 0, false) THEN 0 ELSE 1 END AS fr FROM l)
SELECT track_id, fragment_id, CAST(sum(fr) OVER (PARTITION BY track_id ORDER BY s, e, fragment_id) AS BIGINT) AS cluster FROM f""")
def predictive_clusters(spark, sf):
    w = Window.partitionBy("track_id").orderBy("start_ms", "note_id")
    end = F.col("start_ms") + F.col("dur_ms")
    fresh = F.when(F.col("start_ms") - F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1)) <= 60, 0).otherwise(1)
    cut = notes(spark, sf).withColumn("fr", fresh).withColumn("ph", F.sum("fr").over(w))
    fragments = cut.groupBy("track_id", "ph").agg(F.min("note_id").alias("fragment_id"), F.min("start_ms").alias("start_ms"), F.max(end).alias("end_ms"), F.collect_set("pitch").alias("pitches"), F.when(F.avg("pitch") < 60, "low").otherwise("high").alias("role"))
    return R.predictive_clusters(fragments, 300.0, 5)


@query("""WITH RECURSIVE {N}, o AS (SELECT track_id, floor(start_ms / 400) * 400 AS lo, max(least(dur_ms, 350.0::DOUBLE)) AS d FROM n WHERE note_id % 3 <> 0 GROUP BY 1, 2), q AS (SELECT track_id, lo, lo + d AS hi FROM o WHERE d > 0),
qi AS (SELECT *, lag(hi) OVER w AS before, lead(lo) OVER w AS after FROM q WINDOW w AS (PARTITION BY track_id ORDER BY lo)),
c AS (SELECT track_id, note_id AS clip_id, start_ms AS s, least(dur_ms * 3, 900.0::DOUBLE) AS d FROM n WHERE note_id % 3 = 0),
h AS (SELECT c.*, max(q.lo) AS hit FROM c LEFT JOIN q ON q.track_id = c.track_id AND q.lo < c.s + c.d AND c.s < q.hi AND c.d > 0 GROUP BY 1, 2, 3, 4),
x AS (SELECT h.*, (SELECT min(hi) FROM qi WHERE qi.track_id = h.track_id AND qi.lo >= h.hit AND (after IS NULL OR hi + h.d <= after)) AS r, (SELECT max(lo) - h.d FROM qi WHERE qi.track_id = h.track_id AND qi.lo <= h.hit AND lo - coalesce(before, 0) >= h.d) AS l FROM h)
SELECT track_id, clip_id, CASE WHEN hit IS NULL THEN s WHEN l IS NOT NULL AND l >= 0 AND abs(l - s) <= abs(r - s) THEN l ELSE r END AS start_ms FROM x""")
def free_slot(spark, sf):
    n = notes(spark, sf)
    taken = n.filter("note_id % 3 != 0").groupBy("track_id", (F.floor(F.col("start_ms") / 400) * 400).cast("double").alias("start_ms")).agg(F.max(F.least("dur_ms", F.lit(350.0))).alias("d")).filter("d > 0")
    wanted = n.filter("note_id % 3 = 0").select("track_id", F.col("note_id").alias("clip_id"), "start_ms", F.least(F.col("dur_ms") * 3, F.lit(900.0)).alias("dur_ms"))
    return R.free_slot(wanted, taken.select("track_id", "start_ms", (F.col("start_ms") + F.col("d")).alias("end_ms")))


@query("""WITH {N}, t AS (SELECT track_id, min(start_ms) AS lo, max(start_ms) - min(start_ms) AS w FROM n GROUP BY 1),
c AS (SELECT track_id, track_id * 4 + i AS clip_id, lo + w * i / 5 AS cs, lo + w * (i + 2) / 5 AS ce, i * 100.0::DOUBLE AS off, lo + w * i / 5 + i * 100 + 10 AS ws, lo + w * (i + 2) / 5 + i * 100 - 10 AS we FROM t, range(4) r(i))
SELECT n.track_id, note_id AS control_id, clip_id, start_ms + off AS at_ms FROM n JOIN c ON n.track_id = c.track_id AND start_ms >= cs AND start_ms < ce AND start_ms >= ws - off AND start_ms < we - off""")
def clip_controls_projection(spark, sf):
    n = notes(spark, sf)
    spans = n.groupBy("track_id").agg(F.min("start_ms").alias("lo"), (F.max("start_ms") - F.min("start_ms")).alias("w")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(3))))
    low, high = F.col("lo") + F.col("w") * F.col("i") / 5, F.col("lo") + F.col("w") * (F.col("i") + 2) / 5
    clips = spans.select("track_id", (F.col("track_id") * 4 + F.col("i")).alias("clip_id"), low.alias("content_start_ms"), high.alias("content_end_ms"), (F.col("i") * 100.0).alias("offset_ms"), (low + F.col("i") * 100 + 10).alias("clip_start_ms"), (high + F.col("i") * 100 - 10).alias("clip_end_ms"))
    return R.clip_controls(n.select("track_id", F.col("note_id").alias("control_id"), F.col("start_ms").alias("at_ms")), clips, 2000.0)


@query("""WITH {N8}, m AS (SELECT track_id // 2 AS pair, track_id % 2 AS side, note_id, pitch, vel % 4 AS vel, round_even(start_ms / 20, 0) * 20 AS s, 10.0::DOUBLE + note_id % 3 * 10 AS d, ntype FROM n), a AS (SELECT * FROM m WHERE side = 0), b AS (SELECT * FROM m WHERE side = 1),
k AS (SELECT pair, count(*) FILTER (side = 0) AS n_a, count(*) FILTER (side = 1) AS n_b FROM m GROUP BY 1),
o AS (SELECT a.pair, count(*) AS overlap_pairs, count(*) FILTER (a.pitch = b.pitch) AS same_pitch_pairs FROM a JOIN b ON a.pair = b.pair AND a.s < b.s + b.d AND b.s < a.s + a.d GROUP BY 1),
x AS (SELECT pair, sum(least(ca, cb)) AS exact_duplicates FROM (SELECT pair, pitch, vel, s, d, ntype, count(*) AS ca FROM a GROUP BY ALL) JOIN (SELECT pair, pitch, vel, s, d, ntype, count(*) AS cb FROM b GROUP BY ALL) USING (pair, pitch, vel, s, d, ntype) GROUP BY 1),
st AS (SELECT pair, t, sum(CASE WHEN side = 0 THEN v ELSE 0 END) AS va, sum(CASE WHEN side = 1 THEN v ELSE 0 END) AS vb FROM (SELECT pair, side, s AS t, 1 AS v FROM m UNION ALL SELECT pair, side, s + d, -1 FROM m) GROUP BY 1, 2),
cu AS (SELECT pair, t, sum(va) OVER w AS na, sum(vb) OVER w AS nb, lead(t) OVER w AS nx FROM st WINDOW w AS (PARTITION BY pair ORDER BY t)),
fr AS (SELECT *, CASE WHEN na > 0 AND nb > 0 AND NOT coalesce(lag(na > 0 AND nb > 0) OVER (PARTITION BY pair ORDER BY t), false) THEN 1 ELSE 0 END AS f FROM cu),
rg AS (SELECT pair, sum(f) AS regions, round(sum(CASE WHEN na > 0 AND nb > 0 THEN nx - t ELSE 0 END), 6) AS overlap_ms, max(na + nb) AS peak FROM fr GROUP BY 1)
SELECT CAST(k.pair AS BIGINT) AS pair, n_a, n_b, coalesce(overlap_pairs, 0) AS overlap_pairs, coalesce(same_pitch_pairs, 0) AS same_pitch_pairs, CAST(coalesce(exact_duplicates, 0) AS BIGINT) AS exact_duplicates, CAST(regions AS BIGINT) AS regions, overlap_ms, CAST(peak AS BIGINT) AS peak,
n_a + n_b AS n, greatest(1, CAST(ceil((n_a + n_b) / 730.0) AS BIGINT)) AS chunks FROM k LEFT JOIN o USING (pair) LEFT JOIN x USING (pair) LEFT JOIN rg USING (pair)""")
def merge_report(spark, sf):
    m = notes(spark, sf, 8).select(F.floor(F.col("track_id") / 2).alias("pair"), (F.col("track_id") % 2).alias("side"), "note_id", "pitch", (F.col("vel") % 4).alias("vel"), (F.bround(F.col("start_ms") / 20) * 20).alias("start_ms"), (10.0 + F.col("note_id") % 3 * 10).alias("dur_ms"), "ntype")
    return R.merge_report(m.filter("side = 0").drop("side"), m.filter("side = 1").drop("side"))


@query("""WITH {N}, s AS (SELECT track_id, round(count(*) * 1000.0::DOUBLE / greatest(1, max(start_ms + dur_ms) - min(start_ms)), 6) AS density, round(avg(CASE WHEN dur_ms >= 60 THEN 1.0::DOUBLE ELSE 0 END), 6) AS long_ratio FROM n GROUP BY 1), l(v) AS (VALUES (0.0::DOUBLE), (15.0), (30.0), (45.0), (60.0))
SELECT track_id, density, long_ratio, (SELECT v FROM l ORDER BY abs(round(60 * long_ratio, 6) - v), v LIMIT 1) AS reverb, (SELECT v FROM l ORDER BY abs(round(45 / (1 + density), 6) - v), v LIMIT 1) AS delay FROM s""")
def effect_rules(spark, sf):
    return R.effect_rules(notes(spark, sf))


@query("""WITH {N}, m AS (SELECT *, track_id % 8 AS song FROM n), t AS (SELECT song, track_id, avg(pitch) AS mean, count(DISTINCT floor(start_ms / 24)) AS onsets FROM m GROUP BY 1, 2),
lo AS (SELECT song, 'low_tracks' AS code, CAST(count(*) AS DOUBLE) AS priority FROM t WHERE mean < 58 GROUP BY 1 HAVING count(*) >= 3), o AS (SELECT DISTINCT song, track_id, floor(start_ms / 24) AS b FROM m),
sh AS (SELECT x.song, x.track_id AS a, y.track_id AS b, count(*) AS k FROM o x JOIN o y ON x.song = y.song AND x.b = y.b AND x.track_id < y.track_id GROUP BY 1, 2, 3),
rh AS (SELECT sh.song, 'rhythm_overlap' AS code, round(max(k / least(p.onsets, q.onsets)::DOUBLE), 6) AS priority FROM sh JOIN t p ON p.track_id = a JOIN t q ON q.track_id = sh.b WHERE abs(p.mean - q.mean) < 12 GROUP BY 1),
d AS (SELECT DISTINCT song, floor(start_ms / 45) AS b FROM m WHERE ntype = 99), bs AS (SELECT song, note_id, floor(start_ms / 45) AS b FROM m WHERE ntype <> 99 AND pitch < 48),
mt AS (SELECT bs.song, count(DISTINCT note_id) AS met FROM bs JOIN d ON d.song = bs.song AND abs(d.b - bs.b) <= 1 GROUP BY 1),
bo AS (SELECT bs.song, 'bass_off_drums' AS code, round(1 - coalesce(any_value(met), 0) / count(*)::DOUBLE, 6) AS priority FROM bs LEFT JOIN mt ON mt.song = bs.song GROUP BY 1),
u AS (SELECT * FROM lo UNION ALL SELECT * FROM rh WHERE priority > 0 UNION ALL SELECT * FROM bo WHERE priority > 0), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY song ORDER BY priority DESC, code) AS INTEGER) AS place FROM u)
SELECT song, place, code, priority FROM r WHERE place <= 3""")
def suggestions_topn(spark, sf):
    return R.suggestions(notes(spark, sf).withColumn("song", F.col("track_id") % 8))
