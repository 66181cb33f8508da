"""Queries over aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..notes import notes
from ..operators import aggregates as A
from ..tables import table
from .base import query

_STEPS = "SELECT track_id, start_ms AS t, 1 AS d FROM n WHERE dur_ms > 0 UNION ALL SELECT track_id, start_ms + dur_ms, -1 FROM n WHERE dur_ms > 0"


@query("WITH {N} SELECT track_id, min(start_ms) AS start_ms, max(start_ms + dur_ms) AS end_ms FROM n GROUP BY 1")
def bounds(spark, sf):
    return A.bounds(notes(spark, sf))


@query(f"""WITH {{N8}}, s AS (SELECT track_id, t, sum(d) AS d FROM ({_STEPS}) GROUP BY 1, 2), c AS (SELECT track_id, sum(d) OVER (PARTITION BY track_id ORDER BY t) AS active FROM s)
SELECT track_id, CAST(max(active) AS BIGINT) AS peak FROM c GROUP BY 1""")
def peak_concurrency(spark, sf):
    return A.peak_concurrency(notes(spark, sf, 8))


@query("""WITH {N8}, s AS (SELECT track_id // 2 AS g, t, sum(CASE WHEN track_id % 2 = 0 THEN d ELSE 0 END) AS a, sum(CASE WHEN track_id % 2 = 1 THEN d ELSE 0 END) AS b FROM
(SELECT track_id, start_ms AS t, 1 AS d FROM n WHERE dur_ms > 0 UNION ALL SELECT track_id, start_ms + dur_ms, -1 FROM n WHERE dur_ms > 0) GROUP BY 1, 2),
c AS (SELECT g, t, sum(a) OVER w > 0 AND sum(b) OVER w > 0 AS bo, lead(t) OVER w AS nx FROM s WINDOW w AS (PARTITION BY g ORDER BY t)),
f AS (SELECT *, CASE WHEN bo AND NOT coalesce(lag(bo) OVER (PARTITION BY g ORDER BY t), false) THEN 1 ELSE 0 END AS fresh FROM c),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY g ORDER BY t) AS run FROM f)
SELECT CAST(g AS BIGINT) AS track_id, min(t) AS start_ms, max(nx) AS end_ms FROM r WHERE bo GROUP BY g, run""")
def sweep_regions(spark, sf):
    n = notes(spark, sf, 8).withColumn("half", F.col("track_id") % 2).withColumn("track_id", F.floor(F.col("track_id") / 2))
    return A.sweep_regions(n.filter("half = 0"), n.filter("half = 1"))


@query("""WITH {N}, c AS (SELECT track_id, pitch % 12 AS pc, sum(greatest(1.0::DOUBLE, least(dur_ms, 1600.0::DOUBLE) / 120)) AS w, count(*) AS n FROM n GROUP BY 1, 2),
k AS (SELECT t AS tonic, m AS mode, list_transform(s, lambda x: (x + t) % 12) AS scale FROM range(12) r(t), (VALUES ('major', [0,2,4,5,7,9,11]), ('minor', [0,2,3,5,7,8,10])) v(m, s)),
s AS (SELECT track_id, tonic, mode, round(sum(CASE WHEN list_contains(scale, pc) THEN w ELSE 0 END) / sum(w), 6) AS score, sum(n) AS n FROM c, k GROUP BY 1, 2, 3),
b AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY score DESC, tonic, mode) AS r FROM s WHERE n >= 5)
SELECT track_id, CAST(tonic AS INTEGER) AS tonic, mode, score FROM b WHERE r = 1""")
def key_histogram(spark, sf):
    return A.key_histogram(notes(spark, sf))


@query("""WITH {N} SELECT track_id, count(*) AS n, round(avg(pitch), 9) AS mean_pitch, round(avg(dur_ms), 9) AS mean_dur, round(avg(CASE WHEN dur_ms < 120 THEN 1.0::DOUBLE ELSE 0 END), 6) AS short_ratio,
round(count(DISTINCT pitch) / count(*)::DOUBLE, 6) AS pitch_ratio, max(start_ms + dur_ms) - min(start_ms) AS span_ms, round(count(*) * 1000.0::DOUBLE / nullif(max(start_ms + dur_ms) - min(start_ms), 0), 6) AS density FROM n GROUP BY 1""")
def track_features(spark, sf):
    return A.track_features(notes(spark, sf))


@query("""WITH {N8}, p AS (SELECT track_id, CAST(round_even(start_ms * 1000, 0) AS BIGINT) AS at_us, list_sort(list(note_id)) AS members, avg(vel) AS mean_vel FROM n GROUP BY 1, 2)
SELECT track_id, at_us, len(members) AS members, mean_vel FROM p""")
def velocity_points(spark, sf):
    return A.velocity_points(notes(spark, sf, 8)).withColumn("members", F.size("members").cast("long"))


@query("WITH {N8}, c AS (SELECT track_id, round_even(start_ms / 10.0, 0) AS at, count(*) AS c FROM n GROUP BY 1, 2) SELECT track_id, max(c) AS peak FROM c GROUP BY 1")
def onset_density_peak(spark, sf):
    return A.onset_density_peak(notes(spark, sf, 8), ms=10.0)


@query("SELECT l_suppkey, count(*) AS notes, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1 HAVING count(*) > 100")
def notes_per_instrument(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("notes"), F.count_distinct("l_partkey").alias("parts")).filter("notes > 100")


@query("WITH {N} SELECT count(*) AS notes, count(DISTINCT track_id) AS tracks, min(pitch) AS low, max(pitch) AS high, max(start_ms + dur_ms) AS end_ms FROM n")
def score_summary(spark, sf):
    return notes(spark, sf).agg(F.count("*").alias("notes"), F.count_distinct("track_id").alias("tracks"), F.min("pitch").alias("low"), F.max("pitch").alias("high"), F.max(F.col("start_ms") + F.col("dur_ms")).alias("end_ms"))


@query("SELECT l_partkey, min(l_orderkey) AS first_at FROM lineitem GROUP BY 1")
def distinct_preserving_order(spark, sf):
    return A.first_seen(table(spark, sf, "lineitem"), "l_partkey", "l_orderkey")


@query("""WITH r AS (SELECT label, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM embeddings),
x AS (SELECT label, unnest(range(len(embedding))) AS dim, unnest(embedding)::DOUBLE AS x FROM r WHERE r <= 32)
SELECT label, CAST(dim AS INTEGER) AS dim, median(x) AS median FROM x GROUP BY 1, 2""")
def median_profile(spark, sf):
    return A.median_profile(table(spark, sf, "embeddings"), "label", "vec_id", "embedding")


@query("""WITH {N}, s AS (SELECT *, abs(pitch - lag(pitch) OVER (PARTITION BY track_id ORDER BY start_ms, note_id)) AS step FROM n)
SELECT track_id, median(pitch) AS median_pitch, round(avg(dur_ms), 6) AS mean_dur, count(*) FILTER (step > 7) AS leaps, round(avg(CASE WHEN step <= 2 THEN 1.0::DOUBLE WHEN step > 2 THEN 0 END), 6) AS continuity FROM s GROUP BY 1""")
def voice_stats(spark, sf):
    return A.voice_stats(notes(spark, sf))


@query("""WITH {N}, s AS (SELECT track_id, round(avg(pitch), 9) AS mp, round(avg(CASE WHEN dur_ms < 120 THEN 1.0::DOUBLE ELSE 0 END), 6) AS sr, round(count(DISTINCT pitch) / count(*)::DOUBLE, 6) AS pr FROM n GROUP BY 1),
x AS (SELECT min(mp) AS lo, max(mp) AS hi FROM s)
SELECT track_id, CASE WHEN pr < 0.05 THEN 'drone' WHEN mp < lo + (hi - lo) / 3 THEN 'bass' WHEN mp > hi - (hi - lo) / 3 AND sr < 0.5 THEN 'melody' ELSE 'inner' END AS role FROM s, x""")
def role_inference(spark, sf):
    return A.role_inference(A.track_features(notes(spark, sf)))


@query("""WITH {N}, l AS (SELECT track_id, ntype, sum(vel) AS w, count(*) AS n FROM n GROUP BY 1, 2), b AS (SELECT *, sum(w) OVER (PARTITION BY track_id) AS al, sum(n) OVER (PARTITION BY track_id) AS c, row_number() OVER (PARTITION BY track_id ORDER BY w DESC, ntype) AS r FROM l)
SELECT track_id, ntype, round(w / al::DOUBLE, 6) AS share FROM b WHERE r = 1 AND round(w / al::DOUBLE, 6) >= 0.3 AND c >= 3""")
def label_majority(spark, sf):
    return A.label_majority(notes(spark, sf), "track_id", "ntype", F.col("vel"), share=0.3)


@query("""WITH m AS (SELECT d.lang, quality = 1 AS t, n_chars BETWEEN 200 AND 20000 AS g FROM documents d JOIN labels l ON d.doc_id = l.doc_id)
SELECT lang, count(*) FILTER (t AND g) AS matched, round(count(*) FILTER (t AND g) / greatest(1, count(*) FILTER (g))::DOUBLE, 6) AS "precision", round(count(*) FILTER (t AND g) / greatest(1, count(*) FILTER (t))::DOUBLE, 6) AS recall,
round(2.0::DOUBLE * count(*) FILTER (t AND g) / greatest(1, count(*) FILTER (g) + count(*) FILTER (t)), 6) AS f1 FROM m GROUP BY 1""")
def prf_metrics(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf, "labels"), "doc_id")
    return A.prf_metrics(rows, F.col("quality") == 1, F.col("n_chars").between(200, 20000), [F.col("lang")])


@query("SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type = 'error') AS error FROM events GROUP BY 1")
def coverage_report(spark, sf):
    return A.coverage_report(table(spark, sf, "events"), "user_id", "event_type", ["click", "view", "error"])


@query("SELECT user_id, CAST(greatest(0, 100 - sum(CASE event_type WHEN 'error' THEN 5 WHEN 'click' THEN 1 ELSE 0 END)) AS BIGINT) AS score FROM events GROUP BY 1")
def readiness_score(spark, sf):
    return A.readiness_score(table(spark, sf, "events"), "user_id", F.when(F.col("event_type") == "error", 5).when(F.col("event_type") == "click", 1).otherwise(0))


@query("""WITH {N8}, s AS (SELECT DISTINCT track_id, round_even(start_ms * 1000, 0) / 1000.0::DOUBLE AS s FROM n), g AS (SELECT *, s / 500.0::DOUBLE * 4 AS x, s - lag(s) OVER w AS g1, lead(s) OVER w - s AS g2 FROM s WINDOW w AS (PARTITION BY track_id ORDER BY s)),
r AS (SELECT *, greatest(g1, g2) / least(g1, g2) AS ratio FROM g WHERE true)
SELECT track_id, round(avg(CASE WHEN abs(x - round_even(x, 0)) / 4 > 0.07 THEN 1.0::DOUBLE ELSE 0 END), 6) AS off_grid, round(avg(CASE WHEN g1 IS NOT NULL AND g2 IS NOT NULL AND g1 + g2 <= 575.0 AND ratio BETWEEN 1.25 AND 3.2 THEN ratio END), 6) AS swing FROM r GROUP BY 1""")
def style_syncopation(spark, sf):
    return A.style_syncopation(notes(spark, sf, 8))


@query("""WITH {N8}, p AS (SELECT track_id, CAST(floor(start_ms / 500.0) AS BIGINT) AS beat, pitch, quantile_cont(vel, 0.9) AS p FROM n GROUP BY 1, 2, 3)
SELECT track_id, beat, pitch % 12 AS pc, round(sum(p), 6) AS p90 FROM p GROUP BY 1, 2, 3""")
def beat_percentile(spark, sf):
    return A.beat_percentile(notes(spark, sf, 8))


@query("""WITH {N8}, p AS (SELECT track_id, CAST(floor(start_ms / 2000.0) AS BIGINT) AS beat, pitch % 12 AS pc, sum(dur_ms) AS w FROM n GROUP BY 1, 2, 3),
k AS (SELECT t AS root, m AS quality, list_transform(s, lambda x: (x + t) % 12) AS tones FROM range(12) r(t), (VALUES ('major', [0,4,7]), ('minor', [0,3,7])) v(m, s)),
s AS (SELECT track_id, beat, root, quality, round(0.7::DOUBLE * sum(CASE WHEN list_contains(tones, pc) THEN w ELSE 0 END) / sum(w) + 0.1::DOUBLE * count(*) FILTER (list_contains(tones, pc)), 6) AS score FROM p, k GROUP BY 1, 2, 3, 4),
b AS (SELECT *, row_number() OVER (PARTITION BY track_id, beat ORDER BY score DESC, root, quality) AS r FROM s)
SELECT track_id, beat, CAST(root AS INTEGER) AS root, quality, score FROM b WHERE r = 1""")
def triad_scores(spark, sf):
    return A.triad_scores(notes(spark, sf, 8))


@query("""WITH {N}, o AS (SELECT DISTINCT track_id, CAST(floor(start_ms / 24.0) AS BIGINT) AS b FROM n), z AS (SELECT track_id, count(*) AS c, any_value(lo) AS lo, any_value(hi) AS hi FROM o JOIN (SELECT track_id, min(pitch) AS lo, max(pitch) AS hi FROM n GROUP BY 1) USING (track_id) GROUP BY 1),
s AS (SELECT x.track_id AS a, y.track_id AS b, count(*) AS shared FROM o x JOIN o y ON x.b = y.b AND x.track_id < y.track_id GROUP BY 1, 2)
SELECT a, s.b, shared, round(shared / least(p.c, q.c)::DOUBLE, 6) AS ratio, round(greatest(0, least(p.hi, q.hi) - greatest(p.lo, q.lo)) / greatest(1, least(p.hi - p.lo, q.hi - q.lo))::DOUBLE, 6) AS registers FROM s JOIN z p ON a = p.track_id JOIN z q ON s.b = q.track_id""")
def pairwise_tracks(spark, sf):
    return A.pairwise_tracks(notes(spark, sf))
