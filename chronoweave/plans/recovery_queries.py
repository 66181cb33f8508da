"""Queries over dense runs and crowding."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..notes import notes
from ..operators import cleanup as C
from ..operators import recovery as R
from ..operators.runs import dealt
from .base import query

#: Each note that a seventh of the ids leave out strikes three times, five frames apart and three long.
_EVIDENCE = """ev AS (SELECT track_id, pitch, s + 5 * j + k AS frame, max(0.5::DOUBLE + note_id % 5 / 10.0::DOUBLE) AS fv, max(CASE WHEN k = 0 THEN 0.7::DOUBLE + note_id % 3 / 10.0::DOUBLE ELSE 0.1 END) AS ov
FROM (SELECT track_id, note_id, pitch, CAST(floor(start_ms / 10.0) AS BIGINT) AS s FROM n WHERE note_id % 7 <> 0), range(3) a(j), range(3) b(k) GROUP BY 1, 2, 3),
xs AS (SELECT DISTINCT track_id, pitch, CAST(floor(start_ms / 10.0) AS BIGINT) + d AS frame FROM n, (VALUES (-1), (0), (1)) v(d) WHERE note_id % 4 = 1)"""
_REGULAR = "coalesce({a} BETWEEN 2 AND 8 AND {b} BETWEEN 2 AND 8 AND abs({a} - {b}) <= greatest(1, round_even(greatest({a}, {b}) * 0.35::DOUBLE, 0)), false)"


@query(f"""WITH {{N}}, {_EVIDENCE}, tp AS (SELECT track_id, frame, max(ov) AS top FROM ev GROUP BY 1, 2),
nb AS (SELECT *, CASE WHEN lag(frame) OVER w = frame - 1 THEN lag(top) OVER w ELSE 0 END AS bf, CASE WHEN lead(frame) OVER w = frame + 1 THEN lead(top) OVER w ELSE 0 END AS af FROM tp WINDOW w AS (PARTITION BY track_id ORDER BY frame)),
pk AS (SELECT track_id, frame FROM nb WHERE top >= 0.68 AND top >= bf AND top >= af),
pg AS (SELECT *, lead(frame) OVER w - frame AS n1, lead(frame, 2) OVER w - lead(frame) OVER w AS n2, frame - lag(frame) OVER w AS p1, lag(frame) OVER w - lag(frame, 2) OVER w AS p2 FROM pk WINDOW w AS (PARTITION BY track_id ORDER BY frame)),
dp AS (SELECT track_id, frame FROM pg WHERE {_REGULAR.format(a='n1', b='n2')} OR {_REGULAR.format(a='p1', b='n1')} OR {_REGULAR.format(a='p2', b='p1')}),
en AS (SELECT track_id, max(frame) + 1 AS frames FROM ev GROUP BY 1),
st AS (SELECT ev.track_id, ev.pitch, ev.frame AS s, ev.ov, ev.fv, frames FROM ev JOIN dp USING (track_id, frame) JOIN en USING (track_id) ANTI JOIN xs ON xs.track_id = ev.track_id AND xs.pitch = ev.pitch AND xs.frame = ev.frame WHERE ev.ov >= 0.68 AND frames >= 5),
mt AS (SELECT st.track_id, st.pitch, st.s, k, coalesce(ev.fv, 0) AS fv, coalesce(ev.ov, 0) AS ov FROM st, range(1, 12) r(k) LEFT JOIN ev ON ev.track_id = st.track_id AND ev.pitch = st.pitch AND ev.frame = st.s + k WHERE st.s + k < st.frames),
wk AS (SELECT *, fv < 0.3 AS weak, coalesce(lag(fv) OVER (PARTITION BY track_id, pitch, s ORDER BY k) < 0.3, false) AS wb FROM mt),
sp AS (SELECT track_id, pitch, s, min(CASE WHEN ov >= 0.68 THEN k END) AS ak, arg_min(wb, CASE WHEN ov >= 0.68 THEN k END) AS awb, min(CASE WHEN weak AND wb THEN k END) AS fk FROM wk GROUP BY 1, 2, 3),
ln AS (SELECT st.*, CASE WHEN ak IS NOT NULL AND (fk IS NULL OR ak <= fk) THEN greatest(1, ak - CASE WHEN awb THEN 1 ELSE 0 END) WHEN fk IS NOT NULL THEN fk - 1 ELSE least(frames - s, 12) END AS span FROM st LEFT JOIN sp USING (track_id, pitch, s)),
su AS (SELECT ln.track_id, ln.pitch, ln.s, ln.ov, span, round((any_value(ln.fv) + coalesce(sum(CASE WHEN k < span THEN mt.fv END), 0)) / span, 9) AS support FROM ln LEFT JOIN mt USING (track_id, pitch, s) WHERE span BETWEEN 2 AND 11 GROUP BY 1, 2, 3, 4, 5),
ok AS (SELECT *, coalesce(lag(s) OVER (PARTITION BY track_id, pitch ORDER BY s) = s - 1, false) AS beside FROM su WHERE support >= 0.38)
SELECT track_id, pitch, s AS start_frame, s + span AS end_frame, round(greatest(0, least(1, 0.55::DOUBLE * ov + 0.45::DOUBLE * support)), 9) AS confidence FROM ok WHERE NOT beside""")
def dense_run_recovery(spark, sf):
    n = notes(spark, sf)
    events = C.frame_events(n.filter("note_id % 4 = 1").withColumn("confidence", F.lit(1.0)))
    kept = n.filter("note_id % 7 != 0").select("track_id", "pitch", "note_id", F.floor(F.col("start_ms") / 10.0).alias("s"))
    # dealt by pitch as notes, a ninth of the rows, and by so many tasks as their evidence needs
    struck = dealt(kept, ["track_id", "pitch"], 9 * kept.count()).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(8)))).withColumns({"j": F.floor(F.col("x") / 3), "k": F.col("x") % 3})
    values = F.max(0.5 + F.col("note_id") % 5 / 10.0).alias("frame_value"), F.max(F.when(F.col("k") == 0, 0.7 + F.col("note_id") % 3 / 10.0).otherwise(0.1)).alias("onset_value")
    evidence = struck.groupBy("track_id", "pitch", (F.col("s") + 5 * F.col("j") + F.col("k")).alias("frame")).agg(*values)
    return R.recover_dense(evidence, events)


@query("""WITH {N8}, o AS (SELECT *, start_ms + dur_ms AS end_ms, row_number() OVER (PARTITION BY track_id ORDER BY start_ms, note_id) AS i FROM n),
ac AS (SELECT b.track_id, b.note_id AS b_id, b.i, a.note_id AS a_id, a.pitch AS a_pitch, b.pitch AS b_pitch, a.start_ms AS a_start, b.start_ms AS b_start, a.end_ms AS a_end, b.end_ms AS b_end, a.dur_ms AS a_dur, b.dur_ms AS b_dur
FROM o b JOIN o a ON a.track_id = b.track_id AND a.i < b.i AND a.end_ms > b.start_ms),
ct AS (SELECT o.track_id, o.note_id, o.i, count(a_id) AS c FROM o LEFT JOIN ac ON ac.b_id = o.note_id GROUP BY 1, 2, 3),
sa AS (SELECT *, c >= 4 AND coalesce(lag(c) OVER (PARTITION BY track_id ORDER BY i) < 4, true) AS opens FROM ct),
mk AS (SELECT DISTINCT a_id AS note_id FROM ac JOIN sa ON sa.note_id = ac.b_id AND opens),
pr AS (SELECT ac.*, least(a_end, b_end) - b_start AS shared FROM ac JOIN ct ON ct.note_id = ac.b_id AND c < 4 WHERE a_pitch <> b_pitch AND least(a_end, b_end) - b_start > 0),
ld AS (SELECT note_id, sum(x) AS x, sum(y) AS y FROM (SELECT a_id AS note_id, least(1, shared / a_dur) AS x, CASE WHEN b_start - a_start <= 35 THEN 1 ELSE 0 END AS y FROM pr UNION ALL SELECT b_id, least(1, shared / b_dur), CASE WHEN b_start - a_start <= 35 THEN 1 ELSE 0 END FROM pr) GROUP BY 1)
SELECT o.note_id, round(coalesce(x, 0), 6) AS overlap_load, CAST(coalesce(y, 0) AS BIGINT) AS onset_competitors, c >= 4 OR mk.note_id IS NOT NULL OR round(coalesce(x, 0), 6) >= 1.5 AS dense
FROM o JOIN ct USING (note_id) LEFT JOIN ld ON ld.note_id = o.note_id LEFT JOIN mk ON mk.note_id = o.note_id""")
def contamination_capped(spark, sf):
    return R.crowding(notes(spark, sf, 8), most=4, load=1.5)
