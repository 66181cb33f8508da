"""Queries over folds and grouped decoders. Those without SQL are tested against naive versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..notes import notes
from ..operators import folds as L
from ..operators import sequential as Q
from .base import query


@query("""WITH RECURSIVE {N8}, r AS (SELECT track_id, note_id, start_ms, row_number() OVER (PARTITION BY track_id ORDER BY start_ms, note_id) AS i FROM n),
f AS (SELECT track_id, i, note_id, start_ms AS anchor_ms FROM r WHERE i = 1 UNION ALL
SELECT r.track_id, r.i, r.note_id, CASE WHEN r.start_ms - f.anchor_ms <= 12 THEN f.anchor_ms ELSE r.start_ms END FROM f JOIN r ON r.track_id = f.track_id AND r.i = f.i + 1)
SELECT track_id, note_id, anchor_ms FROM f""")
def anchor_cluster(spark, sf):
    return L.anchor_cluster(notes(spark, sf, 8))


@query()
def fold_same_pitch(spark, sf):
    return L.fold_same_pitch(notes(spark, sf, 8))


@query()
def nms(spark, sf):
    return Q.nms(notes(spark, sf, 8).withColumn("confidence", F.col("note_id") % 100 / 100.0))


@query()
def note_matching(spark, sf):
    n = notes(spark, sf)
    return Q.note_matching(n.filter("track_id % 2 = 0"), n.filter("track_id % 2 = 1"))


@query()
def voice_tracking(spark, sf):
    return Q.voice_tracking(notes(spark, sf))


@query()
def viterbi_four_states(spark, sf):
    beats = notes(spark, sf).groupBy("track_id", F.floor(F.col("start_ms") / 500.0).alias("beat")).agg(*(F.round(F.sum(F.when(F.pmod("pitch", F.lit(4)) == k, F.col("vel"))) / 127.0, 6).alias(f"s{k}") for k in range(4)))
    return Q.viterbi(beats.select("track_id", "beat", F.array(*(F.coalesce(f"s{k}", F.lit(0.0)) for k in range(4))).alias("scores")), 4)


@query("""WITH {N8}, e AS (SELECT track_id AS channel, pitch, vel, start_ms AS t, note_id * 2 AS seq, true AS o FROM n UNION ALL SELECT track_id, pitch, vel, start_ms + dur_ms, note_id * 2 + 1, false FROM n WHERE note_id % 9 <> 0),
l AS (SELECT *, lead(t) OVER (PARTITION BY channel, pitch ORDER BY t, seq) AS nx FROM e)
SELECT channel, pitch, vel, t AS start_ms, coalesce(nx - t, 100.0) AS dur_ms FROM l WHERE o""")
def event_pairing(spark, sf):
    n = notes(spark, sf, 8)
    row = lambda at, seq, on: n.select(F.col("track_id").alias("channel"), "pitch", "vel", at.alias("at_ms"), seq.alias("seq"), F.lit(on).alias("on"), "note_id")
    ons, offs = row(F.col("start_ms"), F.col("note_id") * 2, True), row(F.col("start_ms") + F.col("dur_ms"), F.col("note_id") * 2 + 1, False)
    return Q.event_pairing(ons.unionByName(offs.filter("note_id % 9 != 0")))


@query("""WITH {N8}, r AS (SELECT *, max(start_ms + dur_ms) OVER (PARTITION BY track_id, pitch ORDER BY start_ms, note_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM n),
g AS (SELECT *, sum(CASE WHEN start_ms - reached <= 20 THEN 0 ELSE 1 END) OVER (PARTITION BY track_id, pitch ORDER BY start_ms, note_id) AS run FROM r)
SELECT track_id, pitch, min(start_ms) AS start_ms, max(start_ms + dur_ms) AS end_ms, count(*) AS n FROM g GROUP BY track_id, pitch, run""")
def merge_gaps(spark, sf):
    return Q.merge_gaps(notes(spark, sf, 8))


@query()
def instance_limit(spark, sf):
    return Q.instance_limit(notes(spark, sf, 8).withColumn("track_id", F.lit(0).cast("long")))


@query()
def instance_plan(spark, sf):
    """Tracks are groups and pitches scopes; some groups refuse new notes, some have no limit."""
    n = notes(spark, sf, 8).withColumns({"pitch": F.col("pitch") % 4, "dur_ms": F.col("dur_ms") * 4})
    return Q.instance_plan(n.select("note_id", F.col("track_id").alias("group_id"), F.col("pitch").alias("scope_id"), "start_ms", "dur_ms", (F.col("track_id") % 4).alias("most"), (F.col("track_id") % 3 == 1).alias("newest")))
