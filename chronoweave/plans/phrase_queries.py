"""Queries over changes of colour, budgets and reviews."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..notes import notes
from ..operators import phrases as P
from ..operators import reviews as V
from .base import query


@query()
def voice_refine_timbre(spark, sf):
    """Groups are a track's notes in three seconds; the colour follows velocity and length, and for some groups the half in which a note lies."""
    n = notes(spark, sf, 32)
    late = F.when((F.floor(F.col("start_ms") / 1500.0) % 2 == 1) & (F.floor(F.col("start_ms") / 3000.0) % 3 == 0), 6.0).otherwise(0.0)
    return P.split_by_timbre(n.select((F.col("track_id") * 1000 + F.floor(F.col("start_ms") / 3000.0)).alias("group_id"), "note_id", "start_ms", "pitch", F.array(late + F.round(F.col("vel") / 127.0, 6), late + 1.0, F.round(F.col("dur_ms") / 400.0, 6)).alias("features"), F.when(F.col("note_id") % 6 > 0, 0.5 + F.col("note_id") % 50 / 100.0).alias("reliability")))


@query("""WITH RECURSIVE {N8}, o AS (SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY start_ms, note_id) AS place, CAST(floor(start_ms / 400.0) AS BIGINT) AS phrase, note_id FROM n),
x AS (SELECT track_id, place, phrase, CAST(2 + j * 3 + note_id % 5 AS INTEGER) AS ntype, round(0.6::DOUBLE + (note_id * 7 + j * 31) % 41 / 100.0::DOUBLE, 6) AS confidence, (note_id + j) % 4 > 0 AS verified FROM o, range(2) r(j) WHERE note_id % 3 > 0),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY track_id, place ORDER BY confidence DESC, ntype) AS n FROM x) WHERE n = 1),
k AS (SELECT *, row_number() OVER (PARTITION BY track_id, phrase ORDER BY place) AS number FROM b),
a AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY place) AS i FROM k WHERE number <= 3 AND verified AND confidence >= 0.85),
f AS (SELECT track_id, i, place, ntype, phrase, true AS applied, place AS last, 1 AS used FROM a WHERE i = 1 UNION ALL
SELECT track_id, i, place, ntype, phrase, ok, CASE WHEN ok THEN place ELSE last END, had + CASE WHEN ok THEN 1 ELSE 0 END FROM (
SELECT a.track_id, a.i, a.place, a.ntype, a.phrase, f.last, CASE WHEN a.phrase = f.phrase THEN f.used ELSE 0 END AS had, (CASE WHEN a.phrase = f.phrase THEN f.used ELSE 0 END) < 2 AND a.place - f.last > 2 AS ok FROM f JOIN a ON a.track_id = f.track_id AND a.i = f.i + 1))
SELECT track_id, place, ntype, 'skipped' AS status FROM k WHERE number > 3 UNION ALL SELECT track_id, place, ntype, 'suggested' FROM k WHERE number <= 3 AND NOT (verified AND confidence >= 0.85)
UNION ALL SELECT track_id, place, ntype, CASE WHEN applied THEN 'applied' ELSE 'suggested' END FROM f""")
def budgeted_select(spark, sf):
    n = notes(spark, sf, 8)
    own = n.select("track_id", F.row_number().over(Window.partitionBy("track_id").orderBy("start_ms", "note_id")).alias("place"), F.floor(F.col("start_ms") / 400.0).alias("phrase"), "note_id")
    both = own.filter("note_id % 3 > 0").withColumn("j", F.explode(F.array(F.lit(0), F.lit(1))))
    options = both.select("track_id", "place", "phrase", (2 + F.col("j") * 3 + F.col("note_id") % 5).cast("int").alias("ntype"), F.round(0.6 + (F.col("note_id") * 7 + F.col("j") * 31) % 41 / 100.0, 6).alias("confidence"), ((F.col("note_id") + F.col("j")) % 4 > 0).alias("verified"))
    return P.budgeted_select(options, changes=2)


@query()
def review_recovery(spark, sf):
    """Reviews are a track's notes in two seconds; the new analysis moves the seconds and some notes and gives all new ids."""
    n = notes(spark, sf, 32)

    def spans(rows, shift: float, name: str):
        own = rows.withColumn(name, (F.floor((F.col("start_ms") + shift) / 2000.0)).cast("long"))
        return own.groupBy("track_id", name).agg(F.min("start_ms").alias("start_ms"), F.max(F.col("start_ms") + F.col("dur_ms")).alias("end_ms")), own.select("track_id", name, "note_id", "pitch", "start_ms", "dur_ms")

    moved = n.withColumns({"note_id": F.col("note_id") + 1_000_000_000, "start_ms": F.col("start_ms") + F.col("note_id") % 5, "pitch": F.when(F.col("note_id") % 11 == 0, F.col("pitch") + 1).otherwise(F.col("pitch"))}).filter("note_id % 13 != 0")
    reviews, old = spans(n, 0.0, "review_id")
    targets, new = spans(moved, 300.0, "span_id")
    return V.recover_reviews(reviews, targets, old, new)
