"""Queries over scans, projections and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..notes import DRUM, notes
from ..operators import projections as P
from ..tables import table
from .base import query

_ALL = "track_id, note_id, pitch, vel, start_ms, dur_ms, ntype"


@query("WITH {N} SELECT * REPLACE (pitch + 5 AS pitch) FROM n")
def transpose(spark, sf):
    return P.transpose(notes(spark, sf), 5)


@query("WITH {N} SELECT * REPLACE (greatest(48, least(72, pitch)) AS pitch) FROM n")
def clamp_pitch(spark, sf):
    return P.clamp_pitch(notes(spark, sf), 48, 72)


@query("""WITH {N}, o AS (SELECT DISTINCT track_id, CAST(track_id % 5 - 2 AS INTEGER) AS off FROM n WHERE track_id % 3 = 0)
SELECT n.* REPLACE (CASE WHEN ntype = 99 THEN pitch ELSE pitch + 2 + coalesce(off, 0) END AS pitch) FROM n LEFT JOIN o USING (track_id)""")
def pitch_plan(spark, sf):
    n = notes(spark, sf)
    own = n.filter("track_id % 3 = 0").select("track_id", (F.col("track_id") % 5 - 2).cast("int").alias("offset")).distinct()
    return P.pitch_plan(n, own, 2)


@query("""WITH {N} SELECT * REPLACE (35 + pitch % 20 AS pitch,
greatest(1.0, CASE WHEN pitch % 20 = 7 THEN dur_ms ELSE least(80.0, dur_ms) END) AS dur_ms) FROM n WHERE ntype = 99""")
def drum_map(spark, sf):
    keys = spark.range(128).select(F.col("id").cast("int").alias("pitch"), (35 + F.col("id") % 20).cast("int").alias("to_pitch"))
    return P.drum_map(notes(spark, sf).filter(F.col("ntype") == DRUM), F.broadcast(keys), rolls=(42,))  # 128 rows


@query("""SELECT p_partkey, p_size, CASE WHEN p_size BETWEEN 1 AND 8 THEN 'keys' WHEN p_size BETWEEN 9 AND 24 THEN 'strings'
WHEN p_size = 30 THEN 'horn' ELSE 'other' END AS instrument FROM part""")
def program_map(spark, sf):
    return P.program_map(table(spark, sf, "part").select("p_partkey", "p_size"), [(1, 8, "keys"), (9, 24, "strings"), (30, 30, "horn")], "p_size")


@query("WITH {N} SELECT * REPLACE (greatest(0.0, 10.0 + round_even((start_ms - 10.0) / 125.0, 0) * 125.0) AS start_ms) FROM n")
def quantize_starts(spark, sf):
    return P.quantize_starts(notes(spark, sf), 125.0, 10.0)


@query("""WITH {N}, d AS (SELECT *, round_even(start_ms / 125.0, 0) * 125.0 - start_ms AS delta FROM n),
s AS (SELECT *, CASE WHEN abs(delta) <= 18 THEN delta * 0.5 ELSE 0 END AS shift FROM d)
SELECT track_id, note_id, pitch, vel, greatest(0.0, start_ms + shift) AS start_ms, dur_ms, ntype, abs(shift) >= 0.5 AS moved FROM s""")
def soft_quantize(spark, sf):
    return P.soft_quantize(notes(spark, sf), 125.0)


@query("WITH {N} SELECT * FROM n WHERE start_ms + 50 >= 3000 AND start_ms + 50 < 9000")
def region_filter(spark, sf):
    return P.region_filter(notes(spark, sf), 3000.0, 9000.0, 50.0)


@query("WITH {N} SELECT * FROM n WHERE start_ms < 9000 AND start_ms + dur_ms > 3000")
def overlap_filter(spark, sf):
    return P.overlap_filter(notes(spark, sf), 3000.0, 9000.0)


@query("WITH {N} SELECT * FROM n WHERE start_ms <= 9000 AND start_ms + dur_ms >= 3000")
def viewport_query(spark, sf):
    return P.viewport_query(notes(spark, sf), 3000.0, 9000.0)


@query("WITH {N} SELECT count(*) > 0 AS found FROM n WHERE start_ms <= 3001 AND start_ms + dur_ms >= 3000")
def viewport_exists(spark, sf):
    return P.viewport_query(notes(spark, sf), 3000.0, 3001.0).limit(1).agg((F.count("*") > 0).alias("found"))


@query("""WITH {N}, s AS (SELECT note_id FROM n WHERE vel = 100) SELECT n.* FROM n
WHERE CASE WHEN (SELECT count(*) FROM s) > 0 THEN note_id IN (SELECT note_id FROM s) ELSE start_ms >= 0 AND start_ms < 1000 END AND ntype <> 3""")
def eligible_candidates(spark, sf):
    n = notes(spark, sf)
    return P.eligible_candidates(n, n.filter("vel = 100"), n.filter("ntype = 3"), 0.0, 1000.0)


@query("SELECT c_custkey, c_nationkey % 4 = 1 AS muted, c_nationkey % 5 = 2 AS solo FROM customer WHERE c_nationkey % 4 <> 1 AND c_nationkey % 5 = 2")
def preview_filter(spark, sf):
    return P.preview_filter(table(spark, sf, "customer").selectExpr("c_custkey", "c_nationkey % 4 = 1 AS muted", "c_nationkey % 5 = 2 AS solo"))


@query("""WITH {N} SELECT n.*, coalesce(track_id % 4 <> 0 AND pitch BETWEEN 40 AND 60 + track_id % 7 AND ntype <> 99, false) AS supported FROM n""")
def pitch_supported(spark, sf):
    n = notes(spark, sf)
    limits = n.filter("track_id % 4 != 0").select("track_id", F.lit(40).alias("low"), (60 + F.col("track_id") % 7).alias("high")).distinct()
    return P.pitch_supported(n, limits)


@query("""WITH {N} SELECT n.*, CASE ntype WHEN 1 THEN pitch BETWEEN 45 AND 70 WHEN 2 THEN pitch BETWEEN 50 AND 90 ELSE true END AS supported FROM n""")
def articulation_supported(spark, sf):
    ranges = spark.createDataFrame([(1, 45, 70), (2, 50, 90)], "ntype int, low int, high int")
    return P.articulation_supported(notes(spark, sf), F.broadcast(ranges))  # two rows


@query("""WITH {N} SELECT note_id, list_extract(['C','C#','D','D#','E','F','F#','G','G#','A','A#','B'], CAST(pitch % 12 + 1 AS BIGINT)) || CAST(pitch // 12 - 1 AS VARCHAR) AS name,
CAST(round_even(start_ms * (120.0 * 480 / 60000.0), 0) AS BIGINT) AS tick, CAST(round_even(start_ms * (44100 / 1000.0), 0) AS BIGINT) AS frame,
CASE WHEN CAST(round_even(start_ms / 500.0, 0) AS BIGINT) % 4 = 0 THEN 1.0 WHEN CAST(round_even(start_ms / 500.0, 0) AS BIGINT) % 4 = 2 THEN 0.72 ELSE 0.42 END::DOUBLE AS strength FROM n""")
def scalar_rules(spark, sf):
    s = F.col("start_ms")
    return notes(spark, sf).select("note_id", S.note_name(F.col("pitch")).alias("name"), S.ticks(s).alias("tick"), S.frames(s, 44100).alias("frame"), S.beat_strength(s, 500.0).alias("strength"))


@query("""SELECT conv_id, turn, CAST(len(regexp_extract_all(text, '[぀-ヿ㐀-鿿가-힯]|[\\p{L}\\p{Nd}]+(?:[''’][\\p{L}]+)*')) AS INTEGER) AS n_tokens FROM conversations""")
def lyric_tokens(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.size(S.lyric_tokens(F.col("text"))).alias("n_tokens"))


@query("SELECT vec_id, round(list_sum(list_transform(list_zip(embedding, embedding), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))), 6) AS energy FROM embeddings")
def vector_energy(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.round(S.dot(F.col("embedding"), F.col("embedding")), 6).alias("energy"))
