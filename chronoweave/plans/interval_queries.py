"""Queries over interval joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..notes import notes
from ..operators import intervals as I
from ..tables import table
from .base import also, query

_PAIRS = "a.start_ms < b.start_ms + b.dur_ms AND b.start_ms < a.start_ms + a.dur_ms"


def _ab(spark, sf, tracks=8):
    n = notes(spark, sf, tracks)
    return n.filter("track_id % 2 = 0"), n.filter("track_id % 2 = 1").withColumn("track_id", F.col("track_id") - 1)


_AB = "{N8}, a AS (SELECT * FROM n WHERE track_id % 2 = 0), b AS (SELECT * REPLACE (track_id - 1 AS track_id) FROM n WHERE track_id % 2 = 1)"


@query(f"WITH {_AB} SELECT a.track_id, CAST(count(*) AS BIGINT) AS pairs FROM a JOIN b ON a.track_id = b.track_id AND {_PAIRS} GROUP BY 1")
def overlap_pairs(spark, sf):
    a, b = _ab(spark, sf)
    return I.overlap_count(a, b, ["track_id"]).filter("pairs > 0")


@query(f"WITH {_AB} SELECT a.note_id AS note_id_a, b.note_id AS note_id_b FROM a JOIN b ON a.track_id = b.track_id AND a.pitch = b.pitch AND {_PAIRS}")
def overlap_pairs_same_pitch(spark, sf):
    a, b = _ab(spark, sf)
    return I.overlap_pairs(a, b, 400.0, ["track_id", "pitch"]).select("note_id_a", "note_id_b")


_DUP = "a.pitch = b.pitch AND abs(a.start_ms - b.start_ms) <= 35 AND abs(a.dur_ms - b.dur_ms) <= greatest(35, 0.25 * a.dur_ms)"


@query(f"WITH {_AB} SELECT * FROM a WHERE EXISTS (SELECT 1 FROM b WHERE {_DUP})")
def duplicate_flags(spark, sf):
    return I.duplicate_flags(*_ab(spark, sf))


@query(f"WITH {_AB} SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE {_DUP})")
def nonduplicates(spark, sf):
    return I.nonduplicates(*_ab(spark, sf))


@query(f"""WITH RECURSIVE {_AB}, m AS (SELECT a.pitch, a.note_id, a.start_ms, list(b.note_id ORDER BY abs(a.start_ms - b.start_ms), abs(a.dur_ms - b.dur_ms), b.note_id) AS near FROM a JOIN b ON {_DUP} GROUP BY ALL),
x AS (SELECT *, row_number() OVER (PARTITION BY pitch ORDER BY start_ms, note_id) AS r FROM m),
w AS (SELECT DISTINCT pitch, 0::BIGINT AS r, NULL::BIGINT AS note_id_a, NULL::BIGINT AS note_id_b, []::BIGINT[] AS used FROM x
UNION ALL SELECT pitch, r, note_id, found, CASE WHEN found IS NULL THEN used ELSE list_append(used, found) END
FROM (SELECT x.pitch, x.r, x.note_id, w.used, list_filter(x.near, lambda y: NOT list_contains(w.used, y))[1] AS found FROM w JOIN x ON x.pitch = w.pitch AND x.r = w.r + 1))
SELECT note_id_a, note_id_b FROM w WHERE note_id_b IS NOT NULL""")
def best_draft_match(spark, sf):
    return I.best_match_once(*_ab(spark, sf))


@query("""WITH s AS (SELECT o_custkey AS k, o_orderdate AS t, max(o_orderkey) AS seg FROM orders GROUP BY 1, 2), f AS (SELECT k, arg_min(seg, t) AS seg FROM s GROUP BY 1),
l AS (SELECT l_orderkey, l_linenumber, l_suppkey AS k, l_shipdate AS t FROM lineitem)
SELECT l_orderkey, l_linenumber, coalesce(s.seg, f.seg) AS seg FROM l ASOF LEFT JOIN s ON l.k = s.k AND l.t >= s.t LEFT JOIN f ON l.k = f.k""")
def asof_tempo(spark, sf):
    seconds = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    segments = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k"), seconds("o_orderdate").alias("at")).agg(F.max("o_orderkey").alias("seg"))
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("k"), seconds("l_shipdate").alias("at"))
    return I.asof(lines, segments, "at", ["k"], ["seg"], first_if_none=True).select("l_orderkey", "l_linenumber", "seg")


@query("""WITH {N8}, t AS (SELECT * FROM n WHERE ntype = 3), c AS (SELECT a.note_id, t.start_ms AS nearest,
row_number() OVER (PARTITION BY a.note_id ORDER BY abs(a.start_ms - t.start_ms), t.start_ms) AS r FROM n a JOIN t USING (track_id) WHERE a.ntype <> 3)
SELECT note_id, nearest FROM c WHERE r = 1""")
def asof_nearest(spark, sf):
    n = notes(spark, sf, 8)
    return I.asof_nearest(n.filter("ntype != 3"), n.filter("ntype = 3"), "start_ms", ["track_id"]).select("note_id", "nearest")


@query(f"""WITH {_AB}, m AS (SELECT a.note_id AS note_id_a, b.note_id AS note_id_b, row_number() OVER (PARTITION BY a.note_id ORDER BY
greatest(a.start_ms, b.start_ms) - least(a.start_ms + a.dur_ms, b.start_ms + b.dur_ms), abs(a.start_ms - b.start_ms), b.note_id) AS r
FROM a JOIN b ON a.pitch = b.pitch AND {_PAIRS}) SELECT note_id_a, note_id_b FROM m WHERE r = 1""")
def fragment_assign(spark, sf):
    return I.fragment_assign(*_ab(spark, sf), 400.0)


@query("""WITH {N}, w AS (SELECT note_id, vel, start_ms, start_ms + dur_ms AS end_ms,
unnest(range(CAST(floor(start_ms / 500.0) AS BIGINT), CAST(greatest(floor(start_ms / 500.0), ceil((start_ms + dur_ms) / 500.0) - 1) AS BIGINT) + 1)) AS "window" FROM n)
SELECT note_id, "window", vel / 127.0::DOUBLE * least(1.0, (least(end_ms, ("window" + 1) * 500.0::DOUBLE) - greatest(start_ms, "window" * 500.0::DOUBLE)) / 500.0::DOUBLE) AS weight FROM w""")
def event_window_join(spark, sf):
    return I.event_window_join(notes(spark, sf), 500.0)


@query("""WITH {N8}, w AS (SELECT start_ms AS window_ms, [pitch % 12, (pitch + 4) % 12, (pitch + 7) % 12] AS pcs FROM n WHERE ntype = 3),
m AS (SELECT note_id, window_ms, NOT list_contains(pcs, n.pitch % 12) AS non_chord, row_number() OVER (PARTITION BY note_id ORDER BY window_ms, pcs) AS r
FROM n JOIN w ON window_ms BETWEEN start_ms - 12.0 AND start_ms + 12.0) SELECT note_id, window_ms, non_chord FROM m WHERE r = 1""")
def chord_lookup(spark, sf):
    n = notes(spark, sf, 8)
    windows = n.filter("ntype = 3").select(F.col("start_ms").alias("window_ms"), F.array(*(((F.col("pitch") + k) % 12) for k in (0, 4, 7))).alias("pitch_classes"))
    return I.chord_lookup(n, windows)


@query()
def best_draft_match_once(spark, sf):
    return I.best_match_once(*_ab(spark, sf))


@query(f"""WITH {{N8}} SELECT a.note_id, round(sum((least(a.start_ms + a.dur_ms, b.start_ms + b.dur_ms) - greatest(a.start_ms, b.start_ms)) / nullif(a.dur_ms, 0)), 6) AS contamination
FROM n a JOIN n b ON a.track_id = b.track_id AND a.pitch <> b.pitch AND {_PAIRS} GROUP BY 1""")
def contamination(spark, sf):
    return I.contamination(notes(spark, sf, 8), 400.0)


@query("""WITH {N8}, p AS (SELECT a.note_id, b.track_id AS group_id, round(((b.note_id % 100) / 100.0::DOUBLE) * (0.68::DOUBLE * coalesce(greatest(0.0::DOUBLE, least(a.start_ms + a.dur_ms, b.start_ms + b.dur_ms) - greatest(a.start_ms, b.start_ms)) / nullif(least(a.dur_ms, b.dur_ms), 0), 0)
+ 0.32::DOUBLE * greatest(0.0::DOUBLE, 1 - abs(a.start_ms - b.start_ms) / 180.0::DOUBLE)), 6) AS score
FROM n a JOIN n b ON a.track_id % 2 = 0 AND b.track_id % 2 = 1 AND a.pitch = b.pitch AND abs(a.start_ms - b.start_ms) <= 120)
SELECT note_id, group_id, max(score) AS score FROM p WHERE score >= 0.42 GROUP BY 1, 2""")
def guidance_join(spark, sf):
    n = notes(spark, sf, 8)
    melody = n.filter("track_id % 2 = 1").select(F.col("track_id").alias("group_id"), "pitch", "start_ms", "dur_ms", (F.col("note_id") % 100 / F.lit(100.0)).alias("confidence"))
    return I.guidance_scores(n.filter("track_id % 2 = 0"), melody)


_CLIPS = "SELECT DISTINCT track_id, k AS clip_id, k * 3000.0::DOUBLE + 100 AS c_start, k * 3000.0::DOUBLE + 2600 AS c_end, k * 3000.0::DOUBLE AS content_start_ms, k * 3000.0::DOUBLE + 3500 AS content_end_ms, 40.0::DOUBLE AS off FROM n, range(5) r(k)"


@query("""WITH {N}, a AS (SELECT *, row_number() OVER (PARTITION BY pitch, ntype ORDER BY note_id) AS r FROM n),
b AS (SELECT pitch, ntype, CAST(127 - vel AS INTEGER) AS vel_b, row_number() OVER (PARTITION BY pitch, ntype ORDER BY note_id) AS r FROM n WHERE note_id % 3 = 0)
SELECT track_id, note_id, a.pitch, vel, start_ms, dur_ms, a.ntype, coalesce(vel_b, vel) AS vel_b FROM a LEFT JOIN b ON a.pitch = b.pitch AND a.ntype = b.ntype AND a.r = b.r""")
def bind_velocity_b(spark, sf):
    n = notes(spark, sf)
    records = n.filter("note_id % 3 = 0").select("pitch", "ntype", "note_id", (127 - F.col("vel")).alias("vel_b"))
    return I.bind_in_order(n, records, ["pitch", "ntype"], "note_id", "note_id", "vel_b", F.col("vel"))


@query("""WITH {N}, a AS (SELECT note_id, vel, dur_ms FROM n WHERE note_id % 10 <> 1), b AS (SELECT note_id, vel, CASE WHEN note_id % 7 = 0 THEN dur_ms + 1 ELSE dur_ms END AS dur_ms FROM n WHERE note_id % 10 <> 2)
SELECT coalesce(a.note_id, b.note_id) AS note_id, CASE WHEN b.note_id IS NULL THEN 'left' WHEN a.note_id IS NULL THEN 'right' WHEN a.vel = b.vel AND abs(a.dur_ms - b.dur_ms) <= 1e-6 THEN 'same' ELSE 'changed' END AS status
FROM a FULL JOIN b ON a.note_id = b.note_id""")
def full_outer_diff(spark, sf):
    n = notes(spark, sf).select("note_id", "vel", "dur_ms")
    b = n.filter("note_id % 10 != 2").withColumn("dur_ms", F.col("dur_ms") + F.when(F.col("note_id") % 7 == 0, 1).otherwise(0))
    return I.full_outer_diff(n.filter("note_id % 10 != 1"), b, ["note_id"], ["vel", "dur_ms"])


@query("SELECT DISTINCT l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10)")
def orphan_routes(spark, sf):
    return table(spark, sf, "lineitem").select("l_partkey").join(table(spark, sf, "part").filter("p_size > 10"), F.col("l_partkey") == F.col("p_partkey"), "left_anti").distinct()


@query("""WITH {N}, e AS (SELECT track_id, note_id, start_ms AS edge FROM n UNION ALL SELECT track_id, note_id, start_ms + dur_ms FROM n),
t AS (SELECT track_id, note_id AS target_id, CAST(CASE WHEN ntype = 3 THEN 0 ELSE 1 END AS INTEGER) AS kind_rank, start_ms AS target_ms FROM n),
r AS (SELECT note_id, target_ms, target_ms - edge AS shift, row_number() OVER (PARTITION BY note_id ORDER BY kind_rank, abs(target_ms - edge), target_ms - edge, target_ms) AS r
FROM e JOIN t ON e.track_id = t.track_id AND note_id <> target_id AND target_ms BETWEEN edge - 200.0 AND edge + 200.0)
SELECT note_id, target_ms, shift FROM r WHERE r = 1""")
def snap_nearest(spark, sf):
    n = notes(spark, sf)
    targets = n.select("track_id", F.col("note_id").alias("target_id"), F.when(F.col("ntype") == 3, 0).otherwise(1).alias("kind_rank"), F.col("start_ms").alias("target_ms"))
    return I.snap_nearest_within(n, targets, 200.0, (0, 1))


@query("""WITH {N}, z AS (SELECT p_partkey AS zone_id, 36 + p_size % 30 AS low_pitch, 36 + p_size % 30 + p_size % 7 AS high_pitch,
CAST(p_partkey % 100 AS INTEGER) AS low_vel, CAST(p_partkey % 100 + 30 AS INTEGER) AS high_vel, 36 + p_size AS root FROM part),
k AS (SELECT DISTINCT pitch, vel FROM n),
m AS (SELECT pitch, vel, zone_id, row_number() OVER (PARTITION BY pitch, vel ORDER BY abs(pitch - root), abs(vel - (low_vel + high_vel) / 2.0), zone_id) AS r
FROM k JOIN z ON pitch BETWEEN low_pitch AND high_pitch AND vel BETWEEN low_vel AND high_vel) SELECT note_id, zone_id FROM n JOIN m USING (pitch, vel) WHERE r = 1""")
def zone_lookup(spark, sf):
    z = table(spark, sf, "part").selectExpr(
        "p_partkey AS zone_id", "36 + p_size % 30 AS low_pitch", "36 + p_size % 30 + p_size % 7 AS high_pitch", "CAST(p_partkey % 100 AS INT) AS low_vel", "CAST(p_partkey % 100 + 30 AS INT) AS high_vel", "36 + p_size AS root"
    )
    return I.zone_lookup(notes(spark, sf), z)


def _slots(n, width):
    """(track_id, k): the slots of ``width`` from a track's first start to its last."""
    bounds = n.groupBy("track_id").agg(F.floor(F.min("start_ms") / width).alias("first"), F.floor(F.max("start_ms") / width).alias("last"))
    return bounds.select("track_id", F.explode(F.sequence("first", "last")).alias("k"))


_SLOTS = "SELECT track_id, unnest(range(CAST(floor(min(start_ms) / {0}) AS BIGINT), CAST(floor(max(start_ms) / {0}) AS BIGINT) + 1)) AS k FROM n GROUP BY track_id"


@query(f"""WITH {{N}}, s AS ({_SLOTS.format("3000.0::DOUBLE")}), c AS (SELECT track_id, k AS clip_id, k * 3000.0::DOUBLE + 100 AS c_start, k * 3000.0::DOUBLE + 2600 AS c_end,
k * 3000.0::DOUBLE AS content_start_ms, k * 3000.0::DOUBLE + 3500 AS content_end_ms, 40.0::DOUBLE AS off FROM s),
p AS (SELECT n.track_id, clip_id, note_id, pitch, vel, greatest(start_ms + off, c_start) AS a, least(start_ms + dur_ms + off, c_end) AS b, ntype
FROM n JOIN c ON n.track_id = c.track_id AND start_ms >= content_start_ms AND start_ms < content_end_ms)
SELECT track_id, clip_id, note_id, pitch, vel, a AS start_ms, b - a AS dur_ms, ntype FROM p WHERE b - a >= 1""")
def clip_projection(spark, sf):
    n = notes(spark, sf)
    at = F.col("k") * 3000.0
    clips = _slots(n, 3000.0).select("track_id", F.col("k").alias("clip_id"), (at + 100).alias("start_ms"), (at + 2600).alias("end_ms"), at.alias("content_start_ms"), (at + 3500).alias("content_end_ms"), F.lit(40.0).alias("time_offset_ms"))
    return I.clip_projection(n, clips, 3000.0)


@query(f"""WITH {{N}}, l AS ({_SLOTS.format("1000.0::DOUBLE")}), a AS (SELECT track_id, k * 1000.0::DOUBLE AS s, k * 1000.0::DOUBLE + 1000 AS e FROM l),
m AS (SELECT track_id, 500.0::DOUBLE + track_id % 7 * 300 AS s, 500.0::DOUBLE + track_id % 7 * 300 + 900 AS e FROM (SELECT DISTINCT track_id FROM n) WHERE track_id % 3 = 0)
SELECT track_id, s AS start_ms, e AS end_ms, 'manual' AS label FROM m
UNION ALL SELECT a.track_id, a.s, a.e, 'auto' FROM a WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.track_id = a.track_id AND m.s < a.e AND a.s < m.e)
UNION ALL SELECT a.track_id, a.s, m.s, 'auto' FROM a JOIN m ON m.track_id = a.track_id AND m.s < a.e AND a.s < m.e WHERE a.s < m.s
UNION ALL SELECT a.track_id, m.e, a.e, 'auto' FROM a JOIN m ON m.track_id = a.track_id AND m.s < a.e AND a.s < m.e WHERE m.e < a.e""")
def interval_override(spark, sf):
    n = notes(spark, sf)
    at = F.col("k") * 1000.0
    automatic = _slots(n, 1000.0).select("track_id", at.alias("start_ms"), (at + 1000).alias("end_ms"), F.lit("auto").alias("label"))
    own = 500.0 + F.col("track_id") % 7 * 300
    manual = n.select("track_id").distinct().filter("track_id % 3 = 0").select("track_id", own.alias("start_ms"), (own + 900).alias("end_ms"), F.lit("manual").alias("label"))
    return I.interval_override(automatic, manual, 1000.0)


#: Their other names.
for _name in ("snap_nearest", "zone_lookup", "clip_projection", "interval_override"):
    also(_name, f"{_name}_whole")
