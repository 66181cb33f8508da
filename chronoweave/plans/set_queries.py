"""Queries over set operations, validation and change sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..notes import notes
from ..operators import changes as C
from ..operators import rules as R
from ..operators import sets as D
from ..tables import table
from .base import also, query

_K = "CAST(round_even(start_ms * 1000, 0) AS BIGINT) AS start_us, CAST(round_even(dur_ms * 1000, 0) AS BIGINT) AS dur_us, pitch, vel, ntype"


@query("SELECT l_suppkey AS k, l_quantity AS v FROM lineitem UNION ALL SELECT p_partkey, CAST(p_size AS DOUBLE) FROM part")
def union_tracks(spark, sf):
    a = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_quantity").alias("v"))
    return a.unionByName(table(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").cast("double").alias("v")))


@query("SELECT l_partkey, l_quantity FROM lineitem WHERE l_linenumber <= 3 INTERSECT ALL SELECT l_partkey, l_quantity FROM lineitem WHERE l_linenumber > 3")
def intersect_all(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_partkey", "l_quantity", "l_linenumber")
    return rows.filter("l_linenumber <= 3").drop("l_linenumber").intersectAll(rows.filter("l_linenumber > 3").drop("l_linenumber"))


@query("SELECT l_partkey, l_quantity FROM lineitem WHERE l_linenumber <= 3 EXCEPT ALL SELECT l_partkey, l_quantity FROM lineitem WHERE l_linenumber > 3")
def except_all(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_partkey", "l_quantity", "l_linenumber")
    return rows.filter("l_linenumber <= 3").drop("l_linenumber").exceptAll(rows.filter("l_linenumber > 3").drop("l_linenumber"))


@query(f"""WITH {{N}}, a AS (SELECT {_K}, -1 AS d FROM n WHERE note_id % 10 <> 1 UNION ALL SELECT {_K}, 1 FROM n WHERE note_id % 10 <> 2),
c AS (SELECT start_us, dur_us, pitch, vel, ntype, sum(d) AS d, count(*) FILTER (d > 0) AS p, count(*) FILTER (d < 0) AS q FROM a GROUP BY ALL)
SELECT CAST(sum(greatest(d, 0)) AS BIGINT) AS added, CAST(sum(greatest(-d, 0)) AS BIGINT) AS removed, CAST(sum(least(p, q)) AS BIGINT) AS unchanged FROM c""")
def semantic_diff(spark, sf):
    n = notes(spark, sf)
    return D.semantic_diff(D.micro_keys(n.filter("note_id % 10 != 1")), D.micro_keys(n.filter("note_id % 10 != 2")))


@query("SELECT true AS same")
def lossless_match(spark, sf):
    n = D.micro_keys(notes(spark, sf))
    return D.lossless_match(n, n)


@query("""WITH {N8}, r AS (SELECT CAST(floor(start_ms / 10) AS BIGINT) AS f, pitch, 'u' || track_id AS l FROM n)
SELECT f AS frame, pitch, array_to_string(list_sort(list_distinct(list(l))), ',') AS lineage, count(*) - 1 AS dropped FROM r GROUP BY 1, 2""")
def dedupe_exact(spark, sf):
    rows = notes(spark, sf, 8).select(F.floor(F.col("start_ms") / 10).alias("frame"), "pitch", F.array(F.concat(F.lit("u"), "track_id")).alias("lineage"))
    return D.dedupe_exact(rows, ["frame", "pitch"], "lineage").withColumn("lineage", F.array_join("lineage", ","))


@query("""WITH {N8} SELECT track_id, arg_min(note_id, (start_ms, note_id)) AS note_id, pitch, max(vel) AS vel, min(start_ms) AS start_ms, max(dur_ms) AS dur_ms, ntype FROM n
GROUP BY track_id, CAST(round_even(start_ms / 5, 0) AS BIGINT), pitch, ntype""")
def dedupe_fuzzy(spark, sf):
    return D.dedupe_fuzzy(notes(spark, sf, 8))


@query("""WITH {N}, r AS (SELECT track_id, note_id % 16 AS c, sha256(note_id || '|' || pitch || '|' || vel) AS h FROM n),
p AS (SELECT track_id, c, sha256(string_agg(h, '' ORDER BY h)) AS h FROM r GROUP BY 1, 2) SELECT track_id, sha256(string_agg(h, '' ORDER BY c)) AS digest FROM p GROUP BY 1""")
def fingerprint(spark, sf):
    return D.fingerprint(notes(spark, sf), ["track_id"], [F.col("note_id"), F.col("pitch"), F.col("vel")], F.col("note_id") % 16)


_LIMIT = "count(*) > 60"


@query(f"""WITH {{N}}, i AS (SELECT 'bad_duration' AS code, 'error' AS severity, track_id, note_id FROM n WHERE dur_ms <= 1 UNION ALL
SELECT 'drum_pitch', 'error', track_id, note_id FROM n WHERE ntype = 99 AND pitch > 81 UNION ALL SELECT 'low_velocity', 'warning', track_id, note_id FROM n WHERE vel < 3 UNION ALL
SELECT 'too_many_notes', 'error', track_id, -1 FROM n GROUP BY track_id HAVING {_LIMIT} UNION ALL
SELECT 'dense_onsets', 'warning', track_id, -1 FROM (SELECT track_id, round_even(start_ms / 100.0, 0) AS a, count(*) AS c FROM n GROUP BY 1, 2) GROUP BY track_id HAVING max(c) >= 4)
SELECT * FROM i""")
def validate_tracks(spark, sf):
    return R.validate_tracks(notes(spark, sf), most_notes=60, most_onsets=4, onset_ms=100.0)


@query("""WITH {N8}, d AS (SELECT track_id, count(*) AS n, count(*) FILTER (dur_ms <= 1) AS bad FROM n GROUP BY 1), o AS (SELECT track_id, max(c) AS peak FROM (SELECT track_id, round_even(start_ms, 0) AS a, count(*) AS c FROM n GROUP BY 1, 2) GROUP BY 1)
SELECT track_id, CAST(ceil(n / 730.0) AS BIGINT) AS chunks, bad AS bad_durations, peak AS onset_peak FROM d JOIN o USING (track_id)""")
def diagnose_authoring(spark, sf):
    return R.diagnose_authoring(notes(spark, sf, 8), shortest=1.0)


@query("""WITH {N8}, s AS (SELECT track_id, note_id, pitch, vel, row_number() OVER (PARTITION BY track_id ORDER BY start_ms, note_id) - 1 AS i FROM n)
SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY i, k, q) - 1 AS place, pitch, vel FROM (
SELECT track_id, i, 1 AS k, 0 AS q, CASE WHEN i % 50 = 7 THEN pitch + 1 ELSE pitch END AS pitch, vel FROM s WHERE i % 50 <> 9
UNION ALL SELECT track_id, i, 0, 0, 60, 64 FROM s WHERE i % 50 = 11 UNION ALL SELECT track_id, i, 0, 1, 62, 65 FROM s WHERE i % 50 = 11)""")
def changeset_apply(spark, sf):
    rows = C.indexed(notes(spark, sf, 8)).select("track_id", "idx", "pitch", "vel")
    before = F.struct("pitch", "vel")
    made = lambda p, v: F.struct(F.lit(p).cast("int").alias("pitch"), F.lit(v).cast("int").alias("vel"))
    ops = (
        rows.filter("idx % 50 = 7").select("track_id", F.lit("replace").alias("op"), "idx", F.lit(0).alias("seq"), before.alias("before"), F.struct((F.col("pitch") + 1).alias("pitch"), "vel").alias("after"))
        .unionByName(rows.filter("idx % 50 = 9").select("track_id", F.lit("delete").alias("op"), "idx", F.lit(0).alias("seq"), before.alias("before"), F.lit(None).cast("struct<pitch:int,vel:int>").alias("after")))
        .unionByName(rows.filter("idx % 50 = 11").select("track_id", F.lit("insert").alias("op"), "idx", F.explode(F.array(F.struct(F.lit(0).alias("seq"), made(60, 64).alias("after")), F.struct(F.lit(1).alias("seq"), made(62, 65).alias("after")))).alias("x")).select("track_id", "op", "idx", "x.seq", F.lit(None).cast("struct<pitch:int,vel:int>").alias("before"), "x.after"))
    )
    return C.apply(rows, ops, ["pitch", "vel"])


#: Their other names.
for _name in ("union_tracks",):
    also(_name, f"{_name}_whole")
