"""Queries over documents as sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..notes import notes
from ..operators import sequential as Q
from ..sources import documents as D
from ..tables import table
from .base import query

_CORRUPT = "CASE event_id % 10 WHEN 3 THEN substr(props, 1, 4) WHEN 5 THEN NULL WHEN 7 THEN '{\"k\": \"x\"}' WHEN 8 THEN '[1, 2]' ELSE props END"


@query(f"""WITH d AS (SELECT {_CORRUPT} AS doc FROM events), c AS (SELECT CASE WHEN doc IS NULL THEN 'missing' WHEN NOT json_valid(doc) THEN 'malformed' WHEN json_type(doc) <> 'OBJECT' THEN 'not_an_object'
WHEN json_type(doc, '$.k') NOT IN ('BIGINT', 'UBIGINT') THEN 'bad_value' ELSE 'ok' END AS failure FROM d) SELECT failure, count(*) AS n FROM c GROUP BY 1""")
def scan_corpus(spark, sf):
    docs = table(spark, sf, "events").select(F.expr(_CORRUPT).alias("doc"))
    return D.failures(D.scan_corpus(docs, "doc", "k int"))


@query("WITH {N8} SELECT track_id, note_id, row_number() OVER (PARTITION BY track_id ORDER BY start_ms, note_id) AS place FROM n")
def scan_tracks_snapshot(spark, sf):
    return D.logical_notes(D.physical_tracks(notes(spark, sf, 8))).select("track_id", "note_id", F.col("place").cast("long").alias("place"))


@query("WITH {N8} SELECT track_id, note_id, pitch, vel, start_ms, dur_ms, ntype FROM n")
def document_round_trip(spark, sf):
    return D.logical_notes(D.from_document(D.to_document(D.physical_tracks(notes(spark, sf, 8))))).drop("place")


@query("WITH {N} SELECT track_id, note_id, pitch, vel, start_ms - min(start_ms) OVER (PARTITION BY track_id) AS start_ms, dur_ms, ntype FROM n")
def clipboard_codec(spark, sf):
    return D.from_clipboard(D.to_clipboard(notes(spark, sf), "track_id"), "track_id")


@query("""WITH e AS (SELECT o_custkey % 50 AS root, o_orderkey AS k, o_orderdate AS t, CAST(o_totalprice AS BIGINT) AS b, o_orderkey % 13 = 0 AS p FROM orders),
w AS (SELECT *, count(*) OVER (PARTITION BY root) - coalesce(sum(CASE WHEN p THEN 0 ELSE 1 END) OVER o, 0) AS l, sum(b) OVER (PARTITION BY root) - coalesce(sum(CASE WHEN p THEN 0 ELSE b END) OVER o, 0) AS lb FROM e
WINDOW o AS (PARTITION BY root ORDER BY t, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT root, k, NOT p AND (l > 20 OR lb > 2000000) AS removed FROM w""")
def cache_prune(spark, sf):
    entries = table(spark, sf, "orders").select((F.col("o_custkey") % 50).alias("root"), F.col("o_orderkey").alias("k"), F.col("o_orderdate").alias("t"), F.bround("o_totalprice").cast("long").alias("b"), (F.col("o_orderkey") % 13 == 0).alias("p"))
    return D.cache_prune(entries, "root", 20, 2_000_000, "k", "t", "b", "p").select("root", "k", "removed")


@query("""WITH {N}, r AS (SELECT *, (row_number() OVER (PARTITION BY track_id ORDER BY start_ms, note_id) - 1) // 730 AS chunk FROM n), c AS (SELECT track_id, chunk, count(*) AS k FROM r GROUP BY 1, 2)
SELECT track_id, CAST(chunk AS BIGINT) AS chunk, CASE WHEN track_id % 5 = 1 THEN 'missing' WHEN track_id % 5 = 2 THEN 'content' WHEN track_id % 5 = 3 AND k > 0 THEN 'rows' ELSE 'valid' END AS status FROM c""")
def sink_cache_evidence(spark, sf):
    chunks = D.physical_tracks(notes(spark, sf))
    damaged = chunks.filter("track_id % 5 != 1").withColumn("notes", F.when(F.col("track_id") % 5 == 2, F.transform("notes", lambda n: n.withField("vel", n["vel"] + 1))).when(F.col("track_id") % 5 == 3, F.slice("notes", 1, F.size("notes") - 1)).otherwise(F.col("notes")))
    return D.check_manifest(damaged, D.layer_text(), D.manifest(chunks, D.layer_text()))


@query("""WITH {N8}, ev AS (SELECT track_id AS channel, pitch, vel, start_ms AS t, note_id * 4 AS seq, 'on' AS kind FROM n UNION ALL SELECT track_id, pitch, vel, start_ms + dur_ms, note_id * 4 + 1, 'off' FROM n WHERE note_id % 9 <> 0
UNION ALL SELECT track_id, NULL, NULL, start_ms + 3, note_id * 4 + 2, CASE WHEN note_id % 2 = 0 THEN 'down' ELSE 'up' END FROM n WHERE note_id % 5 < 2),
ch AS (SELECT *, coalesce(last_value(CASE WHEN kind IN ('down', 'up') THEN kind = 'down' END IGNORE NULLS) OVER (PARTITION BY channel ORDER BY t, seq), false) AS down,
min(CASE WHEN kind = 'up' THEN t END) OVER (PARTITION BY channel ORDER BY t, seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS up FROM ev),
k AS (SELECT *, min(CASE WHEN kind = 'on' THEN t END) OVER (PARTITION BY channel, pitch ORDER BY t, seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS again FROM ch WHERE kind IN ('on', 'off')),
e AS (SELECT *, CASE WHEN kind = 'on' OR NOT down THEN t ELSE least(up, again) END AS own FROM k), l AS (SELECT *, lead(own) OVER (PARTITION BY channel, pitch ORDER BY t, seq) AS fin FROM e)
SELECT channel, pitch, vel, t AS start_ms, coalesce(fin - t, 100.0::DOUBLE) AS dur_ms FROM l WHERE kind = 'on' AND coalesce(fin - t, 100.0::DOUBLE) > 0""")
def event_pairing_sustain(spark, sf):
    n = notes(spark, sf, 8)
    row = lambda rows, pitch, vel, at, seq, kind: rows.select(F.col("track_id").alias("channel"), pitch.cast("int").alias("pitch"), vel.cast("int").alias("vel"), at.alias("at_ms"), seq.alias("seq"), kind.alias("kind"))
    ons = row(n, F.col("pitch"), F.col("vel"), F.col("start_ms"), F.col("note_id") * 4, F.lit("on"))
    offs = row(n.filter("note_id % 9 != 0"), F.col("pitch"), F.col("vel"), F.col("start_ms") + F.col("dur_ms"), F.col("note_id") * 4 + 1, F.lit("off"))
    pedal = row(n.filter("note_id % 5 < 2"), F.lit(None), F.lit(None), F.col("start_ms") + 3, F.col("note_id") * 4 + 2, F.when(F.col("note_id") % 2 == 0, "down").otherwise("up"))
    return Q.event_pairing_sustained(ons.unionByName(offs).unionByName(pedal))


#: Onset groups with their draws, as in the operator; places follow one another through a track.
_GROUPS = """r AS (SELECT track_id, note_id, start_ms, row_number() OVER (PARTITION BY track_id ORDER BY start_ms, note_id) AS i FROM n),
f AS (SELECT track_id, i, note_id, start_ms AS anchor_ms FROM r WHERE i = 1 UNION ALL
SELECT r.track_id, r.i, r.note_id, CASE WHEN r.start_ms - f.anchor_ms <= 12 THEN f.anchor_ms ELSE r.start_ms END FROM f JOIN r ON r.track_id = f.track_id AND r.i = f.i + 1),
g AS (SELECT f.track_id, anchor_ms, CAST(sum(pitch) AS BIGINT) AS ps, count(*) AS k, max(n.start_ms + n.dur_ms) AS e FROM f JOIN n USING (track_id, note_id) GROUP BY 1, 2),
g2 AS (SELECT *, lead(anchor_ms) OVER w AS nx, row_number() OVER w AS i, least(anchor_ms % 500, abs(500 - anchor_ms % 500)) <= 18 AS strong FROM g WINDOW w AS (PARTITION BY track_id ORDER BY anchor_ms)),
g3 AS (SELECT *, strong OR nx IS NULL OR nx - e >= 420 AS anchored, ((track_id + 1) * 1000003 + CAST(round_even(anchor_ms * 10, 0) AS BIGINT) * 9176 + ps * 131 + k * 37) & 2147483647 AS sig FROM g2),
g4 AS MATERIALIZED (SELECT *, round((((sig * 1103515245 + 12345) >> 16) & 32767) / 16383.5::DOUBLE * CASE WHEN strong THEN 3 WHEN anchored THEN 4 ELSE 12 END - CASE WHEN strong THEN 3 WHEN anchored THEN 4 ELSE 12 END, 3) AS off,
CAST(round_even(((((xor(sig, 1540483477) * 1103515245 + 12345) >> 16) & 32767) / 16383.5::DOUBLE - 1) * CASE WHEN anchored THEN 2 ELSE 6 END, 0) AS INTEGER) AS delta FROM g3),
v AS (SELECT track_id, i, anchor_ms, delta, -1.0::DOUBLE AS last, CASE WHEN nx IS NULL THEN greatest(0, anchor_ms + off) WHEN least(nx - 1, greatest(0, anchor_ms + off)) < 0 THEN anchor_ms ELSE least(nx - 1, greatest(0, anchor_ms + off)) END AS placed FROM g4 WHERE i = 1 UNION ALL
SELECT t.track_id, t.i, t.anchor_ms, t.delta, v.placed, CASE WHEN nx IS NULL THEN greatest(v.placed + 1, greatest(0, t.anchor_ms + off)) WHEN least(nx - 1, greatest(v.placed + 1, greatest(0, t.anchor_ms + off))) < 0 THEN t.anchor_ms ELSE least(nx - 1, greatest(v.placed + 1, greatest(0, t.anchor_ms + off))) END
FROM v JOIN g4 t ON t.track_id = v.track_id AND t.i = v.i + 1)"""


@query(f"""WITH RECURSIVE {{N8}}, {_GROUPS} SELECT note_id, greatest(0, n.start_ms + (placed - v.anchor_ms)) AS start_ms, least(greatest(vel + delta, 1), 127) AS vel
FROM f JOIN n USING (track_id, note_id) JOIN v ON v.track_id = f.track_id AND v.anchor_ms = f.anchor_ms""")
def humanize_groups(spark, sf):
    return Q.humanize_groups(notes(spark, sf, 8))


@query()
def melodic_lines(spark, sf):
    return Q.melodic_lines(notes(spark, sf))
