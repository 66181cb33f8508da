"""Queries over cascaded matches, votes and small dimensions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..notes import notes
from ..operators import intervals as I
from ..operators import matching as M
from ..tables import table
from .base import query

#: Edits of the notes: every tenth is moved, some get another pitch, velocity or type; one in thirteen is gone.
_NEW = """SELECT track_id, note_id, CASE WHEN note_id % 7 = 1 THEN pitch + 1 ELSE pitch END AS pitch, CASE WHEN note_id % 11 = 2 THEN vel % 100 + 1 ELSE vel END AS vel,
CASE WHEN note_id % 10 = 3 THEN start_ms + 5 ELSE start_ms END AS start_ms, CASE WHEN note_id % 5 = 4 THEN dur_ms * 2 ELSE dur_ms END AS dur_ms, CASE WHEN note_id % 17 = 5 THEN 0 ELSE ntype END AS ntype"""


def _cascade() -> str:
    """The passes as common table expressions ``p0`` to ``p10`` over one table of both sides."""
    steps = []
    for i, (key, edited, unique) in enumerate(M.PASSES):
        k = ", ".join(["track_id", *key, "given IS NULL"])
        own = f"CASE WHEN side = 1 THEN value ELSE partner END" if edited else "partner"
        only = " AND n_old = 1 AND n_new = 1" if unique else ""
        steps.append(
            f"q{i} AS (SELECT *, row_number() OVER (PARTITION BY {k}, side ORDER BY note_id) AS place, count(*) FILTER (side = 0) OVER (PARTITION BY {k}) AS n_old, count(*) FILTER (side = 1) OVER (PARTITION BY {k}) AS n_new FROM p{i}), "
            f"w{i} AS (SELECT *, max(CASE WHEN side = 0 THEN value END) OVER (PARTITION BY {k}, place) AS partner FROM q{i}), "
            f"p{i + 1} AS (SELECT track_id, note_id, pitch, vel, start_ms, dur_ms, ntype, value, side, CASE WHEN given IS NULL AND place <= least(n_old, n_new){only} THEN {own} ELSE given END AS given FROM w{i})"
        )
    return ", ".join(steps)


@query(f"""WITH {{N}}, m AS ({_NEW} FROM n WHERE note_id % 13 <> 0),
p0 AS (SELECT track_id, note_id, pitch, vel, start_ms, dur_ms, ntype, CAST(1 + note_id * 7 % 127 AS INTEGER) AS value, 0 AS side, CAST(NULL AS INTEGER) AS given FROM n UNION ALL
SELECT track_id, note_id, pitch, vel, start_ms, dur_ms, ntype, vel, 1, NULL FROM m), {_cascade()}
SELECT track_id, note_id, coalesce(given, value) AS vel_b FROM p10 WHERE side = 1""")
def reconcile_velocity_b(spark, sf):
    n = notes(spark, sf)
    changed = n.filter("note_id % 13 != 0").selectExpr(*[c.strip() for c in (
        "track_id", "note_id", "CASE WHEN note_id % 7 = 1 THEN pitch + 1 ELSE pitch END AS pitch", "CAST(CASE WHEN note_id % 11 = 2 THEN vel % 100 + 1 ELSE vel END AS INT) AS vel",
        "CASE WHEN note_id % 10 = 3 THEN start_ms + 5 ELSE start_ms END AS start_ms", "CASE WHEN note_id % 5 = 4 THEN dur_ms * 2 ELSE dur_ms END AS dur_ms", "CASE WHEN note_id % 17 = 5 THEN 0 ELSE ntype END AS ntype",
    )])
    return M.reconcile(n.withColumn("vel_b", 1 + F.col("note_id") * 7 % 127), changed)


@query("""WITH {N}, p AS (SELECT a.note_id AS note_id_a, b.note_id AS note_id_b, round((least(a.start_ms + a.dur_ms, b.start_ms + b.dur_ms) - greatest(a.start_ms, b.start_ms)) / (greatest(a.start_ms + a.dur_ms, b.start_ms + b.dur_ms) - least(a.start_ms, b.start_ms)), 9) AS iou
FROM n a JOIN n b ON a.pitch = b.pitch AND a.track_id % 2 = 0 AND b.track_id % 2 = 1 AND a.start_ms < b.start_ms + b.dur_ms AND b.start_ms < a.start_ms + a.dur_ms),
r AS (SELECT *, row_number() OVER (PARTITION BY note_id_a ORDER BY iou DESC, note_id_b) AS i FROM p) SELECT note_id_a, note_id_b, iou FROM r WHERE i = 1""")
def interval_iou(spark, sf):
    n = notes(spark, sf)
    return M.best_iou(n.filter("track_id % 2 = 0"), n.filter("track_id % 2 = 1"), 500.0)


@query("""WITH {N}, c AS (SELECT note_id, pitch, start_ms AS a0, start_ms + greatest(1.0::DOUBLE, dur_ms) AS a1 FROM n WHERE track_id % 2 = 0),
e AS (SELECT pitch, start_ms AS b0, start_ms + dur_ms AS b1, note_id % 100 / 100.0::DOUBLE AS confidence, CASE note_id % 4 WHEN 0 THEN 'wind' WHEN 1 THEN 'string' WHEN 2 THEN 'plucked' ELSE 'key' END AS family FROM n WHERE track_id % 2 = 1),
s AS (SELECT note_id, c.pitch = e.pitch AS same, family, round(confidence * CASE WHEN c.pitch = e.pitch THEN 1 ELSE 0.58::DOUBLE END * (0.64::DOUBLE * greatest(0, 1 - abs(a0 - b0) / 160) + 0.36::DOUBLE * greatest(0, least(a1, b1) - greatest(a0, b0)) / greatest(1, greatest(a1, b1) - least(a0, b0))), 9) AS score
FROM c JOIN e ON abs(c.pitch - e.pitch) <= 1 AND b0 <= a1 + 120 AND abs(a0 - b0) <= 160),
g AS (SELECT note_id, same, family, max(score) AS score FROM s WHERE score >= CASE WHEN same THEN 0.42 ELSE 0.48 END GROUP BY 1, 2, 3),
o AS (SELECT * FROM g QUALIFY same = max(same) OVER (PARTITION BY note_id)),
r AS (SELECT *, row_number() OVER w AS i, coalesce(lead(score) OVER w, 0) AS nx FROM o WINDOW w AS (PARTITION BY note_id ORDER BY score DESC, family))
SELECT note_id, family, score FROM r WHERE i = 1 AND round(score - nx, 9) >= 0.1""")
def label_votes(spark, sf):
    n = notes(spark, sf)
    family = F.element_at(F.array(*map(F.lit, ("wind", "string", "plucked", "key"))), (F.col("note_id") % 4 + 1).cast("int"))
    return M.label_votes(n.filter("track_id % 2 = 0"), n.filter("track_id % 2 = 1").withColumns({"confidence": F.col("note_id") % 100 / 100.0, "family": family}))


#: A small dimension of instruments for the query: name, range, role, articulations.
INSTRUMENTS = (("bass", 28, 55, "bass", (0, 1)), ("cello", 36, 76, "bass", (0, 1, 2)), ("viola", 48, 84, "harmony", (0, 1, 2)), ("violin", 55, 96, "melody", (0, 1, 2, 3)), ("flute", 60, 96, "melody", (0, 2)), ("piano", 21, 108, "harmony", (0, 1)), ("drum", 35, 46, "bass", (99,)), ("bell", 100, 120, "melody", (0,)))


@query(f"""WITH {{N}}, k(instrument, low, high, role, arts) AS (VALUES {", ".join(f"('{n}', {a}, {b}, '{r}', {list(t)})" for n, a, b, r, t in INSTRUMENTS)}),
g AS (SELECT track_id, count(*) AS n, CASE WHEN avg(pitch) < 52 THEN 'bass' WHEN avg(pitch) >= 66 THEN 'melody' ELSE 'harmony' END AS own FROM n GROUP BY 1),
s AS (SELECT n.track_id, instrument, role, count(*) FILTER (pitch BETWEEN low AND high) AS inside, count(*) FILTER (list_contains(arts, ntype)) AS known FROM n, k GROUP BY 1, 2, 3),
c AS (SELECT s.track_id, instrument, inside, known, round(least(0.25::DOUBLE * inside / n + CASE WHEN role = own THEN 0.15::DOUBLE ELSE 0 END + 0.10::DOUBLE * known / n, 0.45::DOUBLE), 9) AS score FROM s JOIN g USING (track_id) WHERE inside > 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY track_id ORDER BY score DESC, inside DESC, known DESC, instrument) AS INTEGER) AS place FROM c) SELECT track_id, place, instrument, score FROM r WHERE place <= 3""")
def group_instrument_cross(spark, sf):
    rows = [(n, a, b, r, list(t)) for n, a, b, r, t in INSTRUMENTS]
    return M.group_instruments(notes(spark, sf), spark.createDataFrame(rows, "instrument string, low int, high int, role string, articulations array<int>"))


@query("""WITH {N}, k(instrument, low, high) AS (VALUES """ + ", ".join(f"('{n}', {a}, {b})" for n, a, b, _, _ in INSTRUMENTS) + """),
c AS (SELECT track_id, instrument, count(*) AS inside FROM n JOIN k ON pitch BETWEEN low AND high GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY inside DESC, instrument) AS i FROM c)
SELECT track_id, string_agg(instrument, ',' ORDER BY i) AS instruments FROM r WHERE i <= 2 GROUP BY 1""")
def topk_match(spark, sf):
    dim = spark.createDataFrame([(n, a, b) for n, a, b, _, _ in INSTRUMENTS], "instrument string, low int, high int")
    by_pitch = notes(spark, sf).groupBy("track_id", "pitch").count()
    inside = by_pitch.join(F.broadcast(dim), F.col("pitch").between(F.col("low"), F.col("high"))).groupBy("track_id", "instrument").agg(F.sum("count").alias("inside"))
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("inside")).alias("down"), "instrument"))), 1, 2)
    return inside.groupBy("track_id").agg(best.alias("b")).select("track_id", F.array_join(F.transform("b", lambda x: x["instrument"]), ",").alias("instruments"))


@query("""WITH r AS (SELECT c_custkey AS k, c_nationkey % 3 AS instrument, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_mktsegment END AS settings, CAST(floor(c_acctbal / 5000.0) AS BIGINT) AS volume FROM customer)
SELECT a.k AS a, b.k AS b, CASE WHEN a.instrument IS DISTINCT FROM b.instrument THEN 'instrument' WHEN a.volume IS DISTINCT FROM b.volume THEN 'volume' WHEN a.settings IS DISTINCT FROM b.settings THEN 'settings' END AS blocked FROM r a JOIN r b ON b.k = a.k + 1""")
def route_join(spark, sf):
    c = table(spark, sf, "customer")
    routes = c.select(F.col("c_custkey").alias("k"), (F.col("c_nationkey") % 3).alias("instrument"), F.floor(F.col("c_acctbal") / 5000.0).alias("volume"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment")).alias("settings"))
    return M.route_join(c.select(F.col("c_custkey").alias("a"), (F.col("c_custkey") + 1).alias("b")), routes, "k", ("instrument", "volume", "settings"))


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_quantity), 6) AS mean_l_quantity, round(avg(l_extendedprice), 6) AS mean_l_extendedprice FROM lineitem GROUP BY 1, 2""")
def metric_means(spark, sf):
    return M.match_metrics(table(spark, sf, "lineitem"), ("l_quantity", "l_extendedprice"), (F.col("l_returnflag"), F.col("l_linestatus")))


@query("""WITH {N}, e AS (SELECT * FROM n WHERE track_id % 2 = 0), f AS (SELECT * FROM n WHERE track_id % 2 = 1),
p AS (SELECT e.note_id AS a, f.note_id AS b, least(e.start_ms + e.dur_ms, f.start_ms + f.dur_ms) - greatest(e.start_ms, f.start_ms) AS o, abs(e.start_ms - f.start_ms) AS d FROM e JOIN f ON e.pitch = f.pitch AND e.start_ms < f.start_ms + f.dur_ms AND f.start_ms < e.start_ms + e.dur_ms),
g AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY o DESC, d, b) AS i FROM p), c AS (SELECT b, count(*) AS parts FROM g WHERE i = 1 GROUP BY 1),
r AS (SELECT pitch, count(*) AS "references", count(parts) AS matched, count(*) FILTER (parts > 1) AS split FROM f LEFT JOIN c ON c.b = f.note_id GROUP BY 1)
SELECT r.pitch, coalesce(x.n, 0) AS estimates, "references", matched, split, round(split / greatest(1, matched)::DOUBLE, 6) AS split_rate FROM r LEFT JOIN (SELECT pitch, count(*) AS n FROM e GROUP BY 1) x ON x.pitch = r.pitch""")
def fragment_metrics(spark, sf):
    n = notes(spark, sf)
    e, f = n.filter("track_id % 2 = 0"), n.filter("track_id % 2 = 1")
    return M.fragment_metrics(e, f, I.fragment_assign(e, f, 500.0))
