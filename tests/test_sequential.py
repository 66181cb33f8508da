"""Order-dependent operators against naive versions on seeded random intervals, and their independence of how rows are dealt."""

import itertools
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoweave.operators import aggregates, changes, folds, intervals, runs, sequential, walks

SCHEMA = "track_id long, note_id long, pitch int, vel int, start_ms double, dur_ms double, ntype int, confidence double"


def random_notes(seed, n=80):
    r = random.Random(seed)
    return [(r.randrange(2), i, r.randrange(40, 44), r.randrange(1, 128), float(r.randrange(0, 1500)) + r.choice((0, 0.5)), float(r.randrange(1, 120)), r.choice((0, 1, 99)), r.randrange(100) / 100) for i in range(n)]


def frame(spark, rows):
    rows = rows[:]
    random.Random(len(rows)).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def groups(rows, key):
    rows = sorted(rows, key=lambda x: (key(x), x[4], x[1]))
    return [list(g) for _, g in itertools.groupby(rows, key)]


@pytest.mark.parametrize("seed", range(4))
def test_folds(spark, seed):
    rows = random_notes(seed)
    got = {r["note_id"]: r["anchor_ms"] for r in folds.anchor_cluster(frame(spark, rows), 12.0).collect()}
    for g in groups(rows, lambda x: x[0]):
        anchor = None
        for x in g:
            if anchor is None or x[4] - anchor > 12:
                anchor = x[4]
            assert got[x[1]] == anchor
    got = sorted(tuple(r)[2:] for r in folds.fold_same_pitch(frame(spark, rows)).collect())
    want = []
    for g in groups(rows, lambda x: (x[0], x[2])):
        now = None
        for x in g:
            a, b = x[4], x[4] + x[5]
            if now and a - now[1] <= 80 and min(now[2], b) - max(now[1], a) >= 0.75 * min(now[2] - now[1], b - a):
                now = [x[1] if x[3] > now[4] else now[0], now[1], max(now[2], b), now[3] + 1, max(now[4], x[3])]
            else:
                want += [tuple(now[:4])] if now else []
                now = [x[1], a, b, 1, x[3]]
        want.append(tuple(now[:4]))
    assert got == sorted(want)


@pytest.mark.parametrize("seed", range(4))
def test_nms(spark, seed):
    rows = random_notes(seed, 120)
    got = {r["note_id"]: r["kept_by"] for r in sequential.nms(frame(spark, rows), 20.0, 0.5).collect()}
    for g in groups(rows, lambda x: (x[0], x[2])):
        kept = []
        for x in sorted(g, key=lambda x: (-x[7], -x[5], x[4], x[1])):
            by = next((k for k in kept if abs(k[4] - x[4]) <= 20 and min(k[4] + k[5], x[4] + x[5]) - max(k[4], x[4]) >= 0.5 * max(k[5], x[5])), None)
            if by is None:
                kept.append(x)
            assert got[x[1]] == (by or x)[1]


def maximum_matching(a, b, tol):
    match = {}

    def augment(i, seen):
        for j, y in enumerate(b):
            if j not in seen and y[2] == a[i][2] and abs(a[i][4] - y[4]) <= tol:
                seen.add(j)
                if j not in match or augment(match[j], seen):
                    match[j] = i
                    return True
        return False

    return sum(augment(i, set()) for i in range(len(a)))


@pytest.mark.parametrize("seed", range(4))
def test_matching_is_maximum(spark, seed):
    rows = random_notes(seed)
    a, b = [x for x in rows if x[1] % 2], [x for x in rows if not x[1] % 2]
    got = sequential.note_matching(frame(spark, a), frame(spark, b), 30.0).collect()
    assert len({r[0] for r in got}) == len({r[1] for r in got}) == len(got) == maximum_matching(a, b, 30.0)
    at = {x[1]: x for x in rows}
    assert all(at[i][2] == at[j][2] and abs(at[i][4] - at[j][4]) <= 30 for i, j in got)


@pytest.mark.parametrize("seed", range(3))
def test_instance_limit_and_concurrency(spark, seed):
    rows = random_notes(seed, 150)
    out = sequential.instance_limit(frame(spark, rows), 2, 0.0)
    capped = {r["note_id"]: r["end_ms"] for r in out.collect()}
    short = [(*x[:5], capped[x[1]] - x[4], *x[6:]) for x in rows]
    peak = aggregates.peak_concurrency(frame(spark, short), ["track_id", "pitch"]).agg({"peak": "max"}).first()[0]
    assert len(capped) == len(rows) and peak <= 2


def test_viterbi_is_optimal(spark):
    r = random.Random(3)
    scores = [[r.random() for _ in range(3)] for _ in range(6)]
    got = [x["state"] for x in sorted(sequential.viterbi(spark.createDataFrame([(1, t, s) for t, s in enumerate(scores)], "track_id long, beat long, scores array<double>"), 3, 0.3).collect(), key=lambda x: x["beat"])]
    value = lambda path: sum(scores[t][s] for t, s in enumerate(path)) - 0.3 * sum(a != b for a, b in itertools.pairwise(path))
    assert value(got) == pytest.approx(max(map(value, itertools.product(range(3), repeat=6))))


def test_voices_do_not_share_an_onset(spark):
    rows = random_notes(9, 150)
    got = {r["note_id"]: r["voice"] for r in sequential.voice_tracking(frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    for g in groups(rows, lambda x: x[0]):
        at = {}
        for x in g:
            assert (got[x[1]], x[4]) not in at
            at[got[x[1]], x[4]] = x


def test_range_joins_have_no_nested_loops(spark):
    a = frame(spark, random_notes(1))
    plan = intervals.overlap_pairs(a, a, 100.0, ["track_id"])._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("seed", range(3))
def test_overlap_count_equals_pairs(spark, seed):
    a, b = random_notes(seed), random_notes(seed + 50)
    want = sum(x[0] == y[0] and x[4] < y[4] + y[5] and y[4] < x[4] + x[5] for x in a for y in b)
    assert intervals.overlap_count(frame(spark, a), frame(spark, b), ["track_id"]).agg({"pairs": "sum"}).first()[0] == want
    assert intervals.overlap_pairs(frame(spark, a), frame(spark, b), 37.0, ["track_id"]).count() == want


def test_change_sets_are_all_or_nothing(spark):
    rows = changes.indexed(frame(spark, random_notes(2))).select("track_id", "idx", "pitch")
    bad = spark.createDataFrame([(0, "replace", 1, 0, (999,), (50,))], "track_id long, op string, idx long, seq int, before struct<pitch:int>, after struct<pitch:int>")
    with pytest.raises(Exception, match="change set"):
        changes.apply(rows, bad, ["pitch"]).collect()


def test_melodic_lines_equal_naive(spark):
    rng = np.random.default_rng(12)
    rows, at = [], 0.0
    for i in range(300):
        at += float(rng.choice([0.0, 5.0, 60.0, 150.0, 400.0, 900.0], p=[0.1, 0.1, 0.3, 0.3, 0.15, 0.05]))
        rows.append((i % 2, i, int(rng.integers(40, 80)), 80, at, float(rng.integers(20, 400)), 0))
    notes = spark.createDataFrame(rows, "track_id long, note_id long, pitch int, vel int, start_ms double, dur_ms double, ntype int")
    got = {r["note_id"]: r["line"] for r in sequential.melodic_lines(notes).collect()}
    want = {}
    for track in (0, 1):
        own = sorted((r for r in rows if r[0] == track), key=lambda r: (r[4], r[1]))
        groups = []
        for r in own:
            if groups and r[4] - groups[-1][0][4] <= 12:
                groups[-1].append(r)
            else:
                groups.append([r])
        active = []
        for g in groups:
            if len(g) != 1:
                active = []
                continue
            n = g[0]
            choices = [(abs(n[2] - x[-1][2]) * 20 + abs(n[4] - x[-1][4] - x[-1][5]), k) for k, x in enumerate(active) if -600 <= n[4] - x[-1][4] - x[-1][5] <= 420 and abs(n[2] - x[-1][2]) <= 12]
            if choices:
                line = active[min(choices)[1]]
                line.append(n)
            else:
                line = [n]
                active.append(line)
            want[n[1]] = line[0][1]
            active = [x for x in active if n[4] - x[-1][4] <= 420]
    assert got == want and len(set(want.values())) > 20


def test_walks_go_over_batches(spark):
    """Groups longer than a batch, and batches of many groups, come out whole and in order."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.range(200).select((F.col("id") % 50 * (F.col("id") % 3 % 2)).alias("k"), F.col("id").alias("v"))
        got = walks.over_groups(df, ["k"], ["v"], ["v"], lambda g: (g["k"][:1], np.array([len(g["v"])]), np.array([",".join(map(str, g["v"]))])), "k long, n long, s string")
        want = df.groupBy("k").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("v")), ",").alias("s"))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_one_dense_key_is_walked_once(spark):
    """A key without gaps is one island; the work must follow its rows, not their square."""
    n = 200_000
    notes = spark.range(n).select(F.lit(0).cast("long").alias("track_id"), F.col("id").alias("note_id"), F.lit(60).alias("pitch"), (F.col("id") % 127).cast("int").alias("vel"), (F.col("id") * 0.5).alias("start_ms"), F.lit(3.0).alias("dur_ms"), F.lit(0).alias("ntype"), (F.col("id") % 100 / 100.0).alias("confidence"))
    began = time.perf_counter()
    assert folds.anchor_cluster(notes).select("anchor_ms").distinct().count() == n // 25
    assert folds.fold_same_pitch(notes).agg(F.sum("members")).first()[0] == n
    assert sequential.nms(notes).count() == n
    assert time.perf_counter() - began < 90


@pytest.mark.parametrize("seed", range(3))
def test_best_match_once_equals_naive(spark, seed):
    rows = random_notes(seed, 160)
    a, b = [r for r in rows if r[1] % 2 == 0], [r for r in rows if r[1] % 2]
    got = sorted(tuple(r) for r in intervals.best_match_once(frame(spark, a), frame(spark, b)).collect())
    free, want = set(b), []
    for x in sorted(a, key=lambda r: (r[4], r[1])):
        near = [(abs(y[4] - x[4]), abs(y[5] - x[5]), y[1], y) for y in free if y[2] == x[2] and abs(y[4] - x[4]) <= 35 and abs(y[5] - x[5]) <= max(35, 0.25 * x[5])]
        if near:
            free.remove(min(near)[3])
            want.append((x[1], min(near)[2]))
    assert got == sorted(want) and len(want) > 10


WIDTHS = (None, 1.0, 37.0, 1e9)


def test_running_values_do_not_depend_on_buckets(spark):
    rows = [(r[0], r[1], r[4], r[3] if r[3] % 3 else None) for r in random_notes(5, 300)] + [(None, 900, 5.0, 7), (None, 901, 800.0, None)]
    df = spark.createDataFrame(rows, "k long, id long, at double, v int")
    same = lambda fn: len({str(sorted(map(str, fn(width).collect()))) for width in WIDTHS}) == 1
    assert same(lambda w: runs.carried(df, ("k",), "at", ("id",), "v", "last", width=w))
    assert same(lambda w: runs.carried(df, ("k",), "at", ("id",), "v", "last", "first", w))
    assert same(lambda w: runs.running_sums(df, ("k",), "at", ("id",), {"s": F.coalesce("v", F.lit(0))}, w))
    assert same(lambda w: runs.islands(df, ("k",), 3.0, "at", ("id",), w))


def test_large_keys_are_cut_by_themselves(spark, monkeypatch):
    monkeypatch.setattr(runs, "SMALL_BYTES", 0)
    df = spark.range(4000).selectExpr("IF(id < 3000, 1, id) AS k", "id", "id * 2.0D AS at")
    assert runs.bucket_width(df, ("k",), "at", 5000) is None
    width = runs.bucket_width(df, ("k",), "at", 500)
    assert df.filter("k = 1").groupBy(F.floor(F.col("at") / width)).count().agg(F.max("count")).first()[0] <= 501
    assert runs.bucket_width(df.withColumn("at", F.lit(1.0)), ("k",), "at", 500) is None



def test_a_dense_key_is_many_tasks(spark):
    """The rows of one key are sorted in as many tasks as there are buckets with rows."""
    df = spark.range(200_000).selectExpr("0L AS k", "id AS note_id", "id * 1.0D AS at")
    tasks = lambda w: runs.running_sums(df, ("k",), "at", ("note_id",), {"s": F.lit(1)}, w).filter("s > 0").withColumn("task", F.spark_partition_id()).select("task").distinct().count()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert tasks(None) == 1 and tasks(2000.0) > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_overlapping_overrides_are_an_error(spark):
    spans = "track_id long, start_ms double, end_ms double, label string"
    automatic = spark.createDataFrame([(1, 0.0, 100.0, "a")], spans)
    manual = spark.createDataFrame([(1, 10.0, 30.0, "m"), (1, 20.0, 40.0, "n")], spans)
    with pytest.raises(Exception, match="manual intervals overlap"):
        intervals.interval_override(automatic, manual, 50.0).collect()
