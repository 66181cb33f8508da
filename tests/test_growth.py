"""Operators whose work once grew faster than their input: results by brute force, and the step that grew."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoweave.operators import arrange, blocks, cleanup, intervals, runs, sequential, walks
from chronoweave.plans import catalog


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def r():
    return random.Random(11)


def test_sustained_pairs_are_read_from_the_other_end(spark, r):
    kinds = ["on", "on", "off", "off", "down", "up"]
    events = [(c, r.choice([60, 61]), float(r.randrange(60)), i, r.choice(kinds), 64) for i, c in enumerate([0, 1] * 80)]
    events = [(c, None if k in ("down", "up") else p, t, i, k, v) for c, p, t, i, k, v in events]
    want = []
    for c, p, t, i, k, _ in events:
        if k != "on":
            continue
        after = lambda t, i: sorted((x for x in events if x[0] == c and (x[2], x[3]) > (t, i)), key=lambda x: x[2:4])  # noqa: B023, E731
        following = next((x for x in after(t, i) if x[1] == p), None)
        end = t + 100
        if following and following[4] == "off":
            pedal = [x[4] for x in sorted(events, key=lambda x: x[2:4]) if x[0] == c and x[1] is None and x[2:4] < following[2:4]]
            end = following[2]
            if pedal and pedal[-1] == "down":
                end = next((x[2] for x in after(*following[2:4]) if x[4] == "up" or x[4] == "on" and x[1] == p), t + 100)
        elif following:
            end = following[2]
        if end > t:
            want.append((c, p, 64, t, end - t))
    df = sequential.event_pairing_sustained(spark.createDataFrame(events, "channel long, pitch int, at_ms double, seq long, kind string, vel int"))
    assert sorted(map(tuple, df.collect())) == sorted(want)
    assert "unboundedfollowing" not in plan(df).lower()


def test_intervals_without_length_overlap_what_holds_them(spark, r):
    rows = lambda n: [(r.randrange(2), float(r.randrange(12)), float(r.choice([0, 0, 1, 3]))) for _ in range(n)]
    a, b = rows(60), rows(60)
    want = {k: sum(x[0] == y[0] == k and x[1] < y[1] + y[2] and y[1] < x[1] + x[2] for x in a for y in b) for k in (0, 1)}
    frame = lambda x: spark.createDataFrame(x, "track_id int, start_ms double, dur_ms double")
    for width in (None, 4.0):
        assert {x.track_id: x.pairs for x in intervals.overlap_count(frame(a), frame(b), ["track_id"], width).collect()} == want


def test_chords_are_found_without_pairs(spark, r):
    notes = [(i, 40 + r.randrange(12), float(r.randrange(300))) for i in range(80)]
    windows = [(float(r.randrange(300)), [r.randrange(12)]) for _ in range(40)]
    want = {}
    for i, pitch, start in notes:
        near = [w for w in windows if start - 12 <= w[0] <= start + 12]
        if near:
            want[i] = (min(near)[0], pitch % 12 not in min(near)[1])
    df = intervals.chord_lookup(spark.createDataFrame(notes, "note_id long, pitch int, start_ms double"), spark.createDataFrame(windows, "window_ms double, pitch_classes array<int>"))
    assert {x.note_id: (x.window_ms, x.non_chord) for x in df.collect()} == want and len(want) > 40
    assert "Join" not in plan(df)


def test_clips_that_just_fit_keep_their_place(spark, r):
    """By the rule of the query's SQL, on lengths that fill a gap but for rounding."""
    wanted, occupied, want = [], [], {}
    for t in range(300):
        at, own = round(r.random() * 5, 2), []
        for _ in range(5):
            end = at + round(1 + r.random() * 5, 2)
            own.append((at, end))
            at = end + round(r.random() * 5, 2)
        i = r.randrange(4)
        for start, d in ((own[i][1], own[i + 1][0] - own[i][1]), (own[i][0] + 0.5, round(own[i + 1][0] - own[i][1], 2))):
            hits = [k for k, (lo, hi) in enumerate(own) if lo < start + d and start < hi and d > 0]
            place, c = start, len(wanted)
            if hits:
                right = min(hi for k, (lo, hi) in enumerate(own) if k >= hits[-1] and (k == 4 or hi + d <= own[k + 1][0]))
                left = [lo - d for k, (lo, hi) in enumerate(own) if k <= hits[-1] and lo - (own[k - 1][1] if k else 0) >= d]
                place = max(left) if left and max(left) >= 0 and abs(max(left) - start) <= abs(right - start) else right
            wanted.append((t, c, start, d))
            want[c] = place
        occupied += [(t, lo, hi) for lo, hi in own]
    df = arrange.free_slot(spark.createDataFrame(wanted, "track_id long, clip_id long, start_ms double, dur_ms double"), spark.createDataFrame(occupied, "track_id long, start_ms double, end_ms double"))
    assert {x.clip_id: x.start_ms for x in df.collect()} == want


@pytest.mark.parametrize("tracks", [3, 1000])
def test_tracks_meet_in_blocks(spark, r, tracks):
    rows = sorted({(r.randrange(2), r.randrange(12), r.choice([0, 1, 2, 2000, 9000, 9001])) for _ in range(90)})
    sets = {}
    for k, t, b in rows:
        sets.setdefault((k, t), set()).add(b)
    want = sorted((k, a, b, len(x & y), min(len(x), len(y))) for (k, a), x in sets.items() for (m, b), y in sets.items() if k == m and a < b and x & y)
    onsets = spark.createDataFrame(rows, "song long, track_id long, bucket long")
    facts = onsets.groupBy("song", "track_id").agg(F.count("*").alias("n"))
    df = blocks.shared_pairs(onsets, facts, ["song"], lambda p: (p["a"], p["b"], p["shared"], np.minimum(*p["n"])), "a long, b long, shared long, least double", tracks)
    assert sorted(map(tuple, df.collect())) == want


def test_copies_of_tracks_do_not_follow_their_number(spark):
    """A track is sent once a block, so many tracks are few blocks."""
    onsets = spark.range(60_000).selectExpr("id AS track_id", "id AS bucket")
    df = blocks.shared_pairs(onsets, onsets.selectExpr("track_id", "1 AS n"), [], lambda p: (p["a"],), "a long")
    (last,) = re.findall(r"explode\(sequence\(0, (\d+)", df._jdf.queryExecution().analyzed().toString())
    assert 1 <= int(last) <= 8


def test_tiles_of_a_block_meet_once(spark, r, monkeypatch):
    solve = blocks.shared_pairs
    rows = sorted({(r.randrange(40), r.choice([0, 1, 2, 2000, 9000, 9001])) for _ in range(120)})
    sets = {}
    for t, b in rows:
        sets.setdefault(t, set()).add(b)
    want = sorted((a, b, len(x & y)) for a, x in sets.items() for b, y in sets.items() if a < b and x & y)
    onsets = spark.createDataFrame(rows, "track_id long, bucket long")
    monkeypatch.setattr(blocks, "TILE", 7)

    def shared(p):
        return p["a"], p["b"], p["shared"]

    for tracks in (100, 13):
        df = solve(onsets, onsets.groupBy("track_id").agg(F.count("*").alias("n")), [], shared, "a long, b long, shared long", tracks)
        assert sorted(map(tuple, df.collect())) == want


def test_counts_and_products_agree(monkeypatch):
    rng = np.random.default_rng(3)

    def side(n, most):
        own = [np.sort(rng.choice(2500, rng.integers(0, most), replace=False)) for _ in range(n)]
        row, code = np.repeat(np.arange(n, dtype=np.int32), [len(x) for x in own]), np.concatenate([*own, np.zeros(0, int)]).astype(np.int32)
        order = np.argsort(code, kind="stable")
        return own, (n, row[order], code[order])

    for most in (1, 2, 40, 2400):
        (a, x), (b, y) = side(20, most), side(30, most)
        want = [[len(np.intersect1d(p, q)) for q in b] for p in a]
        for hits in (0, 1 << 40):
            monkeypatch.setattr(blocks, "HITS", hits)
            assert blocks._counts(x, y).tolist() == want


def test_rounding_is_that_of_spark(spark):
    values = [a / b for b in (1, 3, 7, 65, 128, 640, 1080, 12800) for a in range(-40, 3 * b, max(1, b // 90))] + [float("nan"), 0.0, 5e-7, 4.9999999e-7, 0.1234565, 0.12345649999999999]
    want = [x[0] for x in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i").select(F.round("v", 6)).collect()]
    got = blocks.rounded(np.array(values))
    assert all(a == b or a != a and b != b for a, b in zip(got.tolist(), want, strict=True))


def test_track_pairs_are_not_shuffled(spark):
    for name in ("pairwise_tracks", "suggestions_topn"):
        text = plan(catalog.QUERIES[name](spark, "/root/testdata/sf0.001"))
        assert "FlatMapGroupsInArrow" in text and not any("bucket#" in x and "Inner" in x for x in text.splitlines())


def test_zones_of_equal_ranges_are_one_before_they_are_exploded(spark):
    zones = spark.range(20_000).selectExpr("id AS zone_id", "40 + id % 2 AS low_pitch", "60 + id % 2 AS high_pitch", "0 AS low_vel", "127 AS high_vel", "50 AS root")
    notes = spark.createDataFrame([(1, 40, 64), (2, 61, 64), (3, 50, 0), (4, 62, 1)], "note_id long, pitch long, vel int")
    df = intervals.zone_lookup(notes, zones)
    assert {x.note_id: x.zone_id for x in df.collect()} == {1: 0, 2: 1, 3: 0}
    text = plan(df)
    assert text.index("functions=[min(zone_id") > text.index("Generate explode")


def test_contamination_by_running_sums(spark, r):
    notes = [(r.randrange(2), i, r.choice([60, 61, 62]), round(r.random() * 40, 2), r.choice([0.0, 0.01, 0.3, 7.25, 20.0, -1.5])) for i in range(150)]
    notes += [(0, 900 + i, 60 + i % 2, 5.0, d) for i, d in enumerate([0.0, 0.0, 2.0, 2.0])]
    want = {}
    for t, i, p, s, d in notes:
        met = [min(s + d, u + e) - max(s, u) for t2, _, q, u, e in notes if t == t2 and p != q and s < u + e and u < s + d]
        if met:
            want[i] = sum(x / d for x in met) if d else None
    df = intervals.contamination(spark.createDataFrame(notes, "track_id long, note_id long, pitch int, start_ms double, dur_ms double"), 10.0)
    got = {x.note_id: x.contamination for x in df.collect()}
    assert got.keys() == want.keys() and None in want.values()
    assert all(got[k] is v if v is None else got[k] == pytest.approx(v, abs=2e-6) for k, v in want.items())


def test_contamination_makes_no_pairs_of_notes(spark):
    text = plan(catalog.QUERIES["contamination"](spark, "/root/testdata/sf0.001"))
    assert text.count("Window [") >= 2 and "decimal" in text


def test_a_held_group_takes_its_own_columns_once(spark):
    """A group of several batches: keys are one value, and no column holds the batches that it came in."""

    def solve(g):
        assert np.array_equal(g["at"], np.arange(len(g["at"]))) and set(g["key"].tolist()) == {g["key"][0]}
        return g["key"][:1], np.array([len(g["at"])]), np.array([g["key"].strides[0]]), np.array([g["at"].base is None])

    rows = spark.range(90_000).selectExpr("id % 2 AS key", "id DIV 2 AS at")
    found = walks.over_groups(rows, ["key"], [], ["at"], solve, "key long, n long, stride long, own boolean").collect()
    assert sorted(map(tuple, found)) == [(k, 45_000, 0, True) for k in (0, 1)]


def test_tasks_of_snapping_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(runs, "ROWS_A_TASK", 1000)
    text = plan(catalog.QUERIES["snap_nearest"](spark, "/root/testdata/sf0.001"))
    assert "REPARTITION_BY_NUM" in text and text.count("Exchange hashpartitioning(track_id") == 1


def test_neighbours_are_running_maxima_not_pairs(spark):
    r = random.Random(5)
    rows = [(r.randrange(2), i, 60 + r.randrange(5), s, s + r.choice([1, 2, 3, 7, 9, 12])) for i, s in enumerate(r.randrange(120) for _ in range(150))]
    events = spark.createDataFrame(rows, "track_id long, note_id long, pitch int, start_frame long, end_frame long")
    flicker = {a[1] for a in rows for b in rows if a[0] == b[0] and 1 <= abs(a[2] - b[2]) <= 2 and a[4] - a[3] <= 8 and b[4] - b[3] >= a[4] - a[3] + 2 and b[3] <= a[4] + 1 and b[4] >= a[3] - 1}
    spans = [(t, p, s, e) for t, _, p, s, e in rows[:60]]
    spanned = {a[1]: max(own) for a in rows if (own := [e for t, p, s, e in spans if (t, p) == (a[0], a[2]) and s <= a[3] + 1 and e >= a[3] - 3])}
    chord = {a[1]: any(a[0] == b[0] and a[2] != b[2] and abs(a[3] - b[3]) <= 2 for b in rows) for a in rows}
    for width in (None, 7.0):
        df = cleanup.pitch_flicker(events, width=width)
        assert {x.note_id for x in df.collect()} == flicker and 0 < len(flicker) < len(rows)
        reach = cleanup.spanned_by(events, spark.createDataFrame(spans, "track_id long, pitch int, f_from long, f_to long"), width)
        assert {x.note_id: x.spanned for x in reach.collect()} == spanned
    assert "Join" not in plan(cleanup.pitch_flicker(events))
    known = cleanup.chord_supported(events)
    assert {x.note_id: x.supported for x in known.collect()} == chord
    text = plan(known)
    assert text.index("Window [") < text.rindex("HashAggregate")  # of frames, below the window
