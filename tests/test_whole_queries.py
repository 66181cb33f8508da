"""The queries over all rows and the whole timeline, by brute force on rows that id subsets and timeline prefixes leave out."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest

from chronoweave.notes import notes
from chronoweave.plans import catalog


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    out, r = str(tmp_path_factory.mktemp("whole")), random.Random(5)
    kinds = ["click", "view", "purchase", "signup", "error"]
    events = [
        (i, datetime(2024, 1, 1) + timedelta(seconds=r.randrange(2_590_000), microseconds=i), r.choice([0, 0, 1, 2, 3, 7]), r.choice(kinds), r.random() * 300 + 0.03, f'{{"k": {r.randrange(90)}}}')
        for i in range(500)
    ]
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{out}/events.parquet")
    part = [(i, r.randrange(1, 51)) for i in [*range(1, 40), *range(5000, 5400)]]
    spark.createDataFrame(part, "p_partkey long, p_size int").write.parquet(f"{out}/part.parquet")
    lines = [(r.randrange(1, 100), float(r.randrange(1, 51))) for _ in range(300)]
    spark.createDataFrame(lines, "l_suppkey long, l_quantity double").write.parquet(f"{out}/lineitem.parquet")
    return {"dir": out, "part": part, "lines": lines, "notes": notes(spark, out).collect()}


def got(spark, sf, name):
    return catalog.QUERIES[name](spark, sf["dir"]).collect()


def test_all_parts_are_zones(spark, sf):
    want = {}
    for n in sf["notes"]:
        hits = []
        for p, size in sf["part"]:
            low, vel = 36 + size % 30, p % 100
            if low <= n.pitch <= low + size % 7 and vel <= n.vel <= vel + 30:
                hits.append((abs(n.pitch - 36 - size), abs(n.vel - (2 * vel + 30) / 2), p))
        if hits:
            want[n.note_id] = min(hits)[2]
    assert {r.note_id: r.zone_id for r in got(spark, sf, "zone_lookup_whole")} == want and max(want.values()) > 200


def test_all_notes_snap_within_their_track(spark, sf):
    want = {}
    for n in sf["notes"]:
        hits = [
            (int(t.ntype != 3), abs(t.start_ms - e), t.start_ms - e, t.start_ms)
            for t in sf["notes"] for e in (n.start_ms, n.start_ms + n.dur_ms)
            if t.track_id == n.track_id and t.note_id != n.note_id and e - 200 <= t.start_ms <= e + 200
        ]
        if hits:
            want[n.note_id] = min(hits)[3:1:-1]
    assert {r.note_id: (r.target_ms, r.shift) for r in got(spark, sf, "snap_nearest_whole")} == want
    assert len({n.track_id for n in sf["notes"] if n.note_id in want}) == 5


def test_whole_tables_are_united(spark, sf):
    want = Counter(sf["lines"]) + Counter((p, float(size)) for p, size in sf["part"])
    assert Counter(map(tuple, got(spark, sf, "union_tracks_whole"))) == want


def slots(sf, width):
    at = {}
    for n in sf["notes"]:
        at.setdefault(n.track_id, []).append(n.start_ms)
    return {t: range(int(min(x) // width), int(max(x) // width) + 1) for t, x in at.items()}


def test_clips_reach_the_last_note(spark, sf):
    want = set()
    for n in sf["notes"]:
        for k in slots(sf, 3000)[n.track_id]:
            a, b = max(n.start_ms + 40.0, k * 3000.0 + 100), min(n.start_ms + n.dur_ms + 40.0, k * 3000.0 + 2600)
            if k * 3000 <= n.start_ms < k * 3000 + 3500 and b - a >= 1:
                want.add((n.track_id, k, n.note_id, n.pitch, n.vel, a, b - a, n.ntype))
    rows = list(map(tuple, got(spark, sf, "clip_projection_whole")))
    assert set(rows) == want and len(rows) == len(want) and max(r[1] for r in rows) == 8


def test_automatic_intervals_reach_the_last_note(spark, sf):
    want = []
    for t, ks in slots(sf, 1000).items():
        hole = (500.0 + t % 7 * 300, 1400.0 + t % 7 * 300) if t % 3 == 0 else None
        want += [(t, *hole, "manual")] if hole else []
        for k in ks:
            a, b = k * 1000.0, k * 1000.0 + 1000
            pieces = [(a, min(b, hole[0])), (max(a, hole[1]), b)] if hole and hole[0] < b and a < hole[1] else [(a, b)]
            want += [(t, x, y, "auto") for x, y in pieces if x < y]
    rows = sorted(map(tuple, got(spark, sf, "interval_override_whole")))
    assert rows == sorted(want) and max(r[2] for r in rows) > 25_000
