"""Merging of split events under evidence: the cases that must and mustn't merge, and a plain fold over random events."""

import random
from statistics import median

import pytest

from chronoweave.operators import cleanup as C

EVENTS = "track_id long, note_id long, pitch int, confidence double, start_frame long, end_frame long"


def frames(*spans):
    """{(pitch, frame): value} of (pitch, from, to, value), later ones on top."""
    return {(p, f): v for p, a, b, v in spans for f in range(a, b)}


def run(spark, events, frame, onset=None):
    rows = [(1, i, p, c, a, b) for i, (a, b, p, c) in enumerate(events)]
    onset = onset or {}
    evidence = [(1, p, f, frame.get((p, f), 0.0), onset.get((p, f), 0.0)) for p, f in {*frame, *onset}] or [(1, 0, 0, 0.0, 0.0)]
    return spark.createDataFrame(rows, EVENTS), spark.createDataFrame(evidence, "track_id long, pitch int, frame long, frame_value double, onset_value double")


def merged(spark, *args):
    return sorted((r["start_frame"], r["end_frame"], r["pitch"], r["confidence"]) for r in C.merge_same_pitch(*run(spark, *args)).collect())


SPLIT = [(5, 12, 60, 0.72), (14, 22, 60, 0.64)]
LONG = frames((60, 5, 22, 0.8))


def test_a_weak_split_of_a_sustained_note_is_merged(spark):
    assert merged(spark, SPLIT, LONG) == [(5, 22, 60, 0.72)]
    plateau = frames((60, 5, 6, 0.80), (60, 11, 18, 0.50), (60, 14, 15, 0.52))
    assert merged(spark, SPLIT, LONG, plateau) == [(5, 22, 60, 0.72)]


@pytest.mark.parametrize("onset", [frames((60, 5, 6, 0.80), (60, 14, 15, 0.52)), frames((60, 14, 15, 0.7)), frames((60, 14, 15, 0.2))])
def test_reattacks_stay(spark, onset):
    assert len(merged(spark, SPLIT, LONG, onset)) == 2


def test_rising_frames_broken_frames_and_gaps_stay(spark):
    assert len(merged(spark, SPLIT, frames((60, 5, 22, 0.35), (60, 14, 22, 0.8)))) == 2
    assert len(merged(spark, SPLIT, frames((60, 5, 12, 0.8), (60, 14, 22, 0.8)))) == 2
    assert len(merged(spark, [(5, 11, 60, 0.7), (14, 22, 60, 0.7)], LONG)) == 2


def test_chords_repeats_and_trills_stay(spark):
    chord = merged(spark, [*SPLIT, (14, 22, 64, 0.7)], frames((60, 0, 38, 0.8), (64, 14, 22, 0.8)))
    assert len([x for x in chord if x[2] == 60]) == 2
    assert len(merged(spark, [(0, 6, 60, 0.7), (8, 14, 60, 0.7), (16, 22, 60, 0.7), (24, 30, 60, 0.7)], frames((60, 0, 38, 0.8)))) == 4
    trill = merged(spark, [(0, 8, 60, 0.7), (7, 10, 62, 0.5), (10, 18, 60, 0.7)], frames((60, 0, 18, 0.8), (62, 7, 10, 0.8)))
    assert len([x for x in trill if x[2] == 60]) == 2


def fold(events, frame, onset):
    """The same, event by event."""
    window = lambda series, p, a, b: [series.get((p, f), 0.0) for f in range(max(0, a), b)]
    length = lambda e: e[1] - e[0]
    flicker = [e for e in events if length(e) <= 8 and any(1 <= abs(e[2] - o[2]) <= 2 and length(o) >= length(e) + 2 and o[0] <= e[1] + 1 and o[1] >= e[0] - 1 for o in events)]
    out = []
    for pitch in sorted({e[2] for e in events}):
        own = sorted((e for e in events if e[2] == pitch), key=lambda e: (e[0], e[1], e[4]))
        attacks, current = sorted({e[0] for e in own}), None
        for e in own:
            around = lambda s, e=e: max(window(s, pitch, e[0] - 1, e[0] + 2))
            ok = current is not None and 0 <= e[0] - current[1] <= 2
            if ok:
                ok = min(window(frame, pitch, current[1] - 1, e[0] + 2)) >= 0.24
                ok &= not any(1 <= abs(f[2] - pitch) <= 2 and f[0] <= e[0] + 1 and f[1] >= current[1] - 1 for f in flicker)
                beyond = window(onset, pitch, e[0] - 3, e[0] - 1) + window(onset, pitch, e[0] + 2, e[0] + 4)
                ok &= round(around(onset) - (median(beyond) if beyond else 0), 9) < 0.10
                ok &= around(onset) == 0 or around(onset) < current[5]
                past = window(frame, pitch, e[0] - 3, e[0])
                ok &= round(max(window(frame, pitch, e[0], e[0] + 2)) - (median(past) if past else 0), 9) < 0.10
                ok &= not any(o[2] != pitch and abs(o[0] - e[0]) <= 2 for o in events) and len({o[2] for o in events if abs(o[0] - e[0]) <= 2}) < 2
                k = attacks.index(e[0])
                step = e[0] - attacks[k - 1]
                sides = ([attacks[k - 1] - attacks[k - 2]] if k > 1 else []) + ([attacks[k + 1] - e[0]] if k + 1 < len(attacks) else [])
                ok &= not any(abs(s - step) <= max(1, round(step * 0.2)) for s in sides)
            if ok:
                current[1], current[3], current[6] = max(current[1], e[1]), max(current[3], e[3]), current[6] + 1
            else:
                current = [e[0], e[1], pitch, e[3], e[4], around(onset), 1]
                out.append(current)
    return sorted((x[4], x[0], x[1], x[2], x[3], x[6]) for x in out)


@pytest.mark.parametrize("seed", range(5))
def test_random_events_against_a_plain_fold(spark, seed):
    r, events, at = random.Random(seed), [], 0
    for i in range(140):
        at += r.choice((0, 1, 3, 4, 6, 9))
        events.append((at, at + r.choice((2, 5, 6, 8, 12)), r.choice((60, 60, 60, 62, 70)), r.randrange(100) / 100, i))
    frame = {(p, f): v for p in (60, 62, 70) for f in range(at + 20) if (v := r.choice((0.3, 0.32, 0.35, 0.3, 0.1))) > 0.1 or r.random() < 0.2}
    onset = {(p, f): r.choice((0.01, 0.02, 0.05, 0.3)) for p in (60, 62, 70) for f in range(at + 20) if r.random() < 0.2}
    found = C.merge_same_pitch(*run(spark, [e[:4] for e in events], frame, onset)).collect()
    got = sorted((x["note_id"], x["start_frame"], x["end_frame"], x["pitch"], x["confidence"], x["members"]) for x in found)
    assert got == fold(events, frame, onset)


def test_some_random_events_merge():
    """The generator above does make merges."""
    r = random.Random(0)
    events = [(10 * i, 10 * i + r.choice((8, 9, 10)), 60, 0.5, i) for i in range(0, 60, 3)] + [(10 * i + 9, 10 * i + 14, 60, 0.5, 100 + i) for i in range(0, 60, 6)]
    assert any(x[5] > 1 for x in fold(events, frames((60, 0, 700, 0.5)), {}))


def test_all_steps_of_the_clean_up(spark):
    events = [*SPLIT, (14, 22, 60, 0.64), (40, 50, 60, 0.9), (41, 51, 60, 0.5), (80, 83, 90, 0.1), (5, 5, 60, 0.5), (3, 9, 128, 0.5), (3, 9, 60, 1.5)]
    rows, evidence = run(spark, events, LONG | frames((60, 40, 51, 0.8)))
    audit = lambda profile: {r["note_id"]: (r["status"], r["by"]) for r in C.cleanup(rows, evidence, profile).collect()}
    bad = {i: ("invalid", None) for i in (6, 7, 8)}
    clean = {0: ("kept", None), 1: ("merged", 0), 2: ("duplicate", 1), 3: ("kept", None), 4: ("suppressed", 3), 5: ("hidden", None)} | bad
    assert audit("clean") == clean
    assert audit("balanced") == clean | {5: ("kept", None)}
    assert audit("raw") == clean | {i: ("kept", None) for i in (1, 4, 5)}
    assert C.cleanup(rows.limit(0), evidence).count() == 0
