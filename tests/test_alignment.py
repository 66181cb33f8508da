"""Alignment to a piecewise grid against a note-by-note version."""

import random
from math import ceil

import pytest

from chronoweave.operators import alignment as L

NOTES = "track_id long, note_id long, pitch int, start_ms double, dur_ms double, confidence double"
SEGMENTS = "track_id long, start_ms double, bpm double, beat_at_start double"
MAP = [(0.0, 120.0, 0.0), (2000.0, 90.0, 4.0), (5000.0, 150.0, 8.5)]


def segment(t):
    return next((s for s in reversed(MAP) if s[0] <= t), MAP[0])


def plain(rows, evidence, strict):
    out = {}
    for t, i, p, a, d, c in rows:
        frames = [(-evidence.get((t, p, f), 0.0), f) for f in range(ceil(a / 10) - 2, ceil(a / 10) + 3)]
        value, frame = min(frames)
        onset = frame * 10.0 if -value >= 0.35 and abs(frame * 10.0 - a) <= 30 else a
        (s0, bpm, b0), (e0, e_bpm, eb0) = segment(onset), segment(a + d)
        beat, end_beat, ms = round(b0 + (onset - s0) * bpm / 60000, 9), round(eb0 + (a + d - e0) * e_bpm / 60000, 9), 60000 / bpm
        snap = lambda x, step: round(round(x / step, 9)) * step
        step, divisor = (1 / 16, 16) if strict else next((g for g in L.STEPS if abs(beat - snap(beat, g[0])) * ms <= min(45.0, g[0] * ms * 0.35) + 1e-9), (1 / 16, 16))
        x, y = snap(beat, step), snap(end_beat, step)
        y = y if y > x else x + step
        bound = lambda v, raw: max(raw - 45, min(raw + 45, v))
        start, end = round(max(0.0, bound(s0 + (x - b0) * ms, a)), 6), round(bound(e0 + (y - eb0) * 60000 / e_bpm, a + d), 6)
        out[i] = dict(t=t, i=i, p=p, raw=a, raw_end=a + d, c=c, start=start if end > start else a, dur=round(end - start, 6) if end > start else d, div=divisor, six=ms / 16)
    for track in {x["t"] for x in out.values()}:
        own = sorted((x for x in out.values() if x["t"] == track), key=lambda x: (x["raw"], x["i"]))
        clusters = []
        for x in own:
            if clusters and x["raw"] - clusters[-1][0]["raw"] <= 35:
                clusters[-1].append(x)
            else:
                clusters.append([x])
        for cluster in clusters:
            lead = min(cluster, key=lambda x: (-x["c"], x["raw"], x["i"]))
            at = lead["start"]
            for x in cluster:
                if x["p"] != lead["p"] and abs(at - x["raw"]) <= 45 + 1e-9:
                    x["start"] = at
        for pitch in {x["p"] for x in own}:
            line = sorted((x for x in own if x["p"] == pitch), key=lambda x: (x["start"], x["i"]))
            for a, b in zip(line, line[1:], strict=False):
                if b["start"] <= a["start"] and abs(a["start"] + b["six"] - b["raw"]) <= 45 + 1e-9:
                    b["start"] = a["start"] + b["six"]
                room = b["start"] - a["start"]
                if 0 < room < a["dur"] and abs(a["start"] + room - a["raw_end"]) <= 45 + 1e-9:
                    a["dur"] = room
    return {i: (x["t"], pytest.approx(x["start"], abs=1e-5), pytest.approx(x["dur"], abs=1e-5), x["div"]) for i, x in out.items()}


@pytest.mark.parametrize("profile", ["auto", "strict"])
@pytest.mark.parametrize("seed", [1, 2])
def test_notes_against_a_plain_version(spark, profile, seed):
    r = random.Random(seed)
    rows = [(r.choice((None, 1)), (1 << 53) + 1 + i, r.choice((60, 62, 64)), float(r.randrange(0, 8000)) + r.choice((0, 0.5)), float(r.randrange(5, 700)), r.randrange(100) / 100) for i in range(160)]
    evidence = {(t, p, int(a // 10) + r.randrange(-2, 3)): r.choice((0.2, 0.5, 0.9)) for t, _, p, a, *_ in rows[::2]}
    segments = [(t, *s) for t in (None, 1) for s in MAP]
    df = spark.createDataFrame([*rows, (1, 1, None, 5.0, 9.0, 0.5), (9, 2, 60, 5.0, 9.0, 0.5), (1, 3, 60, -5.0, 9.0, 0.5)], NOTES).repartition(3)
    known = spark.createDataFrame([(*k, v) for k, v in evidence.items()], "track_id long, pitch int, frame long, value double")
    got = {x["note_id"]: (x["track_id"], x["start_ms"], x["dur_ms"], x["divisor"]) for x in L.rhythm_align(df, spark.createDataFrame(segments, SEGMENTS), known, profile).collect()}
    assert got == plain(rows, evidence, profile == "strict")


def test_other_profiles_are_refused(spark):
    with pytest.raises(ValueError, match="profile"):
        L.rhythm_align(spark.createDataFrame([], NOTES), None, None, "raw")
