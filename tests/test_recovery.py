"""Recovery of dense runs and crowding, frame by frame and note by note."""

import random

import pytest

from chronoweave.operators import recovery as R

EVIDENCE = "track_id long, pitch int, frame long, frame_value double, onset_value double"
EVENTS = "track_id long, pitch int, start_frame long, end_frame long"


def plain(frame, onset, existing, longest, thr=0.3, strong=0.68):
    """frame, onset: {(pitch, frame): value}; the notes of one track."""
    length = max((f for _, f in {*frame, *onset}), default=-1) + 1
    if length < 5:
        return []
    pitches = sorted({p for p, _ in {*frame, *onset}})
    top = [max(onset.get((p, f), 0.0) for p in pitches) for f in range(length)]
    peaks = [f for f in range(length) if top[f] >= strong and (f == 0 or top[f] >= top[f - 1]) and (f + 1 == length or top[f] >= top[f + 1])]
    dense = set()
    for a, b, c in zip(peaks, peaks[1:], peaks[2:], strict=False):
        if 2 <= b - a <= 8 and 2 <= c - b <= 8 and abs((b - a) - (c - b)) <= max(1, round(max(b - a, c - b) * 0.35)):
            dense |= {a, b, c}
    taken, out = {(p, s + d) for p, s in existing for d in (-1, 0, 1)}, []
    for s in sorted(dense):
        for p in pitches:
            if onset.get((p, s), 0.0) < strong or (p, s) in taken:
                continue
            e, weak = s + 1, 0
            while e < length and e - s <= longest:
                if onset.get((p, e), 0.0) >= strong:
                    e = max(s + 1, e - weak)
                    break
                weak = 0 if frame.get((p, e), 0.0) >= thr else weak + 1
                if weak >= 2:
                    e -= 1
                    break
                e += 1
            support = sum(frame.get((p, f), 0.0) for f in range(s, e)) / (e - s)
            if 2 <= e - s <= longest and round(support, 9) >= 0.38:
                out.append((p, s, e, round(max(0.0, min(1.0, 0.55 * onset[p, s] + 0.45 * round(support, 9))), 9)))
                taken |= {(p, s + d) for d in (-1, 0, 1)}
    return sorted(out)


def recovered(spark, tracks, existing, longest):
    rows = [(t, p, f, fr.get((p, f), 0.0), on.get((p, f), 0.0)) for t, (fr, on) in tracks.items() for p, f in {*fr, *on}]
    found = R.recover_dense(spark.createDataFrame(rows, EVIDENCE).repartition(3), spark.createDataFrame([(t, p, s, s + 4) for t, p, s in existing], EVENTS), longest=longest).collect()
    return {t: sorted(tuple(x)[1:] for x in found if x["track_id"] == t) for t in tracks}


def test_only_regular_strong_short_sequences_are_recovered(spark):
    frame, onset = {(60, s + k): 0.7 for s in (5, 9, 13) for k in range(3)}, {(60, s): 0.9 for s in (5, 9, 13)} | {(60, 31): 0.0}
    lone = ({(60, 8 + k): 0.8 for k in range(3)}, {(60, 8): 0.95, (60, 23): 0.0})
    got = recovered(spark, {None: (frame, onset), 2: lone}, [], 5)
    assert [x[:3] for x in got[None]] == [(60, 5, 8), (60, 9, 12), (60, 13, 16)] and got[2] == []
    assert [x[:3] for x in recovered(spark, {None: (frame, onset)}, [(None, 60, 10)], 5)[None]] == [(60, 5, 8), (60, 13, 16)]


@pytest.mark.parametrize("longest", [2, 5, 11])
def test_random_evidence_frame_by_frame(spark, longest):
    r, tracks, existing = random.Random(longest), {}, []
    for t in (None, 1, 2):
        frame, onset, at = {}, {}, 0
        while at < 700:
            at += r.choice((1, 2, 3, 4, 4, 4, 5, 8, 20))
            for p in r.sample((60, 61, 70), r.randrange(1, 3)):
                onset[p, at] = r.choice((0.7, 0.7, 0.9, 0.6))
                for k in range(r.randrange(9)):
                    frame[p, at + k] = r.choice((0.2, 0.5, 0.8, 0.8))
        tracks[t] = (frame, onset)
        existing += [(t, r.choice((60, 61, 70)), r.randrange(700)) for _ in range(40)]
    got = recovered(spark, tracks, existing, longest)
    want = {t: plain(*tracks[t], [(p, s) for u, p, s in existing if u == t], longest) for t in tracks}
    assert got == want and sum(map(len, want.values())) > 2


NOTES = "track_id long, note_id long, pitch int, start_ms double, dur_ms double"


@pytest.mark.parametrize("most", [1, 3, 64])
def test_crowding_note_by_note(spark, most):
    r = random.Random(most)
    rows = [(r.choice((None, 1)), (1 << 53) + 1 + i, r.randrange(60, 64), float(r.randrange(4000)), float(r.randrange(0, 120))) for i in range(400)]
    got = {x["note_id"]: tuple(x)[1:] for x in R.crowding(spark.createDataFrame(rows, NOTES).repartition(4), most).collect()}
    want = {}
    for track in (None, 1):
        own, dense_now, active = sorted((x for x in rows if x[0] == track), key=lambda x: (x[3], x[1])), False, []
        for x in own:
            want[x[1]] = [0.0, 0, False]
        for x in own:
            active = [y for y in active if y[3] + y[4] > x[3]]
            if len(active) >= most:
                want[x[1]][2] = True
                for y in active if not dense_now else []:
                    want[y[1]][2] = True
                dense_now = True
            else:
                dense_now = False
                for y in active:
                    both = min(y[3] + y[4], x[3] + x[4]) - x[3]
                    if y[2] != x[2] and both > 0:
                        for z in (x, y):
                            want[z[1]][0] += min(1.0, both / z[4])
                            want[z[1]][1] += x[3] - y[3] <= 35
            active.append(x)
    assert got == {i: (round(a, 6), b, c or round(a, 6) >= 2.5) for i, (a, b, c) in want.items()}
    assert R.crowding(spark.createDataFrame([], NOTES)).count() == 0


def test_a_dense_key_is_swept_in_bounded_time(spark):
    n = spark.range(20_000).selectExpr("0L AS track_id", "id AS note_id", "CAST(id % 90 AS int) AS pitch", "id * 1.0D AS start_ms", "500.0D AS dur_ms")
    assert R.crowding(n).filter("dense").count() > 19_000


def test_starts_are_not_multiplied_by_the_frames_after_them(spark):
    rows = spark.createDataFrame([(1, 60, f, 0.7, 0.9 if k == 0 else 0.1) for s in (5, 9, 13) for k, f in enumerate(range(s, s + 3))], EVIDENCE)
    found = R.recover_dense(rows, spark.createDataFrame([], EVENTS), longest=1_000_000)
    assert "generate" not in found._jdf.queryExecution().executedPlan().toString().lower()
    assert sorted(tuple(x)[2:4] for x in found.collect()) == [(5, 8), (9, 12), (13, 16)]


@pytest.mark.parametrize(("thr", "longest"), [(0.0, 4), (0.0, 9), (0.3, 3), (0.3, 9)])
def test_frames_without_a_row_are_weak_only_below_the_threshold(spark, thr, longest):
    r, frame, onset, at = random.Random(longest), {}, {}, 0
    while at < 900:
        at += r.choice((2, 4, 4, 4, 5, 6, 20))
        for p in r.sample((60, 61, 70), r.randrange(1, 4)):
            onset[p, at] = r.choice((0.7, 0.9, 0.1))
            for k in range(9):
                if r.random() < 0.6:
                    frame[p, at + k] = r.choice((-0.1, 0.2, 0.8, 0.9))
    rows = [(None, p, f, frame.get((p, f)), onset.get((p, f))) for p, f in {*frame, *onset}]
    found = R.recover_dense(spark.createDataFrame(rows, EVIDENCE).repartition(3), spark.createDataFrame([], EVENTS), frame_threshold=thr, longest=longest).collect()
    supported = [tuple(x)[1:] for x in found if (x["confidence"] - 0.55 * onset[x["pitch"], x["start_frame"]]) / 0.45 > 0.38 - 1e-6]  # the least support of plain()
    want = plain(frame, onset, [], longest, thr)
    assert sorted(supported) == want and len(want) > 5
