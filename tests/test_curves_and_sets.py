"""Operators whose result depends on order, without SQL, against naive versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoweave.functions import scalars
from chronoweave.operators import cleanup, curves, matching, sequential
from chronoweave.sources import documents

NOTES = "track_id long, note_id long, pitch int, start_ms double, dur_ms double"


def naive_overlap(old, new):
    """Score of one key's rows, from the definition."""
    ids = {r[1] for r in old} & {r[1] for r in new}
    free, matched = [r for r in new if r[1] not in ids], len(ids)
    for o in sorted((r for r in old if r[1] not in ids), key=lambda r: (r[3], r[1])):
        near = []
        for n in free:
            if n[2] != o[2]:
                continue
            union = max(o[3] + o[4], n[3] + n[4]) - min(o[3], n[3])
            iou = max(0.0, min(o[3] + o[4], n[3] + n[4]) - max(o[3], n[3])) / union if union > 0 else 0.0
            if iou >= 0.35 or abs(o[3] - n[3]) <= max(35.0, 0.2 * min(o[4], n[4])):
                near.append((-iou, abs(o[3] - n[3]), n[1], n))
        if near:
            free.remove(min(near)[3])
            matched += 1
    return matched


@pytest.mark.parametrize("seed", range(3))
def test_candidate_overlap(spark, seed):
    r = random.Random(seed)
    old = [(r.randrange(2), i, r.randrange(50, 53), float(r.randrange(0, 3000)), float(r.randrange(0, 300))) for i in range(150)]
    new = [(t, i if r.random() < 0.5 else i + 1000, p, s + r.choice([0, 10, 40, 200]), d * r.choice([0.5, 1, 2])) for t, i, p, s, d in old if r.random() < 0.8]
    got = {x["track_id"]: (x["n_old"], x["n_new"], x["matched"], x["score"]) for x in matching.candidate_overlap(spark.createDataFrame(old, NOTES), spark.createDataFrame(new, NOTES)).collect()}
    for t in (0, 1):
        a, b = [x for x in old if x[0] == t], [x for x in new if x[0] == t]
        matched = naive_overlap(a, b)
        assert got[t] == (len(a), len(b), matched, round(matched / max(len(a), len(b)), 9))
    assert matching.candidate_overlap(spark.createDataFrame(old, NOTES), spark.createDataFrame([], NOTES)).agg(F.max("score")).first()[0] == 0


def test_beam_select(spark):
    r = random.Random(4)
    rows = [(k, i, r.randrange(100) / 100, r.randrange(4)) for k in range(6) for i in range(12)]
    got = {}
    for x in matching.beam_select(spark.createDataFrame(rows, "k long, option_id long, confidence double, conflict int"), ("k",), width=10_000).collect():
        got.setdefault(x["k"], set()).add(x["option_id"])
    for k in range(6):  # a beam that holds every set finds the best one
        best = {}
        for _, i, c, f in (x for x in rows if x[0] == k):
            best[f] = max(best.get(f, (0.0, 0)), (c, -i))
        conf = {x[1]: x[2] for x in rows if x[0] == k}
        assert abs(sum(conf[i] for i in got[k]) - sum(c for c, _ in best.values())) < 1e-9
    narrow = matching.beam_select(spark.createDataFrame(rows, "k long, option_id long, confidence double, conflict int"), ("k",), width=1).count()
    assert narrow >= 6


def test_envelope_simplify(spark):
    rng = np.random.default_rng(2)
    rows = [(t, float(i), float(60 + 30 * np.sin(i / 17) + rng.integers(0, 3))) for t in (0, 1) for i in range(200)]
    df = spark.createDataFrame(rows, "track_id long, at double, level double")
    for most, tol in ((12, 1.5), (64, 2.5), (500, 1.0)):
        got = {}
        for x in curves.envelope_simplify(df, most, tol).collect():
            got.setdefault(x["track_id"], []).append((x["at"], x["level"]))
        for t in (0, 1):
            points = [(a, v) for k, a, v in rows if k == t]
            chosen = {0, len(points) - 1}
            while len(points) > max(2, most) and len(chosen) < max(2, most):
                best, error = -1, tol
                own = sorted(chosen)
                for a, b in zip(own, own[1:]):
                    for i in range(a + 1, b):
                        line = points[a][1] + (points[b][1] - points[a][1]) * ((points[i][0] - points[a][0]) / max(1e-9, points[b][0] - points[a][0]))
                        if abs(points[i][1] - line) > error:
                            best, error = i, abs(points[i][1] - line)
                if best < 0:
                    break
                chosen.add(best)
            want = points if len(points) <= max(2, most) else [points[i] for i in sorted(chosen)]
            assert sorted(got[t]) == want


def test_lyric_tokens_part_ideographs(spark):
    text = "안녕 don't 漢字かな Été 42"
    assert spark.createDataFrame([(text,)], "t string").select(scalars.lyric_tokens(F.col("t"))).first()[0] == ["안", "녕", "don't", "漢", "字", "か", "な", "Été", "42"]


def test_documents_refuse_damage(spark):
    chunks = spark.createDataFrame([(1, 0, [(1, 60, 80, 0.0, 5.0, 0)])], f"track_id long, chunk long, notes array<{documents.NOTE}>")
    good = documents.to_document(chunks)
    assert documents.from_document(good).collect() == chunks.collect()
    with pytest.raises(Exception, match="damaged"):
        documents.from_document(good.withColumn("document", F.expr("substr(document, 1, 30)"))).collect()
    with pytest.raises(Exception, match="invalid payload"):
        documents.from_clipboard(spark.createDataFrame([(1, '{"version": 9, "notes": []}')], "k long, payload string"), "k").collect()
    notes = documents.logical_notes(chunks)
    with pytest.raises(Exception, match="too large"):
        documents.to_clipboard(notes.unionByName(notes), "track_id", most=1).collect()


@pytest.mark.parametrize("seed", range(2))
def test_region_replace(spark, seed):
    r = random.Random(seed)
    current = [(r.randrange(2), i, r.randrange(50, 52), float(r.randrange(0, 1500)), float(r.randrange(10, 200)), r.random() < 0.3) for i in range(120)]
    incoming = [(r.randrange(2), 1000 + i, r.randrange(50, 52), float(r.randrange(0, 1500)), float(r.randrange(10, 200))) for i in range(120)]
    want = {}
    for t in (0, 1):
        stays = []
        for k, i, p, s, d, reviewed in current:
            if k == t:
                want[i] = "kept" if not 300 <= s < 1200 else "protected" if reviewed else "removed"
                stays += [(p, s, d)] if want[i] != "removed" else []
        for k, i, p, s, d in sorted(incoming, key=lambda x: (x[3], x[1])):
            if k == t and 300 <= s < 1200:
                like = any(q == p and abs(a - s) <= 35 and abs(b - d) <= max(35, 0.25 * d) for q, a, b in stays)
                want[i] = "skipped" if like else "added"
                stays += [] if like else [(p, s, d)]
    got = matching.region_replace(spark.createDataFrame(current, NOTES + ", reviewed boolean"), spark.createDataFrame(incoming, NOTES), 300.0, 1200.0)
    assert {x["note_id"]: x["status"] for x in got.collect()} == want and set(want.values()) == {"kept", "protected", "removed", "added", "skipped"}


def test_cleanup_has_a_row_an_event_and_agrees_with_its_steps(spark):
    r = random.Random(9)
    rows = [(r.randrange(2), i, r.randrange(40, 90), r.randrange(100) / 100, s := r.randrange(0, 4000), s + r.randrange(1, 20)) for i in range(300)]
    rows += [(t, i + 1000, p, c, a, b) for t, i, p, c, a, b in rows[:40]]
    events = spark.createDataFrame(rows, "track_id long, note_id long, pitch int, confidence double, start_frame long, end_frame long")
    evidence = spark.createDataFrame([], "track_id long, pitch int, frame long, frame_value double, onset_value double")
    got = {x["note_id"]: (x["status"], x["by"]) for x in cleanup.cleanup(events, evidence).collect()}
    assert set(got) == {x[1] for x in rows} and all(got[i + 1000] == ("duplicate", i) for i in range(40))
    timed = spark.createDataFrame([x for x in rows if x[1] < 1000], events.schema).selectExpr("*", "start_frame * 10.0D AS start_ms", "(end_frame - start_frame) * 10.0D AS dur_ms")
    kept_by = {x["note_id"]: x["kept_by"] for x in sequential.nms(timed, 20.0).collect()}
    assert all(got[i] == ("suppressed", k) for i, k in kept_by.items() if i != k)
    left = spark.createDataFrame([x for x in rows if kept_by.get(x[1]) == x[1]], events.schema)
    hidden = {x["note_id"]: x["hidden"] for x in cleanup.clean_suppress(cleanup.fragment_flags(left), evidence).collect()}
    assert {i: got[i][0] for i in hidden} == {i: "hidden" if h else "kept" for i, h in hidden.items()} and any(hidden.values())
    assert {s for s, _ in ((x["status"], 0) for x in cleanup.cleanup(events, evidence, "raw").collect())} == {"duplicate", "kept"}
    with pytest.raises(ValueError, match="profile"):
        cleanup.cleanup(events, evidence, "other")


@pytest.mark.parametrize("mode", ["syllabic", "spoken", "melismatic", "legato"])
def test_lyric_align(spark, mode):
    r = random.Random(3)
    notes = [(k, i, r.randrange(50, 60), float(r.randrange(0, 40)) * 50, 100.0) for k in range(2) for i in range(k * 100, k * 100 + 25)]
    tokens = [(k, i, float(r.randrange(0, 2000)) if r.random() < 0.7 else None) for k in range(3) for i in range(k * 100, k * 100 + 18)]
    got = {}
    for x in matching.lyric_align(spark.createDataFrame(tokens, "track_id long, token_id long, time double"), spark.createDataFrame(notes, NOTES), mode).collect():
        got[x["token_id"]] = (x["note_id"], x["notes"], x["relation"], x["confidence"])
    want = {}
    for k in range(2):
        own = sorted((x for x in notes if x[0] == k), key=lambda x: (x[3], -x[2], x[1]))
        asked = sorted((x for x in tokens if x[0] == k), key=lambda x: x[1])
        cursor, anchors = 0, []
        for i, (_, _, t) in enumerate(asked):
            if t is None:
                at = max(cursor, round(i * (len(own) - 1) / (len(asked) - 1)))
            else:
                at = min(range(cursor, len(own)), key=lambda j: (abs(own[j][3] - t), j))
            at = min(len(own) - 1, at)
            anchors.append(at)
            cursor = at if mode == "spoken" else min(len(own) - 1, at + 1)
        for i, (_, token, t) in enumerate(asked):
            a, e = anchors[i], anchors[i + 1] if i + 1 < len(anchors) else len(own)
            limit = {"melismatic": 4, "legato": 2}.get(mode, 1)
            count = max(1, min(e, a + limit) - a) if limit > 1 and e > a + 1 else 1
            relation = "melisma" if count > 1 else "shared_note" if mode == "spoken" and i and a == anchors[i - 1] else "syllabic"
            away = 125 * 0.55 if t is None else abs(own[a][3] - t)
            want[token] = (own[a][1], count, relation, round(max(0.15, min(1.0, math.exp(-away / 125))), 6))
    assert got == want and len(got) == 36
