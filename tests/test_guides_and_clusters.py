"""Paths through onset clusters against a plain beam and all paths, and complete link against a search over all pairs."""

import itertools
import random

import numpy as np
import pytest

from chronoweave.operators import clustering as K
from chronoweave.operators import folds
from chronoweave.operators import guides as G

NOTES = "track_id long, note_id long, pitch int, start_ms double, dur_ms double, confidence double"


def step(a, b, beat=500.0):
    leap, pause = abs(b[2] - a[2]), max(0.0, b[3] - a[3] - a[4])
    return 0.55 - min(1.8, leap / 12 * 0.55) - min(1.2, pause / beat * 0.22) + (0.18 if leap <= 2 else 0)


def worth(x, own, prefer):
    rank = own.index(x) / max(1, len(own) - 1)
    return 2.3 * x[5] + 0.7 * {"high": rank, "low": 1 - rank, "center": 1 - abs(rank - 0.5) * 2}[prefer] + 0.25 * min(1.0, x[4] / 500)


def plain_beam(clusters, prefer, width):
    active = []
    for cluster in clusters:
        own = sorted(cluster, key=lambda x: (x[2], x[1]))
        new = []
        for x in own:
            score, path = max(((round(s + step(p[-1], x), 9), -abs(p[-1][2] - x[2]), p[-1][2], p[-1][1]), p) for s, p in active) if active else ((0.0,), [])
            new.append((round(score[0] + round(worth(x, own, prefer), 9), 9), [*path, x]))
        active = sorted(new, key=lambda n: (-n[0], n[1][-1][2], n[1][-1][1]))[:width]
    return max(active, key=lambda n: (n[0], -n[1][-1][2], n[1][-1][1]))[1]


def tracks(seed, dense):
    r = random.Random(seed)
    rows, at = [], 0.0
    for i in range(160):
        at += r.choice((0.0, 3.0, 20.0) if r.random() < dense else (120.0, 300.0, 2900.0))
        rows.append((r.choice((None, 1)), (1 << 53) + 1 + i, r.randrange(40, 90), at, float(r.randrange(20, 700)), r.randrange(101) / 100))
    return rows


def clusters_of(rows, track):
    out = []
    for x in sorted((x for x in rows if x[0] == track), key=lambda x: (x[3], x[1])):
        if out and x[3] - out[-1][0][3] <= 50:
            out[-1].append(x)
        else:
            out.append([x])
    return out


@pytest.mark.parametrize(("prefer", "width", "dense"), [("high", 10, 0.6), ("low", 2, 0.8), ("center", 1, 0.5), ("high", 999, 0.95)])
def test_stretches_give_the_beam_over_the_whole(spark, prefer, width, dense):
    rows = tracks(width, dense)
    got = {tuple(x) for x in G.continuity_path(spark.createDataFrame(rows, NOTES).repartition(3), prefer, width=width).collect()}
    want = {(t, x[1]) for t in (None, 1) for x in plain_beam(clusters_of(rows, t), prefer, width)}
    assert got == want and len({x[3] for x in rows}) > len(want) > 10


def test_an_unbounded_beam_finds_the_best_path():
    r = random.Random(4)
    for _ in range(30):
        clusters = [[(1, 10 * k + i, r.randrange(40, 80), 300.0 * k, 200.0, r.random()) for i in range(r.randrange(1, 4))] for k in range(5)]
        clusters = [sorted(c, key=lambda x: (x[2], x[1])) for c in clusters]
        value = lambda p: sum(worth(x, c, "high") for x, c in zip(p, clusters, strict=True)) + sum(step(a, b) for a, b in itertools.pairwise(p))
        best = max(map(value, itertools.product(*clusters)))
        flat = [x for c in clusters for x in c]
        col = lambda k: np.array([x[k] for x in flat], float)
        emission = np.array([worth(x, c, "high") for c in clusters for x in c])
        path = G.beam_path(col(3), col(3), col(3) + col(4), col(2), emission, 500.0, 999)
        assert value([flat[i] for i in path]) == pytest.approx(best, abs=1e-7)


def test_a_continuous_lead_beats_high_weak_noise(spark):
    rows = [(1, 3 * k + i, p, 300.0 * k, 240.0, c) for k in range(3) for i, (p, c) in enumerate((((72, 0.9), (98, 0.2), (43, 0.8)), ((74, 0.86), (101, 0.24), (45, 0.78)), ((76, 0.88), (95, 0.22), (47, 0.79)))[k])]
    voices = {(x["voice"], x["note_id"]) for x in G.guide_voices(spark.createDataFrame(rows, NOTES)).collect()}
    assert {i for v, i in voices if v == "lead"} == {0, 3, 6} and {i for v, i in voices if v == "bass"} == {2, 5, 8}
    assert len({i for _, i in voices}) == len(voices)
    assert G.guide_voices(spark.createDataFrame([], NOTES)).count() == 0
    assert folds.anchor_cluster(spark.createDataFrame(rows, NOTES), 50.0).count() == 9


def by_all_pairs(ids, values, sure, start, end, role):
    alike = K.similarities(values, sure, values, sure)
    touch = lambda i, j: role[i] == role[j] and max(0.0, start[j] - end[i], start[i] - end[j]) <= 1500
    clusters = [[i] for i in range(len(ids))]
    while True:
        best = None
        for a, b in itertools.combinations(range(len(clusters)), 2):
            pairs = [(i, j) for i in clusters[a] for j in clusters[b]]
            score = min(alike[i, j] for i, j in pairs)
            if score >= (0.64 if any(touch(i, j) for i, j in pairs) else 0.73):
                key = (score, "|".join(sorted(ids[i] for i in clusters[a] + clusters[b])))
                best = max(best, (key, a, b)) if best else (key, a, b)
        if not best:
            return sorted(sorted(c) for c in clusters)
        _, a, b = best
        clusters[a] += clusters.pop(b)


@pytest.mark.parametrize("seed", range(12))
def test_complete_link_with_ties_against_all_pairs(seed, monkeypatch):
    r = np.random.default_rng(seed)
    monkeypatch.setattr(K, "BLOCK", 7)
    n = int(r.integers(2, 30))
    values = r.integers(0, 4, (n, 2)) * float(r.choice((0.25, 1.0))) + 1
    sure, start = r.choice((0.4, 0.7, 1.0), n), r.integers(0, 9000, n).astype(float)
    args = ([str(i) for i in r.permutation(n)], values, sure, start, start + 400, r.choice(("a", "b"), n))
    assert sorted(sorted(c) for c in K.complete_link(*args)) == by_all_pairs(*args)


GROUPS = "song long, group_id string, features array<double>, reliability double, samples int, members int, role string, start_ms double, end_ms double"


def clusters(spark, *rows):
    found = K.timbre_clusters(spark.createDataFrame(rows, GROUPS)).collect()
    return {x["group_id"]: (x["cluster"], x["is_core"]) for x in found}


def test_named_cases_of_clustering(spark):
    a, b, c = (None, "a", [1.0, 1.0], 0.9, 4, 1, "harmony", 0.0, 240.0), (None, "b", [1.02, 0.99], 0.9, 4, 1, "harmony", 400.0, 640.0), (None, "c", [9.0, -7.0], 0.9, 4, 1, "bass", 800.0, 1040.0)
    assert clusters(spark, a, b, c) == {"a": ("a", True), "b": ("a", True), "c": ("c", True)}
    near, far = (1, "l", [1.0, 1.0], 0.9, 4, 1, "harmony", 0.0, 240.0), (1, "r", [1.45, 1.45], 0.9, 4, 1, "harmony", 500.0, 740.0)
    assert len({x for x, _ in clusters(spark, near, far).values()}) == 1
    assert len({x for x, _ in clusters(spark, near, (*far[:7], 4000.0, 4240.0)).values()}) == 2
    follower, weak = (None, "f", [1.0, 1.01], 0.5, 0, 1, "x", 9000.0, 9100.0), (1, "w", [1.0], 0.1, 1, 1, "x", 0.0, 1.0)
    assert clusters(spark, a, c, follower)["f"] == ("a", False)
    assert clusters(spark, weak) == {}
    assert K.timbre_clusters(spark.createDataFrame([], GROUPS)).count() == 0
