"""Boundary decoding against all paths, and maximum matchings against augmenting by trial."""

import itertools
import random
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoweave.operators import bipartite as B
from chronoweave.operators import rhythm as R

OBSERVED = "track_id long, pitch int, note_id long, start_ms double, confidence double, beats double, grid_distance double, onset double, continuity double, contour double, chord double, voice double, interval_fit double, gap double, repeat boolean"
PLAIN = {"confidence": 0.8, "beats": 0.5, "grid_distance": 0.0, "onset": 0.1, "continuity": 0.9, "contour": 0.9, "chord": 0.0, "voice": 0.5, "interval_fit": 0.8, "gap": 0.02, "repeat": False}


@pytest.mark.parametrize("seed", range(4))
def test_best_path_of_all(seed):
    r = random.Random(seed)
    for _ in range(50):
        n = r.randrange(1, 8)
        rows = [(r.randrange(8) / 8, r.choice((np.nan, r.randrange(8) / 8)), r.choice((np.nan, r.randrange(8) / 8))) for _ in range(n)]
        legal = [p for p in itertools.product(range(3), repeat=n) if all(not np.isnan(x[c]) for x, c in zip(rows, p, strict=True)) and not any(a == 2 and b == 1 for a, b in itertools.pairwise(p))]
        value = lambda p: sum(x[c] for x, c in zip(rows, p, strict=True))
        got = tuple(R.best_path(*(np.array(c, float) for c in zip(*rows, strict=True))).tolist())
        best = max(map(value, legal))
        assert got in legal and value(got) == best
        assert got == min((p for p in legal if value(p) == best), key=lambda p: p[::-1])  # ties from the end on


def observed(spark, *changes):
    rows = []
    for i, change in enumerate(changes):
        x = PLAIN | ({"gap": None} if i == 0 else {}) | change
        rows.append((1, 60, i, float(i), *(x[k] for k in PLAIN)))
    return [r["state"] for r in R.rhythm_decode(spark.createDataFrame(rows, OBSERVED)).orderBy("note_id").collect()]


def test_states_of_named_cases(spark):
    first = {"onset": 0.9}
    assert observed(spark, first, {}, {}) == ["KEEP_SINGLE", "MERGE_CONTINUATION", "MERGE_CONTINUATION"]
    assert observed(spark, first, {"onset": 0.9}) == ["KEEP_SINGLE", "KEEP_REATTACK"]
    for protection in ({"chord": 1 / 3}, {"repeat": True}):
        assert observed(spark, first, protection) == ["KEEP_SINGLE", "KEEP_REATTACK"]
    weak = {"confidence": 0.1, "beats": 0.04, "grid_distance": 0.12, "onset": 0.05, "continuity": 0.1, "contour": 0.05, "voice": 0.0}
    assert observed(spark, weak) == ["SUPPRESS_EXTRA"]
    assert observed(spark, weak, {})[1] != "MERGE_CONTINUATION" or observed(spark, weak, {})[0] != "SUPPRESS_EXTRA"


def test_decoding_in_parts_is_decoding_whole(spark):
    r = random.Random(8)
    rows = []
    for i in range(900):
        weak = r.random() < 0.4
        x = [r.random() * (0.3 if weak else 1), r.random() * (0.12 if weak else 1), r.random() * 0.15, r.random() * 0.3, 0.5 + r.random() / 2, r.random() * (0.2 if weak else 1), 0.0, r.random() * 0.2, r.random(), r.random() * 0.1, r.random() < 0.1]
        rows.append((r.choice((None, 1)), r.choice((None, 60)), (1 << 53) + 1 + i, float(i), *x[:9], None if i < 4 else x[9], x[10]))
    df = spark.createDataFrame(rows, OBSERVED).repartition(4)
    scored = {x["note_id"]: x for x in R.rhythm_choices(df).collect()}
    got = {x["note_id"]: x["state"] for x in R.rhythm_decode(df).collect()}
    assert len(got) == 900
    for key in {x[:2] for x in rows}:
        own = [scored[x[2]] for x in rows if x[:2] == key]
        whole = R.best_path(*(np.array([np.nan if x[c] is None else x[c] for x in own]) for c in ("keep", "merge", "suppress")))
        assert ["MS".find(got[x["note_id"]][0]) + 1 for x in own] == whole.tolist()
    assert {"MERGE_CONTINUATION", "SUPPRESS_EXTRA"} <= set(got.values())
    assert R.rhythm_decode(df.limit(0)).count() == 0


def size_by_trial(a, b, fits):
    match = {}

    def augment(i, seen):
        for j, y in enumerate(b):
            if j not in seen and fits(a[i], y):
                seen.add(j)
                if j not in match or augment(match[j], seen):
                    match[j] = i
                    return True
        return False

    return sum(augment(i, set()) for i in range(len(a)))


NOTES = "track_id long, note_id long, pitch int, ntype int, vel int, vel_b int, start_ms double, dur_ms double"


def random_notes(seed, n=70, reach=300):
    r = random.Random(seed)
    return [(r.choice((None, 1)), (1 << 53) + 1 + i, r.choice((None, 60, 61)), 0, r.randrange(2), 5, float(r.randrange(reach)), float(r.randrange(1, 60))) for i in range(n)]


@pytest.mark.parametrize("seed", range(4))
def test_matchings_are_maximum_and_fit(spark, seed):
    a, b = random_notes(seed), random_notes(seed + 100, 60)
    fits = lambda x, y: x[2] == y[2] and x[4] == y[4] and abs(x[6] - y[6]) <= 8 and abs(x[6] + x[7] - y[6] - y[7]) <= max(6.0, 0.2 * x[7])
    frames = [spark.createDataFrame(x, NOTES).repartition(3) for x in (a, b)]
    got = [tuple(x)[-2:] for x in B.match_notes(*frames, 8.0, 6.0, 0.2, ("pitch", "vel")).collect()]
    left, right = ({x[1]: x for x in y} for y in (a, b))
    assert len({i for i, _ in got}) == len({j for _, j in got}) == len(got) == size_by_trial(a, b, fits) > 3
    assert all(fits(left[i], right[j]) for i, j in got)


def test_an_early_note_gives_its_partner_away(spark):
    """Along the line the first note would take the only partner that the second one has."""
    rows = lambda x: spark.createDataFrame([(1, i, 60, 0, 1, 1, s, d) for i, (s, d) in enumerate(x)], NOTES)
    assert B.match_notes(rows([(0.0, 100.0), (4.0, 50.0)]), rows([(2.0, 72.0), (6.0, 110.0)]), 6.0, 26.0).count() == 2


@pytest.mark.parametrize("seed", range(6))
def test_augmenting_paths_find_a_maximum(seed):
    r = random.Random(seed)
    for _ in range(80):
        n, m = r.randrange(12), r.randrange(1, 12)
        partners = [np.array(sorted(r.sample(range(m), r.randrange(min(m, 4) + 1))), np.int64) for _ in range(n)]
        left = B.maximum_matching(partners, m)
        assert all(j in own for j, own in zip(left.tolist(), partners, strict=True) if j >= 0)
        used = left[left >= 0]
        assert len(set(used.tolist())) == len(used) == size_by_trial(partners, range(m), lambda own, j: j in own)


def test_a_dense_key_is_matched_in_bounded_time():
    n = 4000
    partners = [np.arange(max(0, i - 30), min(n, i + 30)) for i in range(n)]
    assert (B.maximum_matching(partners, n) >= 0).all()
    chain = [np.array([i, i + 1]) for i in range(2000)] + [np.array([0])]
    assert (B.maximum_matching(chain, 2001) >= 0).all()


def test_evaluation_counts(spark):
    a, b = random_notes(1, 60, 200), random_notes(2, 50, 200)
    got = {x["track_id"]: x for x in B.evaluate(*(spark.createDataFrame(x, NOTES) for x in (a, b))).collect()}
    for track in (None, 1):
        x, y = ([r for r in rows if r[0] == track] for rows in (a, b))
        onset = lambda p, q: p[2] == q[2] and abs(p[6] - q[6]) <= 4
        both = lambda p, q: onset(p, q) and abs(p[6] + p[7] - q[6] - q[7]) <= max(4, 0.2 * p[7])
        row = got[track]
        assert (row["n_reference"], row["n_estimate"]) == (len(x), len(y))
        assert (row["onset_matched"], row["note_matched"]) == (size_by_trial(x, y, onset), size_by_trial(x, y, both))
        assert row["onset_f1"] == round(2 * row["onset_matched"] / (len(x) + len(y)), 6)
    only = B.evaluate(spark.createDataFrame(a, NOTES), spark.createDataFrame([], NOTES)).agg(F.sum("onset_matched"), F.sum("n_reference")).first()
    assert tuple(only) == (0, 60) and Counter(x[0] for x in a)[1] > 0


def boxes(r, n, reach, whole):
    start = np.sort(r.integers(0, reach, n).astype(float) if whole else r.random(n) * reach)
    return start, start + r.exponential(20, n).round(1)


@pytest.mark.parametrize("seed", range(4))
def test_boxes_are_matched_as_their_pairs_would_be(seed, monkeypatch):
    monkeypatch.setattr(B, "LOOKED_AT", 1 + seed % 2)  # more is left to the augmenting paths
    r = np.random.default_rng(seed)
    for k in range(40):
        x, y = (boxes(r, n, 200, k % 2) for n in r.integers(0, 80, 2))
        end_tol = np.maximum(6.0, (k % 3) * 0.1 * (x[1] - x[0]))
        near = (np.abs(x[0][:, None] - y[0]).round(6) <= 8) & (np.abs(x[1][:, None] - y[1]).round(6) <= end_tol[:, None])
        got = B.box_matching(x, y, 8.0, end_tol)
        hit = np.flatnonzero(got >= 0)
        assert near[hit, got[hit]].all() and len(set(got[hit].tolist())) == len(hit)
        assert len(hit) == (B.maximum_matching([np.flatnonzero(own) for own in near], len(y[0])) >= 0).sum()
    low, high = np.sort(r.integers(0, 50, (2, 40)))
    high = np.maximum(low, high)
    assert (B.line_matching(low, high) >= 0).sum() == (B.maximum_matching([np.arange(a, b) for a, b in zip(low, high, strict=True)], 50) >= 0).sum()


def test_rows_in_reach_of_all_make_no_list_of_pairs():
    """400,000,000 pairs are in reach; each takes eight bytes in a list."""
    r, n = np.random.default_rng(1), 20_000
    x, y = (boxes(r, n, 10, False) for _ in range(2))
    tracemalloc.start()
    assert (B.box_matching(x, y, 10.0, np.full(n, 300.0)) >= 0).all()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 200 << 20
