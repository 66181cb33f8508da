"""Changes of colour against every split, and budgets against a plain walk."""

import random
from statistics import median

import numpy as np
import pytest

from chronoweave.operators import phrases as P


def similar(a, b, sa, sb):
    apart = [min(1.0, abs(x - y) / max(1.0, abs(x), abs(y))) ** 2 for x, y in zip(a, b, strict=True)]
    return max(0.0, min(1.0, (1 - (sum(apart) / len(apart)) ** 0.5) * min(sa, sb)))


def every_split(start, values, sure):
    best = None
    for k in range(2, len(start) - 1):
        sides = [(values[:k], sure[:k]), (values[k:], sure[k:])]
        centre = [([median(c) for c in zip(*v, strict=True)], sum(s) / len(s)) for v, s in sides]
        cohesion = min(sum(similar(x, c, y, cs) for x, y in zip(v, s, strict=True)) / len(v) for (v, s), (c, cs) in zip(sides, centre, strict=True))
        change = round((1 - similar(centre[0][0], centre[1][0], centre[0][1], centre[1][1])) * min(centre[0][1], centre[1][1]) * cohesion, 9)
        if cohesion >= 0.68 and change >= 0.28:
            score = (change, -(start[k - 1] + start[k]) / 2, k)
            best = max(best, score) if best else score
    return -best[1] if best else None


@pytest.mark.parametrize("seed", range(6))
def test_the_best_split_of_all(seed):
    r, found = random.Random(seed), 0
    for _ in range(60):
        n, cut = r.randrange(0, 14), r.randrange(14)
        start = sorted(float(r.randrange(50)) for _ in range(n))
        values = [[(5.0 if i >= cut else 1.0) + r.choice((0, 0.1, 0.3)), 2.0 + (i >= cut) * r.choice((3, 3, 0))] for i in range(n)]
        sure = [r.choice((0.9, 0.95, 1.0)) for _ in range(n)]
        want = every_split(start, values, sure)
        assert P.change_point(np.array(start), np.array(values).reshape(n, 2), np.array(sure)) == want
        found += want is not None
    assert found > 10


def test_running_medians():
    x = np.random.default_rng(1).integers(0, 9, (30, 3)).astype(float)
    assert np.array_equal(P.running_medians(x), np.array([np.median(x[: i + 1], axis=0) for i in range(30)]))


@pytest.mark.parametrize("least", [0.4, 0.8])
def test_few_splits_of_a_large_group_are_looked_at(monkeypatch, least):
    """Before, each split whose medians differ was a look at all members, as many as there are where no side is alike enough."""
    r, n = np.random.default_rng(2), 600
    start = np.sort(r.integers(0, 3000, n).astype(float))
    values = np.stack([np.where(start >= 1500, 6.0, 0.0) + r.integers(1, 128, n) / 127, r.exponential(0.1, n).round(3)], 1)
    sure = least + r.integers(0, 20, n) / 100
    want, looks, alike, bound = every_split(start.tolist(), values.tolist(), sure.tolist()), [], P.alike, P._most_alike
    monkeypatch.setattr(P, "alike", lambda *x: looks.append(1) or alike(*x))
    monkeypatch.setattr(P, "_most_alike", lambda *x: looks.append(1) or bound(*x))
    assert P.change_point(start, values, sure) == want and (want is None) == (least == 0.4)
    assert len(looks) < n / 2


MEMBERS = "group_id long, note_id long, start_ms double, pitch int, features array<double>, reliability double"


def test_groups_are_split_once_or_stay(spark):
    rows = [(None, i, 10.0 * i, 60, [1.0, 1.0] if i < 3 else [9.0, 9.0], 1.0) for i in range(6)] + [(None, 6, 25.0, 60, None, None), (None, 7, 55.0, 60, [1.0, 1.0], 0.1)]
    rows += [(1, 10 + i, 10.0 * i, 60, [1.0, 1.0], 1.0) for i in range(6)] + [(2, 20, 0.0, 60, [1.0, 1.0], 1.0)]
    got = {x["note_id"]: x["side"] for x in P.split_by_timbre(spark.createDataFrame(rows, MEMBERS).repartition(3)).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 1, 4: 1, 5: 1, 6: 1, 7: 1} | {10 + i: 0 for i in range(6)} | {20: 0}
    assert P.split_by_timbre(spark.createDataFrame([], MEMBERS)).count() == 0


OPTIONS = "track_id long, phrase long, place long, ntype int, confidence double, verified boolean"


@pytest.mark.parametrize("seed", range(4))
def test_budgets_against_a_plain_walk(spark, seed):
    r = random.Random(seed)
    rows = [(t, p // 9 if p % 50 else None, p, r.randrange(9), r.choice((0.5, 0.85, 0.9, 0.95)), r.choice((True, True, False, None))) for t in (None, 1) for p in range(200) for _ in range(r.choice((0, 1, 1, 2)))]
    got = sorted(map(repr, map(tuple, P.budgeted_select(spark.createDataFrame(rows, OPTIONS).repartition(4), suggestions=3, changes=2, between=2).collect())))
    want = []
    for t in (None, 1):
        asked, used, last = {}, {}, -99
        for p in sorted({x[2] for x in rows if x[0] == t}):
            best = min((x for x in rows if x[0] == t and x[2] == p), key=lambda x: (-x[4], x[3], not x[5]))
            asked[best[1]] = asked.get(best[1], 0) + 1
            status = "skipped"
            if asked[best[1]] <= 3:
                status = "suggested"
                if best[4] >= 0.85 and best[5] and used.get(best[1], 0) < 2 and p - last > 2:
                    status, last, used[best[1]] = "applied", p, used.get(best[1], 0) + 1
            want.append(repr((t, p, best[3], status)))
    assert got == sorted(want) and sum("applied" in x for x in want) > 10
