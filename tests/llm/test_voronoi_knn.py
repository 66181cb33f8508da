"""The Voronoi join against brute force in Python's own integers: large values, repeated ids, many lengths, bounds."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from chronoweave.llm import voronoi_knn as V


def brute(rows, k=5, every=50):
    known = {(i, tuple(math.floor(256.0 * c) for c in v)) for i, v in rows if i is not None and v and all(c is not None and math.isfinite(c) for c in v)}
    out = []
    for q_id, q in known:
        if q_id % every == 0:
            best = defaultdict(lambda: None)
            for i, x in known:
                if i != q_id and len(x) == len(q):
                    s = sum(a * b for a, b in zip(q, x, strict=True))
                    best[i] = s if best[i] is None else max(best[i], s)
            ranked = sorted((-s, i) for i, s in best.items())[:k]
            out += [(q_id, r + 1, i, -s) for r, (s, i) in enumerate(ranked)]
    return sorted(out)


def found(spark, rows, **how):
    data = V.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"v": F.lit("clash"), "dim": F.lit(1)})).cache()
    return sorted(tuple(r) for r in V.voronoi_top_k(data.filter("vec_id % 50 = 0"), data, **how).collect())


def near_rows(n, dim, seed, scale=1.0):
    rng = np.random.default_rng(seed)
    return [(int(i), [float(x) for x in scale * (rng.normal(size=dim) + 2 * (i % 5))]) for i in range(n)]


@pytest.mark.parametrize("value", [2.0**41, 1e10, -(2.0**43)])
def test_large_components_take_part(spark, value):
    rows = near_rows(120, 4, 1) + [(201, [value, 0.25, 0.0, 1.0]), (202, [-value, 1.0, 0.0, 1.0])]
    want = brute(rows)
    assert {201, 202} & {r[2] for r in want} and found(spark, rows, query_rows=3, data_rows=20) == want


@pytest.mark.parametrize("value", [2.0**18, 2.0**21.5])
def test_products_beyond_doubles_are_exact(spark, value):
    rows = near_rows(60, 4, 1) + [(100 + 10 * i, [value + i, value - i, float(i % 3), 1.0]) for i in range(12)]
    assert found(spark, rows, query_rows=3, data_rows=20) == brute(rows)


def test_what_fits_no_long_is_an_error(spark):
    with pytest.raises(PySparkException):
        found(spark, [(50, [1.0]), (1, [2.0**54])])
    with pytest.raises(PySparkException):
        found(spark, [(50, [2.0**41]), (1, [2.0**41])])
    assert found(spark, [(50, [2.0**41]), (1, [1.0])]) == [(50, 1, 1, 1 << 57)]


def test_an_id_with_many_vectors_costs_no_ranks(spark):
    rows = near_rows(12, 3, 2) + [(50, [9.0 + i, 9.0, 9.0]) for i in range(4)] + [(7, [8.0, 9.0, 9.0 + i]) for i in range(6)]
    pivots = {3: np.array([[0.0] * 3, [2304.0] * 3])}
    for how in ({}, {"query_rows": 2, "data_rows": 3}, {"pivots": pivots, "query_rows": 2, "data_rows": 3}):
        assert found(spark, rows, **how) == brute(rows)
    assert len(brute(rows)) == 25


def test_three_hundred_lengths(spark):
    rows = [(50 * i if i % 3 == 0 else 50 * i + 1, [float((i * j) % 7) for j in range(n + 1)]) for n in range(300) for i in range(3 * n, 3 * n + 3)]
    assert found(spark, rows) == brute(rows)


def test_pivots_grow_and_bounds_hold(spark):
    rows = near_rows(900, 6, 3, 0.1) + [(2000 + i, near_rows(900, 6, 3, 0.1)[5][1]) for i in range(40)] + [(None, [1.0] * 6), (3001, None), (3002, []), (3003, [1.0, None] * 3), (3004, [math.inf] * 6), (3050, [math.nan] * 6)]
    data = V.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).cache()
    pivots = V.pivots_of(data, rows=100)
    assert len(pivots[6]) == math.ceil(math.sqrt(data.count()) / V.PIVOT_STEP) and V.pivots_of(data, rows=100, most_bytes=5 * 48)[6].shape == (5, 6)
    assert found(spark, rows, pivots=pivots, query_rows=4, data_rows=30) == brute(rows)
    assert found(spark, rows[:0]) == []


def test_far_groups_are_left_out():
    pivots = np.array([[0.0, 0.0], [1000.0, 0.0]])
    groups = [{"g": 0, "radius": 1.0, "high2": 1.0, "near": [(0.0, 0.0, i) for i in range(6)]}, {"g": 1, "radius": 1.0, "high2": 1001.0**2, "near": [(0.0, 1e6, 10 + i) for i in range(6)]}]
    floor, to = V.reachable(pivots[1], 1.0, 999.0**2, 1001.0**2, groups, pivots, 5)
    assert to == [1] and floor < 1e6
    floor, to = V.reachable(pivots[1], 1.0, 999.0**2, 1001.0**2, [groups[0] | {"near": groups[0]["near"][:3]}], pivots, 5)
    assert to == [0] and floor == -math.inf


def test_what_is_sent_to_bins_is_never_broadcast(spark):
    """The size of routed query blocks can't be told from the small files they come from."""
    rows = near_rows(400, 6, 4)
    data = V.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).cache()
    pivots = {6: np.array([[512.0 * i] * 6 for i in range(5)])}
    df = V.voronoi_top_k(data.filter("vec_id % 50 = 0"), data, pivots=pivots, query_rows=2, data_rows=20)
    assert "BroadcastExchange" not in df._jdf.queryExecution().executedPlan().toString()
    for how in ({"bins": 1, "parts": 1}, {"bins": 3, "parts": 2}, {}):
        assert found(spark, rows, pivots=pivots, query_rows=2, data_rows=20, **how) == brute(rows)


def test_best_over_blocks_keeps_ties_and_best_vectors_of_ids():
    rng = np.random.default_rng(5)
    made = lambda ids, x: V.Block(ids.tobytes(), x.tobytes(), True, x.shape[1])
    for size in (3, 1 << 20, 1 << 40):  # floats, doubles and objects
        q, x, ids = rng.integers(-3, 4, (6, 2)), rng.integers(-3, 4, (90, 2)), np.sort(rng.integers(0, 40, 90))
        x = x * np.where(np.arange(90) % 9 == 0, size, 1)[:, None]
        cut = rng.permutation(90)
        blocks = [made(ids[c], x[c]) for c in (np.sort(part) for part in np.array_split(cut, 5))]
        want = []
        for i in range(6):
            best = {}
            for d, v in zip(ids.tolist(), x.tolist(), strict=True):
                if d != i:
                    s = sum(a * b for a, b in zip(q[i].tolist(), v, strict=True))
                    best[d] = max(best.get(d, s), s)
            want += [(i, d, s) for d, s in sorted(best.items(), key=lambda z: (-z[1], z[0]))[:5]]
        assert list(zip(*(z.tolist() for z in V.best_of_blocks(made(np.arange(6), q), blocks, 5, -np.inf)), strict=True)) == want
