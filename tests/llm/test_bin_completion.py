"""Bin completion against planted optima and against all plans of small instances."""

from collections import Counter
from functools import lru_cache

import numpy as np
import pytest

from chronoweave.llm import bin_completion as B


def bins_of(plan):
    return sum(n for _, n in plan)


def planted(seed, capacity, bins, low, high):
    """Lengths that fill ``bins`` bins without waste."""
    rng, out = np.random.default_rng(seed), []
    for _ in range(bins):
        room = capacity
        while room:
            x = int(rng.integers(low, high))
            x = room if x >= room or room - x < low else x
            out.append(x)
            room -= x
    return Counter(out)


def least_bins(items, capacity):
    @lru_cache(None)
    def solve(left):
        if not left:
            return 0
        first, rest = left[0], left[1:]
        best = len(left)
        for mask in range(1 << len(rest)):
            own = [x for i, x in enumerate(rest) if mask >> i & 1]
            if first + sum(own) <= capacity:
                best = min(best, 1 + solve(tuple(x for i, x in enumerate(rest) if not mask >> i & 1)))
        return best

    return solve(tuple(sorted(items, reverse=True)))


@pytest.mark.parametrize("capacity, bins, low, high", [(100, 10, 10, 60), (100, 12, 5, 40), (2048, 40, 20, 400)])
def test_best_fit_is_beaten_where_the_optimum_is_known(capacity, bins, low, high):
    improved = 0
    for seed in range(8):
        counts = planted(seed, capacity, bins, low, high)
        plan, first = B.plan(counts, capacity), B.best_fit(counts, capacity)
        used = Counter()
        for filling, n in plan:
            assert sum(filling) <= capacity
            for x in filling:
                used[x] += n
        assert used == counts and bins_of(plan) == bins == B.lower_bound(counts, capacity)
        improved += bins_of(first) > bins
    assert improved >= 4


def test_small_instances_get_the_least_bins():
    rng = np.random.default_rng(9)
    for _ in range(60):
        items = [int(x) for x in rng.integers(1, 20, 9)]
        counts, least = Counter(items), least_bins(items, 20)
        assert B.lower_bound(counts, 20) <= least == bins_of(B.plan(counts, 20))
        assert bins_of(B.search(counts, 20, B.best_fit(counts, 20), 0, 10**6)) == least  # also without the bound that ends it early


def test_fillings_are_all_there_least_waste_first():
    counts = {7: 2, 5: 1, 3: 3, 2: 1}
    found = list(B.fillings(12, counts, 12))
    everything = {(7,) * a + (5,) * b + (3,) * c + (2,) * d for a in range(3) for b in range(2) for c in range(4) for d in range(2) if 7 * a + 5 * b + 3 * c + 2 * d <= 12}
    assert len(found) == len(set(found)) and set(found) == everything
    assert [12 - sum(f) for f in found] == sorted(12 - sum(f) for f in found)


def test_dominance():
    counts = {7: 1, 5: 1, 4: 1, 3: 1}
    free = B._free(counts)
    assert B.dominated((3, 4), 0, free, counts)  # 7 stands for both
    assert B.dominated((5,), 3, free, counts)  # 3 fits beside it
    assert B.dominated((4,), 1, free, counts)  # 5 takes the slack
    assert not B.dominated((5, 4), 0, B._free({5: 1, 4: 1, 3: 1}), {5: 1, 4: 1, 3: 1})


def test_counts_of_billions_take_no_longer():
    counts = {1500: 10**9, 548: 10**9, 1024: 3 * 10**9 + 1, 700: 2 * 10**9, 648: 10**9}
    plan = B.plan(counts, 2048)
    assert bins_of(plan) == B.lower_bound(counts, 2048)
    assert len(plan) < 100


def test_the_budget_is_kept_and_never_worse():
    counts = planted(3, 2048, 30, 200, 1200)
    for budget in (0, 1, 50):
        assert bins_of(B.plan(counts, 2048, budget)) <= bins_of(B.best_fit(counts, 2048))
