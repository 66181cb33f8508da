"""Bin completion over a histogram of lengths.

A plan says how many bins get which filling; it depends on the counts of each length alone, so its size is bounded by
the capacity and not by the number of items. Around the largest item left, fillings of any number of items are made
lazily, least waste first; dominated ones are passed over, and branches go that can't beat the best plan so far.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np

#: Fillings looked at before the best plan so far is taken; the search's only limit.
NODE_BUDGET = 3000
#: Levels of the search whose enumeration is kept; others begin anew and skip what they gave. A memory bound.
KEPT_LEVELS = 32
#: What is left is packed by best fit where it has few lengths, and else at every so many levels: it takes ten times as long as the rest of a level.
FEW_LENGTHS, BEST_FIT_EVERY = 128, 16

Plan = list[tuple[tuple[int, ...], int]]


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """The least number of bins by the volume, and by the items of more than half a bin, of which no two share one.

    For each k up to half a bin: items above capacity - k are alone among those of k and more, and what the other
    large ones leave free must hold the rest of these.
    """
    number = np.zeros(capacity + 2, np.int64)
    for length, n in counts.items():
        number[length] += n
    n_from, volume_from = (np.cumsum(x[::-1])[::-1] for x in (number, np.arange(capacity + 2) * number))  # items of k and more
    half = capacity // 2
    alone, large_volume = n_from[half + 1], volume_from[half + 1]
    k = np.arange(half + 1)
    big, big_volume = n_from[capacity - k + 1], volume_from[capacity - k + 1]
    room = (alone - big) * capacity - (large_volume - big_volume)
    small = volume_from[k] - large_volume
    return int(max(-(-volume_from[0] // capacity), (alone + np.maximum(0, -((room - small) // capacity))).max()))


def best_fit(counts: dict[int, int], capacity: int) -> Plan:
    """Best-fit decreasing over groups of equal bins: each length goes to the fullest bins that hold it."""
    groups: dict[int, Counter] = {}  # free room: fillings and how many bins have them
    rooms: list[int] = []

    def put(room: int, filling: tuple[int, ...], bins: int) -> None:
        if room not in groups:
            groups[room] = Counter()
            insort(rooms, room)
        groups[room][filling] += bins

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                fit = capacity // length
                whole, rest = divmod(left, fit)
                for copies, bins in ((fit, whole), (rest, 1)):
                    if copies and bins:
                        put(capacity - copies * length, (length,) * copies, bins)
                break
            room = rooms[at]
            filling, bins = next(iter(groups[room].items()))
            fit = min(room // length, left)
            used = min(bins, left // fit)
            if used == bins:
                del groups[room][filling]
                if not groups[room]:
                    del groups[room], rooms[at]
            else:
                groups[room][filling] -= used
            put(room - fit * length, filling + (length,) * fit, used)
            left -= used * fit
    return [(filling, n) for found in groups.values() for filling, n in found.items()]


def _free(counts: dict[int, int]) -> int:
    """The lengths that are left, as bits."""
    return sum(1 << k for k, n in counts.items() if n)


def dominated(filling: tuple[int, ...], slack: int, free: int, counts: dict[int, int]) -> bool:
    """True if one free item can stand for some of the filling's items, or for none, and leave no more waste: never worse.

    An item that takes part of the slack, or the place of two or more items of its own sum, can only help: what it
    displaces fits where it came from. ``free`` has the bits of the lengths that are left.
    """
    sums, of_many = 1, 0  # sums of any of the items, and of two or more
    for x in filling:
        of_many |= (sums & ~1 | of_many) << x
        sums |= sums << x
    reach, width = sums << 1, 1  # sums plus 1 to ``width``
    while width < slack:
        step = min(width, slack - width)
        reach |= reach << step
        width += step
    for x in set(filling):
        if counts[x] == filling.count(x):
            free &= ~(1 << x)
    return bool(((reach if slack else 0) | of_many) & free)


def fillings(room: int, counts: dict[int, int], allowed: int) -> Iterator[tuple[int, ...]]:
    """All fillings of ``room`` by items of ``counts`` that waste at most ``allowed``, least waste first, each once."""
    lengths = sorted((k for k, n in counts.items() if n and k <= room), reverse=True)
    whole = (1 << room + 1) - 1
    reach = [1]  # sums that the lengths from each place on can make
    for k in reversed(lengths):
        sums, n, step = reach[-1], min(counts[k], room // k), 1
        while n:
            step = min(step, n)
            sums |= sums << step * k & whole
            n, step = n - step, 2 * step
        reach.append(sums)
    reach.reverse()

    def exact(at: int, target: int) -> Iterator[tuple[int, ...]]:
        if not target:
            yield ()
        while at < len(lengths) and target and reach[at] >> target & 1:
            k = lengths[at]
            at += 1
            for n in range(min(counts[k], target // k), 0, -1):
                if reach[at] >> target - n * k & 1:
                    for rest in exact(at, target - n * k):
                        yield (k,) * n + rest

    for waste in range(min(allowed, room) + 1):
        if reach[0] >> room - waste & 1:
            yield from exact(0, room - waste)


def search(counts: dict[int, int], capacity: int, incumbent: Plan, bound: int, budget: int = NODE_BUDGET) -> Plan:
    """Depth-first branch and bound around the largest item left.

    Each undominated filling is tried for as many equal bins as the counts allow, then for a single one, so every plan
    of such fillings can be reached. A branch ends where the bins so far and the bound of what is left reach the best
    plan; what is left is packed by best fit, whose plan replaces the best one if it is better.
    """
    best, most = incumbent, sum(n for _, n in incumbent)
    left, chosen, bins, looked_at, seen = dict(counts), [], 0, 0, set()
    mark = {k: hash((k, 1 << 20)) for k in counts}

    def tries(first: bool) -> Iterator[tuple[tuple[int, ...], int]]:
        """Fillings with the largest item left and for how many bins; ends where nothing better can follow. ``first``: not a level that begins anew."""
        nonlocal best, most, looked_at
        if first:
            state = (sum(mark[k] * n for k, n in left.items()), bins)
            if state in seen or bins + lower_bound(left, capacity) >= most:
                return
            seen.add(state)
            if len(left) <= FEW_LENGTHS or len(seen) % BEST_FIT_EVERY == 1:
                rest = best_fit(left, capacity)
                if (total := bins + sum(n for _, n in rest)) < most:
                    most, best = total, chosen + rest
        length = max(left)
        others = left | {length: left[length] - 1}
        volume = sum(k * n for k, n in left.items())
        allowed = (most - 1 - bins) * capacity - volume
        free = _free(others)
        for filling in fillings(capacity - length, others, allowed) if allowed >= 0 else ():
            looked_at += 1
            waste = capacity - length - sum(filling)
            if bins + 1 >= most or looked_at > budget or waste > (most - 1 - bins) * capacity - volume:
                return
            if not dominated(filling, waste, free, others):
                own = (length, *filling)
                n = min(left[x] // k for x, k in Counter(own).items())
                yield own, n
                if n > 1:
                    yield own, 1

    # each level: its enumeration, or None where it isn't kept; how many steps it gave; the step that led to it
    stack: list[list] = [[tries(True), 0, None]]
    while stack and looked_at <= budget and most > bound:
        level = stack[-1]
        if level[0] is None:
            level[0] = islice(tries(False), level[1], None)
        step = next(level[0], None)
        level[1] += 1
        if step is None:
            stack.pop()
            if level[2]:
                filling, n = level[2]
                for x in filling:
                    left[x] = left.get(x, 0) + n
                bins -= n
                chosen.pop()
            continue
        filling, n = step
        if bins + n >= most:
            continue
        for x in filling:
            left[x] -= n
            if not left[x]:
                del left[x]
        bins += n
        chosen.append(step)
        if not left:
            most, best = bins, list(chosen)
        stack.append([tries(True) if left else iter(()), 0, step])
        if len(stack) > KEPT_LEVELS:
            stack[-KEPT_LEVELS - 1][0] = None
    return best


def plan(counts: dict[int, int], capacity: int, budget: int = NODE_BUDGET) -> Plan:
    """Fillings and how many bins get each; every item of ``counts`` once, no filling above ``capacity``.

    Best-fit decreasing is the first incumbent, bin completion improves on it until the lower bound or the budget is
    reached. Lengths must lie in 1..capacity.
    """
    counts = {k: n for k, n in counts.items() if n}
    first, bound = best_fit(counts, capacity), lower_bound(counts, capacity)
    return first if sum(n for _, n in first) <= bound else search(counts, capacity, first, bound, budget)
