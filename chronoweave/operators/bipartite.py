"""Maximum matchings of two sets of notes under two tolerances at once.

With one tolerance, pairing along the line is as good as any matching; with two, an early note may have to give its
partner away. Notes of one identity are cut where no start reaches across, and each part is matched by augmenting
paths. Partners are looked up in cells of starts and ranks of ends, among those that a round has not reached yet, so
neither time nor memory follows the pairs in reach.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .folds import islands
from .projections import end_ms
from .walks import over_groups


#: Pairs that are looked at together.
PAIRS = 1 << 20
#: What the sweep before the augmenting paths looks at: right rows of a cell, cells of a left row.
LOOKED_AT, CELLS = 8, 64
Look = Callable[[np.ndarray, np.ndarray], Iterator[tuple[np.ndarray, np.ndarray]]]


def augmented(look: Look, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """``left``, the right row of each left one or -1, made a maximum matching; ``right`` is its inverse, and both are changed.

    A round grows trees from all free left rows at once, a layer at a time. A right row belongs to the first tree that
    reaches it, and a tree stops where it has a free one; so paths of different trees have no row in common, and all
    are turned over together. A round that reaches no free row ends it. ``look`` gives, in parts, the pairs of some
    left rows with those right rows that still are true in an array, which is kept up to date between parts.
    """
    mix = np.random.default_rng(0)
    while True:
        parent, tree = np.full(len(right), -1, np.int64), np.full(len(left), -1, np.int64)
        fresh, grown = np.ones(len(right), bool), np.zeros(len(left), bool)
        front, ends = np.flatnonzero(left < 0), []
        tree[front] = front
        while len(front):
            new = []
            for i, j in look(front, fresh):
                order = mix.permutation(len(j))  # so that rows of equal reach share what they reach
                parent[j[order]] = i[order]
                j = np.flatnonzero(np.bincount(j, minlength=len(right))) if len(j) > len(right) // 8 else np.unique(j)
                fresh[j] = False
                new.append(j)
            reached = np.concatenate(new) if new else front[:0]
            free = reached[right[reached] < 0]
            roots, at = np.unique(tree[parent[free]], return_index=True)
            ends.append(free[at])
            grown[roots] = True
            held = reached[right[reached] >= 0]
            front = right[held]
            tree[front] = tree[parent[held]]
            front = front[~grown[tree[front]]]
        j = np.concatenate(ends) if ends else np.zeros(0, np.int64)
        if not len(j):
            return left
        while len(j):
            i = parent[j]
            before = left[i]
            left[i], right[j] = j, i
            j = before[before >= 0]


def maximum_matching(partners: list[np.ndarray], n_right: int) -> np.ndarray:
    """For each left row the right row that it is matched with, or -1: as many pairs as any matching."""
    left, right = np.full(len(partners), -1, np.int64), np.full(n_right, -1, np.int64)
    for i, own in enumerate(partners):  # what is free along the line first
        free = own[right[own] < 0] if len(own) else own
        if len(free):
            left[i], right[free[0]] = free[0], i

    def look(front, fresh):
        i, j = np.repeat(front, [len(partners[x]) for x in front]), np.concatenate([partners[x] for x in front])
        yield i[fresh[j]], j[fresh[j]]

    return augmented(look, left, right)


def line_matching(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """maximum_matching of left rows whose partners are the right rows from ``low`` to before ``high``, where neither falls."""
    left, j = np.full(len(low), -1, np.int64), 0
    for i, (x, y) in enumerate(zip(low.tolist(), high.tolist(), strict=True)):
        j = max(j, x)
        if j < y:
            left[i] = j
            j += 1
    return left


def swept(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray], start_tol: float, end_tol: np.ndarray, width: float) -> np.ndarray:
    """A large matching of boxes, not a maximum one: each left row takes the earliest free right row that LOOKED_AT ones a cell of ends, for so many cells, show."""
    (xs, xe), (ys, ye) = x, y
    cells: dict[int, list[int]] = {}
    for j, c in enumerate(np.floor(ye / width).tolist()):
        cells.setdefault(c, []).append(j)
    heads, taken, out = dict.fromkeys(cells, 0), bytearray(len(ys)), np.full(len(xs), -1, np.int64)
    ys, ye = ys.tolist(), ye.tolist()
    for i, (s, e, t) in enumerate(zip(xs.tolist(), xe.tolist(), end_tol.tolist(), strict=True)):
        best, early, late = -1, s - start_tol, s + start_tol
        c, stop = (e - t) // width, (e + t) // width
        if stop - c > CELLS:
            c, stop = e // width - CELLS // 2, e // width + CELLS // 2
        while c <= stop:
            own = cells.get(c)
            if own is not None:
                k = heads[c]
                while k < len(own) and (taken[own[k]] or ys[own[k]] < early):
                    k += 1
                heads[c] = k
                for j in own[k : k + LOOKED_AT]:
                    if ys[j] > late:
                        break
                    if not taken[j] and e - t <= ye[j] <= e + t:
                        late, best = ys[j], j
                        break
            c += 1
        if best >= 0:
            taken[best], out[i] = 1, best
    return out


def box_matching(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray], start_tol: float, end_tol: np.ndarray) -> np.ndarray:
    """maximum_matching of left and right rows, each starts and ends, whose starts lie within ``start_tol`` and ends within that of the left row.

    Both sides come by start. Pairing along the line leaves little to the augmenting paths.
    """
    (xs, xe), (ys, ye) = x, y
    left, right = np.full(len(xs), -1, np.int64), np.full(len(ys), -1, np.int64)
    if not len(xs) or not len(ys):
        return left
    wide, high = max(start_tol, 1e-6), max(float(end_tol.min()), 1e-6)

    def fits(i, j):
        gap = np.abs(ys[j] - xs[i])
        return (gap <= start_tol + 1e-9) & (gap.round(6) <= start_tol) & (np.abs(ye[j] - xe[i]).round(6) <= end_tol[i])

    first_guess = swept(x, y, start_tol, end_tol, high / 2)
    i = np.flatnonzero(first_guess >= 0)
    i = i[fits(i, first_guess[i])]
    left[i], right[first_guess[i]] = first_guess[i], i

    kinds, cell = np.unique(np.floor(ys / wide), return_inverse=True)
    by_end = np.argsort(ye, kind="stable")
    rank = np.empty(len(ye), np.int64)
    rank[by_end] = np.arange(len(ye))
    places = cell * len(ye) + rank
    order = np.argsort(places)
    first, last = np.searchsorted(kinds, np.floor((xs - start_tol - 1e-6) / wide)), np.searchsorted(kinds, np.floor((xs + start_tol + 1e-6) / wide), side="right")
    low, top = np.searchsorted(ye[by_end], xe - end_tol - 1e-6), np.searchsorted(ye[by_end], xe + end_tol + 1e-6, side="right")

    open_, there, seen, spent = order, places[order], None, 0

    def look(front, fresh):
        nonlocal open_, there, seen, spent
        if fresh is not seen:
            open_, there, seen, spent = order, places[order], fresh, 0
        if len(front) > 64:
            front = np.concatenate([front[k::64] for k in range(64)])  # so that the first parts reach far
        at, most = 0, 16
        while at < len(front):
            if spent > len(open_) // 8:  # rows already reached cost as much as leaving them out
                open_ = open_[fresh[open_]]
                there, spent = places[open_], 0
            i = front[at : at + most]
            in_cell = first[i] + np.arange((last[i] - first[i]).max(initial=0))[:, None]
            begin, stop = (np.searchsorted(there, in_cell * len(ye) + bound[i]) for bound in (low, top))
            n = np.where(in_cell < last[i], stop - begin, 0)
            take = max(1, int(np.searchsorted(np.cumsum(n.sum(axis=0)), PAIRS, side="right")))
            n, begin, who = n[:, :take].ravel(), begin[:, :take].ravel(), np.tile(i[:take], len(n))
            who, j = np.repeat(who, n), open_[np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())]
            new = fresh[j]
            spent += len(j) - int(new.sum())
            who, j = who[new], j[new]
            hit = fits(who, j)
            at, most = at + take, 2 * most
            yield who[hit], j[hit]

    return augmented(look, left, right)


def match_notes(a: DataFrame, b: DataFrame, start_tol: float, end_tol: float | None = None, end_ratio: float = 0.0, identity: Sequence[str] = ("pitch",)) -> DataFrame:
    """(*identity, note_id_a, note_id_b): a maximum matching of rows equal in ``identity`` whose starts lie within ``start_tol``.

    With ``end_tol`` their ends lie within it, or ``end_ratio`` of the length of the row of ``a``, too. Null identities
    match each other; rows without start or length match nothing. The number of pairs of each identity doesn't depend
    on the order of rows; which of equal matchings is taken follows from starts, ends and the order of ids alone.
    """
    keys = list(identity)
    side = lambda df, i: df.select(*keys, "note_id", "start_ms", "dur_ms", F.lit(i).alias("side")).dropna(subset=["start_ms", "dur_ms"])
    rows = islands(side(a, 0).unionByName(side(b, 1)), keys, start_tol)

    def solve(g: dict) -> tuple:
        own, other = np.flatnonzero(g["side"] == 0), np.flatnonzero(g["side"] == 1)
        starts, ends = g["start_ms"], g["start_ms"] + g["dur_ms"]
        if end_tol is None:
            low = np.searchsorted(starts[other], starts[own] - start_tol - 1e-9)
            high = np.searchsorted(starts[other], starts[own] + start_tol + 1e-9, side="right")
            left = line_matching(low, high)
        else:
            left = box_matching((starts[own], ends[own]), (starts[other], ends[other]), start_tol, np.maximum(end_tol, end_ratio * g["dur_ms"][own]))
        hit = left >= 0
        return *(g[k][own[hit]] for k in keys), g["note_id"][own[hit]], g["note_id"][other[left[hit]]]

    kinds = dict(a.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "note_id_a long, note_id_b long"])
    return over_groups(rows, [*keys, "island"], ["dur_ms", "side"], ["start_ms", "note_id"], solve, schema)


#: Tolerances of an evaluation in frames, and the share of a reference note's length.
ONSET_FRAMES, OFFSET_FRAMES, OFFSET_RATIO = 4, 4, 0.20


def evaluate(reference: DataFrame, estimate: DataFrame, on: Sequence[str] = ("track_id",), onset: float = ONSET_FRAMES, offset: float = OFFSET_FRAMES, ratio: float = OFFSET_RATIO) -> DataFrame:
    """(*on, n_reference, n_estimate, onset_matched, note_matched, and precision, recall and f1 of both): one-to-one matches of equal pitch.

    The first kind compares starts alone, the second starts and ends. A key of one side only is there too; a rate
    without anything to divide by is 0.
    """
    keys = [*on, "pitch"]
    sides = reference.select(*on, F.lit(1).alias("r"), F.lit(0).alias("e")).unionByName(estimate.select(*on, F.lit(0).alias("r"), F.lit(1).alias("e")))
    none = F.lit(0)
    rows = sides.select(*on, "r", "e", none.alias("o"), none.alias("n"))
    for name, found in (("o", match_notes(reference, estimate, onset, identity=keys)), ("n", match_notes(reference, estimate, onset, offset, ratio, keys))):
        rows = rows.unionByName(found.select(*on, none.alias("r"), none.alias("e"), *(F.lit(int(name == c)).alias(c) for c in "on")))
    counts = rows.groupBy(*on).agg(F.sum("r").alias("n_reference"), F.sum("e").alias("n_estimate"), F.sum("o").alias("onset_matched"), F.sum("n").alias("note_matched"))
    share = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    rates = {}
    for kind in ("onset", "note"):
        hit = F.col(f"{kind}_matched")
        rates |= {f"{kind}_precision": share(hit, F.col("n_estimate")), f"{kind}_recall": share(hit, F.col("n_reference")), f"{kind}_f1": share(2 * hit, F.col("n_reference") + F.col("n_estimate"))}
    return counts.withColumns(rates)


def framed(notes: DataFrame, frame_ms: float = 10.0) -> DataFrame:
    """Notes whose start and length are counted in whole frames."""
    start = F.floor(F.col("start_ms") / frame_ms).cast("double")
    return notes.withColumns({"start_ms": start, "dur_ms": F.greatest(F.lit(1.0), F.floor(end_ms() / frame_ms).cast("double") - start)})
