"""Decisions within phrases: where a phrase's colour changes, and which suggestions its budget allows."""

from __future__ import annotations

from collections.abc import Sequence
from heapq import heapify, heappop, heappush, heappushpop

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .walks import over_groups

#: Least change of colour, members with a profile on either side, how alike each side must be, and how sure a profile.
CHANGE, LEAST_MEMBERS, COHESION, SURE = 0.28, 2, 0.68, 0.35
#: Suggestions and changes a phrase, notes between changes, and the confidence of a change.
SUGGESTIONS, CHANGES, NOTES_BETWEEN, CONFIDENT = 3, 3, 2, 0.85
PLACES = 9
#: Ranges of splits to begin with, and what bounds and sums may differ by for their order.
PARTS, SLACK = 16, 1e-8


def running_medians(values: np.ndarray) -> np.ndarray:
    """The median of each column over the first row, the first two, and so on."""
    out = np.empty(values.shape)
    for c in range(values.shape[1]):
        low: list[float] = []  # negated: the smaller half, and one more where rows are odd
        high: list[float] = []
        medians = []
        for i, x in enumerate(values[:, c].tolist()):
            if i % 2 == 0:
                heappush(low, -heappushpop(high, x))
                medians.append(-low[0])
            else:
                heappush(high, -heappushpop(low, -x))
                medians.append((high[0] - low[0]) / 2)
        out[:, c] = medians
    return out


def alike(a: np.ndarray, a_sure: np.ndarray, b: np.ndarray, b_sure: np.ndarray) -> np.ndarray:
    """How alike rows of ``a`` and ``b`` (of one shape, or one row) are, 0 to 1."""
    apart = np.minimum(1.0, np.abs(a - b) / np.maximum(1.0, np.maximum(np.abs(a), np.abs(b))))
    return np.clip((1.0 - np.sqrt((apart**2).mean(axis=-1))) * np.minimum(a_sure, b_sure), 0.0, 1.0)


def _most_alike(values: np.ndarray, sure: np.ndarray, centres: np.ndarray, centres_sure: np.ndarray) -> np.ndarray:
    """No less than how alike each row is to any of ``centres``."""
    low, high = centres.min(axis=0), centres.max(axis=0)
    apart = np.maximum(0.0, np.maximum(low - values, values - high))
    apart = np.minimum(1.0, apart / np.maximum(1.0, np.maximum(np.abs(values), np.maximum(np.abs(low), np.abs(high)))))
    return np.clip((1.0 - np.sqrt((apart**2).mean(axis=-1))) * np.minimum(sure, centres_sure.max()), 0.0, 1.0)


def change_point(start: np.ndarray, values: np.ndarray, sure: np.ndarray) -> float | None:
    """The time between two members at which the colour changes most, or None.

    Each side stands for itself by the medians of its values; they come from both ends, so every split costs a step.
    How alike a side is within takes a look at all of it. For a range of neighbouring splits, whose medians hardly
    differ, one such look says how large the change can be at most; ranges are cut in order of that, down to single
    splits, and only until none can beat the best.
    """
    n = len(start)
    at = np.arange(LEAST_MEMBERS, n - LEAST_MEMBERS + 1)
    if not len(at):
        return None
    left, right = running_medians(values)[at - 1], running_medians(values[::-1])[::-1][at]
    sums = np.r_[0.0, np.cumsum(sure)]
    left_sure, right_sure = sums[at] / at, (sums[n] - sums[at]) / (n - at)
    most = (1.0 - alike(left, left_sure, right, right_sure)) * np.minimum(left_sure, right_sure)
    middle = (start[at - 1] + start[at]) * 0.5
    best = None

    def bounded(splits: np.ndarray) -> list[tuple[float, int, np.ndarray]]:
        """Those of some splits, in order, that may be a change, with the largest that it can be; SLACK covers the order of sums."""
        splits = splits[most[splits] + SLACK >= CHANGE]
        if not len(splits):
            return []
        if len(splits) == 1:
            return [(-float(most[splits[0]]), int(splits[0]), splits)]
        first, last = at[splits[0]], at[splits[-1]]
        before = np.cumsum(_most_alike(values[:last], sure[:last], left[splits], left_sure[splits]))[at[splits] - 1] / at[splits]
        after = np.cumsum(_most_alike(values[first:], sure[first:], right[splits], right_sure[splits])[::-1])[n - at[splits] - 1] / (n - at[splits])
        own = np.minimum(before, after)
        change = most[splits] * own
        may = (own + SLACK >= COHESION) & (change + SLACK >= CHANGE)
        return [(-float(change[may].max()), int(splits[0]), splits[may])] if may.any() else []

    ranges = [found for part in np.array_split(np.arange(len(at)), min(PARTS, len(at))) for found in bounded(part)]
    heapify(ranges)
    while ranges:
        bound, _, splits = heappop(ranges)
        if best is not None and SLACK - bound < best[0]:
            break
        if len(splits) > 1:
            for part in np.array_split(splits, min(4, len(splits))):
                for found in bounded(part):
                    heappush(ranges, found)
            continue
        k = splits[0]
        own = [alike(values[a:b], sure[a:b], side, side_sure).mean() for a, b, side, side_sure in ((0, at[k], left[k], left_sure[k]), (at[k], n, right[k], right_sure[k]))]
        change = round(float(most[k] * min(own)), PLACES)
        if min(own) >= COHESION and change >= CHANGE:
            score = (change, -middle[k], int(at[k]))
            best = score if best is None else max(best, score)
    return None if best is None else -best[1]


def split_by_timbre(members: DataFrame, on: Sequence[str] = ("group_id",)) -> DataFrame:
    """(*on, note_id, side): 0, or 1 from where its group's colour changes once and for good.

    ``members`` has note_id, start_ms, pitch, features (array<double>) and reliability; a member without features, or
    not sure enough, has no say but goes with its time. Members without start take no part. A group is one walk.
    """

    def solve(g: dict) -> tuple:
        start = g["start_ms"]
        known = np.array([x is not None for x in g["features"]], bool) & (np.nan_to_num(g["reliability"].astype(float)) >= SURE)
        side = np.zeros(len(start), np.int32)
        if known.sum() >= 2 * LEAST_MEMBERS:
            at = change_point(start[known], np.stack(list(g["features"][known])).astype(float), g["reliability"][known].astype(float))
            if at is not None and (start < at).any():
                side[start >= at] = 1
        return *(g[k] for k in on), g["note_id"], side

    kinds = dict(members.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in on), "note_id long, side int"])
    return over_groups(members, on, ["features", "reliability"], ["start_ms", "pitch", "note_id"], solve, schema, nullable=["features", "reliability", "pitch"])


def budgeted_select(options: DataFrame, on: Sequence[str] = ("track_id",), suggestions: int = SUGGESTIONS, changes: int = CHANGES, between: int = NOTES_BETWEEN, confident: float = CONFIDENT) -> DataFrame:
    """(*on, place, ntype, status): what becomes of the best option of each place: ``applied``, ``suggested`` or ``skipped``.

    ``options`` has phrase, place (the note's number in its key), ntype, confidence and verified. The most confident
    option of a place stands for it, ties go to the smaller ntype, then to a verified one. In order of place a phrase has so many
    ``suggestions``; of them a verified and confident one is applied while its phrase has had fewer than ``changes``
    and more than ``between`` notes lie between it and the last one applied. Budgets are counted by windows; only
    candidates for a change are walked, in parts that neither a phrase nor the distance ties together.
    """
    keys = list(on)
    w = Window.partitionBy(*keys)
    best = options.withColumn("n", F.row_number().over(Window.partitionBy(*keys, "place").orderBy(F.desc("confidence"), "ntype", F.desc_nulls_last("verified")))).filter("n = 1")
    known = best.withColumn("number", F.row_number().over(Window.partitionBy(*keys, "phrase").orderBy("place")))
    fits = known.filter(F.col("number") <= suggestions)
    may = F.coalesce(F.col("verified") & (F.col("confidence") >= confident), F.lit(False))
    asked = fits.filter(may).withColumn("until", F.max("place").over(Window.partitionBy(*keys, "phrase")))
    order = w.orderBy("place")
    reached = F.max("until").over(order.rowsBetween(Window.unboundedPreceding, -1))  # as far as phrases begun before go
    apart = (F.col("place") - F.lag("place").over(order) > between) & (F.col("place") > reached)
    cut = asked.withColumn("fresh", F.when(F.coalesce(apart, F.lit(True)), 1).otherwise(0)).withColumn("part", F.sum("fresh").over(order))

    def solve(g: dict) -> tuple:
        place, phrase = g["place"].tolist(), g["phrase"].tolist()
        last, used, out = None, {}, np.zeros(len(place), bool)
        for i, (p, own) in enumerate(zip(place, phrase, strict=True)):
            if used.get(own, 0) < changes and (last is None or p - last > between):
                out[i], last, used[own] = True, p, used.get(own, 0) + 1
        return *(g[k] for k in keys), g["place"], g["ntype"], out

    kinds = dict(options.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"place {kinds['place']}, ntype {kinds['ntype']}, applied boolean"])
    walked = over_groups(cut, [*keys, "part"], ["phrase", "ntype"], ["place"], solve, schema, nullable=["phrase"])
    fields = [*keys, "place", "ntype"]
    rest = known.filter(F.col("number") > suggestions).select(*fields, F.lit("skipped").alias("status"))
    plain = fits.filter(~may).select(*fields, F.lit("suggested").alias("status"))
    return rest.unionByName(plain).unionByName(walked.select(*fields, F.when(F.col("applied"), "applied").otherwise("suggested").alias("status")))
