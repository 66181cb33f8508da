"""Reattaching reviews to the spans of a new analysis, one to one, when both their time and their notes agree."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import written
from .intervals import range_join
from .matching import candidate_overlap
from .walks import join_keys, over_groups

#: The least share of notes and of time that a review and its new span have in common.
LEAST_OVERLAP, LEAST_IOU = 0.60, 0.50


def recover_reviews(reviews: DataFrame, spans: DataFrame, review_notes: DataFrame, span_notes: DataFrame, on: Sequence[str] = ("track_id",), least_overlap: float = LEAST_OVERLAP, least_iou: float = LEAST_IOU, width: float = 4000.0) -> DataFrame:
    """(*on, review_id, span_id, overlap, iou): each review's new span, or nulls where it stays orphaned.

    ``reviews`` (review_id) and ``spans`` (span_id) have start_ms and end_ms; ``review_notes`` and ``span_notes`` hold
    their notes, old and new: the id of what they belong to, note_id, pitch, start_ms and dur_ms. A span fits if the
    intersection of both times is ``least_iou`` of their union and ``candidate_overlap`` of their notes is
    ``least_overlap``. Reviews choose by start, end and id: of the spans still free the one of highest overlap, then
    time, then smallest id. Spans meet in time buckets; only reviews that compete for spans are walked together.
    """
    keys = list(on)
    asked = reviews.filter("end_ms > start_ms").select(*keys, "review_id", F.col("start_ms").alias("r_start"), F.col("end_ms").alias("r_end"))
    there = spans.filter("end_ms > start_ms").select(*keys, "span_id", F.col("start_ms").alias("s_start"), F.col("end_ms").alias("s_end"))
    met = range_join(asked, there, ("r_start", "r_end"), ("s_start", "s_end"), width, keys)
    both = F.least("r_end", "s_end") - F.greatest("r_start", "s_start")
    iou = F.round(both / (F.greatest("r_end", "s_end") - F.least("r_start", "s_start")), 9)
    pairs = written(met.withColumn("iou", iou).filter(F.col("iou") >= least_iou), "review-pairs")
    pair = [*keys, "review_id", "span_id"]
    notes = ["note_id", "pitch", "start_ms", "dur_ms"]
    old = join_keys(pairs.select(*pair), review_notes.select(*keys, "review_id", *notes), [*keys, "review_id"])
    new = join_keys(pairs.select(*pair), span_notes.select(*keys, "span_id", *notes), [*keys, "span_id"])
    score = candidate_overlap(old, new, pair).filter(F.col("score") >= least_overlap).select(*pair, F.col("score").alias("overlap"))
    ranked = join_keys(pairs, score, pair)
    # a part ends where no later pair shares a review or a span with an earlier one
    order = Window.partitionBy(*keys).orderBy(F.least("r_start", "s_start"), "review_id", "span_id")
    reached = F.max(F.greatest("r_end", "s_end")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(F.least("r_start", "s_start") < reached, 0).otherwise(1)
    parts = ranked.withColumn("fresh", fresh).withColumn("part", F.sum("fresh").over(order))

    def solve(g: dict) -> tuple:
        taken: set = set()
        chosen: list[int] = []
        begun = np.flatnonzero(np.r_[True, g["review_id"][1:] != g["review_id"][:-1]]).tolist()
        for lo, hi in zip(begun, [*begun[1:], len(g["review_id"])], strict=True):
            free = [i for i in range(lo, hi) if g["span_id"][i] not in taken]
            if free:
                best = min(free, key=lambda i: (-g["overlap"][i], -g["iou"][i], g["span_id"][i]))
                taken.add(g["span_id"][best])
                chosen.append(best)
        at = np.array(chosen, np.int64)
        return *(g[k][at] for k in [*keys, "review_id", "span_id", "overlap", "iou"]),

    kinds = dict(reviews.dtypes) | dict(spans.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in pair), "overlap double, iou double"])
    found = over_groups(parts, [*keys, "part"], ["span_id", "overlap", "iou"], ["r_start", "r_end", "review_id", "span_id"], solve, schema)
    return join_keys(reviews.select(*keys, "review_id"), found, [*keys, "review_id"], "left")
