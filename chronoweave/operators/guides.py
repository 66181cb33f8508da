"""Guide voices: one note of each onset cluster, chosen so that the whole line is strong and moves smoothly.

Hypotheses go from cluster to cluster in a beam. A cluster of one note leaves one hypothesis, whatever came before, so
a track falls into stretches between such clusters: their notes are on the path at once, and only clusters of several
notes, with the single ones that they lie between, are walked.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import written
from .folds import anchor_cluster
from .projections import end_ms
from .walks import join_keys, over_groups

#: Hypotheses that stay, weights of a note, and what a step costs or earns.
BEAM = 10
CONFIDENCE, REGISTER, LENGTH = 2.3, 0.7, 0.25
SMOOTH, LEAP, MOST_LEAP, PAUSE, MOST_PAUSE, NEAR, NEAR_STEP = 0.55, 0.55, 1.8, 0.22, 1.2, 0.18, 2
#: Distances of the other voices from the lead, in semitones and confidence.
BELOW, AROUND, LEAST_BRANCH, BRANCH_LOSS = 5, 7, 0.32, 0.18
PLACES = 9


def beam_path(cluster: np.ndarray, start: np.ndarray, end: np.ndarray, pitch: np.ndarray, emission: np.ndarray, beat_ms: float, width: int) -> list[int]:
    """The places of a path's notes, one of each ``cluster`` (numbers in order); notes of a cluster come by pitch, then id."""
    edges = np.flatnonzero(np.r_[True, cluster[1:] != cluster[:-1], True])
    active, score, back = np.zeros(0, np.int64), np.zeros(0), np.full(len(cluster), -1, np.int64)
    for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        own = np.arange(lo, hi)
        total = emission[lo:hi].copy()
        if len(active):
            leap = np.abs(pitch[own][:, None] - pitch[active][None, :])
            pause = np.maximum(0.0, start[own][:, None] - end[active][None, :])
            step = SMOOTH - np.minimum(MOST_LEAP, leap / 12.0 * LEAP) - np.minimum(MOST_PAUSE, pause / max(1.0, beat_ms) * PAUSE) + NEAR * (leap <= NEAR_STEP)
            reached = np.round(score[None, :] + step, PLACES)
            for k in range(len(own)):  # of equal ones the smallest leap, then the last id
                at = np.lexsort((active, -leap[k], reached[k]))[-1]
                back[own[k]], total[k] = active[at], total[k] + reached[k, at]
        total = np.round(total, PLACES)
        best = np.lexsort((own, -total))[:width]  # own places follow pitch, then id
        active, score = own[best], total[best]
    if not len(active):
        return []
    at = int(active[np.lexsort((active, -pitch[active], score))[-1]])
    path = []
    while at >= 0:
        path.append(at)
        at = int(back[at])
    return path[::-1]


def continuity_path(notes: DataFrame, prefer: str = "high", beat_ms: float = 500.0, width: int = BEAM, on: Sequence[str] = ("track_id",), clusters: DataFrame | None = None) -> DataFrame:
    """(*on, note_id): the notes of each key's path, one an onset cluster; ``prefer`` is high, low or center.

    ``notes`` has confidence (0 to 1); clusters hold starts within a tenth of a beat, 35 to 90 ms, of their first, or
    are given (*on, note_id, anchor_ms). A beam of ``width`` hypotheses; with a width that is never reached the path is
    the best there is. Rows without start, length, pitch or confidence take no part.
    """
    if prefer not in ("high", "low", "center"):
        raise ValueError(f"unknown preference {prefer}")
    keys = list(on)
    whole = notes.dropna(subset=["start_ms", "dur_ms", "pitch", "confidence"])
    clusters = anchor_cluster(whole, max(35.0, min(90.0, beat_ms * 0.10)), on) if clusters is None else clusters
    rows = join_keys(whole.select(*keys, "note_id", "start_ms", end_ms().alias("end_ms"), F.col("pitch").cast("double").alias("pitch"), "confidence"), clusters.select(*keys, "note_id", "anchor_ms"), [*keys, "note_id"])
    inside, order = Window.partitionBy(*keys, "anchor_ms"), Window.partitionBy(*keys).orderBy("anchor_ms")
    rows = rows.withColumns({"n": F.count("*").over(inside), "place": F.row_number().over(inside.orderBy("pitch", "note_id"))})
    rank = (F.col("place") - 1) / F.greatest(F.lit(1), F.col("n") - 1)
    register = {"high": rank, "low": 1 - rank, "center": 1 - F.abs(rank - 0.5) * 2}[prefer]
    length = F.least(F.lit(1.0), (F.col("end_ms") - F.col("start_ms")) / max(1.0, beat_ms))
    rows = rows.withColumn("emission", F.round(CONFIDENCE * F.col("confidence") + REGISTER * register + LENGTH * length, PLACES))
    sizes = rows.groupBy(*keys, "anchor_ms").agg(F.count("*").alias("n"))
    single = F.when(F.col("n") == 1, 1).otherwise(0)
    placed = sizes.withColumns({"stretch": F.sum(single).over(order), "before": F.lag("n").over(order), "after": F.lead("n").over(order)}).drop("n")
    rows = join_keys(rows, placed, [*keys, "anchor_ms"])
    # a single note ends the stretch before it and begins the next one
    ends = F.when(F.col("n") > 1, F.array("stretch")).otherwise(F.array_compact(F.array(F.when(F.col("before") > 1, F.col("stretch") - 1), F.when(F.col("after") > 1, F.col("stretch")))))
    walked = rows.withColumn("stretch", F.explode(ends))

    def solve(g: dict) -> tuple:
        pitch = g["pitch"]
        path = np.array(beam_path(g["anchor_ms"], g["start_ms"], g["end_ms"], pitch, g["emission"], beat_ms, width), np.int64)
        path = path[g["n"][path] > 1]
        return *(g[k][path] for k in keys), g["note_id"][path]

    kinds = dict(notes.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "note_id long"])
    chosen = over_groups(walked, [*keys, "stretch"], ["start_ms", "end_ms", "emission", "n"], ["anchor_ms", "pitch", "note_id"], solve, schema)
    return rows.filter("n = 1").select(*keys, "note_id").unionByName(chosen)


def guide_voices(notes: DataFrame, beat_ms: float = 500.0, width: int = BEAM, on: Sequence[str] = ("track_id",)) -> DataFrame:
    """(*on, note_id, voice): the lead, then the bass below it, the harmony between and a second lead, each a path through what the ones before leave."""
    keys = list(on)
    clusters = written(anchor_cluster(notes.dropna(subset=["start_ms", "dur_ms", "pitch", "confidence"]), max(35.0, min(90.0, beat_ms * 0.10)), on), "guide-clusters")
    path = lambda rows, prefer: written(continuity_path(rows, prefer, beat_ms, width, on, clusters), "guide-path")
    lead = path(notes, "high")
    known = join_keys(join_keys(notes, clusters.select(*keys, "note_id", "anchor_ms"), [*keys, "note_id"]), lead.withColumn("is_lead", F.lit(True)), [*keys, "note_id"], "left")
    leads = known.filter("is_lead").select(*keys, "anchor_ms", F.col("pitch").alias("lead_pitch"), F.col("confidence").alias("lead_confidence"))
    left = written(join_keys(known.filter("is_lead IS NULL").drop("is_lead"), leads, [*keys, "anchor_ms"], "left"), "guide-left")
    out, cut = lead.withColumn("voice", F.lit("lead")), [*notes.columns]
    branch = (F.col("pitch") >= F.col("lead_pitch") - AROUND) & (F.col("confidence") >= F.greatest(F.lit(LEAST_BRANCH), F.col("lead_confidence") - BRANCH_LOSS))
    for voice, prefer, fits in (("bass", "low", F.coalesce(F.col("pitch") <= F.col("lead_pitch") - BELOW, F.lit(True))), ("harmony", "center", F.lit(True)), ("second", "high", branch)):
        found = path(left.filter(fits).select(*cut), prefer)
        out = out.unionByName(found.withColumn("voice", F.lit(voice)))
        left = join_keys(left, found, [*keys, "note_id"], "left_anti")
    return out
