"""Decoding of note boundaries: each note of a pitch's path is kept, merged into the one before, or suppressed.

What a row may be, and how well, are expressions over its own columns. Only one pair of neighbouring choices is
forbidden, so a path falls apart wherever that pair can't arise: a row alone takes its best choice in the JVM, and only
runs of rows that hang together are walked.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .walks import over_groups

#: Limits of what may be merged or suppressed, and by how much that must beat keeping.
MARGIN, MERGE_SCORE, SUPPRESS_SCORE = 0.08, 0.62, 0.68
MERGE_GAP, MERGE_CONTINUITY, MERGE_ONSET = (-0.05, 0.125), 0.55, 0.48
SUPPRESS_CONFIDENCE, SUPPRESS_ONSET, SUPPRESS_LENGTH, SUPPRESS_OFF_GRID, SUPPRESS_CONTINUITY = 0.35, 0.30, 0.125, 0.10, 0.20
CHORD, GRID = 0.01, 0.125
#: Base and weights of the scores.
FIRST = (0.40, {"confidence": 0.25, "onset": 0.15, "contour": 0.10, "support": 0.05, "grid_fit": 0.05})
AGAIN = (0.35, {"onset": 0.25, "confidence": 0.15, "interval_fit": 0.10, "grid_fit": 0.08, "chord": 0.04, "voice": 0.03, "repeat": 0.08})
MERGE = (0.05, {"continuity": 0.32, "no_onset": 0.18, "contour": 0.15, "interval_fit": 0.12, "gap_fit": 0.08, "confidence": 0.10, "chord": -0.18, "repeat": -0.30})
SUPPRESS = (0.02, {"no_confidence": 0.24, "no_onset": 0.22, "no_contour": 0.16, "off_grid": 0.16, "shortness": 0.12, "no_voice": 0.08, "chord": -0.20})
#: The choices, in the order of ties.
KEEP, MERGED, SUPPRESSED = 0, 1, 2
#: Scores are rounded to so many places before they are compared.
PLACES = 9


def _blend(spec: tuple, terms: dict[str, Column]) -> Column:
    total = F.lit(spec[0])
    for name, weight in spec[1].items():
        total = total + F.lit(weight) * terms[name]
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), total)), PLACES)


def rhythm_choices(rows: DataFrame) -> DataFrame:
    """``rows`` with ``keep``, ``merge`` and ``suppress``: the score of each choice, null where it isn't open.

    Columns: confidence, beats (length), grid_distance (beats), onset, continuity, contour, chord, voice, interval_fit
    (all 0 to 1), gap (beats from the note before; null for the first of a path) and repeat (boolean). A missing value
    counts as 0, but a row without gap is a first one.
    """
    own = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("confidence", "beats", "grid_distance", "onset", "continuity", "contour", "chord", "voice", "interval_fit")}
    repeat, gap = F.coalesce(F.col("repeat"), F.lit(False)), F.col("gap")
    none = F.lit(0.0)
    terms = own | {
        "repeat": F.when(repeat, 1.0).otherwise(0.0), "support": F.greatest(own["chord"], own["voice"]), "grid_fit": F.greatest(none, 1 - own["grid_distance"] / GRID), "off_grid": F.least(F.lit(1.0), own["grid_distance"] / GRID),
        "gap_fit": F.greatest(none, 1 - F.greatest(none, F.coalesce(gap, none)) / GRID), "shortness": F.greatest(none, 1 - own["beats"] / GRID),
        **{f"no_{c}": 1 - own[c] for c in ("confidence", "onset", "contour", "voice")},
    }
    keep = F.when(gap.isNull(), _blend(FIRST, terms)).otherwise(_blend(AGAIN, terms))
    merge, suppress = _blend(MERGE, terms), _blend(SUPPRESS, terms)
    scored = rows.withColumns({"keep": keep, "__merge": merge, "__suppress": suppress})
    beats = lambda c: F.round(F.col(c) - F.col("keep") - MARGIN, PLACES) >= 0
    may_merge = gap.between(*MERGE_GAP) & (own["continuity"] >= MERGE_CONTINUITY) & (own["onset"] <= MERGE_ONSET) & (own["chord"] <= CHORD) & ~repeat & (F.col("__merge") >= MERGE_SCORE) & beats("__merge")
    may_suppress = (
        (own["confidence"] <= SUPPRESS_CONFIDENCE) & (own["onset"] <= SUPPRESS_ONSET) & (own["beats"] <= SUPPRESS_LENGTH) & (own["grid_distance"] >= SUPPRESS_OFF_GRID)
        & (own["chord"] <= CHORD) & (own["voice"] <= SUPPRESS_CONTINUITY) & (F.col("__suppress") >= SUPPRESS_SCORE) & beats("__suppress")
    )
    return scored.withColumns({"merge": F.when(may_merge, F.col("__merge")), "suppress": F.when(may_suppress, F.col("__suppress"))}).drop("__merge", "__suppress")


def best_path(keep: np.ndarray, merge: np.ndarray, suppress: np.ndarray) -> np.ndarray:
    """The choice of each row of a run on its path of greatest sum; nothing merges into a suppressed row. Ties go to keeping, then merging, from the end on."""
    scores = np.stack([keep, merge, suppress], axis=1)
    scores[np.isnan(scores)] = -np.inf
    total, back = scores[0], np.zeros((len(scores), 3), np.int64)
    for i in range(1, len(scores)):
        before = np.stack([total, [total[KEEP], total[MERGED], -np.inf], total])
        back[i] = before.argmax(axis=1)  # the first of equal ones
        total = np.round(scores[i] + before[[0, 1, 2], back[i]], PLACES)
    path = [int(total.argmax())]
    for i in range(len(scores) - 1, 0, -1):
        path.append(int(back[i][path[-1]]))
    return np.array(path[::-1], np.int32)


def rhythm_decode(rows: DataFrame, on: Sequence[str] = ("track_id", "pitch"), order: Sequence[str] = ("start_ms", "note_id")) -> DataFrame:
    """(*on, note_id, state, score, confidence): the path of greatest sum over each key's rows in ``order``, as rhythm_choices scores them.

    States are KEEP_SINGLE (the first of a path), KEEP_REATTACK, MERGE_CONTINUATION and SUPPRESS_EXTRA; a suppressed
    row is never continued. ``confidence`` grows with the lead over keeping, from 0.5 to 0.95.
    """
    w = Window.partitionBy(*on).orderBy(*order)
    tied = F.lag("suppress").over(w).isNotNull() & F.col("merge").isNotNull()  # the forbidden pair can arise
    marked = rhythm_choices(rows).withColumns({"__tied": tied, "__next": F.lead(F.col("merge").isNotNull(), 1, False).over(w) & F.col("suppress").isNotNull()})
    alone = marked.filter(~F.col("__tied") & ~F.col("__next"))
    best = F.greatest("keep", "merge", "suppress")
    chosen = F.when(F.col("keep") == best, KEEP).when(F.col("merge") == best, MERGED).otherwise(SUPPRESSED)
    fields = [*on, "note_id", "keep", "merge", "suppress", "gap"]
    decided = alone.select(*fields, chosen.alias("choice"))
    kinds = dict(rows.dtypes)
    linked = marked.filter("__tied OR __next").withColumn("__run", F.sum(F.when(F.col("__tied"), 0).otherwise(1)).over(w))

    def solve(g: dict) -> tuple:
        return *(g[k] for k in on), g["note_id"], *(g[c] for c in ("keep", "merge", "suppress", "gap")), best_path(g["keep"].astype(float), g["merge"].astype(float), g["suppress"].astype(float))

    schema = ", ".join([*(f"{k} {kinds[k]}" for k in on), "note_id long, keep double, merge double, suppress double, gap double, choice int"])
    walked = over_groups(linked.withColumn("gap", F.col("gap").cast("double")), [*on, "__run"], ["keep", "merge", "suppress", "gap"], list(order), solve, schema, nullable=["merge", "suppress", "gap"])
    done = decided.withColumn("gap", F.col("gap").cast("double")).unionByName(walked)
    state = F.when(F.col("choice") == MERGED, "MERGE_CONTINUATION").when(F.col("choice") == SUPPRESSED, "SUPPRESS_EXTRA").when(F.col("gap").isNull(), "KEEP_SINGLE").otherwise("KEEP_REATTACK")
    score = F.when(F.col("choice") == MERGED, F.col("merge")).when(F.col("choice") == SUPPRESSED, F.col("suppress")).otherwise(F.col("keep"))
    lead = score - F.when(F.col("choice") == KEEP, 0.0).otherwise(F.col("keep"))
    return done.select(*on, "note_id", state.alias("state"), score.alias("score"), F.round(F.least(F.lit(0.95), F.greatest(F.lit(0.5), 0.5 + F.greatest(F.lit(0.0), lead) * 0.75)), 6).alias("confidence"))
