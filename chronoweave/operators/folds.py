"""Order-dependent folds over a key's rows.

Keys are cut at gaps first: where the distance to everything before is larger than the fold's reach, its state starts
anew, so the fold runs over (key, island) and a hot key is many small groups.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .projections import end_ms
from .runs import islands
from .walks import over_groups


def anchor_cluster(notes: DataFrame, tol: float = 12.0, on: Sequence[str] = ("track_id",)) -> DataFrame:
    """(*on, note_id, anchor_ms): a note joins the current cluster if it starts within ``tol`` of the cluster's FIRST start.

    An island without gaps is walked once in order, batch by batch; each step jumps to the end of its cluster.
    """
    def solve(g: dict) -> tuple:
        start = g["start_ms"]
        anchor, i = np.empty(len(start)), 0
        while i < len(start):
            j = i + 1
            while j < len(start) and start[j] - start[i] <= tol:
                j += 1
            anchor[i:j] = start[i]
            i = j
        return *(g[k] for k in on), g["note_id"], anchor

    types = dict(notes.dtypes)
    schema = ", ".join([*(f"{k} {types[k]}" for k in on), "note_id long, anchor_ms double"])
    return over_groups(islands(notes, on, tol), [*on, "island"], [], ["start_ms", "note_id"], solve, schema)


def fold_same_pitch(notes: DataFrame, tol: float = 80.0, ratio: float = 0.75, on: Sequence[str] = ("track_id", "pitch")) -> DataFrame:
    """(*on, note_id, start_ms, end_ms, members): chained clusters of same-pitch notes.

    A note joins if it starts within ``tol`` of the cluster's first start and overlaps what the cluster spans by
    ``ratio`` of the shorter; the span grows. The loudest member, first of ties, gives its id. One walk an island.
    """
    def solve(g: dict) -> tuple:
        start, end, vel, ids = g["start_ms"], g["end_ms"], g["vel"], g["note_id"]
        out: list[list] = []  # place of the first, end, place of the loudest, members
        for i in range(len(start)):
            if out:
                first, reach, loud, _ = now = out[-1]
                both = min(reach, end[i]) - max(start[first], start[i])
                if start[i] - start[first] <= tol and both >= ratio * min(reach - start[first], end[i] - start[i]):
                    now[1], now[2], now[3] = max(reach, end[i]), i if vel[i] > vel[loud] else loud, now[3] + 1
                    continue
            out.append([i, end[i], i, 1])
        first, reach, loud, members = (np.array(x) for x in zip(*out, strict=True))
        return *(g[k][first] for k in on), ids[loud], start[first], reach, members

    types = dict(notes.dtypes)
    schema = ", ".join([*(f"{k} {types[k]}" for k in on), "note_id long, start_ms double, end_ms double, members int"])
    return over_groups(islands(notes.withColumn("end_ms", end_ms()), on, tol), [*on, "island"], ["end_ms", "vel"], ["start_ms", "note_id"], solve, schema)
