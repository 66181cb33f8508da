"""Greedy and dynamic-programming decoders over ordered groups.

Rows are dealt by (key, island) and sorted; each task walks through its groups batch by batch, so thousands of small
groups cost one pass. Keys are cut into islands where nothing can interact across a gap, so a hot key is spread over
tasks; only rows that depend on each other without any gap stay together.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .folds import anchor_cluster, islands
from .projections import end_ms
from .runs import carried
from .walks import join_keys, over_groups


def nms(events: DataFrame, near: float = 20.0, overlap: float = 0.85) -> DataFrame:
    """(note_id, kept_by): greedy same-pitch suppression by confidence.

    In order of falling confidence, length, then start and id, an event that no survivor suppresses survives. A survivor
    suppresses events that start within ``near`` and share ``overlap`` of the longer's length. ``kept_by`` is the
    survivor's id, its own for a survivor, so what a survivor absorbed is a group of it. Only events that start within
    ``near`` can meet: those without such a neighbour survive at once, without Python, and among the rest each survivor
    looks at that window of the sorted starts, not at its whole island. Events that lack a value take no part.
    """

    def solve(g: dict) -> tuple:
        start, d, ids = g["start_ms"], g["dur_ms"], g["note_id"]  # in order of start
        end, owner = start + d, np.full(len(start), -1, np.int64)
        first, last = np.searchsorted(start, start - near, side="left"), np.searchsorted(start, start + near, side="right")
        for i in np.lexsort((ids, start, -d, -g["confidence"])):
            if owner[i] < 0:
                w = slice(first[i], last[i])
                both = np.minimum(end[w], end[i]) - np.maximum(start[w], start[i])
                hit = (owner[w] < 0) & (both >= overlap * np.maximum(d[w], d[i]))
                owner[w][hit] = ids[i]
                owner[i] = ids[i]
        return ids, owner

    w = Window.partitionBy("track_id", "pitch").orderBy("start_ms", "note_id")
    far = lambda gap: F.coalesce(gap > near, F.lit(True))
    sound = events.select("track_id", "pitch", "note_id", "start_ms", "dur_ms", "confidence").dropna(subset=["start_ms", "dur_ms", "confidence"])
    alone = far(F.col("start_ms") - F.lag("start_ms").over(w)) & far(F.lead("start_ms").over(w) - F.col("start_ms"))
    marked = sound.withColumn("alone", alone)
    walked = over_groups(islands(marked.filter("NOT alone"), ["track_id", "pitch"], near), ["track_id", "pitch", "island"], ["dur_ms", "confidence"], ["start_ms", "note_id"], solve, "note_id long, kept_by long")
    return walked.unionByName(marked.filter("alone").select("note_id", F.col("note_id").alias("kept_by")))


def note_matching(a: DataFrame, b: DataFrame, tol: float = 50.0) -> DataFrame:
    """(note_id_a, note_id_b): a maximum matching of equal pitches within ``tol``.

    On a line, giving each note in time order the earliest free partner makes as many pairs as any matching.
    """
    both = a.select("pitch", "start_ms", "note_id", F.lit(0).alias("side")).unionByName(b.select("pitch", "start_ms", "note_id", F.lit(1).alias("side")))

    def solve(g: dict) -> tuple:
        x, y = np.flatnonzero(g["side"] == 0), np.flatnonzero(g["side"] == 1)
        xs, ys = g["start_ms"][x], g["start_ms"][y]
        pairs, j = [], 0
        for i in range(len(xs)):
            while j < len(ys) and ys[j] < xs[i] - tol:
                j += 1
            if j < len(ys) and ys[j] <= xs[i] + tol:
                pairs.append((i, j))
                j += 1
        at = np.array(pairs, np.int64).reshape(-1, 2)
        return g["note_id"][x[at[:, 0]]], g["note_id"][y[at[:, 1]]]

    return over_groups(islands(both, ["pitch"], tol), ["pitch", "island"], ["side"], ["start_ms", "note_id"], solve, "note_id_a long, note_id_b long")


def voice_tracking(notes: DataFrame, gap: float = 600.0, beat: float = 500.0, tol: float = 12.0, most_cost: float = 2.0) -> DataFrame:
    """(note_id, voice): onset clusters assigned to voices by globally cheapest pairs; a voice idle for more than ``gap`` ends.

    The cost of going on is the pitch step in octaves and the silence, or overlap, in beats. A voice has the id of its first note.
    """

    def solve(g: dict) -> tuple:
        start, end, pitch, ids = g["start_ms"], g["end_ms"], g["pitch"], g["note_id"]
        voices: list[list] = []  # end, pitch, name
        out, i = np.zeros(len(ids), np.int64), 0
        while i < len(ids):
            j = i + int(np.searchsorted(start[i:], start[i] + tol, side="right"))
            voices = [v for v in voices if start[i] - v[0] <= gap]
            costs = sorted((abs(int(pitch[m]) - v[1]) / 12 + abs(start[m] - v[0]) / beat, m, k) for m in range(i, j) for k, v in enumerate(voices))
            taken, used = {}, set()
            for c, m, k in costs:
                if m not in taken and k not in used and c <= most_cost:
                    taken[m] = k
                    used.add(k)
            for m in range(i, j):
                if m in taken:
                    v = voices[taken[m]]
                    v[0], v[1] = max(v[0], end[m]), int(pitch[m])
                else:
                    v = [end[m], int(pitch[m]), ids[m]]
                    voices.append(v)
                out[m] = v[2]
            i = j
        return ids, out

    w = Window.partitionBy("track_id").orderBy("start_ms", "note_id")
    reached = F.max(end_ms()).over(w.rowsBetween(Window.unboundedPreceding, -1))
    cut = notes.withColumns({"end_ms": end_ms(), "__f": F.when(F.col("start_ms") - reached <= gap, 0).otherwise(1)}).withColumn("phrase", F.sum("__f").over(w))
    return over_groups(cut, ["track_id", "phrase"], ["end_ms", "pitch"], ["start_ms", "note_id"], solve, "note_id long, voice long")


def viterbi(beats: DataFrame, states: int, switch: float = 0.11) -> DataFrame:
    """(track_id, beat, state): the best path through ``scores`` (an array of ``states`` a beat); a switch costs, ties favour staying, then the lower state.

    Switching goes by way of the best state so far, so a step costs as much as there are states. Beats of a track are
    one group: state flows through all of them.
    """

    def solve(g: dict) -> tuple:
        score = np.stack(g["scores"]).astype(float)[:, :states]
        best, back = score[0].copy(), np.zeros(score.shape, np.int64)
        for t in range(1, len(score)):
            top = int(best.argmax())
            stay = best >= best[top] - switch
            back[t] = np.where(stay, np.arange(states), top)
            best = np.where(stay, best, best[top] - switch) + score[t]
        path = [int(best.argmax())]
        for t in range(len(score) - 1, 0, -1):
            path.append(int(back[t][path[-1]]))
        return g["track_id"], g["beat"], np.array(path[::-1], np.int32)

    return over_groups(beats, ["track_id"], ["scores"], ["beat"], solve, "track_id long, beat long, state int")


def event_pairing(events: DataFrame, dangling: float = 100.0) -> DataFrame:
    """(channel, pitch, vel, start_ms, dur_ms) from on and off events (channel, pitch, at_ms, seq, on, vel).

    The next event of the key ends a note, a re-strike too; one without an end lasts ``dangling``.
    """
    following = F.lead("at_ms").over(Window.partitionBy("channel", "pitch").orderBy("at_ms", "seq"))
    return events.withColumn("next", following).filter("on").select("channel", "pitch", "vel", F.col("at_ms").alias("start_ms"), F.coalesce(F.col("next") - F.col("at_ms"), F.lit(dangling)).alias("dur_ms"))


def event_pairing_sustained(events: DataFrame, dangling: float = 100.0) -> DataFrame:
    """(channel, pitch, vel, start_ms, dur_ms) from events (channel, pitch, at_ms, seq, kind, vel) of kinds on, off, down and up.

    The first event of its key after an on ends a note; an off while the channel's pedal is down only holds it, until
    the pedal goes up or the key is struck again. Notes without an end last ``dangling``, those without length go.
    Pedal state runs over a channel both ways, the rest over its keys. What comes later is read from the other end:
    Spark computes a frame that ends in unbounded following anew for each row.
    """
    keys = ["channel", "pitch"]
    key, back = Window.partitionBy(*keys).orderBy("at_ms", "seq"), Window.partitionBy(*keys).orderBy(F.desc("at_ms"), F.desc("seq"))
    moved = events.withColumns({"__down": F.when(F.col("kind").isin("down", "up"), F.col("kind") == "down"), "__up": F.when(F.col("kind") == "up", F.col("at_ms")), "__turned": -F.col("seq")})
    held = carried(moved, ["channel"], "at_ms", ("seq",), "__down", "down")
    seen = carried(held, ["channel"], "at_ms", ("__turned",), "__up", after="next_up").withColumn("down", F.coalesce("down", F.lit(False))).filter(F.col("kind").isin("on", "off"))
    held_to = F.least("next_up", F.last(F.when(F.col("kind") == "on", F.col("at_ms")), ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1)))
    own_end = F.when((F.col("kind") == "on") | ~F.col("down"), F.col("at_ms")).otherwise(held_to)
    ends = seen.withColumn("own_end", own_end).withColumns({"end": F.lead("own_end").over(key)})
    notes = ends.filter("kind = 'on'").select("channel", "pitch", "vel", F.col("at_ms").alias("start_ms"), F.coalesce(F.col("end") - F.col("at_ms"), F.lit(dangling)).alias("dur_ms"))
    return notes.filter("dur_ms > 0")


#: Fixed values of the signature that offsets are drawn from.
SIGNATURE = {"track": 1000003, "tenths": 9176, "pitches": 131, "members": 37, "velocity": 0x5BD1E995}
DRAW = (1103515245, 12345)


def humanize_groups(notes: DataFrame, beat: float = 500.0, gap: float = 420.0, timing: float = 12.0, least_vel: int = 1, most_vel: int = 127) -> DataFrame:
    """(note_id, start_ms, vel): each onset group moves as one by a reproducible offset and velocity step, drawn from an integer signature.

    Strong beats and ends of phrases move less. A group stays a millisecond behind the place of the one before and
    ahead of the next one's anchor: counted from its number in the track, its place is the one before, clamped between
    two bounds of its own. The bounds are expressions; only the clamps run over a track.
    """
    clusters = join_keys(anchor_cluster(notes), notes, ["track_id", "note_id"])
    groups = clusters.groupBy("track_id", "anchor_ms").agg(F.sum("pitch").alias("pitches"), F.count("*").alias("n"), F.max(end_ms()).alias("end_ms"))
    order = Window.partitionBy("track_id").orderBy("anchor_ms")
    known = groups.withColumns({"next": F.lead("anchor_ms").over(order), "number": F.row_number().over(order).cast("double")})
    phase = F.col("anchor_ms") % beat
    strong = F.least(phase, F.abs(beat - phase)) <= 18.0
    ends = F.col("next").isNull() | (F.col("next") - F.col("end_ms") >= gap)
    signature = F.pmod(F.col("track_id") + 1, F.lit(1 << 31)) * SIGNATURE["track"] + S.half_even(F.col("anchor_ms") * 10).cast("long") * SIGNATURE["tenths"] + F.col("pitches") * SIGNATURE["pitches"] + F.col("n") * SIGNATURE["members"]

    def unit(x: Column) -> Column:
        return F.shiftright(x * DRAW[0] + DRAW[1], 16).bitwiseAND(F.lit(0x7FFF)) / 16383.5 - 1.0

    known = known.withColumn("signature", F.coalesce(signature, F.lit(0)).bitwiseAND(F.lit(0x7FFFFFFF)))
    offset = F.round(unit(F.col("signature")) * F.least(F.lit(timing), F.when(strong, 3.0).when(ends, 4.0).otherwise(12.0)), 3)
    delta = S.half_even(unit(F.col("signature").bitwiseXOR(F.lit(SIGNATURE["velocity"]))) * F.when(strong | ends, 2).otherwise(6)).cast("int")
    high = F.coalesce(F.col("next") - 1, F.lit(float("inf")))
    stuck = high < 0  # no room ahead of the next: the group stays
    bounds = known.withColumns({
        "low": F.when(stuck, F.col("anchor_ms")).otherwise(F.greatest(F.lit(0.0), F.col("anchor_ms") + offset)) - F.col("number"),
        "high": F.when(stuck, F.col("anchor_ms")).otherwise(high) - F.col("number"),
        "delta": delta,
    })

    def solve(g: dict) -> tuple:
        clamped = accumulate(zip(g["low"].tolist(), g["high"].tolist(), strict=True), lambda at, own: min(own[1], max(own[0], at)), initial=float("-inf"))
        return g["track_id"], g["anchor_ms"], np.array(list(clamped)[1:]) + g["number"] - g["anchor_ms"], g["delta"]

    moved = over_groups(bounds, ["track_id"], ["low", "high", "number", "delta"], ["anchor_ms"], solve, "track_id long, anchor_ms double, moved double, delta int")
    out = join_keys(clusters, moved, ["track_id", "anchor_ms"])
    return out.select("note_id", F.greatest(F.lit(0.0), F.col("start_ms") + F.col("moved")).alias("start_ms"), F.least(F.greatest(F.col("vel") + F.col("delta"), F.lit(least_vel)), F.lit(most_vel)).alias("vel"))


def melodic_lines(notes: DataFrame, gap: float = 420.0, early: float = 600.0, leap: int = 12) -> DataFrame:
    """(note_id, line) for notes that sound alone in their onset cluster: each follows the note nearest in pitch and time that nothing follows yet.

    A note may be followed while it began within ``gap`` of the latest but one, from ``early`` before its end to
    ``gap`` after it, within ``leap`` in pitch; of equal choices the line that began first goes on. A line is named by
    its first note. Chords and silences longer than ``gap`` end all lines and cut a track, so it is walked in parts.
    """
    clusters = join_keys(anchor_cluster(notes), notes, ["track_id", "note_id"])
    size = Window.partitionBy("track_id", "anchor_ms")
    w = Window.partitionBy("track_id").orderBy("anchor_ms", "note_id")
    sized = clusters.withColumn("n", F.count("*").over(size))
    reached = F.max(end_ms()).over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when((F.col("n") > 1) | F.coalesce(F.col("start_ms") - reached > gap, F.lit(True)), 1).otherwise(0)
    parts = sized.withColumn("part", F.sum(fresh).over(w)).filter("n = 1").withColumn("end_ms", end_ms())

    def solve(g: dict) -> tuple:
        start, end, pitch = g["start_ms"], g["end_ms"], g["pitch"].astype(float)
        since = np.searchsorted(start, np.r_[start[:1], start[:-1]] - gap)  # the first that may be followed
        root, free = np.arange(len(start)), np.ones(len(start), bool)
        for i in range(1, len(start)):
            w = np.arange(since[i], i)
            pause, step = start[i] - end[w], np.abs(pitch[i] - pitch[w])
            w = w[fits := free[w] & (pause >= -early) & (pause <= gap) & (step <= leap)]
            if len(w):
                before = w[np.lexsort((root[w], (step * 20 + np.abs(pause))[fits]))[0]]
                root[i], free[before] = root[before], False
        return g["note_id"], g["note_id"][root]

    return over_groups(parts, ["track_id", "part"], ["end_ms", "pitch"], ["start_ms", "note_id"], solve, "note_id long, line long")


def merge_gaps(events: DataFrame, most: float = 20.0) -> DataFrame:
    """(track_id, pitch, start_ms, end_ms, n): same-pitch notes joined while the next starts within ``most`` of the latest end."""
    w = Window.partitionBy("track_id", "pitch").orderBy("start_ms", "note_id")
    reached = F.max(end_ms()).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = events.withColumn("__f", F.when(F.col("start_ms") - reached <= most, 0).otherwise(1)).withColumn("run", F.sum("__f").over(w))
    return marked.groupBy("track_id", "pitch", "run").agg(F.min("start_ms").alias("start_ms"), F.max(end_ms()).alias("end_ms"), F.count("*").alias("n")).drop("run")


def instance_limit(notes: DataFrame, most: int = 2, release: float = 30.0) -> DataFrame:
    """(note_id, end_ms, cut): at most ``most`` notes of a track and pitch sound at once; a new one cuts the oldest, which ends within ``release``."""

    def solve(g: dict) -> tuple:
        end, start = g["end_ms"].copy(), g["start_ms"]
        cut, live = np.zeros(len(end), bool), []
        for i in range(len(end)):
            live = [k for k in live if end[k] > start[i]]
            while len(live) >= most:
                k = live.pop(0)
                end[k], cut[k] = min(end[k], start[i] + release), True
            live.append(i)
        return g["note_id"], end, cut

    w = Window.partitionBy("track_id", "pitch").orderBy("start_ms", "note_id")
    reached = F.max(end_ms()).over(w.rowsBetween(Window.unboundedPreceding, -1))
    runs = notes.withColumns({"end_ms": end_ms(), "__f": F.when(F.col("start_ms") < reached, 0).otherwise(1)}).withColumn("run", F.sum("__f").over(w))
    return over_groups(runs, ["track_id", "pitch", "run"], ["end_ms"], ["start_ms", "note_id"], solve, "note_id long, end_ms double, cut boolean")


def instance_plan(notes: DataFrame, release: float = 30.0, on: Sequence[str] = ("group_id", "scope_id")) -> DataFrame:
    """(note_id, accepted, end_ms, cut): what sounds of each note where the notes of a key share a limit.

    ``notes`` has ``most`` (a null or a limit of 0 or less is none) and ``newest``: a note over the limit is refused if
    ``newest`` holds, else it takes the place of the oldest, which ends within ``release`` and no longer counts. Notes
    come by start, then id; one without group has no limit. A key is cut where nothing sounds.
    """
    limited = F.coalesce(F.col("most") > 0, F.lit(False)) & F.col(on[0]).isNotNull()
    sound = notes.dropna(subset=["start_ms", "dur_ms"]).withColumn("end_ms", F.col("start_ms") + F.greatest(F.lit(0.0), F.col("dur_ms")))
    free = sound.filter(~limited).select("note_id", F.lit(True).alias("accepted"), "end_ms", F.lit(False).alias("cut"))
    w = Window.partitionBy(*on).orderBy("start_ms", "note_id")
    reached = F.max("end_ms").over(w.rowsBetween(Window.unboundedPreceding, -1))
    parts = sound.filter(limited).withColumn("fresh", F.when(F.col("start_ms") < reached, 0).otherwise(1)).withColumn("part", F.sum("fresh").over(w))

    def solve(g: dict) -> tuple:
        start, end, most = g["start_ms"], g["end_ms"].copy(), g["most"]
        accepted, cut, live = np.ones(len(start), bool), np.zeros(len(start), bool), []
        for i in range(len(start)):
            live = [k for k in live if end[k] > start[i]]
            over = len(live) - int(most[i]) + 1
            if over > 0 and g["newest"][i]:
                accepted[i], end[i] = False, start[i]
                continue
            for k in live[: max(0, over)]:  # in order of start
                if start[i] + release < end[k]:
                    end[k], cut[k] = start[i] + release, True
            live = [*live[max(0, over) :], i]
        return g["note_id"], accepted, end, cut

    walked = over_groups(parts.withColumn("newest", F.coalesce("newest", F.lit(False))), [*on, "part"], ["end_ms", "most", "newest"], ["start_ms", "note_id"], solve, "note_id long, accepted boolean, end_ms double, cut boolean")
    return free.unionByName(walked)
