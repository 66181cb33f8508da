"""Agglomerative clustering by complete link: two clusters are as alike as their least alike members.

Similarities are computed in blocks and only pairs that could ever merge are kept, so a key takes memory for those and
not for all pairs. A merged cluster's similarity to a third is the lesser of its parts', so nothing is computed twice.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .walks import over_groups

#: Reliability of prototypes, of provisional ones and of those that stand apart, how many of these, and below which similarity they do.
RELIABLE, PROVISIONAL, APART_RELIABILITY, MOST_APART, APART = 0.34, 0.16, 0.24, 4, 0.58
#: Similarity that merges, the lower one for clusters that touch in time in one role, and the gap that still touches.
MERGE, TOUCHING, TOUCH_MS = 0.73, 0.64, 1500.0
#: What a group needs to follow a cluster: similarity, lead over the next, confidence.
FOLLOW, LEAD, CONFIDENCE = 0.60, 0.04, 0.42
MOST_CLUSTERS = 12
BLOCK = 256
PLACES = 9


def similarities(a: np.ndarray, a_sure: np.ndarray, b: np.ndarray, b_sure: np.ndarray) -> np.ndarray:
    """How alike rows of ``a`` and ``b`` are, 0 to 1: relative distances of their values, weighed by the lesser reliability."""
    x, y = a[:, None, :], b[None, :, :]
    apart = np.minimum(1.0, np.abs(x - y) / np.maximum(1.0, np.maximum(np.abs(x), np.abs(y)))) ** 2
    raw = 1.0 - np.sqrt(apart.mean(axis=2))
    return np.round(np.clip(raw * (0.70 + 0.30 * np.sqrt(np.minimum(a_sure[:, None], b_sure[None, :]))), 0.0, 1.0), PLACES)


def touching(start: np.ndarray, end: np.ndarray, role: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    gap = np.maximum(0.0, np.maximum(start[j] - end[i], start[i] - end[j]))
    return (role[i] == role[j]) & (gap <= TOUCH_MS)


def prototypes(values: np.ndarray, sure: np.ndarray, samples: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The places, in order of ``rank``, of reliable groups, and of the few others that stand apart from all chosen before."""
    usable = rank[(samples[rank] >= 1) & (sure[rank] >= PROVISIONAL)]
    firm = (samples[usable] >= 2) & (sure[usable] >= RELIABLE)
    chosen, apart = usable[firm].tolist(), 0
    for i in usable[~firm].tolist():
        if not chosen:
            chosen, apart = [i], apart + 1
        elif apart < MOST_APART and sure[i] >= APART_RELIABILITY and similarities(values[i : i + 1], sure[i : i + 1], values[chosen], sure[chosen]).max() < APART:
            chosen, apart = [*chosen, i], apart + 1
    return np.array(chosen, np.int64)


def complete_link(ids: list[str], values: np.ndarray, sure: np.ndarray, start: np.ndarray, end: np.ndarray, role: np.ndarray) -> list[list[int]]:
    """Clusters of rows: again and again the two most alike merge; of equal ones those whose ids, sorted and joined by |, come last."""
    members = {i: [i] for i in range(len(ids))}
    alike: list[dict[int, tuple[float, bool]]] = [{} for _ in ids]
    heap: list[tuple[float, int, int]] = []

    def propose(a: int, b: int) -> None:
        score, touch = alike[a][b]
        if score >= (TOUCHING if touch else MERGE):
            heapq.heappush(heap, (-score, a, b))

    for lo in range(0, len(ids), BLOCK):
        found = similarities(values[lo : lo + BLOCK], sure[lo : lo + BLOCK], values, sure)
        i, j = np.nonzero(found >= TOUCHING)
        i, j, score = i[later := i + lo < j] + lo, j[later], found[i[later], j[later]]
        for a, b, s, t in zip(i.tolist(), j.tolist(), score.tolist(), touching(start, end, role, i, j).tolist(), strict=True):
            alike[a][b] = alike[b][a] = (s, t)
            propose(a, b)
    while heap:
        ties = [heapq.heappop(heap)]
        while heap and heap[0][0] == ties[0][0]:
            ties.append(heapq.heappop(heap))
        live = [(a, b) for _, a, b in ties if a in members and b in members]
        if not live:
            continue
        named = {pair: "|".join(sorted(ids[k] for k in members[pair[0]] + members[pair[1]])) for pair in live} if len(live) > 1 else {}
        a, b = max(live, key=named.get) if named else live[0]
        for pair in live:
            if pair != (a, b):
                heapq.heappush(heap, (ties[0][0], *pair))
        new = len(alike)
        both = {c: (min(alike[a][c][0], alike[b][c][0]), alike[a][c][1] or alike[b][c][1]) for c in alike[a].keys() & alike[b].keys() if c in members}
        members[new] = members.pop(a) + members.pop(b)
        alike.append(both)
        for c, x in both.items():
            alike[c][new] = x
            propose(c, new)
    return list(members.values())


def timbre_clusters(groups: DataFrame, on: Sequence[str] = ("song",), most: int = MOST_CLUSTERS) -> DataFrame:
    """(*on, group_id, cluster, is_core, confidence) for the groups of a key that belong to a cluster, named by its smallest id.

    ``groups`` has group_id (text), features (array<double>, of one length a key), reliability, samples, members, role,
    start_ms and end_ms; rows without one of them take no part. Prototypes are clustered by complete link, the ``most``
    strongest clusters stay, and other groups follow the cluster of their most similar prototype if it is alike enough
    and leads clearly. A key is one group, in memory that follows its pairs alike enough to merge.
    """

    def solve(g: dict) -> tuple:
        ids, sure, samples, size = list(map(str, g["group_id"])), g["reliability"].astype(float), g["samples"].astype(int), g["members"].astype(int)
        values, start, end, role = np.stack(g["features"]).astype(float), g["start_ms"].astype(float), g["end_ms"].astype(float), g["role"].astype(str)
        rank = np.array(sorted(range(len(ids)), key=lambda i: (samples[i], sure[i], size[i], -start[i], ids[i]), reverse=True), np.int64)
        seeds = prototypes(values, sure, samples, rank)
        clusters = [seeds[c] for c in complete_link([ids[i] for i in seeds], values[seeds], sure[seeds], start[seeds], end[seeds], role[seeds])]
        clusters.sort(key=lambda c: (size[c].sum(), samples[c].sum(), round(float(sure[c].sum()), PLACES), -start[c].min(), min(ids[i] for i in c)), reverse=True)
        clusters = clusters[:most]
        out = []
        for c in clusters:
            cohesion = min((similarities(values[c], sure[c], values[c], sure[c]) + 2 * np.eye(len(c))).min(), 1.0) if len(c) > 1 else 1.0
            out += [(i, min(ids[k] for k in c), True, round(float(sure[c].mean() * cohesion), 6)) for i in c]
        rest = np.setdiff1d(np.arange(len(ids)), np.concatenate(clusters)) if clusters else np.zeros(0, np.int64)
        for lo in range(0, len(rest), BLOCK):
            own = rest[lo : lo + BLOCK]
            score = np.stack([similarities(values[own], sure[own], values[c], sure[c]).max(axis=1) for c in clusters], axis=1)
            order = np.argsort(-score, axis=1, kind="stable")
            best = score[np.arange(len(own)), order[:, 0]]
            second = score[np.arange(len(own)), order[:, 1]] if len(clusters) > 1 else np.zeros(len(own))
            confidence = best * (0.65 + 0.35 * np.sqrt(np.maximum(0.0, sure[own])))
            for k in np.flatnonzero((best >= FOLLOW) & (np.round(best - second, PLACES) >= LEAD) & (confidence >= CONFIDENCE)):
                out.append((own[k], min(ids[x] for x in clusters[order[k, 0]]), False, round(float(confidence[k]), 6)))
        at = np.array([x[0] for x in out], np.int64)
        return *(g[k][at] for k in on), np.array(ids, object)[at], np.array([x[1] for x in out], object), np.array([x[2] for x in out], bool), np.array([x[3] for x in out], float)

    kinds = dict(groups.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in on), "group_id string, cluster string, is_core boolean, confidence double"])
    rows = groups.withColumn("group_id", F.col("group_id").cast("string"))
    return over_groups(rows, on, ["features", "reliability", "samples", "members", "role", "start_ms", "end_ms"], ["group_id"], solve, schema)
