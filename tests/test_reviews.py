"""Reattaching reviews against a plain search over all pairs."""

import random

import pytest

from chronoweave.operators import reviews as V

SPAN = "track_id long, {}_id long, start_ms double, end_ms double"
NOTE = "track_id long, {}_id long, note_id long, pitch int, start_ms double, dur_ms double"


def overlap(old, new):
    left, right = [x for x in old if x[0] not in {y[0] for y in new}], [y for y in new if y[0] not in {x[0] for x in old}]
    n = len(old) - len(left)
    for x in sorted(left, key=lambda x: (x[2], x[0])):
        fits = []
        for y in right:
            both = max(0.0, min(x[2] + x[3], y[2] + y[3]) - max(x[2], y[2]))
            ratio = both / u if (u := max(x[2] + x[3], y[2] + y[3]) - min(x[2], y[2])) > 0 else 0.0
            if x[1] == y[1] and (ratio >= 0.35 or abs(x[2] - y[2]) <= max(35.0, 0.2 * min(x[3], y[3]))):
                fits.append((-ratio, abs(x[2] - y[2]), y[0], y))
        if fits:
            right.remove(min(fits)[3])
            n += 1
    return round(n / max(len(old), len(new)), 9) if old and new else 0.0


def plain(reviews, spans, old, new):
    used, out = set(), {}
    for t, i, a, b in sorted(reviews, key=lambda x: (str(x[0]), x[2], x[3], x[1])):
        fits = []
        for u, j, c, d in spans:
            iou = round((min(b, d) - max(a, c)) / (max(b, d) - min(a, c)), 9)
            if t == u and (u, j) not in used and iou >= 0.5 and (s := overlap([x[2:] for x in old if x[:2] == (t, i)], [x[2:] for x in new if x[:2] == (u, j)])) >= 0.6:
                fits.append((-s, -iou, j))
        if fits:
            s, iou, j = min(fits)
            used.add((t, j))
            out[t, i] = (j, -s, -iou)
        else:
            out[t, i] = (None, None, None)
    return out


def recovered(spark, reviews, spans, old, new):
    make = lambda rows, kind, name: spark.createDataFrame(rows, kind.format(name)).repartition(3)
    found = V.recover_reviews(make(reviews, SPAN, "review"), make(spans, SPAN, "span"), make(old, NOTE, "review"), make(new, NOTE, "span"))
    return {(x["track_id"], x["review_id"]): tuple(x)[2:] for x in found.collect()}


def test_time_and_notes_must_both_agree(spark):
    old = [(1, 1, 10, 60, 100.0, 200.0), (1, 1, 11, 64, 400.0, 200.0)]
    same = [(1, 5, 20, 60, 105.0, 200.0), (1, 5, 21, 64, 402.0, 190.0)]
    assert recovered(spark, [(1, 1, 0.0, 1000.0), (1, 2, 3000.0, 4000.0)], [(1, 5, 10.0, 990.0)], old, same) == {(1, 1): (5, 1.0, 0.98), (1, 2): (None, None, None)}
    assert recovered(spark, [(1, 1, 0.0, 1000.0)], [(1, 5, 0.0, 1000.0)], old, [(1, 5, 20, 72, 100.0, 200.0)]) == {(1, 1): (None, None, None)}
    assert recovered(spark, [(1, 1, 0.0, 1000.0)], [(1, 5, 600.0, 1600.0)], old, same) == {(1, 1): (None, None, None)}
    assert recovered(spark, [], [(1, 5, 0.0, 1.0)], [], same) == {}


@pytest.mark.parametrize("seed", range(3))
def test_one_to_one_against_all_pairs(spark, seed):
    r = random.Random(seed)
    reviews, spans, old, new = [], [], [], []
    for t in (None, 1):
        for i in range(25):
            a = float(r.randrange(60) * 100)
            notes = [(r.choice((60, 61, 64)), a + r.randrange(500), float(r.randrange(20, 200))) for _ in range(r.randrange(4))]
            reviews.append((t, i, a, a + r.choice((400.0, 600.0))))
            old += [(t, i, 100 * i + k, *x) for k, x in enumerate(notes)]
            for j in (2 * i, 2 * i + 1):
                if r.random() < 0.7:
                    c = a + r.choice((-100.0, 0.0, 50.0))
                    spans.append((t, j, c, c + r.choice((400.0, 600.0))))
                    new += [(t, j, 10_000 + 100 * j + k, p, s + r.choice((0, 4, 90)), d) for k, (p, s, d) in enumerate(notes) if r.random() < 0.9]
    want = plain(reviews, spans, old, new)
    assert recovered(spark, reviews, spans, old, new) == want
    assert sum(x[0] is not None for x in want.values()) > 8
