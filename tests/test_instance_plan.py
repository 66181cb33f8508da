"""Limits of instances against a plain walk."""

import random

import pytest

from chronoweave.operators import sequential

NOTES = "note_id long, group_id long, scope_id int, start_ms double, dur_ms double, most int, newest boolean"


@pytest.mark.parametrize("release", [0.0, 15.0])
def test_limits_against_a_plain_walk(spark, release):
    r = random.Random(int(release))
    limits = {None: (2, False), 1: (2, False), 2: (1, True), 3: (0, False), 4: (3, None), 5: (None, True)}
    rows = [((1 << 53) + 1 + i, g := r.choice(list(limits)), r.choice((None, 0, 1)), float(r.randrange(1500)), float(r.randrange(0, 200)), *limits[g]) for i in range(400)]
    got = {x["note_id"]: tuple(x)[1:] for x in sequential.instance_plan(spark.createDataFrame(rows, NOTES).repartition(4), release).collect()}
    want = {}
    for key in {x[1:3] for x in rows}:
        active = []
        for x in sorted((x for x in rows if x[1:3] == key), key=lambda x: (x[3], x[0])):
            want[x[0]] = [True, x[3] + x[4], False]
            most, newest = x[5:]
            if key[0] is None or not most or most <= 0:
                continue
            active = [i for i in active if want[i][1] > x[3]]
            if len(active) >= most and newest:
                want[x[0]] = [False, x[3], False]
                continue
            while len(active) >= most:
                first = want[active.pop(0)]
                if x[3] + release < first[1]:
                    first[1:] = [x[3] + release, True]
            active.append(x[0])
    assert got == {i: tuple(x) for i, x in want.items()}
    assert sum(x[2] for x in want.values()) > 20 and sum(not x[0] for x in want.values()) > 10
    assert sequential.instance_plan(spark.createDataFrame([], NOTES)).count() == 0
