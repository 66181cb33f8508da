import hashlib
import itertools
import random
import re
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from chronoweave.llm import common
from chronoweave.llm import conversation_repair as C

BLANK = re.compile(r"[^\x20\x09-\x0D]")


def faults(rows):
    out, seen = [], set()
    for _, role, text in rows:
        said = BLANK.findall(text)
        out.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def brute_repair(rows):
    """(cost, audit, repaired) by trying every edit of every row with up to two inserts before each and at the end."""
    fault = faults(rows)
    choices = [("D",) if f in ("blank", "duplicate") else ("D", "K", "R") for f in fault]
    best = None
    for inserts in itertools.product(range(3), repeat=len(rows) + 1):
        for edits in itertools.product(*choices):
            cost = 5 * sum(inserts) + sum({"D": 2, "K": 0, "R": 1}[e] + 5 * (e != "D" and f == "truncated") for e, f in zip(edits, fault, strict=True))
            audit = "".join("I" * n + e for n, e in zip(inserts, (*edits, ""), strict=True))
            if best and (cost, audit) >= best[:2]:
                continue
            free = ["user", "assistant"]
            slots = [([("I", r) for r in free] if a == "I" else [("R", r) for r in free] if a == "R" else [(a, None)]) for a in audit]
            for filled in itertools.product(*slots):
                it, out = iter(rows), []
                for a, role in filled:
                    if a == "I":
                        out.append((role, ""))
                        continue
                    _, own, text = next(it)
                    if a != "D":
                        out.append((role or own, text))
                if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in out)):
                    best = (cost, audit, out)
                    break
    return best


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        said = lambda x: " " if x is None else str(x)
        kind, role, text = crc32(f"{said(conv)}:{said(turn)}".encode()) % 20, said(role), said(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def row_of(conv, rows, solve):
    rows = sorted(((t, r, x) for c, t, r, x in rows if c == conv), key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
    fault = faults(rows)
    turns = {t for t, _, _ in rows if t is not None}
    initials = [r[:1] for _, r, _ in rows]
    cost, audit, out = solve(rows)
    text = "\n".join(f"{r}:{x}" for r, x in out)
    return (conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(fault.count(k) for k in ("blank", "duplicate", "truncated")), sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)), cost, audit, hashlib.sha256(text.encode()).hexdigest())


def random_rows(r, convs, most):
    texts = ["Yes.", "no", "Why? ", " ", "", "ok!", "a.\n", "never.", None]
    roles = ["user", "assistant", "system", "tool", "", None, "user", "assistant"]
    return [(c, r.choice((None, *range(9))), r.choice(roles), r.choice(texts)) for c in convs for _ in range(r.randrange(1, most))]


def found(rows, spark, **more):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit("clash")).repartition(3)
    damaged, copies = C.damaged(df)
    return sorted(map(repr, map(tuple, C.digests(*C.repair(damaged, copies=copies, **more)).collect())))


@pytest.mark.parametrize("seed", range(3))
def test_least_edits_against_every_edit(seed):
    r = random.Random(seed)
    for _ in range(60):
        rows = [(i, role or "", text or "") for i, (_, _, role, text) in enumerate(random_rows(r, [0], 5))]
        steps, _ = C.steps_of([(*x, 1, False) for x in rows], set())
        best = C.decode(C.only(C.NOTHING), steps)
        cost, audit = best[C.least_end(best)]
        want = brute_repair(rows)
        assert (cost, audit) == want[:2]
        assert [(x["role"], x["text"]) for x in C.carried_out([(*x, 1, False) for x in rows], audit, C.NOTHING)] == want[2]


def test_small_tables_against_brute_force(spark):
    rows = random_rows(random.Random(5), [*range(40), None, (1 << 53) + 1], 5)
    rows += [(70, 1, "user", "Same.")] * 3 + [(71, None, "system", "Be brief."), (71, 2, "user", "Hi."), (71, 9, "assistant", "Hello.")]
    after = damage(rows)
    convs = {x[0] for x in rows}
    want = sorted(repr(row_of(c, after, brute_repair)) for c in convs if sum(x[0] == c for x in after) <= 5)
    got = found(rows, spark)
    assert len(got) == len(convs) and len(want) >= 35
    assert set(want) <= set(got)
    assert found([], spark) == []


def whole(rows):
    steps, _ = C.steps_of([(*x, 1, False) for x in rows], set())
    best = C.decode(C.only(C.NOTHING), steps)
    cost, audit = best[C.least_end(best)]
    return cost, audit, [(x["role"], x["text"]) for x in C.carried_out([(*x, 1, False) for x in rows], audit, C.NOTHING)]


@pytest.mark.parametrize("part_rows", (1, 3, 7))
def test_parts_give_what_one_walk_gives(spark, part_rows):
    r = random.Random(part_rows)
    rows = random_rows(r, [1, 2, 3, None], 60) + random_rows(r, range(10, 14), 3)
    rows += [(5, i % 50, ("user", "assistant")[i % 2], "Again and again.") for i in range(300)]
    after = damage(rows)
    assert found(rows, spark, part_rows=part_rows) == sorted(repr(row_of(c, after, whole)) for c in {x[0] for x in rows})


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(x) for x in common.table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").collect()]
    after = damage(rows)
    got = C.op13_conversation_repair(spark, sf)
    assert got.columns == ["conv_id", *C.COUNTS, "audit", "repaired_sha256"]
    got = {x["conv_id"]: repr(tuple(x)) for x in got.collect()}
    convs = sorted({x[0] for x in rows})
    assert sorted(got) == convs
    for c in convs:
        few = sum(x[0] == c for x in after) <= 4
        assert got[c] == repr(row_of(c, after, brute_repair if few else whole))
