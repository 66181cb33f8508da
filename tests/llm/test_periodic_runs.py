import hashlib
import random
from fractions import Fraction
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoweave.llm import common
from chronoweave.llm import periodic_runs as P


def brute_runs(words, least_length, least_exponent):
    """Every stretch equal to itself a period later, made as long as it gets; the smallest period of each."""
    n, found = len(words), {}
    for p in range(1, n // least_exponent + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j > i and j - i + p >= max(least_length, least_exponent * p):
                found.setdefault((i, j - i + p), p)
            i = max(j, i + 1)
    return sorted((s, length, p) for (s, length), p in found.items())


def brute_row(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    h = 1 if doc_id is None else crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        a = (h // 10) % n
        p = 1 + (n - a) // (3 + (h // 10) % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words, 6, 4)
    dropped = {i for s, length, p in runs for i in range(s + p, s + length)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    digest = lambda data: hashlib.sha256(data).hexdigest()
    lines = "".join(f"{s},{length},{p}\n" for s, length, p in sorted(runs, key=lambda r: (r[0], r[2])))
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, digest(lines.encode()), digest(b" ".join(w for i, w in enumerate(words) if i not in dropped)))


@pytest.mark.parametrize("seed", range(6))
def test_runs_against_every_period(seed):
    r = random.Random(seed)
    for _ in range(150):
        docs = []
        for _ in range(r.randrange(5)):
            n, k = r.randrange(60), r.choice((1, 2, 2, 3))
            words = [r.randrange(k) for _ in range(n)]
            if r.random() < 0.5:
                words = ([r.randrange(k) for _ in range(r.randrange(1, 7))] * 60)[:n]
                for _ in range(min(n, r.randrange(3))):
                    words[r.randrange(n)] = r.randrange(k)
                words += [9, *words] * r.randrange(3)
            docs.append(words)
        limits = r.choice(((6, 4), (2, 2), (4, 3)))
        lengths = np.array([len(d) for d in docs], np.int64)
        symbols = np.array([w + 20 * i for i, d in enumerate(docs) for w in d], np.int64)
        want = [(s + b, s + b + n - 1, p) for d, b in zip(docs, np.cumsum(lengths) - lengths, strict=True) for s, n, p in brute_runs(d, *limits)]
        assert [tuple(x) for x in P.runs_of(symbols, lengths, *limits).tolist()] == sorted(want)


def test_agreement_in_both_directions():
    r = random.Random(3)
    s = [r.randrange(2) for _ in range(90)] * 2
    agree = P.Agreement(np.array(s))
    assert [s[i:] for i in agree.suffixes] == sorted(s[i:] for i in range(len(s)))
    a, b = (np.array(x) for x in zip(*((i, j) for i in range(0, 180, 7) for j in range(i + 1, 180)), strict=True))
    same = lambda x, y: next((k for k, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
    assert agree.forward(a, b).tolist() == [same(s[i:], s[j:]) for i, j in zip(a, b, strict=True)]
    assert agree.backward(a, b).tolist() == [same(s[i::-1], s[j::-1]) for i, j in zip(a, b, strict=True)]


EDGES = [(1, None), (2, ""), (3, " \n\t"), (4, "a a a a a a"), (5, "a a a a a"), (4, "a a a a a a"), (None, "x y x y x y x y x y"), (6, "é😀 b é😀 b é😀 b é😀 b c"), (7, "w " * 5000 + "end"), (8, " ".join(str(i % 700) for i in range(3500)))]


def test_edges_and_planted_periods(spark):
    r = random.Random(1)
    rows = EDGES + [(i, " ".join(r.choice("abcdefgh") * r.randrange(1, 3) for _ in range(r.randrange(200)))) for i in range(100, 260)]
    assert sum(crc32(str(i).encode()) % 10 == 0 for i, _ in rows if i is not None) > 5
    found = P.find_runs(spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs", F.lit(1)).withColumn("best", F.lit(None).cast("string")).repartition(4), change=P.planted_period)
    assert found.columns == ["doc_id", "n_words", "runs", "best", "collapsed"]
    key = lambda x: repr(tuple(x))
    got = sorted((x["doc_id"], tuple(tuple(y) for y in x["runs"]), hashlib.sha256(x["collapsed"].encode()).hexdigest()) for x in found.collect() if x["doc_id"] is not None)
    assert [(i, len(runs), text) for i, runs, text in got] == sorted((x[0], x[1], x[7]) for x in map(lambda r: brute_row(*r), rows) if x[0] is not None)
    empty = P.find_runs(spark.createDataFrame([], "doc_id long, text string"))
    assert empty.count() == 0 and key(empty.columns) == key(found.columns)


def test_query_against_brute_force(spark, tmp_path):
    docs = common.table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").union(spark.createDataFrame(EDGES, "doc_id long, text string"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = [tuple(x) for x in docs.collect()]
    short = [x for x in rows if len(x[1] or "") < 20000]
    found = P.op12_periodic_runs(spark, str(tmp_path))
    assert found.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = sorted(repr(tuple(x)) for x in found.collect())
    want = sorted(repr(brute_row(*x)) for x in short)
    assert len(got) == len(rows) and len(short) > 150
    assert set(want) <= set(got)
    assert sum("None, None" not in x for x in want) > 10


def test_limits_of_parameters(spark):
    with pytest.raises(ValueError):
        P.find_runs(spark.createDataFrame([], "doc_id long, text string"), least_exponent=1)
