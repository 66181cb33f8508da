import math
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoweave.llm import common
from chronoweave.llm import ppm_score as P

DOCS = [(1, "the cat sat on the mat"), (2, "The cat sat"), (3, None), (4, ""), (5, "abracadabra abracadabra é😀"), (6, "zebra the cat"), (7, "x" * 3000 + " end"), (1, "the cat sat on the mat"), (None, "unnamed the"), (16, "held the out cat")]


def held_out(i):
    return i is not None and crc32(str(i).encode()) % 7 == 2


def brute(docs, order):
    counts, tokens = Counter(), Counter()
    bare = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode()
    for i, t in docs:
        if not held_out(i):
            data = bytes(order) + bare(t) + b"\xff"
            counts.update(data[k : k + order + 1] for k in range(len(data) - order))
            tokens.update([*bare(t).split(), b""])
    followers = {}
    for gram, c in counts.items():
        for d in range(order + 1):
            followers.setdefault(gram[order - d : order], Counter())[gram[-1]] += c

    def prob(ctx, s):
        p, out = 1.0, set()
        for d in range(order, -1, -1):
            own = {k: n for k, n in followers.get(ctx[order - d :], {}).items() if k not in out}
            if own:
                total = sum(own.values()) + len(own)
                if s in own:
                    return p * own[s] / total
                p *= len(own) / total if len(out) + len(own) < 256 else 1
                out |= set(own)
        return p / max(1, 256 - len(out))

    n, v = sum(tokens.values()), len(tokens)
    rows = []
    for i, t in docs:
        data = bytes(order) + bare(t) + b"\xff"
        score = sum(math.log10(prob(data[k : k + order], data[k + order])) for k in range(len(data) - order))
        words = [*bare(t).split(), b""]
        rows.append((str(i), held_out(i), len(words), sum(tokens[w] > 0 for w in words), n, sum(math.log10((tokens[w] + 1) / (n + v + 1)) for w in words), score))
    return sorted(rows)


@pytest.mark.parametrize("order, block_bytes", [(5, 1 << 20), (5, 40), (3, 40)])
def test_scores_equal_brute_force(spark, order, block_bytes):
    got = P.ppm_scores(spark.createDataFrame(DOCS, "doc_id long, text string").withColumn("block", F.lit("clash")), block_bytes=block_bytes, order=order).collect()
    rows = sorted((str(r["doc_id"]), *list(r)[1:]) for r in got)
    want = brute(DOCS, order)
    assert [r[:5] for r in rows] == [w[:5] for w in want]
    assert np.allclose([r[5:] for r in rows], [w[5:] for w in want], rtol=1e-5)


def test_no_table_is_left_and_blocks_are_in_the_shared_folder(spark):
    before = spark.catalog.listTables()
    docs = spark.createDataFrame([(i, f"text number {i} " * 20) for i in range(50)], "doc_id long, text string")
    blocks = P.blocked(docs, block_bytes=2000)
    assert blocks.count() == 50 and spark.catalog.listTables() == before
    bare = lambda path: path.removeprefix("file:").lstrip("/")
    assert all(bare(f).startswith(bare(common.shared_dir(spark))) for f in blocks.inputFiles())
    plan = blocks.groupBy("block").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_grams_pack_and_places():
    keys, lengths = P.grams([b"abc", b""], 2)
    assert lengths.tolist() == [4, 1]
    assert [k.to_bytes(3, "big") for k in keys.tolist()] == [b"\0\0a", b"\0ab", b"abc", b"bc\xff", b"\0\0\xff"]
    x = np.unique(np.random.default_rng(1).integers(0, 1 << 47, 5000))
    assert (P.unpacked(P.packed(x)) == x).all() and len(P.unpacked(P.packed(x[:0]))) == 0
    assert (P.Places(x).of(x[::-1].copy()) == np.arange(len(x))[::-1]).all()
    assert P.unpacked_words(P.packed_words([b"", b"a"])) == [b"", b"a"] and P.unpacked_words(P.packed_words([b""])) == [b""] and P.unpacked_words(None) == []


def test_empty_table(spark):
    assert P.ppm_scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0
