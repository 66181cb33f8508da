import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoweave.llm import common
from chronoweave.llm import suffix_dedup as S


def letters(r, n, k):
    return bytes(97 + r.randrange(k) for _ in range(n))


def brute(texts, window):
    """(n_bytes, n_removed, n_spans, sha256 of what is kept) of each text, from a count of every window."""
    data = [(t or "").encode() for t in texts]
    count = Counter(d[i : i + window] for d in data for i in range(len(d) - window + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 2, bool)
        for i in range(len(d) - window + 1):
            if count[d[i : i + window]] > 1:
                gone[i + 1 : i + 1 + window] = True
        spans = int((gone[1:] & ~gone[:-1]).sum())
        kept = bytes(x for x, g in zip(d, gone[1:], strict=False) if not g)
        out.append((len(d), len(d) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_merged_transforms_against_all_windows(seed):
    r = random.Random(seed)
    for _ in range(60):
        k, (window, size) = r.choice((1, 2, 3, 26)), r.choice(((12, 3), (20, 5), (8, 4), (16, 2)))
        contexts = []
        for _ in range(r.randrange(1, 8)):
            contexts.append(letters(r, r.randrange(window, window * 4), k))
            if r.random() < 0.4:
                contexts.append(contexts[-1][: r.randrange(window, len(contexts[-1]) + 1)] + letters(r, r.randrange(5), k))
            if r.random() < 0.2:
                contexts.append(contexts[0])
        counts = np.array([r.choice((1, 1, 1, 2)) for _ in contexts])
        total = Counter()
        for x, n in zip(contexts, counts.tolist(), strict=True):
            for i in range(len(x) - window + 1):
                total[x[i : i + window]] += n
        want = {(j, i) for j, x in enumerate(contexts) for i in range(len(x) - window + 1) if total[x[i : i + window]] > 1}
        own, a, b = S.repeated_windows(contexts, counts, window, size, r.choice((1, 30, 60, 10000)))
        assert {(o, i) for o, x, y in zip(own.tolist(), a.tolist(), b.tolist(), strict=True) for i in range(x, y + 1)} == want


def test_interleave_is_in_order_of_symbols():
    r = random.Random(2)
    contexts = [letters(r, r.randrange(12, 60), 2) for _ in range(9)]
    lengths = np.array([len(c) for c in contexts])
    firsts = np.cumsum(lengths) - lengths
    joined = b"".join(contexts)
    symbols = S.symbols_of(np.frombuffer(joined, np.uint8), 3)
    place, stretch = S.merged([S.Shard(symbols, firsts[k : k + 2], lengths[k : k + 2], 4, 3) for k in range(0, 9, 2)], 4)
    owner = np.searchsorted(firsts, place, side="right") - 1
    whole = (place >= 0) & (place + 12 <= (firsts + lengths)[owner])
    windows = [joined[p : p + 12] for p in place[whole].tolist()]
    assert windows == sorted(windows)
    assert [a == b for a, b in zip(windows, windows[1:], strict=False)] == (stretch[whole][1:] == stretch[whole][:-1]).tolist()
    assert sorted(place[place >= 0].tolist()) == [f + i for f, n in zip(firsts.tolist(), lengths.tolist(), strict=True) for i in range(n - 2)]


def test_contexts_cover_every_window_once():
    r = random.Random(7)
    for _ in range(100):
        texts = [letters(r, r.randrange(80), r.choice((1, 2, 26))) for _ in range(r.randrange(1, 6))]
        found = S.contexts_of(texts, 20, 4)
        rows = list(zip(*(found[k].tolist() for k in ("row", "lo", "hi", "key", "again")), strict=True))
        assert sorted((row, i) for row, lo, hi, *_ in rows for i in range(lo, hi + 1)) == [(j, i) for j, t in enumerate(texts) for i in range(len(t) - 19)]
        key_of = {}
        for row, lo, hi, key, again in rows:
            own = [texts[row][i : i + 20] for i in range(lo, hi + 1)]
            assert all(key_of.setdefault(w, key) == key for w in own)
            assert again or len(set(own)) == len(own)


SMALL = {"window": 20, "gram": 4, "size": 5, "block_bytes": 600, "batch_bytes": 200, "shard_bytes": 60}


@pytest.mark.parametrize("hot_bytes", (1, 150, 1 << 20))
def test_operator_against_all_windows(spark, hot_bytes):
    r = random.Random(hot_bytes)
    passages = [letters(r, 60, 26).decode() for _ in range(4)]
    texts = [None, "", "short", "a" * 500, "ab" * 100, "é😀" * 30, passages[0], passages[0], passages[0][:19]]
    texts += [letters(r, r.randrange(90), 3).decode() + r.choice(passages)[r.randrange(20) :] + letters(r, r.randrange(60), 26).decode() for _ in range(120)]
    rows = [(r.choice((None, i, 7)), t, "clash") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, block string").withColumn("key", F.lit(1)).repartition(3)
    found = S.without_repeats(df, hot_bytes=hot_bytes, **SMALL)
    assert found.columns == ["doc_id", "n_bytes", "n_removed", "spans", "kept"]
    got = [(str(x["doc_id"]), x["n_bytes"], x["n_removed"], len(x["spans"]), hashlib.sha256(x["kept"]).hexdigest()) for x in found.collect()]
    assert sorted(got) == sorted((str(i), *x) for (i, *_), x in zip(rows, brute(texts, 20), strict=True))
    assert all(e - s >= 20 for x in found.collect() for s, e in x["spans"])


def test_empty_and_wrong_parameters(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert S.without_repeats(empty).count() == 0
    for wrong in ({"gram": 63}, {"gram": 512}, {"size": 48}):
        with pytest.raises(ValueError):
            S.without_repeats(empty, **wrong)


def test_query_against_all_windows(spark):
    sf = "/root/testdata/sf0.001"
    rows = common.table(spark, sf, "documents").select("doc_id", "text").collect()
    found = S.op11_suffix_dedup(spark, sf)
    assert found.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    want = sorted((x["doc_id"], *y) for x, y in zip(rows, brute([x["text"] for x in rows], 400), strict=True))
    assert sum(x[2] > 0 for x in want) > 5
    assert sorted(map(tuple, found.collect())) == want
