"""The conditional random field against sums over all label paths, and its edge cases."""

from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoweave.llm import language_crf as L


def all_paths(model, scores):
    """Marginals, expected transitions and the logarithm of the sum over every label path of one sequence."""
    n, k = scores.shape
    weights = {path: np.exp(sum(scores[t, y] for t, y in enumerate(path)) + sum(model.moves[a, b] for a, b in zip(path, path[1:]))) for path in product(range(k), repeat=n)}
    total = sum(weights.values())
    marginals, both = np.zeros((n, k)), np.zeros((k, k))
    for path, w in weights.items():
        for t, y in enumerate(path):
            marginals[t, y] += w / total
        for a, b in zip(path, path[1:]):
            both[a, b] += w / total
    return marginals, both, np.log(total)


@pytest.mark.parametrize("k", [2, 3, 4])
def test_forward_backward_equals_all_paths(k):
    rng = np.random.default_rng(k)
    model = L.Crf([f"l{i}" for i in range(k)])
    model.moves = rng.normal(size=(k, k)) * 2
    lengths = np.array([5, 1, 0, 3, 6, 2])
    scores = rng.normal(size=(lengths.sum(), k)) * 3
    got = model.marginals(scores, lengths)
    at, both = 0, np.zeros((k, k))
    for n in lengths:
        if n:
            want, moved, _ = all_paths(model, scores[at : at + n])
            assert np.allclose(got[at : at + n], want)
            both += moved
        at += n
    some = lengths[lengths > 0]
    prob, moved = model._expected(scores, some)
    assert np.allclose(prob, got) and np.allclose(moved, both)


def test_fit_climbs_the_likelihood_over_all_paths():
    words = {0: [b"ouxe", b"leau", b"aieux"], 1: [b"kzk", b"zkrk", b"krz"], 2: [b"umlo", b"olmu", b"mulo"]}
    rng = np.random.default_rng(4)
    windows = [(y, [ws[i] for i in rng.integers(0, 3, 4)]) for y, ws in words.items() for _ in range(30)]

    def likelihood(model):
        out = 0.0
        for (y, a), (z, b) in zip(windows[:20], windows[40:60], strict=True):
            scores = model.emissions(a + b)
            path = [y] * len(a) + [z] * len(b)
            own = sum(scores[t, l] for t, l in enumerate(path)) + sum(model.moves[p, q] for p, q in zip(path, path[1:]))
            out += own - all_paths(model, scores)[2]
        return out

    found = [likelihood(L.Crf(["a", "b", "c"]).fit(windows, epochs=n)) for n in (0, 1, 6)]
    assert found[0] < found[1] < found[2] < 0


def test_gradient_is_that_of_all_paths():
    """Gold counts less expected ones are the slope of the likelihood in a transition's weight."""
    rng = np.random.default_rng(8)
    model = L.Crf(["a", "b", "c"])
    model.moves = rng.normal(size=(3, 3))
    scores = rng.normal(size=(5, 3))
    _, both = model._expected(scores, np.array([5]))
    for a, b in product(range(3), repeat=2):
        up, down = L.Crf(model.languages), L.Crf(model.languages)
        up.moves, down.moves = model.moves.copy(), model.moves.copy()
        up.moves[a, b] += 1e-5
        down.moves[a, b] -= 1e-5
        assert np.isclose((all_paths(up, scores)[2] - all_paths(down, scores)[2]) / 2e-5, both[a, b], atol=1e-6)


def test_long_words_are_learned_whole(spark):
    stem = "x" * 80
    rows = [(i, " ".join([stem + ("aa" if i % 2 else "zz")] * 30), "en" if i % 2 else "fr") for i in range(1, 80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    windows = L.training_windows(docs)
    assert {len(w) for _, ws in windows for w in ws} == {82}
    found = {r["doc_id"]: r["lang_pred"] for r in L.identify_languages(docs).collect()}
    assert found == {i: lang for i, _, lang in rows}
    huge = docs.withColumn("text", F.repeat(F.lit("y"), 20_000))
    assert L.training_windows(huge) == []


def test_too_many_languages_are_an_error(spark):
    docs = spark.range(L.MOST_LANGUAGES + 1).select(F.col("id").alias("doc_id"), F.lit("some words").alias("text"), F.col("id").cast("string").alias("lang"))
    with pytest.raises(ValueError, match="languages"):
        L.training_windows(docs)


def test_empty_table_long_text_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, score string, __text string")
    assert L.identify_languages(empty).count() == 0 and L.keep_known(empty).count() == 0
    rows = [(i, ("le chat noir dort ici " if i % 2 else "the black cat sleeps here ") * 8, "fr" if i % 2 else "en", "s", "t") for i in range(1, 60)]
    rows += [(100, "le chat noir dort ici " * 60_000, None, None, None), (101, None, None, None, None), (102, "12 34", "en", None, None), (102, "12 34", "en", None, None)]
    docs = spark.createDataFrame(rows, empty.schema)
    found = sorted((r["doc_id"], r["lang_pred"], r["n_words"]) for r in L.identify_languages(docs).collect() if r["doc_id"] >= 100)
    assert found == [(100, "fr", 300_000), (101, "und", 0), (102, "und", 2), (102, "und", 2)]
    kept = L.keep_known(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [*range(1, 60), 100]
    nothing = L.identify_languages(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in nothing} == {"und"}


def test_bytes_of_the_sample_are_bounded(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "xy"[i % 2] + ("abcdefgh"[i % 8] * 30 + " ") * 40, "xy"[i % 2]) for i in range(60)], "doc_id long, text string, lang string")
    whole = L.training_windows(docs)
    monkeypatch.setattr(L, "SAMPLE_BYTES", 20_000)
    few = L.training_windows(docs)
    assert 0 < len(few) < len(whole) and {y for y, _ in few} == {"x", "y"}
    assert all(sum(len(b" ".join(ws)) for y, ws in few if y == lang) <= 10_000 for lang in "xy")
