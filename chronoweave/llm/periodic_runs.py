"""Maximal runs of repeated words, from longest previous factors.

A suffix array by prefix doubling, whose levels also answer how far two places agree in either direction, gives each
place its longest previous factor and with it the blocks of a Lempel-Ziv parse. A run that touches a block's edge is
found by extending in both directions from the edge, for periods that the neighbouring blocks bound; a run inside a
block is the copy of one in the block's source, and runs kept in order of their start are copied block by block. All
texts of a slice are worked on at once: words of different texts are different symbols, so nothing spans two texts.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Callable
from fractions import Fraction
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LEAST_LENGTH = 6
LEAST_EXPONENT = 4
#: Bytes of text that one slice holds; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20
RUN = "struct<start:long, length:long, period:long>"
SCHEMA = f"doc_id long, n_words long, runs array<{RUN}>, best {RUN}, collapsed string"


class Agreement:
    """How far places of a sequence agree: ``levels[k]`` has equal numbers just where 2^k symbols from there are equal."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        order = np.argsort(symbols, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = self._firsts(symbols[order])
        self.n, self.levels, step = n, [rank], 1
        active = self._shared(order, rank[order])
        while len(active):
            after = active + step
            key = rank[active] * (n + 1) + np.where(after < n, rank[np.minimum(after, n - 1)], -1) + 1
            by = np.argsort(key, kind="stable")
            active, key = active[by], key[by]
            old = rank[active]
            rank = rank.copy()
            rank[active] = old + self._firsts(key) - self._firsts(old)
            self.levels.append(rank)
            active, step = self._shared(active, rank[active]), 2 * step
        self.levels = [np.append(x, -1) for x in self.levels]
        self.suffixes = np.empty(n, np.int64)
        self.suffixes[rank] = np.arange(n)

    @staticmethod
    def _firsts(sorted_: np.ndarray) -> np.ndarray:
        """For each item of a sorted array the place of the first equal one."""
        at = np.arange(len(sorted_))
        return np.maximum.accumulate(np.where(np.r_[True, sorted_[1:] != sorted_[:-1]][: len(at)], at, 0)) if len(at) else at

    @staticmethod
    def _shared(places: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
        same = sorted_[1:] == sorted_[:-1]
        return places[np.r_[False, same] | np.r_[same, False]] if len(places) else places

    def _reach(self, a: np.ndarray, b: np.ndarray, back: bool) -> np.ndarray:
        out, top = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)

        def same(live: np.ndarray, k: int) -> np.ndarray:
            """Those of the queries ``live`` whose next 2^k symbols agree, after what they agree on already."""
            shift = 1 - (1 << k) - out[live] if back else out[live]
            x, y, level = a[live] + shift, b[live] + shift, self.levels[k]
            inside = (x >= 0) & (y >= 0) & (x < self.n) & (y < self.n)
            return live[inside & (level[np.where(inside, x, self.n)] == level[np.where(inside, y, self.n)])]

        live = np.arange(len(a))
        for k in range(len(self.levels)):  # up to the first power of two that isn't agreed on
            live = same(live, k)
            if not len(live):
                break
            top[live] = k + 1
        for k in range(int(top.max(initial=0)) - 1, -1, -1):
            out[same(np.flatnonzero(top > k), k)] += 1 << k
        return out

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Symbols on which the places ``a`` and ``b`` (different ones) agree from there on."""
        return self._reach(a, b, False)

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Symbols on which they agree up to there, themselves included; places before the first agree on none."""
        return self._reach(a, b, True)


def previous_smaller(values: np.ndarray, group: np.ndarray) -> np.ndarray:
    """For each place the nearest one before it in its stretch of equal ``group`` that holds less, or -1; pointers jump over what is known to be larger."""
    before = np.where(np.r_[False, group[1:] == group[:-1]], np.arange(len(values)) - 1, -1)
    wrong = np.flatnonzero(before >= 0)
    while len(wrong := wrong[values[before[wrong]] > values[wrong]]):
        before[wrong] = before[before[wrong]]
        wrong = wrong[before[wrong] >= 0]
    return before


def previous_factors(agree: Agreement) -> tuple[np.ndarray, np.ndarray]:
    """For each place the length of the longest factor that also starts before it, and such a start (-1 for none)."""
    sa, n = agree.suffixes, agree.n
    length, source = np.zeros(n, np.int64), np.full(n, -1, np.int64)
    word = agree.levels[0][sa]  # suffixes of other first words agree on nothing
    above = previous_smaller(sa, word)
    below = n - 1 - previous_smaller(sa[::-1], word[::-1])[::-1]
    for near, has in ((above, above >= 0), (below, below < n)):
        at, other = sa[has], sa[near[has]]
        reach = agree.forward(at, other)
        better = reach > length[at]
        length[at[better]], source[at[better]] = reach[better], other[better]
    return length, source


def _spread(firsts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each of ``firsts`` with 1 to its count."""
    ends = np.cumsum(counts)
    return np.repeat(firsts, counts), np.arange(1, int(counts.sum()) + 1) - np.repeat(ends - counts, counts)


def runs_of(symbols: np.ndarray, lengths: np.ndarray, least_length: int, least_exponent: int) -> np.ndarray:
    """(first, last, period) of every run of consecutive texts with these ``lengths``, whose symbols no two texts share; in order."""
    n = len(symbols)
    if n < least_length:
        return np.zeros((0, 3), np.int64)
    agree = Agreement(symbols)
    factor, source = previous_factors(agree)
    step, blocks, i = np.maximum(factor, 1).tolist(), [], 0
    while i < n:
        blocks.append(i)
        i += step[i]
    blocks = np.array(blocks, np.int64)
    size = np.diff(np.append(blocks, n))
    text_ends = np.cumsum(lengths[lengths > 0])
    text_starts = text_ends - lengths[lengths > 0]
    # Edges: where a block begins, and where a text ends, after which no block of that text comes.
    first = np.isin(blocks, text_starts)
    before = np.where(first, 0, np.r_[0, size[:-1]])
    last = np.r_[first[1:], True]
    edge, right, left = np.r_[blocks, text_ends], np.r_[size, np.zeros(len(text_ends), np.int64)], np.r_[before, size[last]]
    opens = np.r_[text_starts[np.searchsorted(text_starts, blocks, side="right") - 1], text_starts]
    found = []
    word = np.r_[agree.levels[0], -2]  # the place before the first is the last but one of these, an own symbol
    for shift, (b, p) in ((1, _spread(edge, right)), (-1, _spread(edge, np.minimum(left + right, edge - opens)))):
        other = b + shift * p
        ahead, behind = word[b] == word[other], word[b - 1] == word[other - 1]
        some = ahead | behind
        b, p, other = b[some], p[some], other[some]
        f, g = agree.forward(b, other), agree.backward(b - 1, other - 1)
        length = f + g + p
        long = (length >= least_length) & (length >= least_exponent * p)
        begin = np.minimum(b, other)[long] - g[long]
        found.append(np.stack([begin, begin + length[long] - 1, p[long]], axis=1))
    found = np.concatenate(found)
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    same = (found[1:, :2] == found[:-1, :2]).all(axis=1)
    found = found[np.r_[True, ~same][: len(found)]]  # of the periods of a stretch the smallest
    if not len(found):
        return found
    runs, known = list(map(tuple, found.tolist())), set(map(tuple, found.tolist()))
    wide = (size >= least_length + 2) & (source[blocks] >= 0)
    for b, end, src in zip(blocks[wide].tolist(), (blocks + size)[wide].tolist(), source[blocks[wide]].tolist(), strict=True):
        shift = b - src
        at = bisect_right(runs, (src, n, n))
        while at < len(runs) and runs[at][0] + shift < end:  # copies of copies are taken along as the list grows
            run = runs[at]
            at += 1
            if run[1] + shift < end - 1 and (copy := (run[0] + shift, run[1] + shift, run[2])) not in known:
                known.add(copy)
                insort(runs, copy)
    return np.array(runs, np.int64)


def planted_period(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The query's change of a tenth of the documents: from a word on, the text repeats a stretch. Without an id nothing changes."""
    h = 1 if doc_id is None else crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT, change: Callable | None = None) -> DataFrame:
    """One row per document (columns of SCHEMA): its runs in order of start and period, the one of greatest exponent, and the text without repetitions.

    Words are ``[^\\x20\\x09-\\x0D]+``. A run is a stretch with smallest period p, of ``least_length`` words and
    ``least_exponent`` (2 at least) periods or more, that can't be made longer; after its first p words it is dropped
    from the text, whose kept words are joined by one space. ``best`` is null where there is no run, and ties go to the
    smaller start, then period. ``change(id, words)`` may alter the words first. A null or blank text has no words.
    Repeated rows give a row each, an empty table none; other columns are ignored. One Arrow pass without shuffle; a
    text is worked on whole, in memory that follows its words times the logarithm of its longest repeat.
    """
    if least_exponent < 2 or least_length < 2:
        raise ValueError("a run has two periods and two words at least")

    def solve(ids: pa.Array, texts: list) -> dict:
        texts_words = [common.word_bytes(t) for t in texts]
        if change is not None:
            texts_words = [change(i, w) for i, w in zip(ids.to_pylist(), texts_words, strict=True)]
        lengths = np.fromiter(map(len, texts_words), np.int64, len(texts_words))
        ranks = dict.fromkeys(chain.from_iterable(texts_words))
        ranks.update(zip(ranks, range(len(ranks)), strict=True))
        symbols = np.fromiter(map(ranks.__getitem__, chain.from_iterable(texts_words)), np.int64, int(lengths.sum()))
        symbols += np.repeat(np.arange(len(lengths)), lengths) * max(1, len(ranks))
        found = runs_of(symbols, lengths, least_length, least_exponent)
        starts = np.cumsum(lengths) - lengths
        cut = np.searchsorted(found[:, 0], np.r_[starts, len(symbols)])
        runs, best, collapsed = [], [], []
        for words, base, lo, hi in zip(texts_words, starts.tolist(), cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            own = [{"start": s - base, "length": e - s + 1, "period": p} for s, e, p in found[lo:hi].tolist()]
            own.sort(key=lambda r: (r["start"], r["period"]))
            runs.append(own)
            best.append(max(own, key=lambda r: (Fraction(r["length"], r["period"]), -r["start"], -r["period"]), default=None))
            if own:
                keep = np.ones(len(words), bool)
                for r in own:
                    keep[r["start"] + r["period"] : r["start"] + r["length"]] = False
                words = [words[i] for i in np.flatnonzero(keep)]
            collapsed.append(b" ".join(words))
        kind = pa.struct([(k, pa.int64()) for k in ("start", "length", "period")])
        return {"doc_id": ids, "n_words": lengths, "runs": pa.array(runs, pa.list_(kind)), "best": pa.array(best, kind), "collapsed": pa.array(collapsed, pa.string())}

    return common.map_texts(docs, solve, SCHEMA, id_col, text_col, SLICE_BYTES)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_runs(common.table(spark, sf_dir, "documents"), change=planted_period)
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col(f"best.{k}").alias(k) for k in ("start", "length", "period")),
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
