"""Scoring texts by prediction by partial matching over bytes.

The model is a byte-context trie of fixed order, pretrained on the training documents: escape method C, with the
symbols of longer contexts excluded. The trie is a set of DataFrames, one row per context and symbol, and every
probability follows from a row, its parent's and sums over the context, so it is computed level by level with joins and
windows (a window holds the symbols of one context, 256 at most). Texts lie in blocks in a table bucketed by block:
each block asks for the distinct grams and words it has, gets an answer for each, and scores its texts. Questions and
answers travel as packed arrays in two steps: from a block by ranges of buckets, and from a group of blocks, merged, by
bucket; answers come back the same way. Blocks a group and buckets a range grow with the square root of their numbers,
so a row keeps thousands of grams, and bytes follow the input, where rows a (block, bucket) would grow with its square.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Bytes of context.
ORDER = 5
#: Bytes of text in a block; a longer text is a block of its own.
BLOCK_BYTES = 32 << 20
HELD_OUT = (7, 2)
#: Symbols that aren't part of a text's UTF-8: before its start, and after its end.
START, END = 0, 255
ALPHABET = 256
ASKED = "grams binary, gram_counts binary, words binary, word_counts binary"
ANSWERED = "is_gram boolean, asked binary, answers binary"
#: Bytes of text for each bucket of grams and words; buckets grow with the input, so a bucket doesn't.
BUCKET_BYTES = 16 << 20
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def text_bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").lower()


def _windows(data: np.ndarray, n: int) -> np.ndarray:
    """Every ``n`` neighbouring bytes as one integer."""
    if n == 1:
        return data.astype(np.int64)
    half = _windows(data, n // 2)
    own = (half[: len(half) - n // 2] << 8 * (n // 2)) | half[n // 2 :]
    return (own[: len(data) - n + 1] << 8) | data[n - 1 :] if n % 2 else own


def grams(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Context and symbol of every position of the texts and their ends, packed into integers; and each text's positions."""
    data = np.frombuffer(b"".join(bytes([START]) * order + t + bytes([END]) for t in texts), np.uint8)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    keys = _windows(data, order + 1)
    whole = lengths + order  # positions that span two texts are left out
    begins = np.cumsum(whole) - whole
    inside = np.ones(len(data), bool)
    for i in range(order):
        inside[begins + lengths + i] = False
    return keys[inside[: len(keys)]], lengths


def blocked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` as (block, doc_id, training, text) in files bucketed by block, whose number grows with the text."""
    training = F.coalesce(common.crc32_mod(id_col, HELD_OUT[0]) != HELD_OUT[1], F.lit(True))
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), training.alias("training"), F.col(text_col).cast("string").alias("text"))
    return common.blocked(slim, "ppm-blocks", block_bytes).drop("row")


def _steps(table: pa.Table):
    """(ids, training, lower-case bytes of the texts) of a block, in slices."""
    for batch in table.select(["doc_id", "training", "text"]).to_batches():
        for part in common.steps(batch, 2):
            yield part.column(0), part.column(1).to_numpy(zero_copy_only=False), [text_bytes(t) for t in part.column(2).to_pylist()]


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    own, back = np.unique(keys, return_inverse=True)
    return own, np.bincount(back, counts, len(own)).astype(np.int64)


def packed(values: np.ndarray) -> bytes:
    """Integers or floats as compressed byte planes."""
    return zstandard.compress(np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T.tobytes(), 1) if len(values) else b""


def unpacked(data: bytes | None, kind=np.int64) -> np.ndarray:
    if not data:
        return np.zeros(0, kind)
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1)


def packed_words(words: list[bytes]) -> bytes | None:
    return zstandard.compress(b" ".join(words), 3) if words else None


def unpacked_words(data: bytes | None) -> list[bytes]:
    return zstandard.decompress(data).split(b" ") if data else []


def by_bucket(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of sorted ``keys`` by bucket, then key; and the ends of the buckets in it. ``buckets`` is odd, so the last byte doesn't decide."""
    own = keys % buckets
    return np.argsort(own, kind="stable"), np.cumsum(np.bincount(own, minlength=buckets))


def words_by_bucket(words, buckets: int) -> tuple[list[bytes], np.ndarray]:
    """``words`` in order of bucket, then word; and the ends of the buckets."""
    placed = sorted((zlib.crc32(w) % buckets, w) for w in words)
    return [w for _, w in placed], np.cumsum(np.bincount(np.fromiter((b for b, _ in placed), np.int64, len(placed)), minlength=buckets))


class Places:
    """Where each of distinct integers stands: a table of hashed places, looked up for whole arrays at once."""

    def __init__(self, keys: np.ndarray):
        bits = max(8, len(keys).bit_length() + 2)
        self.keys, self.shift, self.mask = keys, np.uint64(64 - bits), (1 << bits) - 1
        self.table = np.full(1 << bits, -1, np.int32)
        at, todo = self._hash(keys), np.arange(len(keys), dtype=np.int32)
        while len(todo):
            free = self.table[at] < 0
            self.table[at[free]] = todo[free]
            lost = self.table[at] != todo
            at, todo = (at[lost] + 1) & self.mask, todo[lost]

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def of(self, sought: np.ndarray) -> np.ndarray:
        """The places of ``sought``, all of which are there."""
        at = self._hash(sought)
        found = self.table[at]
        wrong = np.flatnonzero(self.keys[found] != sought)
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & self.mask
            found[wrong] = self.table[at[wrong]]
            wrong = wrong[self.keys[found[wrong]] != sought[wrong]]
        return found


def _rows(keys: tuple[str, str], first: int, ends: list[int], own: np.ndarray, counts: np.ndarray, words, buckets: int) -> pa.Table:
    """Rows (``keys``, columns of ASKED), the keys being ``first`` and the place in ``ends``: the grams and words of the buckets up to each of ``ends``, where there are any."""
    at, gram_ends = by_bucket(own, buckets)
    own, counts = own[at], counts[at]
    listed, word_ends = words_by_bucket(words, buckets)
    word_counts = np.fromiter(map(words.__getitem__, listed), np.int64, len(listed))
    rows, a, c = [], 0, 0
    for number, end in enumerate(ends):
        b, d = int(gram_ends[end]), int(word_ends[end])
        if b > a or d > c:
            rows.append((first, number, packed(np.diff(own[a:b], prepend=0)), packed(counts[a:b]), packed_words(listed[c:d]), packed(word_counts[c:d])))
        a, c = b, d
    names = [*keys, "grams", "gram_counts", "words", "word_counts"]
    return pa.table([pa.array([r[i] for r in rows], pa.int64() if i < 2 else pa.binary()) for i in range(6)], names=names)


def asked(blocks: DataFrame, order: int, buckets: int, width: int) -> DataFrame:
    """Each block's distinct grams and words with their counts in its training texts, a row for each range of ``width`` buckets that has any (block, part, columns of ASKED); the end token is the empty word."""
    ends = [min(e, buckets - 1) for e in range(width - 1, buckets + width - 1, width)]

    def count(table: pa.Table) -> pa.Table:
        parts, words = [], Counter({b"": 0})
        for _, training, texts in _steps(table):
            keys, lengths = grams(texts, order)
            known = np.repeat(training, lengths)
            for own, weight in ((keys[known], 1), (keys[~known], 0)):
                own = np.sort(own)
                edge = np.flatnonzero(np.r_[True, own[1:] != own[:-1]][: len(own)])
                parts.append((own[edge], np.diff(np.r_[edge, len(own)]) * weight))
            for t, use in zip(texts, training, strict=True):
                own = t.split()
                if use:
                    words.update(own)
                    words[b""] += 1
                else:
                    words.update(dict.fromkeys(own, 0))
            if len(parts) >= 16:
                parts = [_merged(parts)]
        return _rows(("block", "part"), table.column("block")[0].as_py(), ends, *_merged(parts), words, buckets)

    return blocks.groupBy("block").applyInArrow(count, f"block long, part long, {ASKED}")


def gathered(questions: DataFrame, buckets: int, width: int) -> DataFrame:
    """The questions of each group of blocks, merged, a row a bucket (team, bucket, columns of ASKED)."""

    def merge(table: pa.Table) -> pa.Table:
        parts, words = [], Counter()
        for g, n, w, k in zip(*(table.column(c) for c in ("grams", "gram_counts", "words", "word_counts")), strict=True):
            parts.append((np.cumsum(unpacked(g.as_py())), unpacked(n.as_py())))
            if len(parts) >= 64:
                parts = [_merged(parts)]
            for word, c in zip(unpacked_words(w.as_py()), unpacked(k.as_py()).tolist(), strict=True):
                words[word] += c
        return _rows(("team", "bucket"), table.column("team")[0].as_py(), list(range(buckets)), *_merged(parts), words, buckets)

    return questions.groupBy("team", "part").applyInArrow(merge, f"team long, bucket long, {ASKED}")


def spread(questions: DataFrame, answers: DataFrame, width: int) -> DataFrame:
    """The answers of a group, by ranges of buckets, dealt to its blocks in the order in which each asked (block, columns of ANSWERED)."""

    def deal(asked_of: pa.Table, known: pa.Table) -> pa.Table:
        keys, values, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.float32)], {}
        for is_gram, sought, data in zip(*(known.column(n) for n in ("is_gram", "asked", "answers")), strict=True):
            if is_gram.as_py():
                keys.append(np.cumsum(unpacked(sought.as_py())))
                values.append(unpacked(data.as_py(), np.float32))
            else:
                counts.update(zip(unpacked_words(sought.as_py()), unpacked(data.as_py()).tolist(), strict=True))
        keys, values = np.concatenate(keys), np.concatenate(values)
        order = np.argsort(keys)
        keys, values = keys[order], values[order]
        rows = []
        for block, g, w in zip(asked_of.column("block").to_pylist(), asked_of.column("grams"), asked_of.column("words"), strict=True):
            if sought := g.as_py():
                rows.append((block, True, sought, packed(values[np.searchsorted(keys, np.cumsum(unpacked(sought)))])))
            if sought := w.as_py():
                own = unpacked_words(sought)
                rows.append((block, False, sought, packed(np.fromiter(map(counts.__getitem__, own), np.int64, len(own)))))
        types = (pa.int64(), pa.bool_(), pa.binary(), pa.binary())
        return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["block", "is_gram", "asked", "answers"])

    back = answers.withColumn("part", F.floor(F.col("bucket") / width)).drop("bucket")
    return questions.select("team", "part", "block", "grams", "words").groupBy("team", "part").cogroup(back.groupBy("team", "part")).applyInArrow(deal, f"block long, {ANSWERED}")


def gram_counts(questions: DataFrame) -> DataFrame:
    """(gram, c): the training count of every gram of any block."""

    def merge(table: pa.Table) -> pa.Table:
        parts = []
        for g, n in zip(table.column("grams"), table.column("gram_counts"), strict=True):
            parts.append((np.cumsum(unpacked(g.as_py())), unpacked(n.as_py())))
            if len(parts) >= 64:
                parts = [_merged(parts)]
        own, n = _merged(parts)
        return pa.table({"gram": pa.array(own), "c": pa.array(n)})

    return questions.select("bucket", "grams", "gram_counts").groupBy("bucket").applyInArrow(merge, "gram long, c long")


def gram_answers(questions: DataFrame, probabilities: DataFrame, buckets: int) -> DataFrame:
    """For each group of blocks and bucket the logarithms of its grams' probabilities, in its order."""

    def answer(asked_of: pa.Table, known: pa.Table) -> pa.Table:
        gram, value = known.column("gram").to_numpy(), known.column("value").to_numpy()
        at = np.argsort(gram)
        gram, value = gram[at], value[at].astype(np.float32)
        out = [packed(value[np.searchsorted(gram, np.cumsum(unpacked(g.as_py())))]) for g in asked_of.column("grams")]
        return pa.table({"team": asked_of.column("team"), "bucket": asked_of.column("bucket"), "is_gram": pa.array([True] * len(out), pa.bool_()), "asked": asked_of.column("grams"), "answers": pa.array(out, pa.binary())})

    keyed = probabilities.select(F.pmod("gram", F.lit(buckets)).alias("bucket"), "gram", F.log10("prob").alias("value"))
    return questions.select("team", "bucket", "grams").groupBy("bucket").cogroup(keyed.groupBy("bucket")).applyInArrow(answer, f"team long, bucket long, {ANSWERED}")


def word_answers(questions: DataFrame) -> DataFrame:
    """For each group of blocks and bucket the training counts of its words; the bucket's sum of counts and number of trained words stand in one of its rows."""

    def answer(table: pa.Table) -> pa.Table:
        total: Counter = Counter()
        for w, n in zip(table.column("words"), table.column("word_counts"), strict=True):
            for word, k in zip(unpacked_words(w.as_py()), unpacked(n.as_py()).tolist(), strict=True):
                total[word] += k
        out = []
        for w in table.column("words"):
            own = unpacked_words(w.as_py())
            out.append(packed(np.fromiter(map(total.__getitem__, own), np.int64, len(own))))
        rest = [0] * (len(out) - 1)
        sums = {"tokens": [sum(total.values()), *rest], "trained": [sum(k > 0 for k in total.values()), *rest]}
        return pa.table({"team": table.column("team"), "bucket": table.column("bucket"), "is_gram": pa.array([False] * len(out), pa.bool_()), "asked": table.column("words"), "answers": pa.array(out, pa.binary())} | {k: pa.array(v, pa.int64()) for k, v in sums.items()})

    return questions.select("team", "bucket", "words", "word_counts").groupBy("bucket").applyInArrow(answer, f"team long, bucket long, {ANSWERED}, tokens long, trained long")


def gram_probabilities(counts: DataFrame, order: int) -> DataFrame:
    """(gram, prob) for every row of ``counts`` (gram, c): the model's probability of its symbol after its context.

    ``c`` counts the gram in training. With c, n, q the count of a symbol, the sum over a context and its distinct
    symbols: a context gives a seen symbol c / (n + q) and escapes by q / (n + q); its parent then leaves the symbols
    seen by the child out of all three. Below order zero all symbols not yet seen are alike.
    """
    rows = counts.select(F.shiftright("gram", 8).alias("ctx"), F.col("gram").bitwiseAND(F.lit(255)).alias("s"), "c")
    levels = {order: rows}
    for d in range(order - 1, -1, -1):
        cut = F.col("ctx").bitwiseAND(F.lit((1 << 8 * d) - 1)).alias("ctx")
        levels[d] = levels[d + 1].groupBy(cut, "s").agg(F.sum("c").alias("c"))
    seen = F.when(F.col("c") > 0, 1).otherwise(0)
    within = Window.partitionBy("ctx")
    root = levels[0].withColumns({"n": F.sum("c").over(within), "q": F.sum(seen).over(within)})
    done = root.withColumn("escaped", 1 / F.greatest(F.lit(ALPHABET) - F.col("q"), F.lit(1)))
    for d in range(1, order + 1):
        parent = done.select(F.col("ctx").alias("p_ctx"), F.col("s").alias("p_s"), F.col("c").alias("p_c"), F.col("n").alias("p_n"), F.col("q").alias("p_q"), F.col("escaped").alias("p_escaped"))
        joined = levels[d].join(parent, (F.col("ctx").bitwiseAND(F.lit((1 << 8 * (d - 1)) - 1)) == F.col("p_ctx")) & (F.col("s") == F.col("p_s")))
        sums = joined.withColumns({"n": F.sum("c").over(within), "q": F.sum(seen).over(within), "left_out": F.sum(F.when(F.col("c") > 0, F.col("p_c")).otherwise(0)).over(within)})
        free, all_ = F.col("p_q") - F.col("q"), F.col("p_n") - F.col("left_out") + F.col("p_q") - F.col("q")
        escaped = F.when(free <= 0, F.col("p_escaped")).when(F.col("p_c") > 0, F.col("p_c") / all_).otherwise(free / all_ * F.col("p_escaped"))
        done = sums.withColumn("escaped", escaped).select("ctx", "s", "c", "n", "q", "escaped")
    full = F.col("n") + F.col("q")
    prob = F.when(F.col("c") > 0, F.col("c") / full).when(F.col("n") > 0, F.col("q") / full * F.col("escaped")).otherwise(F.col("escaped"))
    return done.select((F.shiftleft("ctx", 8) + F.col("s")).alias("gram"), prob.alias("prob"))


def ppm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document (columns of SCHEMA); all are scored, those outside the held-out remainder are learned from.

    A null text counts as empty: its end is all there is to score. Null ids train and aren't held out. Repeated rows
    are learned from and scored each; an empty table gives no rows; other columns are ignored.
    """
    blocks = blocked(docs, id_col, text_col, block_bytes)
    size, n_blocks = blocks.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.approx_count_distinct("block")).first()
    buckets = max(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // BUCKET_BYTES) | 1
    width, teams = math.isqrt(buckets), max(1, math.isqrt(n_blocks))
    by_block = common.written(asked(blocks, order, buckets, width).withColumn("team", F.pmod("block", F.lit(teams))), "ppm-asked")
    questions = common.written(gathered(by_block, buckets, width), "ppm-gathered")
    counts = common.written(gram_counts(questions), "ppm-counts")
    words = common.written(word_answers(questions), "ppm-words")
    total, distinct = words.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("trained"), F.lit(0))).first()
    answers = spread(by_block, gram_answers(questions, gram_probabilities(counts, order), buckets).unionByName(words.drop("tokens", "trained")), width)

    def score(texts_of: pa.Table, answers_of: pa.Table) -> pa.Table:
        keys, values, words, counts = [], [], [], []
        for is_gram, sought, data in zip(*(answers_of.column(n).to_pylist() for n in ("is_gram", "asked", "answers")), strict=True):
            if is_gram:
                keys.append(np.cumsum(unpacked(sought)))
                values.append(unpacked(data, np.float32))
            else:
                words += unpacked_words(sought)
                counts.append(unpacked(data))
        places, value, word_count = Places(np.concatenate(keys)), np.concatenate(values).astype(np.float64), np.concatenate(counts)
        at = dict(zip(words, range(len(words)), strict=True))
        end = at[b""]
        word_score = np.log10((word_count + 1) / (total + distinct + 1))
        out = []
        for ids, training, texts in _steps(texts_of):
            position, lengths = grams(texts, order)
            scores = common.segment_sums(value[places.of(position)], lengths)
            base, n_tokens, n_known = [], [], []
            for t in texts:
                i = np.fromiter(map(at.__getitem__, t.split()), np.int64)
                base.append(math.fsum(word_score[i]) + word_score[end])
                n_tokens.append(len(i) + 1)
                n_known.append(int((word_count[i] > 0).sum()) + int(word_count[end] > 0))
            n = len(texts)
            out.append(pa.table({"doc_id": ids, "held_out": pa.array(~training), "n_tokens": pa.array(n_tokens, pa.int64()), "n_known": pa.array(n_known, pa.int64()), "train_tokens": pa.array([int(total)] * n, pa.int64()), "base_score": pa.array(base, pa.float64()), "score": pa.array(scores)}))
        return pa.concat_tables(out)

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, SCHEMA)


def op3_ppm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm_scores(common.table(spark, sf_dir, "documents"))
