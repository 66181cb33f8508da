"""Language identification of code-switched text with a linear-chain conditional random field.

Each word of a text gets one of the learned languages. Features of a word are hashed affixes, character n-grams and
the word itself (its lexicon entry); transitions between languages are learned along with them. Training takes windows
of words at hashed places of a bounded sample of labelled documents and joins windows of different languages, so that
switches occur. Forward-backward over the whole text gives each word's marginals; their mean decides the document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Bounds of the training sample: documents a language, windows a document, words a window.
SAMPLE_DOCS = 400
SAMPLE_WINDOWS = 4
WINDOW_WORDS = 24
#: Windows of more bytes, which hold words of unusual length, aren't drawn; words are never cut.
WINDOW_BYTES = 16 << 10
#: Bytes of all windows of the sample; usual text stays far below.
SAMPLE_BYTES = 128 << 20
#: Languages that can be learned; the model's size follows their number. More labels are an error.
MOST_LANGUAGES = 256
BUCKETS = 1 << 17
N_GRAMS = (1, 2, 3, 4)
EPOCHS = 6
RATE = 0.25
#: A shrinking of weights each step, relative to the rate.
DECAY = 1e-5
UNKNOWN = "und"
#: Mean marginal below which no learned language accounts for a text.
LEAST_SCORE = 0.4
KEPT_WORDS = 200_000
#: Bytes of text and distinct words of one numpy step; memory bounds.
SLICE_BYTES = 2 << 20
STEP_WORDS = 8_000
HELD_OUT = 5
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, n_words long, n_switches long"
LETTER = regex.compile(r"\p{L}")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed feature numbers of all ``words`` and how many each has: n-grams with word edges (so affixes), and the whole word."""
    data = np.frombuffer(b"".join(b"\x02" + w + b"\x03" for w in words), np.uint8).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(sizes)
    word = np.repeat(np.arange(len(words)), sizes)
    found, owner = [], []
    rolling = np.zeros(len(data), np.uint64)
    for n in range(1, max(N_GRAMS) + 1):
        m = len(data) - n + 1
        if m <= 0:
            break
        rolling = rolling[:m] * np.uint64(257) + data[n - 1 :]
        if n in N_GRAMS:
            inside = word[:m] == word[n - 1 :]
            found.append(_mixed((rolling + np.uint64(n)) * _MIX)[inside])
            owner.append(word[:m][inside])
    powers = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(len(data), 1_000_003, np.uint64))])
    place = np.arange(len(data)) - np.repeat(ends - sizes, sizes)
    whole = np.add.reduceat(data * powers[place], ends - sizes) if len(words) else np.zeros(0, np.uint64)
    found.append(_mixed(whole * _MIX + np.uint64(77)))
    owner.append(np.arange(len(words)))
    owner = np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return (np.concatenate(found)[order] % np.uint64(BUCKETS)).astype(np.int64), np.bincount(owner, minlength=len(words))


class Crf:
    """Weights: hashed features by language, and transitions between languages."""

    def __init__(self, languages: list[str]):
        self.languages = languages
        k = len(languages)
        self.weights = np.zeros((BUCKETS, k), np.float32)
        self.moves = np.zeros((k, k))

    def emissions(self, words: list[bytes]) -> np.ndarray:
        """Scores of each word for each language: the sum of its features' weights over the square root of their number."""
        if not words:
            return np.zeros((0, len(self.languages)))
        at, count = features(words)
        starts = np.cumsum(count) - count
        return np.add.reduceat(self.weights[at], starts, axis=0).astype(np.float64) / np.sqrt(count)[:, None]

    def marginals(self, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Each word's probabilities by forward-backward; ``scores`` holds sequences of the given lengths one after another.

        Sequences advance together, the longest first; every step normalises, so lengths don't matter to precision.
        """
        k = len(self.languages)
        out = np.empty_like(scores)
        if not len(scores):
            return out
        order = np.argsort(-lengths, kind="stable")
        order = order[lengths[order] > 0]
        size = lengths[order]
        start = (np.cumsum(lengths) - lengths)[order]
        emit = np.exp(scores - scores.max(axis=1, keepdims=True))
        move = np.exp(self.moves - self.moves.max())
        alive = np.searchsorted(-size, -np.arange(1, size[0] + 1), side="right")
        now = np.full((len(order), k), 1.0)
        for t in range(int(size[0])):
            n = alive[t]
            now = (now[:n] @ move if t else now[:n]) * emit[start[:n] + t]
            now /= now.sum(axis=1, keepdims=True)
            out[start[:n] + t] = now
        back = np.ones((len(order), k))
        for t in range(int(size[0]) - 2, -1, -1):
            n = alive[t + 1]  # sequences with a next word
            ahead = (back[:n] * emit[start[:n] + t + 1]) @ move.T
            back[:n] = ahead / ahead.sum(axis=1, keepdims=True)
            own = out[start[:n] + t] * back[:n]
            out[start[:n] + t] = own / own.sum(axis=1, keepdims=True)
        return out

    def fit(self, windows: list[tuple[int, list[bytes]]], epochs: int = EPOCHS, rate: float = RATE, seed: int = 7) -> Crf:
        """Stochastic gradient ascent (AdaGrad) of the conditional likelihood over pairs of joined windows."""
        k = len(self.languages)
        rng = np.random.default_rng(seed)
        vocabulary: dict[bytes, int] = {}
        coded = [(y, np.array([vocabulary.setdefault(w, len(vocabulary)) for w in ws])) for y, ws in windows if ws]
        if not coded or k < 2:
            return self
        at, count = features(list(vocabulary))
        ends = np.cumsum(count)
        seen = np.full((BUCKETS, k), 1e-2, np.float32)
        seen_moves = np.full((k, k), 1e-2)
        for epoch in range(epochs):
            order = rng.permutation(len(coded))
            for group in np.array_split(order, max(1, len(order) // 64)):
                pairs = [group[i : i + 2] for i in range(0, len(group), 2)]
                ids = np.concatenate([coded[i][1] for p in pairs for i in p])
                gold = np.concatenate([np.full(len(coded[i][1]), coded[i][0]) for p in pairs for i in p])
                lengths = np.array([sum(len(coded[i][1]) for i in p) for p in pairs])
                own = np.unique(ids)
                flat = np.concatenate([at[ends[w] - count[w] : ends[w]] for w in own])
                starts = np.cumsum(count[own]) - count[own]
                scale = 1 / np.sqrt(count[own])
                scores = (np.add.reduceat(self.weights[flat], starts, axis=0) * scale[:, None]).astype(np.float64)
                place = np.searchsorted(own, ids)
                prob, both = self._expected(scores[place], lengths)
                wrong = -prob
                wrong[np.arange(len(gold)), gold] += 1
                by_word = np.zeros((len(own), k))
                np.add.at(by_word, place, wrong)
                touched, where = np.unique(flat, return_inverse=True)
                step = np.zeros((len(touched), k))
                np.add.at(step, where, np.repeat(by_word * scale[:, None], count[own], axis=0))
                seen[touched] += step**2
                self.weights[touched] += rate * (step / np.sqrt(seen[touched]) - DECAY * self.weights[touched])
                moved = -both
                inner = np.ones(len(gold), bool)
                inner[np.cumsum(lengths) - 1] = False
                pairs_at = np.flatnonzero(inner)
                np.add.at(moved, (gold[pairs_at], gold[pairs_at + 1]), 1)
                seen_moves += moved**2
                self.moves += rate * moved / np.sqrt(seen_moves)
        return self

    def _expected(self, scores: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of words, and the expected number of each transition."""
        prob = self.marginals(scores, lengths)
        k = prob.shape[1]
        # p(a, b) at a place is proportional to forward(a) move(a, b) emit(b) backward(b), and backward = marginal / forward
        forward = self._forward(scores, lengths)
        move = np.exp(self.moves - self.moves.max())
        inner = np.ones(len(scores), bool)
        inner[np.cumsum(lengths) - 1] = False
        i = np.flatnonzero(inner)
        ahead = forward[i] @ move
        ratio = prob[i + 1] / np.maximum(ahead, 1e-300)
        return prob, (move * (forward[i].T @ ratio)) if len(i) else np.zeros((k, k))

    def _forward(self, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        out = np.empty_like(scores)
        start = np.cumsum(lengths) - lengths
        emit = np.exp(scores - scores.max(axis=1, keepdims=True))
        move = np.exp(self.moves - self.moves.max())
        now = np.ones((len(lengths), scores.shape[1]))
        for t in range(int(lengths.max())):
            live = np.flatnonzero(lengths > t)
            now[live] = (now[live] @ move if t else now[live]) * emit[start[live] + t]
            now[live] /= now[live].sum(axis=1, keepdims=True)
            out[start[live] + t] = now[live]
        return out


def normal_words(text: str | None) -> list[bytes]:
    """Lower-cased words; white space parts them."""
    return text.lower().encode("utf-8", "surrogatepass").split() if text else []


def training_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = SAMPLE_DOCS) -> list[tuple[str, list[bytes]]]:
    """(language, words) of SAMPLE_WINDOWS windows at hashed places of about ``most`` documents of each language, chosen by hash.

    At most 2 x ``most`` documents' windows of each language reach the driver, whatever the size of ``docs``, each of
    WINDOW_BYTES and all of SAMPLE_BYTES at most, of which each language has its share. More than MOST_LANGUAGES labels
    are an error.
    """
    labelled = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.lit(11), F.col(id_col), F.col(text_col)).alias("h"))
    counts = labelled.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not counts:
        return []
    share = F.create_map(*(F.lit(x) for r in counts for x in (r["lang"], min(1.0, most / r["count"]))))
    drawn = labelled.filter(F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53)) < F.try_element_at(share, F.col("lang"))).select("h", "text", "lang")

    def windows(batches):
        for batch in batches:
            for part in common.steps(batch, 1):
                rows = []
                for h, text, lang in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    words = normal_words(text)
                    rng = np.random.default_rng(h & 0xFFFFFFFF)
                    for _ in range(min(SAMPLE_WINDOWS, -(-len(words) // WINDOW_WORDS))):
                        at = int(rng.integers(0, max(1, len(words) - WINDOW_WORDS + 1)))
                        window = b" ".join(words[at : at + WINDOW_WORDS])
                        if len(window) <= WINDOW_BYTES:
                            rows.append((h, lang, window))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.string(), pa.binary()))], names=["h", "lang", "words"])

    size = F.sum(F.length("words")).over(Window.partitionBy("lang").orderBy("h", "words"))  # over the sample alone
    cut = drawn.mapInArrow(windows, "h long, lang string, words binary").withColumn("size", size).filter(F.col("size") <= SAMPLE_BYTES // len(counts))
    found = cut.orderBy("h", "lang", "words").limit(2 * most * len(counts) * SAMPLE_WINDOWS).collect()
    return [(r["lang"], bytes(r["words"]).split()) for r in found]


def train(windows: list[tuple[str, list[bytes]]]) -> Crf:
    languages = sorted({y for y, _ in windows})
    return Crf(languages).fit([(languages.index(y), ws) for y, ws in windows])


class Emissions:
    """Word scores that a task keeps between slices, as one table and each word's row in it."""

    def __init__(self, model: Crf):
        self.model, self.rows, self.table = model, {}, np.zeros((0, len(model.languages)))

    def scores(self, lists: list[list[bytes]]) -> np.ndarray:
        if len(self.rows) > KEPT_WORDS:
            self.rows, self.table = {}, self.table[:0]
        new = [w for w in set().union(*lists) if w not in self.rows]
        self.table = np.concatenate([self.table, *(self.model.emissions(new[i : i + STEP_WORDS]) for i in range(0, len(new), STEP_WORDS))])
        self.rows.update(zip(new, range(len(self.rows), len(self.rows) + len(new)), strict=True))
        at = np.fromiter((self.rows[w] for ws in lists for w in ws), np.int64, sum(map(len, lists)))
        return self.table[at]


def label_words(model: Crf, texts: list, kept: Emissions | None = None) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """Words of each text, the marginals of all words one after another, and the texts' lengths in words."""
    lists = [normal_words(t) for t in texts]
    lengths = np.fromiter(map(len, lists), np.int64, len(lists))
    return lists, model.marginals((kept or Emissions(model)).scores(lists), lengths), lengths


def judge(spark: SparkSession, model: Crf):
    """A function of texts to their columns lang_pred, score, n_words and n_switches, for use in tasks."""
    kept: list[Emissions] = []
    shared = spark.sparkContext.broadcast(model)  # of fixed size: BUCKETS times the languages, MOST_LANGUAGES at most

    def judged(texts):
        model = shared.value
        out = {"lang_pred": [], "score": [], "n_words": [], "n_switches": []}
        if model.languages:
            if not kept:
                kept.append(Emissions(model))
            _, prob, lengths = label_words(model, texts, kept[0])
            best = prob.argmax(axis=1)
            change = np.r_[best[1:] != best[:-1], False][: len(best)].astype(np.int64)
            ends = np.cumsum(lengths)
            change[ends[lengths > 0] - 1] = 0
            switches = common.segment_sums(change, lengths)
            mean = common.segment_sums(prob.T.reshape(-1), np.tile(lengths, prob.shape[1])).reshape(prob.shape[1], -1).T / np.maximum(lengths, 1)[:, None]
        for i, text in enumerate(texts):
            known = bool(model.languages) and bool(text) and LETTER.search(text) is not None
            at = int(mean[i].argmax()) if known else 0
            out["lang_pred"].append(model.languages[at] if known else UNKNOWN)
            out["score"].append(min(1.0, max(0.0, float(mean[i][at]))) if known else 0.0)
            out["n_words"].append(int(lengths[i]) if model.languages else len(normal_words(text)))
            out["n_switches"].append(int(switches[i]) if known else 0)
        return out

    return judged


def predict(docs: DataFrame, model: Crf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, n_words, n_switches) per row, from the text alone.

    ``lang_pred`` has the highest mean marginal (ties: the first in order), ``score`` is that mean, ``n_switches`` how
    often the words' best language changes. A null text, or one without a letter, is ``und`` with score 0; so is every
    text if no language was learned. A null id isn't held out. Repeated rows each give a row, an empty table none.
    """
    judged = judge(docs.sparkSession, model)
    found = common.map_texts(docs, lambda ids, texts: judged(texts) | {"doc_id": ids, "held_out": pa.array([False] * len(texts))}, SCHEMA, id_col, text_col, SLICE_BYTES)
    return found.withColumn("held_out", F.coalesce(common.crc32_mod("doc_id", HELD_OUT) == 0, F.lit(False)))


def identify_languages(docs: DataFrame, labelled: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learns from ``labelled`` (else from ``docs``) without the held-out ids, and predicts every row of ``docs``."""
    known = (docs if labelled is None else labelled).filter(F.coalesce(common.crc32_mod(id_col, HELD_OUT) != 0, F.lit(True)))
    return predict(docs, train(training_windows(known, id_col, text_col, lang_col)), id_col, text_col)


def keep_known(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: float = LEAST_SCORE) -> DataFrame:
    """The rows of ``docs``, with all their columns, in a learned language; null texts, texts without a letter and those scored below ``least`` go.

    Learns as ``identify_languages`` does. If no language can be learned, every row goes.
    """
    known = docs.filter(F.coalesce(common.crc32_mod(id_col, HELD_OUT) != 0, F.lit(True)))
    judged = judge(docs.sparkSession, train(training_windows(known, id_col, text_col, lang_col)))

    def verdict(texts):
        out = judged(texts)
        return [p != UNKNOWN and s >= least for p, s in zip(out["lang_pred"], out["score"], strict=True)]

    return common.keep_texts(docs, verdict, text_col, SLICE_BYTES)


def op8_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(common.table(spark, sf_dir, "documents"))
