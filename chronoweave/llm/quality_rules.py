"""Quality rules from compression bands.

Whole texts and fixed chunks of them are compressed with zstandard. A ratio above the band of the text's length means
repetition, one below it means noise; either rejects the document, as does too large a share of it in such chunks. The
rest after a text's last whole chunk is a chunk too, with the band of its own length. Word and
line counts come along, with two hard limits on them.
"""

from __future__ import annotations

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession

from . import common

#: (bytes, lowest ratio, highest ratio) of a whole text, interpolated over the logarithm of the length. They lie about
#: 10 to 25 % around the ratios of prose of that length, and widen where texts get rare.
BANDS = (
    (32, 0.65, 1.1),
    (64, 0.72, 1.25),
    (128, 0.95, 1.5),
    (256, 1.18, 1.7),
    (512, 1.36, 1.86),
    (1024, 1.56, 2.04),
    (2048, 1.76, 2.2),
    (4096, 1.89, 2.32),
    (8192, 2.02, 2.43),
    (16384, 2.1, 2.55),
    (65536, 2.1, 3.2),
    (1 << 20, 1.9, 5.0),
)
CHUNK_BYTES = 4096
#: Band of a whole chunk, and the share of a text's bytes that chunks outside their bands may hold.
CHUNK_BAND = (1.7, 2.7)
CHUNK_SHARE = 0.25
LEVEL = 3
MIN_WORDS = 10
REPEAT_PERCENT = 20

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, n_bytes long, ratio double, n_chunks long, n_odd_chunks long, odd_bytes long"
)


def repeat_words(word_lists: list[list[bytes]], window: int = 5) -> np.ndarray:
    """Per text, the words that lie in a five-word window found twice or more in that text.

    Windows are ranked exactly, not hashed: pairs of word ranks, then pairs of pairs, then the fifth word and the text.
    """
    lengths = np.fromiter(map(len, word_lists), np.int64, len(word_lists))
    total = int(lengths.sum())
    if total < window:
        return np.zeros(len(word_lists), np.int64)
    ranks: dict[bytes, int] = {}
    put = ranks.setdefault
    ids = np.fromiter((put(w, len(ranks)) for ws in word_lists for w in ws), np.int64, total)
    doc = np.repeat(np.arange(len(word_lists)), lengths)
    n = total - window + 1
    two = np.unique(ids[:-1] * len(ranks) + ids[1:], return_inverse=True)[1]
    four = np.unique(two[:-2] * (int(two.max()) + 1) + two[2:], return_inverse=True)[1]
    inside = np.flatnonzero(doc[:n] == doc[window - 1 :])
    five = np.unique(four[inside] * len(ranks) + ids[inside + 4], return_inverse=True)[1]
    _, back, count = np.unique(five * len(word_lists) + doc[inside], return_inverse=True, return_counts=True)
    twice = inside[count[back] > 1]
    edge = np.bincount(twice, minlength=total + 1) - np.bincount(twice + window, minlength=total + 1)[: total + 1]
    return common.segment_sums((np.cumsum(edge)[:total] > 0).astype(np.int64), lengths)


def bands(n_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lowest and highest ratio of texts of these lengths."""
    at, low, high = np.log2(np.maximum(n_bytes, 1)), *zip(*((lo, hi) for _, lo, hi in BANDS), strict=True)
    knots = np.log2([n for n, _, _ in BANDS])
    return np.interp(at, knots, low), np.interp(at, knots, high)


def chunk_verdict(n_bytes: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    """True where a chunk's ratio lies outside its band: that of a whole chunk, or of the length of a last, shorter one."""
    low, high = bands(n_bytes)
    whole = n_bytes == CHUNK_BYTES
    return (ratio < np.where(whole, CHUNK_BAND[0], low)) | (ratio > np.where(whole, CHUNK_BAND[1], high))


def band_verdict(n_bytes: np.ndarray, ratio: np.ndarray, odd_bytes: np.ndarray) -> np.ndarray:
    """True where a text lies within the band of its length and little enough of it is in chunks that lie outside theirs."""
    low, high = bands(n_bytes)
    return (ratio >= low) & (ratio <= high) & (odd_bytes <= CHUNK_SHARE * n_bytes)


def measure(ids, texts: list) -> dict:
    """The columns of SCHEMA for a slice of documents."""
    press = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True)
    words = [common.word_bytes(t) for t in texts]
    n_words = np.fromiter(map(len, words), np.int64, len(words))
    out = {k: [] for k in ("word_chars", "n_symbols", "n_dup_lines", "n_bytes", "ratio")}
    sizes, ratios, n_chunks = [], [], []
    for text, own in zip(texts, words, strict=True):
        text = text or ""
        data = text.encode("utf-8", "surrogatepass")
        out["word_chars"].append(len(text) - sum(map(text.count, " \t\n\v\f\r")))
        out["n_symbols"].append(sum(map(data.count, (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">"))))
        lines = [x for x in data.split(b"\n") if x.strip()]
        out["n_dup_lines"].append(len(lines) - len(set(lines)))
        out["n_bytes"].append(len(data))
        out["ratio"].append(len(data) / len(press.compress(data)) if data else 0.0)
        chunks = [data[i : i + CHUNK_BYTES] for i in range(0, len(data), CHUNK_BYTES)] if len(data) > CHUNK_BYTES else []
        n_chunks.append(len(chunks))
        sizes += map(len, chunks)
        ratios += [len(c) / len(press.compress(c)) for c in chunks]
    out["n_chunks"] = np.array(n_chunks, np.int64)
    odd = chunk_verdict(np.array(sizes, np.int64), np.array(ratios, float))
    out["n_odd_chunks"] = common.segment_sums(odd.astype(np.int64), out["n_chunks"])
    out["odd_bytes"] = common.segment_sums(np.where(odd, sizes, 0).astype(np.int64), out["n_chunks"])
    repeated = repeat_words(words)
    failed = (n_words < MIN_WORDS) | (100 * repeated > REPEAT_PERCENT * n_words)
    good = band_verdict(*(np.array(out[k], float) for k in ("n_bytes", "ratio", "odd_bytes")))
    return out | {"doc_id": ids, "n_words": n_words, "n_repeat_words": repeated, "base_failed": failed, "kept": ~failed & good}


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with its counts, ratios and verdict (columns of SCHEMA).

    A null or empty text has no words, so it fails the base limits and isn't kept. Repeated rows each give a row; an
    empty table gives none; other columns are ignored, whatever their names. Documents are measured whole and apart
    from each other: one Arrow pass without shuffle.
    """
    return common.map_texts(docs, measure, SCHEMA, id_col, text_col)


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text passes, with all their columns; the same edge cases. One Arrow pass without shuffle."""
    return common.keep_texts(docs, lambda texts: measure(None, texts)["kept"], text_col)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(common.table(spark, sf_dir, "documents"))
