"""Byte-pair encoding and decoding by batched numpy merge rounds.

No token spans white space, so a text's words encode apart; each distinct word of a slice is normalised, split and
merged once. Where Unicode tables matter, the file's own normaliser and splitter do the first two. Merging works on the
symbols of all those words in one flat array: each round looks every neighbouring pair up by binary search over sorted
pair keys, takes each word's lowest rank and merges it, until no word has a pair.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache

import numpy as np
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession

from . import common

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
TEXT_SCHEMA = "doc_id long, ids array<int>, decoded string"
#: Distinct words whose encodings a Python worker keeps in each of two generations; a memory bound, not one on the vocabulary.
KEPT_WORDS = 300_000
#: str.split() also parts at these four, which are no white space to the tokenizer's patterns.
SEPARATORS = regex.compile("[\x1c-\x1f]")
SPACE = regex.compile(f"[{common.WHITE_SPACE}]+")
#: Words of these alone are lowered and split alike by Python and the file's own steps (a test holds this), and compose no further.
PLAIN = regex.compile("[\x00-\x7f\u00c0-\u017f]*")
NO_RANK = np.iinfo(np.int64).max


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]


class WordMerges:
    """The merge tables of a tokenizers JSON file with word ends, as sorted arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        self.normalizer, self.splitter = own.normalizer, own.pre_tokenizer
        vocab: dict[str, int] = spec["model"]["vocab"]
        suffix = spec["model"]["end_of_word_suffix"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.width = max([*vocab.values(), *self.special.values()]) + 1
        self.tokens = [""] * self.width
        for token, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = token
        self.inner = np.array([vocab[c] for c in byte_symbols()], np.int64)
        self.last = np.array([vocab[c + suffix] for c in byte_symbols()], np.int64)
        left, right, made = (np.array(x, np.int64) for x in zip(*((vocab[a], vocab[b], vocab[a + b]) for a, b in spec["model"]["merges"]), strict=True))
        keys = left * self.width + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order, made
        first_use = np.full(self.width, NO_RANK)
        np.minimum.at(first_use, left, np.arange(len(left)))
        np.minimum.at(first_use, right, np.arange(len(left)))
        #: A merge after which no pair of lower rank can arise: all its places in a word may merge in one round.
        self.settled = first_use[made] > np.arange(len(made))

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """Token ids of each word (none empty)."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        if not len(lengths):
            return []
        data = np.frombuffer(b"".join(words), np.uint8)
        symbols, ends = self.inner[data], np.cumsum(lengths)
        symbols[ends - 1] = self.last[data[ends - 1]]
        word = np.repeat(np.arange(len(words)), lengths)
        done_words, done_symbols = [], []
        while len(symbols):
            pairs = symbols[:-1] * self.width + symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, pairs), len(self.keys) - 1)
            rank = np.full(len(symbols), NO_RANK)
            hit = (self.keys[at] == pairs) & (word[:-1] == word[1:])
            rank[:-1][hit] = self.ranks[at[hit]]
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            sizes = np.diff(np.r_[starts, len(word)])
            lowest = np.repeat(np.minimum.reduceat(rank, starts), sizes)
            over = lowest == NO_RANK
            done_words.append(word[over])
            done_symbols.append(symbols[over])
            picked = np.flatnonzero((rank == lowest) & ~over)
            if not len(picked):
                break
            begins = np.r_[True, picked[1:] != picked[:-1] + 1]  # of runs of overlapping places, as in "aaa"
            run = np.maximum.accumulate(np.where(begins, np.arange(len(picked)), 0))
            first = np.r_[True, word[picked[1:]] != word[picked[:-1]]]
            picked = picked[np.where(self.settled[rank[picked]], (np.arange(len(picked)) - run) % 2 == 0, first)]
            symbols[picked] = self.made[rank[picked]]
            keep = ~over
            keep[picked + 1] = False
            symbols, word = symbols[keep], word[keep]
        word = np.concatenate(done_words)
        symbols = np.concatenate(done_symbols)[np.argsort(word, kind="stable")]
        return np.split(symbols, np.cumsum(np.bincount(word, minlength=len(words)))[:-1])

    def pieces(self, raw: str) -> list[str | int]:
        """A white-space-free word as its normalised split words, and ids of special tokens between them."""
        out: list[str | int] = []
        for part in self.special_split.split(raw) if "<|" in raw else (raw,):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                out.extend(self.pattern.findall(part.lower()) if part.isascii() or PLAIN.fullmatch(part) else self.by_file(part))
        return out

    def by_file(self, part: str) -> list[str]:
        """``part`` normalised and split by the file's own two steps, whose Unicode tables may differ from Python's."""
        part = self.normalizer.normalize_str(part)
        return [part[a:b] for _, (a, b) in self.splitter.pre_tokenize_str(part)]

    def encode_words(self, raws: list[str]) -> list[np.ndarray]:
        split = [self.pieces(r) for r in raws]
        number: dict[str, int] = {}
        for parts in split:
            for p in parts:
                if isinstance(p, str):
                    number.setdefault(p, len(number))
        merged = self.merge([w.encode("utf-8") for w in number])
        empty = np.zeros(0, np.int64)
        ids = [[merged[number[p]] if isinstance(p, str) else np.array([p]) for p in parts] for parts in split]
        return [x[0] if len(x) == 1 else np.concatenate(x) if x else empty for x in ids]

    def decode(self, ids) -> str:
        """The vocabulary has no decoder: tokens are joined by single spaces."""
        return " ".join(self.tokens[i] for i in ids)


@lru_cache(maxsize=2)
def tables(path: str) -> WordMerges:
    return WordMerges(path)


def words_of(text: str | None) -> list[str]:
    if not text:
        return []
    return [w for w in SPACE.split(text) if w] if SEPARATORS.search(text) else text.split()


@lru_cache(maxsize=4)
def recent(path: str, what: str) -> common.Recent:
    """Words encoded lately by this Python worker, over the tasks that it runs."""
    return common.Recent(KEPT_WORDS)


def _looked_up(path: str, kept: common.Recent, texts: list, make) -> list[list[str]]:
    """The words of each text, with every word in ``kept.now``."""
    lists = [words_of(t) for t in texts]
    new = kept.missing(lists)
    kept.put(new, map(make, tables(path).encode_words(new)))
    return lists


def bpe_digests(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document the token count, the SHA-256 of its ids and that of the text decoded from them (columns of SCHEMA).

    A null text counts as empty: no tokens, digests of the empty string. Repeated rows each give a row, an empty table
    none; other columns are ignored. ``path`` names a tokenizers JSON file with word ends that all executors can open.
    """
    path = path or public_tokenizers.path("word_bpe_49k.json")

    def shown(ids: np.ndarray) -> tuple[str, str]:
        own = ids.tolist()
        return " ".join(map(str, own)), tables(path).decode(own)

    def measure(ids, texts):
        kept = recent(path, "shown")
        out = {"doc_id": ids, "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for words in _looked_up(path, kept, texts, shown):
            codes, decoded = zip(*map(kept.now.__getitem__, words), strict=True) if words else ((), ())
            line = " ".join(filter(None, codes)).encode()
            out["n_tokens"].append(line.count(b" ") + 1 if line else 0)
            out["ids_sha256"].append(hashlib.sha256(line).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(" ".join(filter(None, decoded)).encode()).hexdigest())
        return out

    return common.map_texts(docs, measure, SCHEMA, id_col, text_col)


def bpe_encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded) per document: the token ids themselves and the text decoded from them. Edge cases as in bpe_digests."""
    path = path or public_tokenizers.path("word_bpe_49k.json")

    def encode(ids, texts):
        kept = recent(path, "ids")
        lists = _looked_up(path, kept, texts, lambda x: x)
        codes = [[int(i) for w in words for i in kept.now[w]] for words in lists]
        return {"doc_id": ids, "ids": codes, "decoded": [tables(path).decode(x) for x in codes]}

    return common.map_texts(docs, lambda i, t: _typed(encode(i, t)), TEXT_SCHEMA, id_col, text_col)


def _typed(cols: dict) -> dict:
    import pyarrow as pa

    return cols | {"ids": pa.array(cols["ids"], pa.list_(pa.int32())), "decoded": pa.array(cols["decoded"], pa.string())}


def op10_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(common.table(spark, sf_dir, "documents"))
