"""The tokenising operators against the tokenizers library over every code point and over random texts."""

import hashlib
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from chronoweave.llm import bpe_codec, sequence_packing

POINTS = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
#: All code points go through the first shape, those of the two lower planes through the others too.
SHAPES = (("a{0}b ", 0x110000), ("{0}", 0x20000), ("É{0}'s<|endoftext|>{0}\u0301x", 0x20000), (" {0}  A{0}1\n{0}", 0x20000))


def library(name):
    coder = Tokenizer.from_file(public_tokenizers.path(name))
    coder.no_truncation()
    coder.no_padding()
    return coder


@pytest.fixture(scope="module")
def texts():
    """Every code point in every shape, parted by spaces and line ends, in texts of moderate length; and random mixtures."""
    out = [" ".join(shape.format(chr(c)) for c in POINTS[i : i + 4096] if c < most) for shape, most in SHAPES for i in range(0, len(POINTS), 4096)]
    rng = np.random.default_rng(11)
    blocks = [(0x20, 0x7F), (0x80, 0x250), (0x300, 0x370), (0x370, 0x530), (0x530, 0x1000), (0x1000, 0x3000), (0x3000, 0xA000), (0xA000, 0xD800), (0xE000, 0x20000)]
    for _ in range(3000):
        lo, hi = blocks[int(rng.integers(len(blocks)))]
        own = [chr(int(c)) if c % 7 else " \n\t '"[int(c) % 5] for c in rng.integers(lo, hi, 30)]
        own += [chr(int(c)) for c in rng.integers(0x20, 0x180, 10)]
        out.append("".join(np.array(own, object)[rng.permutation(40)]))
    return out + ["", " ", "\n\n", "x" * 3000, "don't WE'LL 12 345"]


def test_words_encode_as_the_library_over_all_code_points(texts):
    coder = library("word_bpe_49k.json")
    path = public_tokenizers.path("word_bpe_49k.json")
    kept = bpe_codec.recent(path, "test")
    for at in range(0, len(texts), 200):
        part = texts[at : at + 200]
        lists = bpe_codec._looked_up(path, kept, part, lambda x: x)
        for text, words, want in zip(part, lists, coder.encode_batch(part, add_special_tokens=False), strict=True):
            got = [int(i) for w in words for i in kept.now[w]]
            assert got == want.ids, [hex(ord(c)) for c in text[:40]]


def test_units_encode_as_the_library_over_all_code_points(texts):
    coder = library("byte_bpe_50k.json")
    path = public_tokenizers.path("byte_bpe_50k.json")
    for at in range(0, len(texts), 200):
        part = texts[at : at + 200]
        for text, got, want in zip(part, sequence_packing.encode_texts(path, part), coder.encode_batch(part, add_special_tokens=False), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == want.ids, [hex(ord(c)) for c in text[:40]]


def test_codec_edge_cases(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, n_tokens string")
    assert bpe_codec.bpe_digests(empty).count() == 0 and bpe_codec.bpe_encode(empty).count() == 0
    long_text = "straße İstanbul " * 40_000
    rows = bpe_codec.bpe_digests(spark.createDataFrame([(1, long_text, "clash"), (1, long_text, "x"), (None, None, None)], empty.schema)).collect()
    ids = library("word_bpe_49k.json").encode(long_text, add_special_tokens=False).ids
    want = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"] == want) for r in rows) == [("1", len(ids), True), ("1", len(ids), True), ("None", 0, False)]
    assert crc32(b"") == 0 and sequence_packing.pack(empty.select("doc_id", "text")).count() == 0
