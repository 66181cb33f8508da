"""The operators over documents against brute force: quality rules, SimHash groups, packing, BPE, languages."""

import hashlib
import re
from collections import Counter
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

from chronoweave.llm import bin_completion, bpe_codec, common, language_crf, quality_rules, sequence_packing, simhash_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PROSE = "The quick brown fox jumps over the lazy dog while seven wizards quietly examine twelve jars of excellent plum jam. "
DOCS = [
    (1, PROSE), (2, PROSE.upper()), (3, None), (4, ""), (5, " \n\t "), (6, "one two three four five " * 40), (7, "é😀 word"), (8, "a b\na b\n\nc\na b"),
    (9, PROSE * 3 + "extra"), (1, PROSE), (None, "no id at all"), (11, "#*$%&|<> x" * 5), (12, "".join(chr(33 + i * 7919 % 90) for i in range(5000))), (13, "word " * 60_000),
    (14, PROSE + " Ångström"), (15, "\x1cone\x1dtwo \x85three"),
]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string").withColumns({"kept": F.lit("clash"), "fp": F.lit(1), "lang": F.lit("en")})


def key(i):
    return str(i)


def test_quality_counts_equal_brute_force(docs):
    got = {(key(r["doc_id"]), r["n_words"]): r for r in quality_rules.quality_rules(docs).collect()}
    for i, t in DOCS:
        words = WORD.findall(t or "")
        grams = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
        hit = set()
        for k in range(len(words) - 4):
            if grams[tuple(words[k : k + 5])] > 1:
                hit.update(range(k, k + 5))
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        r = got[key(i), len(words)]
        assert (r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (sum(map(len, words)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit))
        failed = len(words) < 10 or 100 * len(hit) > 20 * len(words)
        assert r["base_failed"] == failed and not (failed and r["kept"])


def test_bands_reject_repetition_and_noise(spark):
    rng = np.random.default_rng(3)
    noise = " ".join("".join(chr(c) for c in rng.integers(33, 126, 9)) for _ in range(300))
    menu = " | ".join(f"item {i}" for i in range(400))
    verdict = quality_rules.measure(None, [PROSE, noise, menu])
    assert verdict["kept"].tolist() == [True, False, False] and not verdict["base_failed"].any()
    kept = quality_rules.keep_good(spark.createDataFrame([(1, PROSE, "a"), (2, noise, "b"), (3, None, "c")], "doc_id long, text string, source string"))
    assert [tuple(r) for r in kept.collect()] == [(1, PROSE, "a")]


def brute_verdict(text):
    """kept by the module's bands, worked out chunk by chunk with an own interpolation."""
    data = text.encode()
    press = zstandard.ZstdCompressor(level=quality_rules.LEVEL, write_content_size=True)

    def band(n):
        knots = quality_rules.BANDS
        if n <= knots[0][0]:
            return knots[0][1:]
        for (a, lo, hi), (b, lo2, hi2) in zip(knots, knots[1:]):
            if n <= b:
                x = (np.log2(n) - np.log2(a)) / (np.log2(b) - np.log2(a))
                return lo + x * (lo2 - lo), hi + x * (hi2 - hi)
        return knots[-1][1:]

    ratio = lambda d: len(d) / len(press.compress(d))
    lo, hi = band(len(data))
    odd = 0
    if len(data) > quality_rules.CHUNK_BYTES:
        for i in range(0, len(data), quality_rules.CHUNK_BYTES):
            own = data[i : i + quality_rules.CHUNK_BYTES]
            low, high = quality_rules.CHUNK_BAND if len(own) == quality_rules.CHUNK_BYTES else band(len(own))
            odd += 0 if low <= ratio(own) <= high else len(own)
    return lo <= ratio(data) <= hi and odd <= quality_rules.CHUNK_SHARE * len(data)


def test_verdicts_equal_brute_force():
    rng = np.random.default_rng(6)
    vocabulary = ["".join(chr(97 + int(c)) for c in rng.integers(0, 26, rng.integers(2, 10))) for _ in range(900)]
    prose = lambda n: " ".join(vocabulary[int(min(899, abs(rng.normal()) * 200))] for _ in range(n))
    noise = lambda n: "".join(chr(int(c)) for c in rng.integers(33, 126, n))
    texts = [prose(int(n)) for n in rng.integers(10, 3000, 60)] + [prose(600)[:4096] + noise(n) for n in (1, 30, 500, 1500, 4000)] + [prose(900)[:6000] + "ab " * n for n in (1, 200, 2000)] + [noise(5000), "x y " * 3000]
    got = quality_rules.measure(None, texts)
    want = [brute_verdict(t) for t in texts]
    assert [k for k, f in zip(got["kept"], got["base_failed"], strict=True) if not f] == [w for w, f in zip(want, got["base_failed"], strict=True) if not f]
    assert got["n_chunks"].tolist() == [-(-len(t.encode()) // 4096) if len(t.encode()) > 4096 else 0 for t in texts]


def test_a_bad_tail_counts():
    good = quality_rules.measure(None, ["x" * 4096 + "y" * n for n in (1, 3000)])
    assert good["n_chunks"].tolist() == [2, 2] and good["odd_bytes"].tolist()[1] == 4096 + 3000
    assert quality_rules.chunk_verdict(np.array([1500, 1500, 4096]), np.array([1.9, 1.1, 1.1])).tolist() == [False, True, True]
    assert quality_rules.band_verdict(np.array([6000.0]), np.array([2.2]), np.array([1904.0])).tolist() == [False]


def test_quality_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, kept boolean")
    assert quality_rules.quality_rules(empty).count() == 0 and quality_rules.keep_good(empty).columns == empty.columns


def fingerprint(text):
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")]
    grams = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_groups(fps, distance=2):
    parent = {i: i for i in fps}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in fps:
        for j in fps:
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i in fps}


def test_simhash_groups_equal_brute_force(docs):
    got = simhash_dedup.near_duplicate_groups(docs).collect()
    fps = {i: fingerprint(t) for i, t in DOCS if i is not None}
    groups = brute_groups(fps)
    assert len(got) == len(DOCS)
    for r in got:
        if r["doc_id"] is not None:
            assert r["fingerprint"] == f"{fps[r['doc_id']]:016x}" and r["component_id"] == groups[r["doc_id"]]


@pytest.mark.parametrize("distance", [0, 1, 2])
@pytest.mark.parametrize("hot", [1, 3, 64])
def test_close_fingerprints_link_in_hot_blocks_too(spark, hot, distance):
    rng = np.random.default_rng(hot)
    base = [int(x) for x in rng.integers(0, 1 << 62, 12)]
    fps = {base[0]}
    for b in base:
        for _ in range(12):
            for bit in rng.integers(0, 64, rng.integers(0, 4)):
                b ^= 1 << int(bit)
            fps.add(b)
    ids = dict(enumerate(sorted(fps)))
    nodes = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in ids.items()], "node long, fp long")
    links = simhash_dedup.close_links(nodes, distance, hot=hot)
    if distance < 2:  # then every link is between close nodes
        assert {(r["src"], r["dst"]) for r in links.collect()} == {(i, j) for i in ids for j in ids if i < j and (ids[i] ^ ids[j]).bit_count() <= distance}
    found = {r["node"]: r["component"] for r in simhash_dedup.components(links).collect()}
    assert {i: found.get(i, i) for i in ids} == brute_groups(ids, distance)


@pytest.mark.parametrize("middle", [None, 7])
def test_rows_without_id_link_others(spark, middle):
    """A chain of two-bit steps holds through a row without an id; what has none at all stays without."""
    marked = spark.createDataFrame([(1, 0b0011), (middle, 0), (2, 0b1100), (None, 1 << 40), (None, -1), (9, (1 << 40) + 7 * (1 << 50))], "doc_id long, fp long")
    got = {(r["doc_id"], int(r["fingerprint"], 16)): r["component_id"] for r in simhash_dedup.grouped(marked).collect()}
    assert got == {(1, 3): 1, (middle, 0): 1, (2, 12): 1, (None, 1 << 40): 1, (None, (1 << 64) - 1): None, (9, (1 << 40) + 7 * (1 << 50)): 9}


@pytest.mark.parametrize("distance", [-1, 3, 9])
def test_other_distances_are_refused(spark, distance):
    with pytest.raises(ValueError, match="distance"):
        simhash_dedup.close_links(spark.createDataFrame([], "node long, fp long"), distance)


def test_one_of_each_group_stays(docs):
    kept = simhash_dedup.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    ids = sorted(str(r["doc_id"]) for r in kept.collect())
    fps = {i: fingerprint(t) for i, t in DOCS if i is not None}
    assert ids == sorted([str(i) for i, g in brute_groups(fps).items() if i == g] + ["None"])
    assert simhash_dedup.keep_one_of_each(docs.limit(0)).count() == 0
    clash = docs.withColumn("__own", F.lit("mine")).withColumn("__OWN_", F.lit("too"))
    assert {tuple(r)[-2:] for r in simhash_dedup.keep_one_of_each(clash).collect()} == {("mine", "too")}


def test_hot_keys_join_by_broadcast_to_the_same_rows(spark):
    big = spark.range(1000).select((F.col("id") % 7 * (F.col("id") % 2)).alias("k"), F.col("id").alias("v"))
    small = big.groupBy("k").agg(F.max("v").alias("top"), F.count("*").alias("n")).filter("k != 3")
    for how in ("inner", "left"):
        want = sorted(map(str, big.join(small.drop("n"), "k", how).collect()))
        for least in (1, 400, 10_000):
            assert sorted(map(str, common.join_counted(big, small, "k", "n", how, least).collect())) == want


def test_packing_is_whole_and_gapless(docs):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = sequence_packing.pack(docs, most=64).collect()
    for (i, t), count in Counter(DOCS).items():
        ids = [*coder.encode(t or "", add_special_tokens=False).ids, 0]
        own = sorted((r["start"], r["piece"], r["length"], r["ids_crc32"]) for r in rows if r["doc_id"] == i)
        cuts = sequence_packing.cut(len(ids), 64)
        assert own == sorted((s, k, n, crc32(np.array(ids[s : s + n], "<u4").tobytes())) for k, (s, n) in enumerate(cuts) for _ in range(count))
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    counts = Counter(r["length"] for r in rows)
    assert bin_completion.lower_bound(counts, 64) <= len(bins) <= sum(n for _, n in bin_completion.best_fit(counts, 64))
    assert sequence_packing.pack(docs.limit(0)).count() == 0


def test_bin_completion_beats_or_equals_best_fit():
    rng = np.random.default_rng(5)
    for _ in range(30):
        counts = dict(Counter(int(x) for x in rng.integers(1, 50, 60)))
        plan = bin_completion.plan(counts, 50)
        used = Counter()
        for filling, n in plan:
            assert sum(filling) <= 50
            for x in filling:
                used[x] += n
        assert dict(used) == counts
        assert bin_completion.lower_bound(counts, 50) <= sum(n for _, n in plan) <= sum(n for _, n in bin_completion.best_fit(counts, 50))


def test_bpe_equals_the_library(docs):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    coder.no_truncation()
    coder.no_padding()
    got = Counter((key(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe_codec.bpe_digests(docs).collect())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = Counter()
    for i, t in DOCS:
        ids = coder.encode(t or "", add_special_tokens=False).ids
        want[key(i), len(ids), sha(" ".join(map(str, ids))), sha(coder.decode(ids, skip_special_tokens=False))] += 1
    assert got == want


def test_languages_are_learned_and_held_out_is_right(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = language_crf.identify_languages(table).join(table.select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(rows) == table.count()
    assert all(r["held_out"] == (crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    known = [r for r in rows if r["held_out"] and r["lang"]]
    assert sum(r["lang"] == r["lang_pred"] for r in known) >= 0.9 * len(known)


def test_language_edge_cases(docs):
    rows = {key(r["doc_id"]): r for r in language_crf.identify_languages(docs).collect()}
    assert rows["3"]["lang_pred"] == rows["4"]["lang_pred"] == rows["5"]["lang_pred"] == "und" and rows["3"]["score"] == 0
    assert rows["1"]["lang_pred"] == "en"
    kept = language_crf.keep_known(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} & {3, 4, 5} == set()


def test_code_switched_words_change_language():
    rng = np.random.default_rng(1)
    words = {"x": [b"ouxe", b"leau", b"aieux", b"eaux"], "y": [b"kzk", b"zkrk", b"krz", b"rkzz"]}
    windows = [(y, [ws[k] for k in rng.integers(0, 4, 12)]) for y, ws in words.items() for _ in range(60)]
    model = language_crf.train(windows)
    _, prob, _ = language_crf.label_words(model, ["ouxe leau eaux kzk krz zkrk"])
    assert prob.argmax(axis=1).tolist() == [0, 0, 0, 1, 1, 1]
