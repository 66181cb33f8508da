"""SimHash near-duplicates by pigeonhole blocks.

Fingerprints are made in one Arrow pass. Equal fingerprints become one node. With ``k`` differing bits allowed and the
64 bits cut into ``k + extra`` blocks, a close pair agrees on at least ``extra`` blocks, so nodes are joined on each
choice of ``extra`` blocks and verified. A block value that very many fingerprints share isn't joined with itself: its
members are linked through bit flips instead (two fingerprints within two bits share a value at distance one from
both), which is exact and linear in the group. Links stay in Spark throughout; components come from rounds of joins.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components

MAX_DISTANCE = 2
EXTRA_BLOCKS = 2
SHINGLE_WORDS = 3
#: A block value with more fingerprints than this is resolved by bit flips: a member then makes 65 rows instead of so many pairs.
HOT_BLOCK = 64


def fingerprints(texts: list, k: int = SHINGLE_WORDS) -> np.ndarray:
    """64-bit SimHash of each text's ``k``-word shingles, repeats included (int64; zero for texts without words)."""
    digest, hashes, counts = xxhash.xxh64_intdigest, [], []
    for text in texts:
        words = common.word_bytes(text, lower=True)
        n = len(words)
        if n <= k:
            own = [digest(b" ".join(words), 42)] if n else []
        else:
            joined = memoryview(b" ".join(words))
            sizes = np.fromiter(map(len, words), np.int64, n)
            ends = np.cumsum(sizes + 1) - 1
            own = [digest(joined[a:b], 42) for a, b in zip((ends - sizes)[: n - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)]
        hashes.append(np.array(own, np.uint64))
        counts.append(len(own))
    out = np.zeros(len(texts), np.uint64)
    for i, own in enumerate(hashes):
        if counts[i]:
            set_bits = np.zeros(64, np.int64)
            for at in range(0, counts[i], 65536):  # bounded for very long texts
                bits = np.unpackbits(own[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                set_bits += bits.sum(axis=0, dtype=np.int64)
            out[i] = np.packbits(2 * set_bits > counts[i], bitorder="little").view(np.uint64)[0]
    return out.view(np.int64)


def _block(fp: Column, n_blocks: int, at: int) -> Column:
    edges = [round(64 * i / n_blocks) for i in range(n_blocks + 1)]
    width = edges[at + 1] - edges[at]
    return F.shiftrightunsigned(fp, edges[at]).bitwiseAND(F.lit((1 << width) - 1))


def close_links(nodes: DataFrame, distance: int = MAX_DISTANCE, extra: int = EXTRA_BLOCKS, hot: int = HOT_BLOCK) -> DataFrame:
    """Links (src, dst) that connect just the ``nodes`` (node, fp; fp distinct) within ``distance`` differing bits.

    ``distance`` is 0, 1 or 2; others are an error. Members of hot block values are linked through flips of a bit: at
    distance 1 to the node that a flip gives, at 2 in stars around a shared neighbour, instead of by all pairs.
    """
    if distance not in (0, 1, 2):
        raise ValueError("distance must be 0, 1 or 2")
    n_blocks = distance + extra
    choices = list(combinations(range(n_blocks), extra))
    keys = F.array(*(F.struct(F.lit(i).cast("byte").alias("choice"), F.xxhash64(*(_block(F.col("fp"), n_blocks, b) for b in choice)).alias("value")) for i, choice in enumerate(choices)))
    keyed = nodes.select("node", "fp", F.explode(keys).alias("k")).select("node", "fp", "k.choice", "k.value")
    sizes = keyed.groupBy("choice", "value").agg(F.count("*").alias("size")).filter("size > 1")
    keyed = common.written(keyed.join(sizes, ["choice", "value"]), "simhash-blocks")
    few = keyed.filter(F.col("size") <= hot)
    a, b = (few.select("choice", "value", F.col("node").alias(f"node_{x}"), F.col("fp").alias(f"fp_{x}")) for x in "ab")
    pairs = (
        a.join(b, ["choice", "value"])
        .filter((F.col("node_a") < F.col("node_b")) & (F.bit_count(F.col("fp_a").bitwiseXOR(F.col("fp_b"))) <= distance))
        .select(F.col("node_a").alias("src"), F.col("node_b").alias("dst"))
    )
    if distance == 0:  # distinct fingerprints have no links
        return pairs.distinct()
    many = keyed.filter(F.col("size") > hot).select("node", "fp").distinct()
    flips = F.array(*(F.col("fp").bitwiseXOR(F.lit((1 << i) - (1 << 64 if i == 63 else 0))) for i in range(64)))
    if distance == 1:
        near = many.select(F.col("node").alias("node_a"), F.explode(flips).alias("fp"))
        ends = near.join(many, "fp").filter("node_a < node")
        return pairs.unionByName(ends.select(F.col("node_a").alias("src"), F.col("node").alias("dst"))).distinct()
    near = many.select("node", F.explode(F.concat(F.array("fp"), flips)).alias("near"))
    centre = near.groupBy("near").agg(F.min("node").alias("src"), F.count("*").alias("size")).filter("size > 1").select("near", "src")
    stars = near.join(centre, "near").filter("node != src").select("src", F.col("node").alias("dst"))
    return pairs.unionByName(stars).distinct()


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = MAX_DISTANCE, shingle_words: int = SHINGLE_WORDS, hot: int = HOT_BLOCK) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row: its fingerprint and the smallest id reachable over close fingerprints.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased. A null, empty or blank text has fingerprint
    zero and is linked like any other. Repeated rows keep a row each; ids that repeat with other texts join those
    texts' groups only through their fingerprints. An empty table gives no rows; other columns are ignored. Rows whose
    id is null link others like any row; they get the component of the rows with ids, or null if none has one.
    """
    spec = "doc_id long, fp long"
    marked = common.map_texts(docs, lambda ids, texts: {"doc_id": ids, "fp": fingerprints(texts, shingle_words)}, spec, id_col, text_col)
    return grouped(common.written(marked, "simhash-marked"), distance, hot)


def grouped(marked: DataFrame, distance: int = MAX_DISTANCE, hot: int = HOT_BLOCK) -> DataFrame:
    """(doc_id, fingerprint, component_id) for rows (doc_id, fp), as near_duplicate_groups has them."""
    counted = common.written(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")), "simhash-nodes")
    links = common.written(close_links(counted.select(F.col("fp").alias("node"), "fp"), distance, hot=hot), "simhash-links")
    found = components(links).withColumnRenamed("node", "fp")
    placed = common.written(counted.join(found, "fp", "left").withColumn("component", F.coalesce("component", "fp")), "simhash-placed")
    lowest = placed.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("nodes"))
    reach = common.join_counted(placed, common.written(lowest, "simhash-lowest"), "component", "nodes").select("fp", "component_id", "rows")
    reach = common.written(reach, "simhash-reach")
    return common.join_counted(marked, reach, "fp", "rows").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that represent their group: the one of smallest id.

    A row that repeats an id counts as the same document, so one of such rows stays. Rows without an id take part
    under a number made of their text, above all usual ids, so they stay only where no row with an id is close.
    """
    number = F.coalesce(F.col(id_col).cast("long"), F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64(text_col), 2))
    own = common.free_name(docs, "__own")
    named = docs.withColumn(own, number)
    groups = near_duplicate_groups(named, own, text_col)
    first = groups.filter("doc_id = component_id").select(F.col("doc_id").alias(own)).distinct()
    return named.join(first, own, "left_semi").dropDuplicates([own]).select(*docs.columns)


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_groups(common.table(spark, sf_dir, "documents"))
