"""Best-fit packing of tokenised documents into fixed-length sequences by bin completion.

One Arrow pass tokenises and cuts; the histogram of piece lengths (at most as many rows as a sequence has tokens) is
planned by bin completion; pieces find their slots by their rank among pieces of equal length, which is a count per
(length, salt), summed in two levels, and a rank within it, so no task sees all pieces or all salts of a common length.
"""

from __future__ import annotations

import json
import os
import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .bin_completion import NODE_BUDGET, plan
from .bpe_codec import byte_symbols

SEQUENCE_TOKENS = 2048
SEPARATOR_ID = 0
#: Distinct text units whose ids a Python worker keeps in each of two generations; a memory bound.
KEPT_UNITS = 400_000
#: Pieces of one length that share a salt, about.
SALT_ROWS = 500
#: Salts of a length that are summed up together before the sums of such parts are.
PART_SALTS = 1000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_W = common.WHITE_SPACE
UNITS = regex.compile(f" ?[^{_W}]+|[{_W}]+(?![^{_W}])|[{_W}]")


@lru_cache(maxsize=2)
def tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def units(text: str) -> list[str]:
    """``text`` cut where the tokenizer's pattern always parts, before a space that a word follows: units encode apart.

    Runs of spaces take the exact pattern; single spaces, the usual case, part by plain splitting.
    """
    if "  " in text or text.endswith(" ") or "\0" in text:
        return UNITS.findall(text)
    found = text.replace(" ", "\0 ").split("\0")
    return found if found[0] else found[1:]


@lru_cache(maxsize=2)
def recent(path: str) -> common.Recent:
    """Units encoded lately by this Python worker, over the tasks that it runs."""
    return common.Recent(KEPT_UNITS)


@lru_cache(maxsize=2)
def rank_coder(path: str):
    """The same vocabulary as merge ranks, which encode several times faster; None if its merges aren't in the order of their ids.

    Where they are and each token encodes to itself, merging the pair of lowest rank and merging the pair whose union
    has the lowest id are the same.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab = model["vocab"]
    made = [vocab[a + b] for a, b in model["merges"]]
    if made != sorted(made) or len(made) + 256 != len(vocab):
        return None
    byte = {c: b for b, c in enumerate(byte_symbols())}
    return tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks={bytes(byte[c] for c in t): i for t, i in vocab.items()}, special_tokens={})


def encode_units(path: str, units: list[str]) -> list[bytes]:
    """Token ids of each unit. Those without line breaks go many to a text, parted by one, which is a token of its own there."""
    coder, ranks = tokenizer(path), rank_coder(path)
    encode = ranks.encode_ordinary if ranks else lambda text: coder.encode(text, add_special_tokens=False).ids
    breaks = encode("\n")
    out: dict[str, bytes] = {}
    simple = [u for u in units if " " not in u[1:] and u.lstrip(" ").isprintable() and not u.isspace()] if len(breaks) == 1 else []
    for at in range(0, len(simple), 500):
        group = simple[at : at + 500]
        ids = np.array(encode("\n".join(group)), "<u4")
        ends = np.flatnonzero(ids == breaks[0])
        if len(ends) == len(group) - 1:
            data, edges = ids.tobytes(), [-1, *ends.tolist(), len(ids)]
            out.update((u, data[4 * a + 4 : 4 * b]) for u, a, b in zip(group, edges, edges[1:], strict=False))
    out.update((u, np.array(encode(u), "<u4").tobytes()) for u in units if u not in out)
    return [out[u] for u in units]


def encode_texts(path: str, texts: list) -> list[bytes]:
    """Token ids of each text, as little-endian unsigned 32-bit; units met lately aren't encoded again."""
    coder, kept = tokenizer(path), recent(path)
    special = [x.content for x in coder.get_added_tokens_decoder().values()]
    plain = [None if t and any(s in t for s in special) else units(t) if t else [] for t in texts]
    new = kept.missing([p for p in plain if p])
    kept.put(new, encode_units(path, new))
    get = kept.now.__getitem__
    return [np.array(coder.encode(t, add_special_tokens=False).ids, "<u4").tobytes() if p is None else b"".join(map(get, p)) for t, p in zip(texts, plain, strict=True)]


def cut(n: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens: full pieces, but for a shorter first one."""
    first = n % most
    out = [(0, first)] if first else []
    return out + [(s, most) for s in range(first, n, most)]


def pieces(docs: DataFrame, path: str, most: int = SEQUENCE_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of every document (columns of PIECES); a null text is one separator token."""
    end = np.array([SEPARATOR_ID], "<u4").tobytes()

    def measure(ids, texts):
        rows = [(i, k, s, n, zlib.crc32(data[4 * s : 4 * (s + n)])) for i, data in enumerate(x + end for x in encode_texts(path, texts)) for k, (s, n) in enumerate(cut(len(data) // 4, most))]
        at, piece, start, length, crc = (np.array(x, np.int64) for x in zip(*rows, strict=True))
        return {"doc_id": ids.take(pa.array(at)), "piece": piece.astype(np.int32), "start": start, "length": length, "ids_crc32": crc}

    return common.map_texts(docs, measure, PIECES, id_col, text_col)


def slots(counts: dict[int, int], capacity: int, budget: int = NODE_BUDGET) -> np.ndarray:
    """Rows (length, first slot, bins, copies, first bin, offset) that give the ``counts[length]`` slots of each length a place.

    Slot s of a length lies in the last row of that length whose first slot is at most s; rows are sorted so.
    """
    used: dict[int, int] = {}
    rows, bin_id = [], 0
    for filling, bins in plan(counts, capacity, budget):
        at = 0
        for length in sorted(set(filling), reverse=True):
            copies = filling.count(length)
            rows.append((length, used.get(length, 0), bins, copies, bin_id, at))
            used[length] = used.get(length, 0) + bins * copies
            at += copies * length
        bin_id += bins
    return np.array(sorted(rows), np.int64).reshape(-1, 6)


def _sums_before(counts: DataFrame, keys: list[str], order: str, name: str) -> DataFrame:
    """(keys, order, name): the sum of ``n`` over the rows of the keys that come earlier."""
    return counts.select(*keys, order, (F.sum("n").over(Window.partitionBy(*keys).orderBy(order)) - F.col("n")).alias(name))


def pack(docs: DataFrame, path: str | None = None, most: int = SEQUENCE_TOKENS, id_col: str = "doc_id", text_col: str = "text", budget: int = NODE_BUDGET) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of every document.

    A null or empty text is a document of one separator token. Repeated rows are documents of their own; rows that are
    equal in all of (id, piece, ids) may swap places. A null id keeps its rows. An empty table gives no rows; other
    columns are ignored. Only documents above ``most`` tokens are cut.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    cut_up = common.written(pieces(docs, path, most, id_col, text_col), "packing-pieces")
    counts = {int(r["length"]): int(r["n"]) for r in cut_up.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``most`` rows
    places = slots(counts, most, budget)
    salts = cut_up.sparkSession.createDataFrame([(k, 1 + n // SALT_ROWS) for k, n in counts.items()], "length long, salts long")  # at most ``most`` rows
    salted = cut_up.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("salts"))).drop("salts")
    by_salt = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    parts = by_salt.withColumn("part", F.floor(F.col("salt") / PART_SALTS))
    before_part = _sums_before(parts.groupBy("length", "part").agg(F.sum("n").alias("n")), ["length"], "part", "ahead")
    inside = _sums_before(parts, ["length", "part"], "salt", "within")
    before = inside.join(before_part, ["length", "part"]).select("length", "salt", (F.col("ahead") + F.col("within")).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1
    ranked = salted.withColumn("rank", own).join(before, ["length", "salt"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("slot"))

    def place(batches):
        key = places[:, 0] * (1 << 48) + places[:, 1]
        for batch in batches:
            cols = {n: batch.column(n) for n in batch.schema.names}
            length, slot = (cols[n].to_numpy(zero_copy_only=False) for n in ("length", "slot"))
            row = places[np.searchsorted(key, length * (1 << 48) + slot, side="right") - 1].reshape(-1, 6)
            bin_no, copy = np.divmod(slot - row[:, 1], row[:, 3])
            out = [cols[n] for n in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*out, pa.array(row[:, 4] + bin_no), pa.array(row[:, 5] + copy * length)], names=[*("doc_id", "piece", "start", "length", "ids_crc32"), "sequence_id", "offset"])

    return ranked.mapInArrow(place, f"{PIECES}, sequence_id long, offset long")


def op5_sequence_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"))
