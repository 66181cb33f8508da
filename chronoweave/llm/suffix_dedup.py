"""Bytes in substrings that stand elsewhere too, from merged Burrows-Wheeler transforms.

Texts lie in blocks. One pass cuts each text into contexts: stretches of neighbouring windows whose least gram is the
same, so equal windows, wherever they stand, are in contexts of one key. Equal contexts are counted before anything
moves, and those of keys that stand alone go. What is left is gathered by key, a bounded batch at a time: its contexts
are shards, each with its own transform over symbols of many bytes, and the shards' interleave is refined symbol by
symbol, without sorting suffixes again, until it is in the order of whole windows. Stretches of it that agree so far
are the repeated windows. A key with more contexts than a batch holds is dealt by window instead.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Bytes of a window, of the grams whose least one keys it, and of a symbol of the transforms.
WINDOW = 400
GRAM = 64
SYMBOL = 50
#: Bytes of text in a block and in a slice of the first pass; a longer text is one of its own.
BLOCK_BYTES, SLICE_BYTES = 8 << 20, 1 << 20
#: Bytes of contexts merged at a time (whole keys) and in a shard; and those from which a key is dealt by window.
BATCH_BYTES, SHARD_BYTES, HOT_BYTES = 60_000, 15_000, 1 << 20
MIX = np.uint64(0xD6E8FEB86659FD93)
SPANS = "array<struct<start:long, end:long>>"


def gram_hashes(data: np.ndarray, n: int = GRAM) -> np.ndarray:
    """A hash of every ``n`` bytes (a power of two), made by doubling."""
    h, size = data.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 1
    while size < n:
        h = h[:-size] * MIX + (h[size:] ^ (h[size:] >> np.uint64(29)))
        size *= 2
    h ^= h >> np.uint64(32)
    return h * MIX


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    least, size = values, 1
    while size * 2 <= width:
        least, size = np.minimum(least[:-size], least[size:]), size * 2
    rest = width - size
    return np.minimum(least[:-rest], least[rest:]) if rest else least


def contexts_of(texts: list[bytes], window: int = WINDOW, gram: int = GRAM) -> dict[str, np.ndarray]:
    """key, digest, row, lo, hi, again: stretches lo to hi of window starts in the texts' rows with one least gram, their bytes' digest,
    and whether the gram stands in the stretch more than once, so that a window of it may repeat within."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    none = np.zeros(0, np.int64)
    if lengths.max(initial=0) < window:
        return {k: none for k in ("key", "digest", "row", "lo", "hi")} | {"again": none.astype(bool)}
    joined = b"".join(texts)
    hashes = gram_hashes(np.frombuffer(joined, np.uint8), gram)
    width = window - gram + 1
    least = sliding_min(hashes, width)
    firsts = np.cumsum(lengths) - lengths
    inside = np.zeros(len(least) + 1, np.int64)
    has = lengths >= window
    inside[firsts[has]] = 1
    inside[(firsts + lengths - window + 1)[has]] -= 1
    inside = np.cumsum(inside)[:-1] > 0
    fresh = np.r_[True, least[1:] != least[:-1]] | np.r_[True, ~inside[:-1]]
    lo = np.flatnonzero(inside & fresh)
    stops = np.flatnonzero(np.append(~inside | fresh, True))
    hi = stops[np.searchsorted(stops, lo, side="right")] - 1
    key = least[lo]
    # The places of each stretch's gram in it: sought among the few hashes that are small enough.
    kinds, of = np.unique(key, return_inverse=True)
    low = np.flatnonzero(hashes <= kinds[-1])
    kind = np.minimum(np.searchsorted(kinds, hashes[low]), len(kinds) - 1)
    hit = kinds[kind] == hashes[low]
    stand = np.sort(kind[hit] * len(joined) + low[hit])
    count = np.searchsorted(stand, of * len(joined) + hi + width - 1, side="right") - np.searchsorted(stand, of * len(joined) + lo)
    view, digest = memoryview(joined), xxhash.xxh3_64_intdigest
    digests = np.fromiter((digest(view[a:b]) for a, b in zip(lo.tolist(), (hi + window).tolist(), strict=True)), np.uint64, len(lo))
    row = np.searchsorted(firsts, lo, side="right") - 1  # of texts that begin at one place the last, the only one with bytes
    return {"key": key.view(np.int64), "digest": digests.view(np.int64), "row": row, "lo": lo - firsts[row], "hi": hi - firsts[row], "again": count > 1}


def stable_order(values: np.ndarray) -> np.ndarray:
    """The stable order of integers below 2^32, by counting sorts of 16 bits."""
    order = np.argsort(values.astype(np.uint16), kind="stable")
    if values.max(initial=0) >> 16:
        order = order[np.argsort((values[order] >> 16).astype(np.uint16), kind="stable")]
    return order


def symbols_of(data: np.ndarray, size: int = SYMBOL) -> np.ndarray:
    """The rank, from 1, of the ``size`` bytes from every place, among all of them."""
    rank, width = data.astype(np.int64), 1
    while width < size:
        step = min(width, size - width)
        width += step
        pair = rank[: len(rank) - step] * (int(rank.max()) + 1) + rank[step:]
        rank = np.unique(pair, return_inverse=True)[1] if width >= 4 else pair
    return rank + 1


class Shard:
    """The transform of some contexts, seen as strings of symbols ``size`` bytes apart: one string for each of a context's first ``size`` places.

    Slots are the suffixes in order of their first ``depth`` symbols, the empty ones first. ``transform`` has the symbol
    before each (0 at a string's start), ``back`` the slot of the suffix that begins with it, ``place`` where it stands.
    """

    def __init__(self, symbols: np.ndarray, firsts: np.ndarray, lengths: np.ndarray, depth: int, size: int):
        counts = lengths - size + 1
        owner = np.repeat(np.arange(len(firsts)), counts)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        place, left = firsts[owner] + at, counts[owner] - at  # left: places from here to the context's last symbol
        order = np.arange(len(place))
        for h in range(depth - 1, -1, -1):
            own = np.where(left[order] > h * size, symbols[np.minimum(place[order] + h * size, len(symbols) - 1)], 0)
            order = order[stable_order(own)]
        place, at = place[order], at[order]
        last = np.concatenate([np.arange(max(0, n - size), n) + f for f, n in zip(firsts, counts, strict=True)])
        self.place = np.r_[np.full(len(last), -1), place]
        self.transform = np.r_[symbols[last], np.where(at >= size, symbols[place - size], 0)]
        self.back = np.empty(len(self.place), np.int64)
        self.back[stable_order(self.transform)] = np.arange(len(self.place))


def merged(shards: list[Shard], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The shards' suffixes interleaved in order of their first ``depth`` symbols: the place of each, and the number of its stretch of equal ones.

    The interleave begins as the shards one behind the other. A round deals its slots by the symbol before each, in
    order; the shard's next slot with that symbol is then next. After h rounds it is sorted by h symbols, and stretches
    that agree on them are those with one symbol before one earlier stretch.
    """
    bases = np.cumsum([0, *(len(s.place) for s in shards)])
    place, transform = (np.concatenate([getattr(s, k) for s in shards]) for k in ("place", "transform"))
    back = np.concatenate([s.back + base for s, base in zip(shards, bases, strict=False)])
    slots, stretch = np.arange(bases[-1]), np.zeros(bases[-1], np.int64)
    for _ in range(depth):
        symbol = transform[slots]
        order = stable_order(symbol)
        symbol, stretch = symbol[order], stretch[order]
        slots = back[slots[order]]
        stretch = np.cumsum(np.r_[False, (symbol[1:] != symbol[:-1]) | (stretch[1:] != stretch[:-1])])
    return place[slots], stretch


def repeated_windows(contexts: list[bytes], counts: np.ndarray, window: int = WINDOW, size: int = SYMBOL, shard_bytes: int = SHARD_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, lo, hi): stretches of window starts whose windows stand twice or more in ``contexts``, each of which stands ``counts`` times."""
    lengths = np.fromiter(map(len, contexts), np.int64, len(contexts))
    firsts = np.cumsum(lengths) - lengths
    data = np.frombuffer(b"".join(contexts), np.uint8)
    symbols, depth = symbols_of(data, size), window // size
    part = np.cumsum(lengths) // shard_bytes
    shards = [Shard(symbols, firsts[own], lengths[own], depth, size) for own in (part == k for k in np.unique(part))]
    place, stretch = merged(shards, depth)
    owner = np.searchsorted(firsts, place, side="right") - 1
    whole = (place >= 0) & (place + window <= (firsts + lengths)[owner])
    place, stretch, owner = place[whole], stretch[whole], owner[whole]
    twice = np.bincount(stretch, counts[owner])[stretch] > 1 if len(stretch) else np.zeros(0, bool)
    place = np.sort(place[twice])
    owner = np.searchsorted(firsts, place, side="right") - 1
    opens = np.r_[True, (place[1:] != place[:-1] + 1) | (owner[1:] != owner[:-1])][: len(place)]
    closes = np.r_[opens[1:], True][: len(place)]
    own = owner[opens]
    return own, place[opens] - firsts[own], place[closes] - firsts[own]


def _found(gathered: DataFrame, window: int, size: int, batch_bytes: int, shard_bytes: int) -> DataFrame:
    """(key, digest, a, b): repeated stretches of ``gathered`` contexts (key, digest, n, bytes), whole keys at a time."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        keys, digests, counts, contexts = zip(*rows, strict=True)
        own, a, b = repeated_windows(list(contexts), np.array(counts, np.int64), window, size, shard_bytes)
        return pa.RecordBatch.from_arrays([pa.array(np.array(keys, np.int64)[own]), pa.array(np.array(digests, np.int64)[own]), pa.array(a), pa.array(b)], names=["key", "digest", "a", "b"])

    def run(batches):
        held, size_held, now = [], 0, None
        for batch in batches:
            for row in zip(*(batch.column(n).to_pylist() for n in ("key", "digest", "n", "bytes")), strict=True):
                if row[0] != now and size_held >= batch_bytes:
                    yield solve(held)
                    held, size_held = [], 0
                now = row[0]
                held.append(row)
                size_held += len(row[3])
        if held:
            yield solve(held)

    return gathered.repartition("key").sortWithinPartitions("key").mapInArrow(run, "key long, digest long, a long, b long")


def _found_by_window(gathered: DataFrame, window: int) -> DataFrame:
    """The same for keys of many contexts: their windows are counted by digest, each a row, so no task holds a key. Then each context's neighbours are one stretch."""

    def windows(batches):
        for batch in batches:
            for key, digest, n, data in zip(*(batch.column(c).to_pylist() for c in ("key", "digest", "n", "bytes")), strict=True):
                view, hashed = memoryview(data), xxhash.xxh3_128_digest
                total = len(data) - window + 1
                for begin in range(0, total, 1 << 14):
                    at = range(begin, min(total, begin + (1 << 14)))
                    yield pa.RecordBatch.from_arrays([pa.array([x] * len(at), pa.int64()) for x in (key, digest, n)] + [pa.array(at, pa.int64()), pa.array([hashed(view[i : i + window]) for i in at], pa.binary())], names=["key", "digest", "n", "a", "own"])

    rows = common.written(gathered.mapInArrow(windows, "key long, digest long, n long, a long, own binary"), "suffix-windows")
    twice = rows.groupBy("own").agg(F.sum("n").alias("n"), F.count("*").alias("rows")).filter("n > 1").select("own", "rows")
    found = common.join_counted(rows, common.written(twice, "suffix-twice"), "own", "rows")
    context = Window.partitionBy("key", "digest")
    stretch = F.col("a") - F.row_number().over(context.orderBy("a"))
    return found.select("key", "digest", "a", stretch.alias("stretch")).groupBy("key", "digest", "stretch").agg(F.min("a").alias("a"), F.max("a").alias("b")).drop("stretch")


def _gathered(blocks: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """(key, digest, n, bytes) of ``wanted`` contexts, read from the blocks where they stand; texts aren't shuffled."""

    def read(texts: pa.Table, asked: pa.Table) -> pa.Table:
        if not asked.num_rows or not texts.num_rows:
            return pa.table({"key": pa.array([], pa.int64()), "digest": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "bytes": pa.array([], pa.binary())})
        text = dict(zip(texts.column("row").to_pylist(), texts.column("text"), strict=True))
        data = {i: _bytes(text[i].as_py()) for i in set(asked.column("row").to_pylist())}
        cut = [data[i][lo : hi + window] for i, lo, hi in zip(*(asked.column(c).to_pylist() for c in ("row", "lo", "hi")), strict=True)]
        return asked.select(["key", "digest", "n"]).append_column("bytes", pa.array(cut, pa.binary()))

    asked = wanted.select("block", "row", "lo", "hi", "key", "digest", "n")
    return blocks.select("block", "row", "text").groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(read, "key long, digest long, n long, bytes binary")


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _cut(blocks: DataFrame, covered: DataFrame, window: int) -> DataFrame:
    """One row per text of ``blocks`` without what windows from ``a`` to ``b`` of its ``covered`` rows hold."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def cut(texts: pa.Table, found: pa.Table) -> pa.Table:
        row, a, b = (found.column(c).to_numpy().astype(np.int64) for c in ("row", "a", "b"))
        order = np.lexsort((a, row))
        row, a, b = row[order], a[order], b[order] + window
        out = {k: [] for k in ("n_bytes", "n_removed", "spans", "kept")}
        for i, text in zip(texts.column("row").to_pylist(), texts.column("text"), strict=True):
            data = _bytes(text.as_py())
            own = slice(np.searchsorted(row, i), np.searchsorted(row, i, side="right"))
            start, end = a[own], np.maximum.accumulate(b[own])
            opens = np.r_[True, start[1:] > end[:-1]][: len(start)]
            start, end = start[opens].tolist(), end[np.r_[opens[1:], True][: len(end)]].tolist()
            kept = [data[x:y] for x, y in zip([0, *end], [*start, len(data)], strict=True)]
            out["kept"].append(b"".join(kept))
            out["n_bytes"].append(len(data))
            out["n_removed"].append(len(data) - len(out["kept"][-1]))
            out["spans"].append([{"start": x, "end": y} for x, y in zip(start, end, strict=True)])
        kinds = {"n_bytes": pa.int64(), "n_removed": pa.int64(), "spans": span, "kept": pa.binary()}
        return pa.table({"doc_id": texts.column("doc_id"), **{k: pa.array(out[k], t) for k, t in kinds.items()}})

    return blocks.groupBy("block").cogroup(covered.groupBy("block")).applyInArrow(cut, f"doc_id long, n_bytes long, n_removed long, spans {SPANS}, kept binary")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, size: int = SYMBOL, block_bytes: int = BLOCK_BYTES, batch_bytes: int = BATCH_BYTES, shard_bytes: int = SHARD_BYTES, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept): each row's text, in UTF-8, without the bytes of any ``window`` bytes that also start elsewhere.

    Elsewhere is any other place of any row, the same row included; copies may overlap, and every copy goes. Nothing
    spans two rows. ``spans`` are the maximal removed stretches, end exclusive; ``kept`` is binary, as a stretch may end
    within a character. A null or empty text has no bytes. Rows that repeat an id, or have none, are texts of their own,
    so repeated rows of ``window`` bytes or more lose all. An empty table gives no rows; other columns are ignored.
    ``gram`` is a power of two below ``window``, which is a multiple of ``size``.
    """
    if gram & (gram - 1) or gram >= window or window % size:
        raise ValueError("gram must be a power of two below window, and window a multiple of size")
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    blocks = common.blocked(slim, "suffix-blocks", block_bytes)

    def scan(batches):
        for batch in batches:
            for part in common.steps(batch, 2, SLICE_BYTES):
                found = contexts_of([_bytes(t) for t in part.column(2).to_pylist()], window, gram)
                at = pa.array(found["row"])
                yield pa.RecordBatch.from_arrays([pa.array(found["key"]), pa.array(found["digest"]), part.column(0).take(at), part.column(1).take(at), pa.array(found["lo"].astype(np.int32)), pa.array(found["hi"].astype(np.int32)), pa.array(found["again"])], names=["key", "digest", "block", "row", "lo", "hi", "again"])

    stands = common.written(blocks.select("block", "row", "text").mapInArrow(scan, "key long, digest long, block long, row int, lo int, hi int, again boolean"), "suffix-stands")
    contexts = stands.groupBy("key", "digest").agg(F.count("*").alias("n"), F.min(F.struct("block", "row", "lo", "hi")).alias("at"), F.max("again").alias("again"))
    contexts = contexts.select("key", "digest", "n", "at.*", "again", (F.col("at.hi") - F.col("at.lo") + window).cast("long").alias("size"))
    keys = contexts.groupBy("key").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"), F.max("again").alias("any_again"), F.sum("size").alias("key_size")).filter("total > 1 OR any_again")
    shared = common.written(contexts.join(keys, "key").drop("total", "again", "size"), "suffix-contexts")
    alone = (F.col("kinds") == 1) & ~F.col("any_again")  # every window of a context that stands twice does so too
    gathered = _gathered(blocks, shared.filter(~alone & (F.col("key_size") <= hot_bytes)), window)
    found = shared.filter(alone).select("key", "digest", F.lit(0).cast("long").alias("a"), (F.col("hi") - F.col("lo")).cast("long").alias("b"))
    found = found.unionByName(_found(gathered, window, size, batch_bytes, shard_bytes))
    hot = shared.filter(~alone & (F.col("key_size") > hot_bytes))
    if not hot.isEmpty():
        found = found.unionByName(_found_by_window(_gathered(blocks, hot, window), window))
    covered = stands.join(common.written(found, "suffix-found"), ["key", "digest"]).select("block", "row", (F.col("lo") + F.col("a")).alias("a"), (F.col("lo") + F.col("b")).alias("b"))
    return _cut(blocks, covered, window)


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_repeats(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
