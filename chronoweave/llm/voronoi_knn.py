"""Exact top-k inner products by a Voronoi join.

Vectors are grouped by their nearest pivot and packed into blocks of a group. From small summaries of the groups
(radius, norms, the distances of the members nearest to the pivot) follow, for each block of queries, a score that its
k-th result reaches at least and the score that no member of a group can exceed; the query block meets only groups
that can reach the former. Data blocks are dealt to bins, and a query block is sent once to each bin that holds any of
its groups, where matrix products with one block after the other raise what a result must reach. Results of all bins
meet in a top-k a query.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: A vector length gets a pivot for each PIVOT_STEP of the square root of its rows, if it has PIVOT_ROWS rows at all.
PIVOT_STEP = 4
PIVOT_ROWS = 1000
#: Bounds of what reaches the driver and is broadcast: bytes of all pivots, and lengths that have any; other lengths are one group each.
PIVOT_BYTES = 64 << 20
PIVOT_LENGTHS = 256
#: Summaries of a group meet in parts of so many blocks first.
PART_BLOCKS = 1024
#: Rows of a block of data and of queries.
DATA_ROWS = 4096
QUERY_ROWS = 512
#: Bytes of the data of one bin, and of the queries of one part: a task holds one of each.
BIN_BYTES = 32 << 20
PART_BYTES = 64 << 20
#: Bins a core at least, if there are so many blocks, and shuffle partitions a cell: hashes leave few cells in one task.
BINS_CORE = 4
SPREAD = 4
SCALE = 256
TOP = 5
EVERY = 50
#: Integers that a double, and a float, hold exactly.
EXACT = 1 << 53
EXACT_FLOAT = 1 << 24
#: Quantised components are smaller than this; larger ones are an error.
MOST_COMPONENT = 1 << 62
BLOCK = "dim int, g int, salt long, ids binary, rows binary, wide boolean, radius double, low2 double, high2 double, near array<struct<away:double,norm2:double,id:long>>"


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component as integers.

    Rows without an id, vectors that are null or empty, and those that hold null or non-finite components are left out;
    equal rows count once. A finite component whose product reaches 2^62 fits no integer here and is an error.
    """
    x = F.col(vector_col).cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))

    def whole(c):
        scaled = F.lit(float(scale)) * c
        return F.when(F.abs(scaled) < float(MOST_COMPONENT), F.floor(scaled)).otherwise(F.raise_error(F.concat(F.lit("component too large: "), c.cast("string"))).cast("long"))

    kept = vectors.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & (F.size(x) > 0) & finite)
    return kept.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, whole).alias("v")).distinct()


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def pivots_of(vectors: DataFrame, step: float = PIVOT_STEP, rows: int = PIVOT_ROWS, most_bytes: int = PIVOT_BYTES) -> dict[int, np.ndarray]:
    """The pivots of each vector length that has several, chosen by hash in one pass; ``most_bytes`` at most.

    Their number grows with the square root of the length's rows. Lengths without pivots are one group around zero.
    """
    counts = vectors.groupBy(F.size("v").alias("dim")).count().filter(F.col("count") >= rows).orderBy(F.desc("count"), "dim").limit(PIVOT_LENGTHS).collect()
    wanted = {r["dim"]: min(math.ceil(math.sqrt(r["count"]) / step), most_bytes // (8 * r["dim"] * len(counts))) for r in counts}
    wanted = {dim: n for dim, n in wanted.items() if n > 1}
    if not wanted:
        return {}
    # a few times as many as are wanted are drawn, so that a sort of few rows gives the number
    share = {r["dim"]: min(1.0, (4 * wanted[r["dim"]] + 40) / r["count"]) for r in counts if r["dim"] in wanted}
    spec = vectors.sparkSession.createDataFrame([(dim, n, share[dim]) for dim, n in wanted.items()], "dim int, wanted long, share double")
    hashed = vectors.withColumns({"dim": F.size("v"), "h": F.xxhash64("vec_id", "v")})
    drawn = hashed.join(F.broadcast(spec), "dim").filter(F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53)) < F.col("share"))
    place = F.row_number().over(Window.partitionBy("dim").orderBy("h", "vec_id", "v"))
    out: dict[int, list] = {}
    for r in drawn.withColumn("place", place).filter("place <= wanted").select("dim", "v").collect():
        out.setdefault(r["dim"], []).append(r["v"])
    return {dim: np.array(sorted(own), float) for dim, own in out.items()}


def _centres(pivots: dict[int, np.ndarray], dim: int) -> np.ndarray:
    return pivots[dim] if dim in pivots else np.zeros((1, dim))


def blocks_of(vectors: DataFrame, pivots: dict[int, np.ndarray], rows: int, keep: int) -> DataFrame:
    """``vectors`` in blocks of about ``rows`` of one pivot's group, with each block's summary (columns of BLOCK).

    ``near`` has the ``keep`` distinct ids nearest to the pivot, each with its nearest vector.
    """
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)  # PIVOT_BYTES at most

    def nearest(batches):
        for batch in batches:
            dims = np.diff(batch.column(1).offsets.to_numpy())
            for dim in np.unique(dims):
                own = batch.take(pa.array(np.flatnonzero(dims == dim)))
                x = _matrix(own.column(1), dim).astype(float)
                p = _centres(shared.value, int(dim))
                g = np.concatenate([((p**2).sum(1) - 2 * (x[i : i + 512] @ p.T)).argmin(1) for i in range(0, len(x), 512)])
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(np.full(len(x), dim, np.int32)), pa.array(g.astype(np.int32))], names=["vec_id", "v", "dim", "g"])

    grouped = common.written(vectors.mapInArrow(nearest, "vec_id long, v array<long>, dim int, g int"), "voronoi-groups")
    sizes = grouped.groupBy("dim", "g").agg(F.ceil(F.count("*") / rows).alias("salts"))
    salted = grouped.join(sizes, ["dim", "g"]).withColumn("salt", F.pmod(F.xxhash64("vec_id", "v"), F.col("salts"))).select("dim", "g", "salt", "vec_id", "v")
    fields = ["dim", "g", "salt", "ids", "rows", "wide", "radius", "low2", "high2", "near"]
    near_type = pa.list_(pa.struct([("away", pa.float64()), ("norm2", pa.float64()), ("id", pa.int64())]))
    types = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.bool_(), pa.float64(), pa.float64(), pa.float64(), near_type]

    def packed(table: pa.Table) -> pa.Table:
        dim, g, salt = (table.column(n)[0].as_py() for n in ("dim", "g", "salt"))
        x, ids = _matrix(table.column("v"), dim), table.column("vec_id").combine_chunks().to_numpy()
        away = np.sqrt(((x - _centres(shared.value, dim)[g]) ** 2).sum(1))
        norm2 = (x.astype(float) ** 2).sum(1)
        order = np.argsort(away, kind="stable")
        first = order[np.sort(np.unique(ids[order], return_index=True)[1])][:keep]
        near = [{"away": float(away[i]), "norm2": float(norm2[i]), "id": int(ids[i])} for i in first]
        by_id = np.argsort(ids, kind="stable")
        x, ids = x[by_id], ids[by_id]
        wide = bool(np.abs(x).max() >= 1 << 15)
        row = (dim, g, salt, ids.tobytes(), x.astype(np.int64 if wide else np.int16).tobytes(), wide, float(away.max()), float(norm2.min()), float(norm2.max()), near)
        return pa.table([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=fields)

    return common.written(salted.groupBy("dim", "g", "salt").applyInArrow(packed, BLOCK), "voronoi-blocks")


def reachable(centre: np.ndarray, radius: float, low2: float, high2: float, groups: list[dict], pivots: np.ndarray, k: int) -> tuple[float, list[int]]:
    """For queries within ``radius`` of ``centre`` and squared norms in [low2, high2]: a score that the k-th result reaches, and the groups that can reach it.

    2 q.x = |q|^2 + |x|^2 - |q - x|^2, and the distance lies within the triangle's bounds around the pivots. One more
    than k distinct ids count, as a query's own may be one of them. Bounds are widened by far more than rounding takes.
    """
    apart = np.sqrt(((pivots - centre) ** 2).sum(1))
    sure: dict[int, float] = {}
    for s in groups:
        for away, norm2, vec_id in s["near"]:
            far2 = (radius + apart[s["g"]] + away) ** 2
            least = low2 + norm2 - far2 - 1e-9 * (low2 + norm2 + far2)
            sure[vec_id] = max(sure.get(vec_id, -np.inf), least)
    floor = heapq.nlargest(k + 1, sure.values())[-1] / 2 - 1 if len(sure) > k else -np.inf
    best = []
    for s in groups:
        gap2 = max(0.0, apart[s["g"]] - radius - s["radius"]) ** 2
        best.append((s["g"], (high2 + s["high2"] - gap2 + 1e-9 * (high2 + s["high2"] + gap2)) / 2 + 1))
    return float(floor), [g for g, most in best if most >= floor]


def _nearest_ids(blocks: DataFrame, keys: list[str], most: int) -> DataFrame:
    """(keys, near): the ``most`` distinct ids nearest to the pivot over the summaries ``near`` of the rows of each key."""
    one = blocks.select(*keys, F.explode("near").alias("x")).groupBy(*keys, "x.id").agg(F.min("x").alias("x"))
    return one.groupBy(*keys).agg(F.slice(F.array_sort(F.collect_list("x")), 1, most).alias("near"))


def _product(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    top = max(int(np.abs(q).max(initial=0)) * int(np.abs(x).max(initial=0)) * q.shape[1], 1)
    if top < EXACT:
        return (q.astype(float) @ x.astype(float).T).astype(np.int64)
    return q @ x.T if top < 1 << 63 else q.astype(object) @ x.astype(object).T


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows (int64): integers, or objects where they may not fit; only rows of large components pay for these."""
    whole = max(int(np.abs(q).max(initial=0)) * int(np.abs(x).max(initial=0)) * q.shape[1], 1)
    if whole < EXACT:
        return _product(q, x)
    most = math.isqrt((EXACT - 1) // q.shape[1])
    out = np.empty((len(q), len(x)), np.int64 if whole < 1 << 63 else object)
    q_small, x_small = (np.abs(m).max(axis=1) <= most for m in (q, x))
    for a in (np.flatnonzero(q_small), np.flatnonzero(~q_small)):
        for b in (np.flatnonzero(x_small), np.flatnonzero(~x_small)):
            if len(a) and len(b):
                out[np.ix_(a, b)] = _product(q[a], x[b])
    return out


class Block:
    """Vectors of one length by id; ``most`` is their largest component."""

    def __init__(self, ids, rows, wide: bool, dim: int):
        self.ids = np.frombuffer(ids, np.int64)
        self.rows = np.frombuffer(rows, np.int64 if wide else np.int16).reshape(-1, dim)
        self.most = max(abs(int(self.rows.max(initial=0))), abs(int(self.rows.min(initial=0))))
        #: Where an id's vectors begin, if any id has several.
        self.starts = None
        if (self.ids[1:] == self.ids[:-1]).any():
            self.starts = np.flatnonzero(np.r_[True, self.ids[1:] != self.ids[:-1]])
        self._floats = None

    @property
    def names(self) -> np.ndarray:
        return self.ids if self.starts is None else self.ids[self.starts]

    def floats(self) -> np.ndarray:
        if self._floats is None:
            self._floats = self.rows.astype(np.float32)
        return self._floats


def _scores(q: Block, x: Block) -> np.ndarray:
    """Exact scores of the vectors of ``q`` and the ids of ``x``, of which the best vector counts: floats where these hold them."""
    if q.most * x.most * q.rows.shape[1] < EXACT_FLOAT:
        score = q.floats() @ x.floats().T
    else:
        score = products(q.rows.astype(np.int64), x.rows.astype(np.int64))
    return score if x.starts is None else np.maximum.reduceat(score, x.starts, axis=1)


def best_of_block(q: Block, x: Block, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's row, id, score) of other ids in ``x`` that reach ``least`` of the query: each query's ``k`` best are among them; an id's best vector counts."""
    score, ids = _scores(q, x), x.names
    if score.dtype == object:
        rows = [(i, int(d), s) for i, own in enumerate(score) for s, d in heapq.nsmallest(k, ((-s, d) for s, d in zip(own, ids, strict=True) if d != q.ids[i] and s >= int(least[i])))]
        if any(abs(s) >= 1 << 63 for _, _, s in rows):
            raise OverflowError("an inner product among the best of a block doesn't fit a long")
        return np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64), np.array([-r[2] for r in rows], np.int64)
    whole = score.dtype == np.int64
    at = np.minimum(np.searchsorted(ids, q.ids), len(ids) - 1)
    same = np.flatnonzero(ids[at] == q.ids)
    score[same, at[same]] = np.iinfo(np.int64).min if whole else -np.inf  # below every score: these are under 2^63 in size
    floor = least if whole else np.clip(least, -2 * EXACT_FLOAT, 2 * EXACT_FLOAT).astype(np.float32)
    a, b = np.nonzero(score >= floor[:, None])
    many = np.flatnonzero(np.bincount(a, minlength=len(q.ids)) > 8 * k)
    if len(many):  # nothing is known of what these reach
        floor = floor.copy()
        floor[many] = np.maximum(floor[many], np.partition(score[many], len(ids) - k, axis=1)[:, len(ids) - k])
        a, b = np.nonzero(score >= floor[:, None])
    own = score[a, b].astype(np.int64)
    order = np.lexsort((ids[b], -own, a))  # ties beyond the k-th go by id, so few rows remain a query
    a, b, own = a[order], b[order], own[order]
    some = np.arange(len(a)) - np.searchsorted(a, a) < k
    return a[some], ids[b[some]], own[some]


def best_of_blocks(q: Block, blocks: list[Block], k: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``best_of_block``, the ``k`` best over ``blocks``: what one has found is what the next must reach."""
    low = np.iinfo(np.int64).min + 1
    floor = np.full(len(q.ids), low if least == -np.inf else min(max(math.floor(least), low), (1 << 63) - 1), np.int64)
    best = tuple(np.zeros(0, np.int64) for _ in range(3))
    for x in blocks:
        more = best_of_block(q, x, k, floor)
        if not len(more[0]):
            continue
        a, d, s = (np.concatenate(z) for z in zip(best, more, strict=True))
        order = np.lexsort((-s, d, a))
        a, d, s = a[order], d[order], s[order]
        first = np.r_[True, (a[1:] != a[:-1]) | (d[1:] != d[:-1])]  # an id's best vector
        a, d, s = a[first], d[first], s[first]
        order = np.lexsort((d, -s, a))
        a, d, s = a[order], d[order], s[order]
        place = np.arange(len(a)) - np.searchsorted(a, a)
        best = a[place < k], d[place < k], s[place < k]
        full = place == k - 1
        floor[a[full]] = np.maximum(floor[a[full]], s[full])
    return best


def _bins(blocks: DataFrame, most_bytes: int) -> tuple[int, int]:
    """(how many hold ``most_bytes`` each on average, how many blocks there are)."""
    size, count = blocks.agg(F.coalesce(F.sum(F.octet_length("rows") + F.octet_length("ids")), F.lit(0)), F.count("*")).first()
    return max(1, math.ceil(size / most_bytes)), count


def voronoi_top_k(queries: DataFrame, data: DataFrame, k: int = TOP, query_rows: int = QUERY_ROWS, data_rows: int = DATA_ROWS, pivots: dict | None = None, bins: int | None = None, parts: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the ``k`` rows of ``data`` of highest inner product, ties to smaller ids.

    Both are (vec_id, v) as of ``quantised``: equal rows count once, vectors meet only those of their length. A row
    with the query's id isn't its result; fewer than ``k`` others give fewer rows; no queries or data give none. An id
    with several vectors is a query, and a candidate, with each; as a candidate its best score counts once. A score
    that doesn't fit a long, where it is among the best of a block, is an error. ``bins`` and ``parts`` follow the
    bytes of the data and of the queries; data are sent once a part and queries once a bin at most.
    """
    pivots = pivots_of(data) if pivots is None else pivots
    found = blocks_of(data, pivots, data_rows, k + 1)
    asked = blocks_of(queries, pivots, query_rows, 0)
    if bins is None:
        by_size, count = _bins(found, BIN_BYTES)
        bins = max(by_size, min(count, BINS_CORE * data.sparkSession.sparkContext.defaultParallelism))
    parts = _bins(asked, PART_BYTES)[0] if parts is None else parts
    several = F.col("dim").isin([dim for dim, own in pivots.items() if len(own) > 1])
    own = found.filter(several).withColumn("part", F.floor(F.col("salt") / PART_BLOCKS))
    near = _nearest_ids(_nearest_ids(own, ["dim", "g", "part"], k + 1), ["dim", "g"], k + 1)
    extent = own.groupBy("dim", "g").agg(F.max("radius").alias("radius"), F.max("high2").alias("high2"))
    groups: dict[int, list[dict]] = {}
    for s in extent.join(near, ["dim", "g"]).collect():  # a row a pivot
        groups.setdefault(s["dim"], []).append({"g": s["g"], "radius": s["radius"], "high2": s["high2"], "near": [tuple(x) for x in s["near"]]})
    shared = data.sparkSession.sparkContext.broadcast((pivots, groups))  # PIVOT_BYTES at most, and a summary a pivot

    def routed(batches):
        pivots, groups = shared.value
        for batch in batches:
            cols = batch.to_pydict()
            to, floors = [], []
            for i, (dim, g) in enumerate(zip(cols["dim"], cols["g"], strict=True)):
                floor, own = reachable(pivots[dim][g], cols["radius"][i], cols["low2"][i], cols["high2"][i], groups[dim], pivots[dim], k) if dim in groups else (-np.inf, [0])
                to.append(own)
                floors.append(floor)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("dim", "g", "salt")), pa.array(floors, pa.float64()), pa.array(to, pa.list_(pa.int32()))], names=["dim", "q_g", "q_salt", "least", "to"])

    # Numbers alone say where a query block goes; its vectors follow once a bin. Sizes of what is sent can't be told
    # from the files it comes from, so no join here may be a broadcast.
    dealt = found.withColumn("bin", F.pmod(F.xxhash64("dim", "g", "salt"), F.lit(bins)))
    sent = asked.select("dim", "g", "salt", "radius", "low2", "high2").mapInArrow(routed, "dim int, q_g int, q_salt long, least double, to array<int>")
    sent = sent.select("dim", "q_g", "q_salt", "least", F.explode("to").alias("g")).hint("merge").join(dealt.select("dim", "g", "bin").distinct(), ["dim", "g"])
    sent = sent.groupBy("dim", "q_g", "q_salt", "bin").agg(F.first("least").alias("least"), F.collect_list("g").alias("to"))
    vectors = asked.select("dim", F.col("g").alias("q_g"), F.col("salt").alias("q_salt"), "ids", "rows", "wide")
    part = F.pmod(F.xxhash64("dim", "q_g", "q_salt"), F.lit(parts))
    left = sent.hint("merge").join(vectors, ["dim", "q_g", "q_salt"]).withColumn("cell", F.col("bin") * parts + part).drop("bin")
    right = dealt.select("dim", "g", "ids", "rows", "wide", F.explode(F.sequence(F.col("bin") * parts, F.col("bin") * parts + parts - 1)).alias("cell"))
    target = pa.schema([("dim", pa.int32()), ("q_g", pa.int32()), ("q_salt", pa.int64()), ("place", pa.int32()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def solved(asked: pa.Table, held: pa.Table) -> pa.Table:
        made, done = lambda t, i: Block(t.column("ids")[i].as_buffer(), t.column("rows")[i].as_buffer(), t.column("wide")[i].as_py(), t.column("dim")[i].as_py()), []
        blocks = defaultdict(list)
        for i, key in enumerate(zip(held.column("dim").to_pylist(), held.column("g").to_pylist(), strict=True)):
            blocks[key].append(made(held, i))
        for i, (dim, g, salt, least, to) in enumerate(zip(*(asked.column(n).to_pylist() for n in ("dim", "q_g", "q_salt", "least", "to")), strict=True)):
            q = made(asked, i)
            place, vec_id, score = best_of_blocks(q, [x for to_g in sorted(to, key=lambda x: x != g) for x in blocks[dim, to_g]], k, least)
            n = len(place)
            done.append(pa.table([pa.array(v, t) for v, t in zip((np.full(n, dim), np.full(n, g), np.full(n, salt), place, q.ids[place], vec_id, score), target.types, strict=True)], schema=target))
        return pa.concat_tables(done) if done else target.empty_table()

    cells = SPREAD * bins * parts
    near = left.repartition(cells, "cell").groupBy("cell").cogroup(right.repartition(cells, "cell").groupBy("cell")).applyInArrow(solved, "dim int, q_g int, q_salt long, place int, query_id long, vec_id long, score long")
    query = ["dim", "q_g", "q_salt", "place", "query_id"]  # a query vector's own key: its block and its place there
    best = near.groupBy(*query, "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy(*query).orderBy(F.desc("score"), "vec_id")).cast("int")
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_voronoi_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = common.written(quantised(common.table(spark, sf_dir, "embeddings")), "voronoi-vectors")
    return voronoi_top_k(data.filter(F.col("vec_id") % EVERY == 0), data)


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, x.vec_id,
    CAST(list_sum(list_transform(list_zip(q.v, x.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v x ON q.vec_id <> x.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
