"""What the training-data operators share: batches of texts, blocks, and the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from itertools import filterfalse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy step handles; a longer text is a step of its own.
STEP_BYTES = 4 << 20
#: Rows of one join key from which it may be joined by broadcast.
HOT_ROWS = 10_000
#: White space by the Unicode property, for a character class; str.isspace() holds four control characters more.
WHITE_SPACE = r"\t-\r\x20\x85\xa0" + "".join(rf"\u{c:04x}" for c in (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or the session's own checkpoint folder.

    Where neither is set, a local master gets a temporary folder; on a cluster that is an error, as executors wouldn't
    see each other's files.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if (found := spark.sparkContext.getCheckpointDir()) is None:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            found = "file://" + tempfile.mkdtemp(prefix="spark-")
            spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: later uses and lost executors don't recompute it.

    Results are lazy and read these files when they run, so the files stay as long as the shared folder keeps them;
    what an operator has itself finished reading it ``remove``s.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def blocked(slim: DataFrame, label: str, block_bytes: int) -> DataFrame:
    """``slim`` (its last column is ``text``) as (block, row, ...) in files bucketed by block: a block's later steps don't shuffle texts.

    A block holds at most ``block_bytes`` of text, or one longer text; ``row`` numbers its rows. Buckets grow with the
    text, so that none holds more than a few blocks. The files are in the shared folder; the catalog's entry, which
    tells Spark of the buckets, is gone once they are written.
    """
    spark, at = slim.sparkSession, len(slim.columns) - 1
    size = slim.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]

    def assign(batches):
        block, held, row = 0, block_bytes + 1, 0
        for batch in batches:
            for part in steps(batch, at):
                own = part.column(at).nbytes
                if held + own > block_bytes:
                    block, held, row = uuid.uuid4().int >> 65, 0, 0
                held += own
                n = part.num_rows
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), pa.array(np.arange(row, row + n, dtype=np.int32)), *part.columns], names=["block", "row", *part.schema.names])
                row += n

    schema = ", ".join(["block long", "row int", *(f"{n} {t}" for n, t in slim.dtypes)])
    name = f"blocks_{uuid.uuid4().hex}"
    buckets = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), size // block_bytes)
    slim.mapInArrow(assign, schema).write.bucketBy(buckets, "block").option("compression", "zstd").option("path", new_path(spark, label)).saveAsTable(name)
    found = spark.table(name)
    found.schema  # resolves the table while its entry is there
    spark.sql(f"DROP TABLE {name}")  # its files are its own folder's and stay
    return found


def remove(df: DataFrame) -> None:
    """Deletes the files that ``df``, a result of ``written``, reads."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores added until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def join_counted(big: DataFrame, small: DataFrame, key: str, rows: str, how: str = "inner", least: int = HOT_ROWS) -> DataFrame:
    """``big`` joined on ``key`` with ``small``, which has a row a key and in ``rows`` the number of its rows in ``big``.

    Keys of ``least`` rows and a thousandth of all rows, so 1,000 keys at most, are joined by broadcast and their rows
    of ``big`` stay where they are; the others by a shuffle, in which no key holds more than that.
    """
    total = small.agg(F.coalesce(F.sum(rows), F.lit(0))).first()[0]
    is_hot = F.col(rows) >= max(least, total / 1000)
    hot, rest = small.filter(is_hot).drop(rows), small.filter(~is_hot).drop(rows)
    if hot.isEmpty():
        return big.join(rest, key, how)
    cold = big.join(F.broadcast(hot.select(key)), key, "left_anti")
    return big.join(F.broadcast(hot), key).unionByName(cold.join(rest, key, how))


def word_bytes(text: str | None, lower: bool = False) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8; ``lower`` changes A-Z alone. bytes.split() parts at just these six characters."""
    if not text:
        return []
    data = text.encode("utf-8", "surrogatepass")
    return (data.lower() if lower else data).split()


def steps(batch: pa.RecordBatch, text_at: int = 1, most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of at most ``most`` bytes of text, one row at least."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, start = np.cumsum(sizes + 16), 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(start, end - start)
        start = end


def map_texts(df: DataFrame, fn: Callable[[pa.Array, list], dict], schema: str, id_col: str = "doc_id", text_col: str = "text", most: int = STEP_BYTES) -> DataFrame:
    """One Arrow pass over (id, text): ``fn(ids, texts)`` gives the columns of ``schema`` for a slice of documents.

    Other columns of ``df`` don't travel to Python. No shuffle; memory is bounded by ``most`` and the longest text.
    """
    spark = df.sparkSession
    slim = df.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("__text"))
    target = spark.createDataFrame([], schema).schema
    names = target.fieldNames()

    def run(batches):
        for batch in batches:
            for part in steps(batch, 1, most):
                cols = fn(part.column(0), part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in (cols[n] for n in names)], names=names)

    return slim.mapInArrow(run, target)


def keep_texts(df: DataFrame, verdict: Callable[[list], np.ndarray], text_col: str = "text", most: int = STEP_BYTES) -> DataFrame:
    """The rows of ``df``, with all their columns, for whose texts ``verdict`` is true. One Arrow pass without shuffle."""
    at = df.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for part in steps(batch, at, most):
                yield part.filter(pa.array(verdict(part.column(at).to_pylist()), pa.bool_()))

    return df.mapInArrow(run, df.schema)


class Recent:
    """A bounded table of what was lately looked up, in two generations: a full one replaces the older, and what is asked for again moves on."""

    def __init__(self, most: int):
        self.most, self.now, self.old = most, {}, {}

    def missing(self, lists: list[list]) -> list:
        """The items of ``lists`` that aren't in ``now``, without those that ``old`` had; then ``put`` the rest."""
        if len(self.now) > self.most:
            self.now, self.old = {}, self.now
        lack: set = set()
        for items in lists:
            lack.update(filterfalse(self.now.__contains__, items))
        known = [x for x in lack if x in self.old]
        self.now.update(zip(known, map(self.old.__getitem__, known), strict=True))
        return list(lack.difference(known))

    def put(self, items: list, values) -> None:
        self.now.update(zip(items, values, strict=True))


def crc32_mod(id_col: str, modulus: int) -> Column:
    """crc32 of the id as decimal text, modulo ``modulus``."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % F.lit(modulus)


def segment_sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of ``values`` with the given lengths (zero where a run is empty)."""
    ends = np.cumsum(lengths)
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return total[ends] - total[ends - lengths]
