"""WARC archives as seekable Zstandard bundles.

Each write task packs its records into bundle files in the shared folder: records go into independent Zstandard
frames, a skippable footer frame holds the seek table (the public seekable format), and an index row maps each record
to bundle, frame and its offset inside the decompressed frame. Reading a record takes the footer, one frame and a cut.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

FRAME_BYTES = 128 << 10
BUNDLE_BYTES = 64 << 20
LEVEL = 3
#: Records with equal payloads of at least so many bytes become one response and revisits of it.
REVISIT_BYTES = 0
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Fixed numbers of the seekable format: skippable frame, seek table footer.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUMS = 0x80
INDEX = "page_id long, bundle string, frame int, offset long, length long"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"


def digest_text(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def _id(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _page(header: str) -> int | None:
    own = header.removeprefix("<urn:page:").removesuffix(">")
    return None if own == "null" else int(own)


def warc_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record. A revisit holds the HTTP header alone; digest and length in its header are those of the full payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_id(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest_text(payload)}",
    ]
    if url is not None:
        safe = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)
        head.append(f"WARC-Target-URI: {safe}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_id(refers_to)}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """The fields of RECORD from one WARC record; a response whose payload doesn't have its digest is an error."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.rpartition(b"Content-Length: ")[2])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = fields["WARC-Type"] == "revisit"
    if first != "WARC/1.1" or not revisit and (len(payload) != size or digest_text(payload) != digest):
        raise ValueError(f"damaged record {fields.get('WARC-Record-ID')}")
    return {
        "page_id": _page(fields["WARC-Record-ID"]),
        "url": fields.get("WARC-Target-URI"),
        "record_type": fields["WARC-Type"],
        "refers_to": _page(fields["WARC-Refers-To"]) if revisit else None,
        "payload_digest": digest,
        "payload_bytes": size,
        "payload": None if revisit else payload,
    }


class BundleWriter:
    """One seekable bundle: ``add`` records, then ``close``. ``places`` has (frame, offset in it, length) of each."""

    def __init__(self, sink, frame_bytes: int = FRAME_BYTES, level: int = LEVEL):
        self.sink, self.frame_bytes, self.size = sink, frame_bytes, 0
        self.press = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.entries: list[tuple[int, int, int]] = []
        self.places: list[tuple[int, int, int]] = []
        self.open: list[bytes] = []
        self.filled = 0

    def add(self, record: bytes) -> None:
        self.places.append((len(self.entries), self.filled, len(record)))
        self.open.append(record)
        self.filled += len(record)
        if self.filled >= self.frame_bytes:
            self._frame()

    def _frame(self) -> None:
        if self.open:
            data = b"".join(self.open)
            packed = self.press.compress(data)
            self.sink.write(packed)
            self.entries.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
            self.size += len(packed)
            self.open, self.filled = [], 0

    def close(self) -> None:
        self._frame()
        body = b"".join(struct.pack("<III", *e) for e in self.entries) + struct.pack("<IBI", len(self.entries), CHECKSUMS, SEEKABLE_MAGIC)
        self.sink.write(struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body)
        self.sink.close()


class BundleReader:
    """Random access to the frames of a bundle, by the seek table at its end."""

    def __init__(self, source):
        self.source, size = source, source.size()
        source.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError("no seek table")
        width = 12 if flags & CHECKSUMS else 8
        source.seek(size - 9 - n * width)
        table = source.read(n * width)
        self.frames, at = [], 0
        for i in range(n):
            packed, raw, *check = struct.unpack_from("<III" if width == 12 else "<II", table, i * width)
            self.frames.append((at, packed, raw, check))
            at += packed
        self.unpack = zstandard.ZstdDecompressor()

    def frame(self, number: int) -> bytes:
        at, packed, raw, check = self.frames[number]
        self.source.seek(at)
        data = self.unpack.decompress(self.source.read(packed), max_output_size=raw)
        if len(data) != raw or check and xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != check[0]:
            raise ValueError(f"damaged frame {number}")
        return data


def marked(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """(page_id, url, payload, keeper): keeper is the largest page_id with the same payload, if that is another page's.

    Digests are counted before payloads move; the payloads of a very frequent digest, as of empty pages, don't move at all.
    """
    own = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.encode("html", "UTF-8"), F.lit(b"")).alias("payload"))
    own = own.withColumn("digest", F.sha1("payload"))
    twice = own.filter(F.length("payload") >= least).groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).filter("n > 1")
    return common.join_counted(own, common.written(twice, "warc-repeated"), "digest", "n", "left").select("page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("keeper")), F.col("keeper")).alias("keeper"))


def write_bundles(pages: DataFrame, folder: str, least: int = REVISIT_BYTES, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Writes a record per row of ``pages`` (page_id, url, html) below ``folder``; the index (columns of INDEX), written once.

    A file's name is new for each attempt and only files of tasks that ended are in the index, so retried and lost
    tasks leave nothing that is read. Null html is an empty payload, a null url leaves its header out; rows that
    repeat a page_id with the same payload are all responses if it is the largest; a null page_id never is, unless all
    are null. An empty table gives an empty index.
    """

    def write(batches) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        writer, name, ids = None, "", []

        def finish():
            writer.close()
            frames, offsets, lengths = zip(*writer.places, strict=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([name] * len(ids), pa.string()), pa.array(frames, pa.int32()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())],
                names=["page_id", "bundle", "frame", "offset", "length"],
            )

        for batch in batches:
            for part in common.steps(batch, 2):
                for page_id, url, payload, keeper in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if writer is None:
                        name, ids = f"{uuid.uuid4().hex}.warc.zst", []
                        writer = BundleWriter(store.open_output_stream(f"{root}/{name}", compression=None), frame_bytes)
                    writer.add(warc_record(page_id, url, payload, keeper, keeper is not None))
                    ids.append(page_id)
                    if writer.size >= bundle_bytes:
                        yield finish()
                        writer = None
        if writer is not None:
            yield finish()

    return common.written(marked(pages, least).mapInArrow(write, INDEX), "warc-index")


def read_records(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records (columns of RECORD) that the rows of ``index`` name; each frame that holds any is read once a task."""
    n = max(1, min(20_000, index.select(F.approx_count_distinct("bundle")).first()[0]))
    near = index.select("bundle", "frame", "offset", "length").repartition(n, "bundle").sortWithinPartitions("bundle", "frame", "offset")
    names = [x.split()[0] for x in RECORD.split(", ")]

    def read(batches) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        bundle, frame, reader, data, rows, held = None, None, None, b"", [], 0
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

        def out():
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types, strict=True)], names=names)

        for batch in batches:
            for b, f, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b != bundle:
                    if reader:
                        reader.source.close()
                    reader, bundle, frame = BundleReader(store.open_input_file(f"{root}/{b}")), b, None
                if f != frame:
                    data, frame = reader.frame(f), f
                rows.append(parse_record(data[offset : offset + length]))
                if not payloads:
                    rows[-1]["payload"] = None
                held += length if payloads else 256
                if held >= common.STEP_BYTES:
                    yield out()
                    rows, held = [], 0
        if rows:
            yield out()

    return near.mapInArrow(read, RECORD)


def op1_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{common.shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    index = write_bundles(common.table(spark, sf_dir, "pages"), folder)
    return read_records(index, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
ORACLE_SQL = f"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex FROM pages
), d AS (
  SELECT *, max(page_id) OVER (PARTITION BY hex) AS keeper,
    list_transform(range(8), lambda i: CAST('0x' || substr(hex, CAST(5 * i + 1 AS BIGINT), 5) AS BIGINT)) AS parts
  FROM p
)
SELECT page_id, CAST(octet_length(encode(payload)) AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(parts, lambda v:
    substr('{_LETTERS}', (v >> 15) + 1, 1) || substr('{_LETTERS}', ((v >> 10) & 31) + 1, 1)
    || substr('{_LETTERS}', ((v >> 5) & 31) + 1, 1) || substr('{_LETTERS}', (v & 31) + 1, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> keeper THEN keeper END AS refers_to
FROM d
"""
