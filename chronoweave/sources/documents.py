"""Documents as sources and sinks: JSON with counted failures, physical chunks and logical tracks, clipboards, cache budgets and manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NOTE = "struct<note_id:bigint,pitch:int,vel:int,start_ms:double,dur_ms:double,ntype:int>"
FIELDS = ("note_id", "pitch", "vel", "start_ms", "dur_ms", "ntype")
#: Notes of a physical track, version and bounds of a clipboard.
CHUNK_NOTES = 730
CLIPBOARD_VERSION, CLIPBOARD_NOTES, CLIPBOARD_BYTES = 1, 20_000, 4 << 20


def scan_corpus(rows: DataFrame, text: str, schema: str) -> DataFrame:
    """``rows`` with ``parsed`` and ``failure``: null for a document of ``schema``, else why it isn't one; nothing aborts the scan."""
    parsed = F.from_json(text, f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    generic = F.try_parse_json(text)
    failure = F.when(F.col(text).isNull(), "missing").when(generic.isNull(), "malformed").when(F.schema_of_variant(generic).startswith("OBJECT") == F.lit(False), "not_an_object").when(F.col("parsed._corrupt").isNotNull(), "bad_value")
    return rows.withColumn("parsed", parsed).withColumn("failure", failure)


def failures(scanned: DataFrame) -> DataFrame:
    """(failure, n) with ``ok`` for the documents that were read."""
    return scanned.groupBy(F.coalesce("failure", F.lit("ok")).alias("failure")).agg(F.count("*").alias("n"))


def physical_tracks(notes: DataFrame, most: int = CHUNK_NOTES) -> DataFrame:
    """(track_id, chunk, notes): a track's notes in order, cut into arrays of ``most`` at most."""
    place = F.row_number().over(Window.partitionBy("track_id").orderBy("start_ms", "note_id")) - 1
    rows = notes.withColumn("place", place).withColumn("chunk", F.floor(F.col("place") / most))
    return rows.groupBy("track_id", "chunk").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", F.struct(*FIELDS).alias("note")))), lambda x: x["note"]).alias("notes"))


def logical_notes(chunks: DataFrame) -> DataFrame:
    """The notes of physical tracks again, with their ``place`` in the logical one: chunks before count by their sizes, so no track becomes one array."""
    before = F.coalesce(F.sum(F.size("notes")).over(Window.partitionBy("track_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = chunks.withColumn("before", before).select("track_id", "before", F.posexplode("notes").alias("i", "note"))
    return placed.select("track_id", (F.col("before") + F.col("i") + 1).alias("place"), "note.*")


def to_document(chunks: DataFrame, version: int = 1) -> DataFrame:
    """(track_id, chunk, document): each physical track as a JSON document."""
    return chunks.select("track_id", "chunk", F.to_json(F.struct(F.lit(version).alias("version"), F.size("notes").alias("n"), "notes")).alias("document"))


def from_document(documents: DataFrame) -> DataFrame:
    """(track_id, chunk, notes) from JSON documents; one that doesn't parse or has another count is an error."""
    parsed = F.from_json("document", f"version int, n int, notes array<{NOTE}>")
    whole = documents.withColumn("d", parsed)
    good = F.coalesce(F.size("d.notes") == F.col("d.n"), F.lit(False))
    return whole.select("track_id", "chunk", F.when(good, F.col("d.notes")).otherwise(F.raise_error(F.concat(F.lit("damaged document of track "), F.col("track_id").cast("string"))).cast(f"array<{NOTE}>")).alias("notes"))


def to_clipboard(notes: DataFrame, key: str, most: int = CLIPBOARD_NOTES, most_bytes: int = CLIPBOARD_BYTES) -> DataFrame:
    """(key, payload): a selection as bounded JSON with starts from zero; larger selections are an error, before their rows are gathered."""
    sized = notes.withColumns({"n": F.count("*").over(Window.partitionBy(key)), "origin": F.min("start_ms").over(Window.partitionBy(key))})
    fits = sized.filter(F.when(F.col("n") <= most, F.lit(True)).otherwise(F.raise_error(F.lit("selection too large")).cast("boolean")))
    row = F.struct("note_id", "pitch", "vel", (F.col("start_ms") - F.col("origin")).alias("start_ms"), "dur_ms", "ntype")
    payload = F.to_json(F.struct(F.lit(CLIPBOARD_VERSION).alias("version"), F.array_sort(F.collect_list(row)).alias("notes")))
    out = fits.groupBy(key).agg(payload.alias("payload"))
    return out.filter(F.when(F.octet_length("payload") <= most_bytes, F.lit(True)).otherwise(F.raise_error(F.lit("payload too large")).cast("boolean")))


def from_clipboard(payloads: DataFrame, key: str) -> DataFrame:
    """(key, *FIELDS) of valid payloads; another version, no notes, or starts that aren't relative are an error."""
    parsed = payloads.withColumn("d", F.from_json("payload", f"version int, notes array<{NOTE}>"))
    good = (F.col("d.version") == CLIPBOARD_VERSION) & (F.size("d.notes") > 0) & (F.array_min(F.transform("d.notes", lambda n: n["start_ms"])) == 0.0)
    checked = parsed.filter(F.when(F.coalesce(good, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit("invalid payload")).cast("boolean")))
    return checked.select(key, F.explode("d.notes").alias("n")).select(key, "n.*")


def cache_prune(entries: DataFrame, root: str, most_entries: int, most_bytes: int, key: str = "key", at: str = "modified", size: str = "bytes", keep: str = "protected") -> DataFrame:
    """``entries`` with ``removed``: of each ``root`` the oldest unprotected ones go until its count and bytes are bounded.

    What has gone before an entry is a running sum over older unprotected ones, so the verdict is one window.
    """
    every = Window.partitionBy(root)
    older = every.orderBy(at, key).rowsBetween(Window.unboundedPreceding, -1)
    loose = F.when(F.col(keep), 0).otherwise(1)
    left = F.count("*").over(every) - F.coalesce(F.sum(loose).over(older), F.lit(0))
    left_bytes = F.sum(size).over(every) - F.coalesce(F.sum(F.col(size) * loose).over(older), F.lit(0))
    return entries.withColumn("removed", ~F.col(keep) & ((left > most_entries) | (left_bytes > most_bytes)))


def manifest(chunks: DataFrame, layer: Column) -> DataFrame:
    """(track_id, chunk, rows, sha256): what must hold of each layer when it is read again."""
    return chunks.select("track_id", "chunk", F.size("notes").alias("rows"), F.sha2(layer.cast("binary"), 256).alias("sha256"))


def check_manifest(chunks: DataFrame, layer: Column, expected: DataFrame) -> DataFrame:
    """(track_id, chunk, status): ``valid``, or why a layer isn't: missing, extra, rows, content."""
    own = manifest(chunks, layer)
    both = expected.select("track_id", "chunk", F.col("rows").alias("want"), F.col("sha256").alias("sha")).join(own, ["track_id", "chunk"], "full")
    status = F.when(F.col("rows").isNull(), "missing").when(F.col("want").isNull(), "extra").when(F.col("rows") != F.col("want"), "rows").when(F.col("sha") != F.col("sha256"), "content").otherwise("valid")
    return both.select("track_id", "chunk", status.alias("status"))


def layer_text(fields: Sequence[str] = ("note_id", "pitch", "vel", "ntype")) -> Column:
    """A chunk's whole numbers as text, the content that a manifest hashes."""
    return F.array_join(F.transform("notes", lambda n: F.concat_ws(":", *(n[f].cast("string") for f in fields))), ",")
