"""Bag and set operations, exact and fuzzy deduplication, and content hashes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S


def micro_keys(notes: DataFrame) -> DataFrame:
    """Notes keyed by whole microseconds, so equal times compare as equal."""
    us = lambda c: S.half_even(F.col(c) * 1000).cast("long")
    return notes.select(us("start_ms").alias("start_us"), us("dur_ms").alias("dur_us"), "pitch", "vel", "ntype")


def semantic_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: how many rows were added, removed and kept, as bags of equal keys. One shuffle on the key counts both sides."""
    keys = before.columns
    both = before.withColumn("__n", F.lit(-1)).unionByName(after.withColumn("__n", F.lit(1)))
    counts = both.groupBy(*keys).agg(F.sum("__n").alias("d"), F.count_if(F.col("__n") > 0).alias("a"), F.count_if(F.col("__n") < 0).alias("b"))
    zero = F.lit(0).cast("long")
    return counts.agg(F.coalesce(F.sum(F.greatest("d", zero)), zero).alias("added"), F.coalesce(F.sum(F.greatest(-F.col("d"), zero)), zero).alias("removed"), F.coalesce(F.sum(F.least("a", "b")), zero).alias("unchanged"))


def lossless_match(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: whether both hold the same bag of rows."""
    d = semantic_diff(a, b)
    return d.select(((F.col("added") == 0) & (F.col("removed") == 0)).alias("same"))


def dedupe_exact(rows: DataFrame, keys: Sequence[str], lineage: str) -> DataFrame:
    """(*keys, lineage, dropped): one row a key with the sorted union of the lineages, and how many rows it stands for beyond one."""
    return rows.groupBy(*keys).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(lineage)))).alias(lineage), (F.count("*") - 1).alias("dropped"))


def dedupe_fuzzy(notes: DataFrame, grid: float = 5.0) -> DataFrame:
    """One note a (track, start on the grid, pitch, articulation): the first, with the largest velocity and duration."""
    key = S.half_even(F.col("start_ms") / grid).cast("long").alias("slot")
    first = F.min(F.struct("start_ms", "note_id"))
    out = notes.groupBy("track_id", key, "pitch", "ntype").agg(first.alias("f"), F.max("vel").alias("vel"), F.max("dur_ms").alias("dur_ms"))
    return out.select("track_id", "f.note_id", "pitch", "vel", "f.start_ms", "dur_ms", "ntype")


def fingerprint(rows: DataFrame, on: Sequence[str], fields: Sequence[Column], chunk: Column) -> DataFrame:
    """(*on, digest): a content hash of a key's rows whatever their order.

    Rows are hashed, hashes of a ``chunk`` of the key are sorted and hashed, and then those of the chunks, so no task
    holds all rows of a key; ``chunk`` must follow from the row.
    """
    row = F.sha2(F.concat_ws("|", *(F.coalesce(f.cast("string"), F.lit("null")) for f in fields)), 256)
    parts = rows.select(*on, chunk.alias("__c"), row.alias("__h")).groupBy(*on, "__c").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("__h")), ""), 256).alias("__h"))
    return parts.groupBy(*on).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__c", "__h"))), lambda x: x["__h"]), ""), 256).alias("digest"))
