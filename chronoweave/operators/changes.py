"""Change sets: an operation log applied to ordered rows by joins, all or nothing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import by_start


def indexed(notes: DataFrame) -> DataFrame:
    """``idx``: the place of a note among its track's, from 0."""
    return notes.withColumn("idx", (F.row_number().over(by_start("track_id")) - 1).cast("long"))


def violations(rows: DataFrame, ops: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Operations that can't apply: an index that no row has (inserts may go to the end), an old value that isn't there, an index changed twice."""
    has = rows.select("track_id", "idx", F.struct(*fields).alias("now"))
    ends = rows.groupBy("track_id").agg(F.max("idx").alias("last"))
    found = ops.join(has, ["track_id", "idx"], "left").join(ends, "track_id", "left")
    lost = F.when(F.col("op") == "insert", ~F.col("idx").between(0, F.coalesce("last", F.lit(-1)) + 1)).otherwise(F.col("now").isNull() | ~F.col("now").eqNullSafe(F.col("before")))
    changes = F.count(F.when(F.col("op") != "insert", 1)).over(Window.partitionBy("track_id", "idx"))
    return found.withColumn("__n", changes).filter(lost | ((F.col("op") != "insert") & (F.col("__n") > 1))).select("track_id", "op", "idx")


def apply(rows: DataFrame, ops: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(track_id, place, *fields) after ``ops`` (track_id, op, idx, seq, before, after). Any violation fails the whole set.

    Inserts at an index come before its row, in order of ``seq``; indexes mean the order before the change. Rows and
    operations meet in one table dealt by index: what stands at an index, whether a row stands before it, and what
    changes it are windows there, so nothing is read or joined twice.
    """
    row = F.struct(*fields)
    kind = rows.select(row.alias("r")).schema["r"].dataType
    none = F.lit(None).cast(kind)
    at_row = rows.select("track_id", "idx", F.lit("row").alias("op"), F.lit(0).alias("seq"), row.alias("now"), none.alias("before"), none.alias("after"))
    after_row = rows.select("track_id", (F.col("idx") + 1).alias("idx"), F.lit("end").alias("op"), F.lit(0).alias("seq"), none.alias("now"), none.alias("before"), none.alias("after"))
    asked = ops.select("track_id", "idx", "op", F.col("seq").cast("int").alias("seq"), none.alias("now"), F.col("before").cast(kind).alias("before"), F.col("after").cast(kind).alias("after"))
    w = Window.partitionBy("track_id", "idx")
    changes = F.col("op").isin("replace", "delete")
    met = at_row.unionByName(after_row).unionByName(asked).withColumns({
        "here": F.max("now").over(w), "ended": F.max(F.col("op") == "end").over(w), "n": F.count_if(changes).over(w), "change": F.max(F.when(changes, F.struct("op", "after"))).over(w),
    })
    no_place = (F.col("op") == "insert") & ((F.col("idx") < 0) | ((F.col("idx") > 0) & F.col("here").isNull() & ~F.col("ended")))
    lost = changes & (F.col("here").isNull() | ~F.col("here").eqNullSafe(F.col("before")) | (F.col("n") > 1))
    stays = (F.col("op") == "insert") | ((F.col("op") == "row") & ~F.col("change.op").eqNullSafe("delete"))
    kept = met.filter(F.when(no_place | lost, F.raise_error(F.lit("the change set doesn't fit the rows")).cast("boolean")).otherwise(stays))
    value = F.when(F.col("op") == "insert", F.col("after")).when(F.col("change.op") == "replace", F.col("change.after")).otherwise(F.col("now"))
    out = kept.select("track_id", "idx", F.when(F.col("op") == "insert", 0).otherwise(1).alias("k"), "seq", value.alias("v"))
    place = F.row_number().over(Window.partitionBy("track_id").orderBy("idx", "k", "seq")) - 1
    return out.select("track_id", place.cast("long").alias("place"), *(F.col(f"v.{f}").alias(f) for f in fields))
