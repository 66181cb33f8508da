"""Running values over a key, in one level or two: within time buckets, and over what the buckets before them hold.

A window over a whole key sorts all its rows in one task. That is the cheaper form while no key is large; a key of more
than ROWS_A_BUCKET rows is cut into time buckets of about so many, each sorted by itself, and one row a bucket goes
over the key. Both forms give the same values. Rows that all stand at one time can't be cut by it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .walks import join_keys

#: Rows of a key that one task sorts.
ROWS_A_BUCKET = 2_000_000
#: Rows that a task of ``dealt`` sorts.
ROWS_A_TASK = 500_000
#: Bytes, as Spark estimates them, below which an input isn't counted: no key of it can be that large.
SMALL_BYTES = 64 << 20


def bucket_width(rows: DataFrame, on: Sequence[str], at: str, most: int = ROWS_A_BUCKET) -> float | None:
    """The width of buckets that leaves about ``most`` rows in each of the largest key, or None if no key has more."""
    if int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < SMALL_BYTES:
        return None
    n = F.count(at)
    keys = rows.groupBy(*on).agg(n.alias("n"), (F.max(at) - F.min(at)).cast("double").alias("span")).filter(F.col("n") > most)
    return keys.agg(F.min(F.col("span") / F.ceil(F.col("n") / most))).first()[0] or None


def dealt(rows: DataFrame, on: Sequence[str], n: int) -> DataFrame:
    """``rows``, about ``n`` of them, dealt by ``on`` to so many tasks that one sorts ROWS_A_TASK on average at most, and to the session's number at least."""
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(least, -(-n // ROWS_A_TASK)), *on)


def _bucket(at: str, width: float) -> Column:
    return F.floor(F.col(at) / width)


def _over(on: Sequence[str]) -> Window:
    """The buckets of a key before one."""
    return Window.partitionBy(*on).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)


def running_sums(rows: DataFrame, on: Sequence[str], at: str, then: Sequence[str], sums: Mapping[str, Column], width: float | None = None) -> DataFrame:
    """``rows`` with each of ``sums`` up to the row, and its peers, in order of ``at`` and ``then`` within ``on``; ``width`` forces buckets."""
    width = bucket_width(rows, on, at) if width is None else width
    if width is None:
        return rows.withColumns({n: F.sum(c).over(Window.partitionBy(*on).orderBy(at, *then)) for n, c in sums.items()})
    cut = rows.withColumns({"__bucket": _bucket(at, width), **{f"__x_{n}": c for n, c in sums.items()}})
    totals = cut.groupBy(*on, "__bucket").agg(*(F.sum(f"__x_{n}").alias(f"__t_{n}") for n in sums))
    before = totals.select(*on, "__bucket", *(F.coalesce(F.sum(f"__t_{n}").over(_over(on)), F.lit(0)).alias(f"__b_{n}") for n in sums))
    own = cut.withColumns({n: F.sum(f"__x_{n}").over(Window.partitionBy(*on, "__bucket").orderBy(at, *then)) for n in sums})
    return join_keys(own, before, [*on, "__bucket"]).select(*rows.columns, *((F.col(n) + F.col(f"__b_{n}")).alias(n) for n in sums))


def running_maxima(rows: DataFrame, on: Sequence[str], at: str, then: Sequence[str], maxima: Mapping[str, Column], width: float | None = None) -> DataFrame:
    """``rows`` with the largest of each of ``maxima`` up to the row, and its peers, in order of ``at`` and ``then`` within ``on``; ``width`` forces buckets."""
    width = bucket_width(rows, on, at) if width is None else width
    if width is None:
        return rows.withColumns({n: F.max(c).over(Window.partitionBy(*on).orderBy(at, *then)) for n, c in maxima.items()})
    cut = rows.withColumns({"__bucket": _bucket(at, width), **{f"__x_{n}": c for n, c in maxima.items()}})
    tops = cut.groupBy(*on, "__bucket").agg(*(F.max(f"__x_{n}").alias(f"__t_{n}") for n in maxima))
    before = tops.select(*on, "__bucket", *(F.max(f"__t_{n}").over(_over(on)).alias(f"__b_{n}") for n in maxima))
    own = cut.withColumns({n: F.max(f"__x_{n}").over(Window.partitionBy(*on, "__bucket").orderBy(at, *then)) for n in maxima})
    return join_keys(own, before, [*on, "__bucket"]).select(*rows.columns, *(F.greatest(n, f"__b_{n}").alias(n) for n in maxima))


def carried(rows: DataFrame, on: Sequence[str], at: str, then: Sequence[str], value: str, name: str | None = None, after: str | None = None, width: float | None = None) -> DataFrame:
    """``rows`` with ``name``: the last ``value`` that isn't null up to the row in order of ``at`` and ``then``; and with ``after``: the first one from the other end, in which ``then`` keeps its order.

    Both come from one deal of the rows; ``width`` forces buckets.
    """
    width = bucket_width(rows, on, at) if width is None else width
    wanted = {n: back for n, back in ((name, False), (after, True)) if n}
    turn = {False: F.asc, True: F.desc}
    seen = lambda keys, back: Window.partitionBy(*keys).orderBy(turn[back](at), *then).rowsBetween(Window.unboundedPreceding, 0)
    if width is None:
        return rows.withColumns({n: F.last(value, ignorenulls=True).over(seen(on, back)) for n, back in wanted.items()})
    cut = rows.withColumn("__bucket", _bucket(at, width))
    place = lambda back: F.when(F.col(value).isNotNull(), F.struct((-F.col(at) if back else F.col(at)).alias("at"), *then))
    ends = cut.groupBy(*on, "__bucket").agg(*(F.max_by(value, place(back)).alias(f"__end_{n}") for n, back in wanted.items()))
    over = lambda back: Window.partitionBy(*on).orderBy(turn[back]("__bucket")).rowsBetween(Window.unboundedPreceding, -1)
    before = ends.select(*on, "__bucket", *(F.last(f"__end_{n}", ignorenulls=True).over(over(back)).alias(f"__b_{n}") for n, back in wanted.items()))
    own = cut.withColumns({f"__own_{n}": F.last(value, ignorenulls=True).over(seen([*on, "__bucket"], back)) for n, back in wanted.items()})
    return join_keys(own, before, [*on, "__bucket"]).select(*rows.columns, *(F.coalesce(f"__own_{n}", f"__b_{n}").alias(n) for n in wanted))


def islands(rows: DataFrame, on: Sequence[str], reach: float, at: str = "start_ms", then: Sequence[str] = ("note_id",), width: float | None = None) -> DataFrame:
    """``island``: a new one begins where a row is more than ``reach`` after the one before; ``width`` forces buckets."""
    width = bucket_width(rows, on, at) if width is None else width
    fresh = lambda before: F.when(F.col(at) - before <= reach, 0).otherwise(1)
    if width is None:
        w = Window.partitionBy(*on).orderBy(at, *then)
        marked = rows.withColumn("__fresh", fresh(F.lag(at).over(w)))
        return marked.withColumn("island", F.sum("__fresh").over(w)).drop("__fresh")
    cut = rows.withColumn("__bucket", _bucket(at, width))
    lasts = cut.groupBy(*on, "__bucket").agg(F.max(at).alias("__last"))
    before = lasts.select(*on, "__bucket", F.max("__last").over(_over(on)).alias("__before"))
    near = F.lag(at).over(Window.partitionBy(*on, "__bucket").orderBy(at, *then))
    met = join_keys(cut.withColumn("__near", near), before, [*on, "__bucket"])
    marked = met.withColumn("__fresh", fresh(F.coalesce("__near", "__before"))).drop("__bucket", "__near", "__before")
    return running_sums(marked, on, at, then, {"island": F.col("__fresh")}, width).drop("__fresh")
