"""Connected components by alternating large-star and small-star rounds, all as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Rounds after which a graph that still changes is an error, never a cut result. Rounds needed grow with the logarithm of the diameter.
MOST_ROUNDS = 60


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One star round over links (src, dst). Large: neighbours above a node go to its smallest; small: those below it."""
    both = links.union(links.select("dst", "src"))
    if not large:
        both = both.filter("src > dst")
    lowest = both.groupBy("src").agg(F.min("dst").alias("low")).select("src", F.least("src", "low").alias("low"))
    moved = both.join(lowest, "src")
    if large:
        return moved.filter("dst > src").select(F.col("low").alias("src"), "dst").distinct()
    own = lowest.select(F.col("low").alias("src"), F.col("src").alias("dst"))
    return moved.filter("dst != low").select(F.col("low").alias("src"), "dst").union(own).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component): for every node of ``links`` (src, dst) the smallest node reachable.

    Each round is written to the shared folder, which cuts the lineage and outlives lost executors; the driver sees
    two aggregate numbers a round. An empty table gives no rows; loops and repeated links don't matter.
    """
    links = links.filter("src != dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    seen = None
    for _ in range(MOST_ROUNDS):
        last, links = links, common.written(_star(_star(links, True), False), "components")
        if seen is not None:
            common.remove(last)  # the round before, read for the last time
        now = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)")).alias("sum")).first()
        if seen == now:
            break
        seen = now
    else:
        raise RuntimeError(f"components still change after {MOST_ROUNDS} rounds")
    return links.select(F.col("dst").alias("node"), F.col("src").alias("component")).union(links.select("src", "src")).distinct()
