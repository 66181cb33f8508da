"""The batch forms of the streaming windows; tests hold the streams against them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import windows as S
from ..tables import table
from . import ordered_queries  # noqa: F401
from .base import query


def _events(spark, sf):
    return table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _plain(df):
    return df.withColumns({c: F.unix_micros(c) for c in ("start_ts", "end_ts")})


@query("""SELECT epoch_us(time_bucket(INTERVAL 1 hour, ts)) AS start_ts, epoch_us(time_bucket(INTERVAL 1 hour, ts)) + 3600000000 AS end_ts, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL""")
def block_render(spark, sf):
    return _plain(S.tumbling(_events(spark, sf)))


@query("""WITH e AS (SELECT *, epoch_us(ts) AS us FROM events), w AS (SELECT (us // 1800000000 - k) * 1800000000 AS start_ts, event_type, value FROM e, range(4) r(k))
SELECT start_ts, start_ts + 7200000000 AS end_ts, event_type, count(*) AS n, round(sum(value), 6) AS total FROM w GROUP BY ALL""")
def chunk_overlap(spark, sf):
    return _plain(S.sliding(_events(spark, sf)))


@query("""WITH e AS (SELECT user_id, epoch_us(ts) AS us, value FROM events), f AS (SELECT *, CASE WHEN us - lag(us) OVER w >= 1800000000 THEN 1 ELSE 0 END AS fresh FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY us) AS run FROM f)
SELECT min(us) AS start_ts, max(us) + 1800000000 AS end_ts, user_id, count(*) AS n, round(sum(value), 6) AS total FROM s GROUP BY user_id, run""")
def phrase_session(spark, sf):
    return _plain(S.sessions(_events(spark, sf)))
