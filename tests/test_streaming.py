import datetime
import glob
import os

import pytest
from pyspark.sql import functions as F

from chronoweave.streaming import windows as S

EVENTS = "/root/testdata/sf0.001/events.parquet"


def normal(df):
    return sorted(tuple(map(str, r)) for r in df.collect())


@pytest.mark.parametrize("operator", [S.tumbling, S.sliding, S.sessions])
def test_stream_equals_batch(spark, tmp_path, operator):
    batch = spark.read.parquet(EVENTS).withColumn("ts", F.col("ts").cast("timestamp"))
    batch.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(batch.schema).parquet(f"{tmp_path}/in")
    out = S.drained(operator(stream, late="40 days"), f"drained_{operator.__name__}", f"{tmp_path}/checkpoint", "complete" if operator is not S.sessions else "append")
    want = normal(operator(batch))
    got = normal(out)
    assert got == want if operator is not S.sessions else set(got) <= set(want)


def test_peak_meter_keeps_state_between_batches(spark, tmp_path):
    rows = [(k, s, float((7 * s + k) % 5)) for k in range(2) for s in range(10)]
    for part in range(2):
        spark.createDataFrame([r for r in rows if r[1] // 5 == part], "key long, seq long, level double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("key long, seq long, level double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = {(r["key"], r["seq"]): r["peak"] for r in S.drained(S.peak_meter(stream), "meter", f"{tmp_path}/checkpoint").collect()}
    for k in range(2):
        peak = 0.0
        for s in range(10):
            peak = max(float((7 * s + k) % 5), 0.82 * peak)
            assert got[k, s] == pytest.approx(peak)


def fed(spark, folder, parts, schema):
    """A stream of ``parts``, a file and a micro-batch each, in their order."""
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        (newest,) = [f for f in glob.glob(f"{folder}/in/*.parquet") if f not in seen_files.setdefault(folder, set())]
        seen_files[folder].add(newest)
        os.utime(newest, (1_000_000 + i, 1_000_000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


seen_files: dict[str, set] = {}
ROW = "ts timestamp, user_id long, event_type string, value double"


def at(hour, minute=0):
    return datetime.datetime(2024, 1, 1, hour, minute)


def test_late_rows_are_dropped_and_windows_come_once(spark, tmp_path):
    parts = [[(at(10), 1, "a", 1.0), (at(10, 30), 1, "a", 2.0)], [(at(12), 1, "a", 4.0)], [(at(12, 5), 1, "a", 32.0)], [(at(10, 5), 1, "a", 100.0), (at(11, 55), 1, "a", 8.0)], [(at(20), 1, "a", 16.0)]]
    stream = fed(spark, str(tmp_path), parts, ROW)
    rows = S.drained(S.tumbling(stream, "1 hour", "10 minutes"), "late_tumbling", f"{tmp_path}/checkpoint").collect()
    got = {r["start_ts"].hour: (r["n"], r["total"]) for r in rows}
    # 10:05 comes after the watermark, which drops rows a batch after it was reached, and is lost; 11:55 is within it; 20:00 is still open
    assert got == {10: (2, 3.0), 11: (1, 8.0), 12: (2, 36.0)} and len(rows) == 3


def test_sessions_of_a_stream_equal_those_of_the_batch(spark, tmp_path):
    parts = [[(at(8, m), u, "a", float(m)) for m in (0, 10, 50) for u in (1, 2)], [(at(9, 5), 1, "a", 7.0), (at(12), 2, "a", 1.0)], [(at(23), 9, "a", 0.0)]]
    stream = fed(spark, str(tmp_path), parts, ROW)
    got = [r for r in S.drained(S.sessions(stream, "30 minutes", "1 minute"), "all_sessions", f"{tmp_path}/checkpoint").collect() if r["user_id"] != 9]
    batch = spark.createDataFrame([r for p in parts[:2] for r in p], ROW)
    want = S.sessions(batch, "30 minutes").collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) == 5
