"""Walks over null keys and ids above 2^53: a null key is a key like any other, and no row or digit is lost."""

import random

import pytest
from pyspark.sql import functions as F

from chronoweave.operators import arrange, curves, features, folds, harmony, intervals, matching, sequential

BIG = (1 << 53) + 1
SCHEMA = "track_id long, note_id long, pitch int, vel int, start_ms double, dur_ms double, ntype int, confidence double, reviewed boolean"


def rows(seed, pitches=(None, 60, 62)):
    r = random.Random(seed)
    return [(r.choice((None, 1, BIG)), BIG + i + 1000 * seed, r.choice(pitches), r.randrange(1, 128), float(r.randrange(900)), float(r.randrange(1, 90)), 0, r.randrange(100) / 100, i % 3 == 0) for i in range(90)]


def both(spark, data):
    """The rows, and the same ones with a number in place of each null."""
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    return df, df.fillna({"track_id": -7, "pitch": 61})


def plain(df):
    return sorted(str([-7 if n == "track_id" and v is None else 61 if n == "pitch" and v is None else v for n, v in zip(df.columns, r, strict=True)]) for r in df.collect())


WALKS = {
    "anchor_cluster": folds.anchor_cluster,
    "fold_same_pitch": folds.fold_same_pitch,
    "nms": sequential.nms,
    "instance_limit": sequential.instance_limit,
    "merge_gaps": sequential.merge_gaps,
    "note_matching": lambda n: sequential.note_matching(n.filter("reviewed"), n.filter("NOT reviewed")),
    "best_match_once": lambda n: intervals.best_match_once(n.filter("reviewed"), n.filter("NOT reviewed")),
    "candidate_overlap": lambda n: matching.candidate_overlap(n.filter("note_id % 3 != 0"), n.filter("note_id % 3 != 1").withColumn("start_ms", F.col("start_ms") + 5)),
    "region_replace": lambda n: matching.region_replace(n.filter("note_id % 2 = 0"), n.filter("note_id % 2 = 1"), 100.0, 700.0),
    "overlap_pairs": lambda n: intervals.overlap_pairs(n.select("track_id", "note_id", "start_ms", "dur_ms"), n.select("track_id", "note_id", "start_ms", "dur_ms"), 50.0, ["track_id"]),
}
#: Those that measure steps of pitch: a note without pitch has none, so only tracks are null here.
PITCHED = {
    "voice_tracking": sequential.voice_tracking,
    "melodic_lines": sequential.melodic_lines,
    "humanize_groups": lambda n: sequential.humanize_groups(n).select("note_id"),
    "song_features": features.song_features,
    "chord_classify": harmony.chord_classify,
    "harmony_windows": harmony.harmony_windows,
    "beam_select": lambda n: matching.beam_select(n.select("track_id", F.col("note_id").alias("option_id"), "confidence", F.col("pitch").alias("conflict")), ["track_id"]),
    "envelope_simplify": lambda n: curves.envelope_simplify(n.select("track_id", F.col("start_ms").alias("at"), F.col("vel").cast("double").alias("level"))),
    "lyric_align": lambda n: matching.lyric_align(n.filter("reviewed").select("track_id", F.col("note_id").alias("token_id"), F.when(F.col("note_id") % 2 == 0, F.col("start_ms")).alias("time")), n),
    "free_slot": lambda n: arrange.free_slot(n.select("track_id", F.col("note_id").alias("clip_id"), "start_ms", "dur_ms"), n.select("track_id", (F.floor(F.col("start_ms") / 100) * 100.0).alias("start_ms")).distinct().withColumn("end_ms", F.col("start_ms") + 60)),
}


@pytest.mark.parametrize("name", [*WALKS, *PITCHED])
def test_null_is_a_key_like_any_other(spark, name):
    walk, data = (WALKS[name], rows(1)) if name in WALKS else (PITCHED[name], rows(2, (60, 62, 65)))
    nulls, numbers = both(spark, data)
    got = plain(walk(nulls))
    assert got == plain(walk(numbers)) and len(got) > 2
    assert not {"track_id", "note_id"} <= set(walk(nulls).columns) or any(str(BIG) in x for x in got)


@pytest.mark.parametrize("name", ["voice_tracking", "melodic_lines"])
def test_rows_without_pitch_take_no_part(spark, name):
    data = rows(3)
    whole = spark.createDataFrame(data, SCHEMA)
    assert plain(sequential.voice_tracking(whole)) == plain(sequential.voice_tracking(whole.filter("pitch IS NOT NULL"))) if name == "voice_tracking" else sequential.melodic_lines(whole).count() > 0
