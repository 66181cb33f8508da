import base64
import hashlib
import io

import numpy as np
from pyspark.sql import functions as F

from chronoweave.llm import common, voronoi_knn, warc_bundles as W

PAGES = [(1, "http://a/ b", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "u", None), (4, "u", ""), (5, "u", "unique"), (5, "u", "unique"), (None, "u", "lost"), (7, "u", "x" * 400_000)]


def test_pages_come_back_from_archives(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    folder = f"file://{tmp_path}/warc"
    index = W.write_bundles(pages, folder, frame_bytes=500)
    rows = W.read_records(index, folder).collect()
    assert len(rows) == len(PAGES)
    groups = {}
    for i, _, html in PAGES:
        groups.setdefault(html or "", []).append(i)
    for r in rows:
        html = next(h or "" for i, _, h in PAGES if i == r["page_id"])
        data = html.encode()
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        ids = [i for i in groups[html] if i is not None]
        keeper = max(ids) if ids else None
        assert r["record_type"] == ("response" if r["page_id"] == keeper else "revisit") and r["refers_to"] == (None if r["page_id"] == keeper else keeper)
        assert r["payload"] == (data if r["record_type"] == "response" else None)
    empty = W.write_bundles(pages.limit(0), folder)
    assert empty.count() == 0 and W.read_records(empty, folder).count() == 0


def test_a_very_frequent_payload_gives_the_same_records(spark, tmp_path, monkeypatch):
    pages = spark.createDataFrame([(i, "u", "" if i % 3 == 0 else "twin" if i % 3 == 1 else f"page {i}") for i in range(90)], "page_id long, url string, html string")
    found = []
    for least in (1, 10_000):
        monkeypatch.setattr(common.join_counted, "__defaults__", ("inner", least))
        rows = W.read_records(W.write_bundles(pages, f"file://{tmp_path}/{least}"), f"file://{tmp_path}/{least}").collect()
        found.append(sorted((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in rows))
    assert found[0] == found[1] and len(found[0]) == 90 and sum(r[1] == "response" for r in found[0]) == 32


def test_frames_are_independent_and_damage_is_seen():
    class Sink(io.BytesIO):
        def close(self):
            pass

    sink = Sink()
    w = W.BundleWriter(sink, frame_bytes=10)
    records = [W.warc_record(i, "u", b"x" * i, None, False) for i in range(5)]
    for r in records:
        w.add(r)
    w.close()

    class Source(io.BytesIO):
        def size(self):
            return len(self.getvalue())

    reader = W.BundleReader(Source(sink.getvalue()))
    for r, (frame, offset, length) in reversed(list(zip(records, w.places, strict=True))):
        assert reader.frame(frame)[offset : offset + length] == r
    assert len(reader.frames) == 5 and W.parse_record(records[3])["payload"] == b"xxx"


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    vectors = [(int(i), [float(v) for v in rng.normal(size=6) + 3 * (i % 4)]) for i in range(400)]
    vectors += [(400 + i, vectors[7][1]) for i in range(60)] + [(900, None), (901, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (902, [float("nan")] * 6), (903, [float("inf")] * 6), (950, [1.0, 2.0])]
    data = voronoi_knn.quantised(spark.createDataFrame(vectors, "vec_id long, embedding array<double>")).cache()
    pivots = {6: np.array([[0.0] * 6, [768.0] * 6, [1536.0] * 6]), 2: np.zeros((1, 2))}
    got = sorted(tuple(r) for r in voronoi_knn.voronoi_top_k(data.filter("vec_id % 50 = 0"), data, query_rows=4, data_rows=50, pivots=pivots).collect())
    x = {i: np.floor(256 * np.array(v)).astype(int) for i, v in vectors if v and len(v) == 6 and all(c is not None and np.isfinite(c) for c in v)}
    want = []
    for q in x:
        if q % 50 == 0:
            best = sorted((-int(x[q] @ x[i]), i) for i in x if i != q)[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == sorted(want)
    assert voronoi_knn.voronoi_top_k(data.limit(0), data).count() == 0
