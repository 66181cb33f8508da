"""The pipeline against its stages worked out apart from each other."""

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_small_operators import brute_groups, fingerprint
from tokenizers import Tokenizer

import corpus_pipeline
from chronoweave.llm import common, language_crf, quality_rules, secret_scan


def test_pipeline_equals_its_stages(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    more = spark.createDataFrame([(9001, None, "en", "x", None), (9002, "", None, "x", 0), (9003, "... 123", "en", "x", 7)], docs.schema)
    docs.unionByName(more).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    known = {r["doc_id"] for r in language_crf.identify_languages(docs).collect() if r["lang_pred"] != "und" and r["score"] >= language_crf.LEAST_SCORE}
    ids = sorted(known)
    good = [i for i, k in zip(ids, quality_rules.measure(None, [rows[i] for i in ids])["kept"].tolist(), strict=True) if k]
    groups = brute_groups({i: fingerprint(rows[i]) for i in good})
    kept = {i for i, g in groups.items() if i == g}
    assert {9001, 9002, 9003}.isdisjoint(kept) and len(kept) < len(rows)
    clean = {r["doc_id"]: r["text"] for r in secret_scan.redact_secrets(docs).collect()}
    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokens = {i: len(coder.encode(clean[i], add_special_tokens=False).ids) + 1 for i in kept}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    found = {}
    for r in got:
        found[r["doc_id"]] = found.get(r["doc_id"], 0) + r["length"]
    assert found == tokens
    ends = np.array([r["offset"] + r["length"] for r in got])
    assert ends.max() <= 2048
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "quality_rules", "simhash_dedup", "secret_scan", "best_fit_packing"]


def test_empty_documents_and_extra_columns(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0).withColumns({"__own": F.lit(1), "spans": F.lit("x"), "block": F.lit(2)})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name


class OnCluster:
    """A session as a cluster has it, without a shared folder."""

    class conf:  # noqa: N801
        get = staticmethod(lambda key, default=None: default)

    class sparkContext:  # noqa: N801
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)


def test_no_local_folder_on_a_cluster():
    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(OnCluster)
