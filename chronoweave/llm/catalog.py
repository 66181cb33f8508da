"""The operators' queries, and SQL where it can state their results."""

from __future__ import annotations

from . import bpe_codec, conversation_repair, language_crf, periodic_runs, pii_pseudonyms, ppm_score, quality_rules, secret_scan, sequence_packing, simhash_dedup, suffix_dedup, voronoi_knn, warc_bundles

QUERIES = {
    "op1_warc_bundles": warc_bundles.op1_warc_bundles,
    "op2_quality_rules": quality_rules.op2_quality_rules,
    "op3_ppm_score": ppm_score.op3_ppm_score,
    "op4_voronoi_knn": voronoi_knn.op4_voronoi_knn,
    "op5_sequence_packing": sequence_packing.op5_sequence_packing,
    "op6_simhash_dedup": simhash_dedup.op6_simhash_dedup,
    "op7_pii_pseudonyms": pii_pseudonyms.op7_pii_pseudonyms,
    "op8_language_crf": language_crf.op8_language_crf,
    "op9_secret_scan": secret_scan.op9_secret_scan,
    "op10_bpe_codec": bpe_codec.op10_bpe_codec,
    "op11_suffix_dedup": suffix_dedup.op11_suffix_dedup,
    "op12_periodic_runs": periodic_runs.op12_periodic_runs,
    "op13_conversation_repair": conversation_repair.op13_conversation_repair,
}
ORACLES: dict[str, str] = {
    "op1_warc_bundles": warc_bundles.ORACLE_SQL,
    "op4_voronoi_knn": voronoi_knn.ORACLE_SQL,
}
