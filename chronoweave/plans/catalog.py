"""The registered queries and the SQL that states the same results."""

from __future__ import annotations

from . import aggregate_queries, arrange_queries, cleanup_queries, curve_queries, feature_queries, harmony_queries, interval_queries, matching_queries, ordered_queries, phrase_queries, projection_queries, recovery_queries, rhythm_queries, sequence_queries, set_queries, source_queries, stream_queries  # noqa: F401
from .base import ORACLES, QUERIES  # noqa: F401

FLAGSHIP = "phrase_numbers"
