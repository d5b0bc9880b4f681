"""Imports every module that registers queries."""

from verisieve.plans import attention_queries, detector_queries, feature_queries, frame_queries, matching_queries, model_queries, rank_queries, report_queries, source_queries, vector_queries  # noqa: F401
