"""Imports every module that registers queries."""

from quillstone.plans import audit_queries, coverage_queries, fact_queries, issuer_queries, join_queries, pick_queries, segment_queries, series_queries, share_queries, source_queries, statement_queries  # noqa: F401
from quillstone.plans.registry import QUERIES


def FLAGSHIP(spark, sf_dir):  # noqa: N802
    return QUERIES["latest_restated_ttm"](spark, sf_dir)
