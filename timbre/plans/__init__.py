"""Registered queries over the given tables."""

from timbre.plans import queries_builders, queries_manifest, queries_matching, queries_metrics, queries_reports, queries_sources, queries_text  # noqa: F401
from timbre.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
