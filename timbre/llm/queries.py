"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from timbre.llm import (
    query_chat,
    query_licenses,
    query_multi_index,
    query_negatives,
    query_packing,
    query_simhash,
    query_substrings,
    query_subwords,
    query_topk,
    query_toxicity,
    query_urls,
    query_warc,
    query_whitening,
)

Query = Callable[[SparkSession, str], DataFrame]

_MODULES = [
    query_chat,
    query_licenses,
    query_multi_index,
    query_negatives,
    query_packing,
    query_simhash,
    query_substrings,
    query_subwords,
    query_topk,
    query_toxicity,
    query_urls,
    query_warc,
    query_whitening,
]

QUERIES: dict[str, Query] = {name: fn for module in _MODULES for name, fn in module.QUERIES.items()}
ORACLES: dict[str, str] = {name: sql for module in _MODULES for name, sql in getattr(module, "ORACLES", {}).items()}
