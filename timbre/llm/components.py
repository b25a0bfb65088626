"""Connected components of a link table.

Every partition first merges its own links into stars. Alternating star operations over all links follow,
each round checkpointed, until a round changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from timbre.session import cut_lineage


#: Rows of a checkpoint's file, about: many tiny files cost more than the rows in them.
FILE_ROWS = 65_536


def parts_for(rows: int) -> int:
    return -(-rows // FILE_ROWS) or 1


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest node of its neighbourhood."""
    both = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("_least"))
    joined = both.join(least, "a").filter(F.col("b") > F.col("a"))
    return joined.select(F.col("b").alias("a"), F.least("a", "_least").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the smallest of them."""
    least = links.groupBy("a").agg(F.min("b").alias("_least"))
    moved = links.join(least, "a").filter(F.col("b") != F.col("_least"))
    return moved.select(F.col("b").alias("a"), F.col("_least").alias("b")).unionAll(least.select("a", F.col("_least").alias("b")))


def _merge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Stars with the components of the links of a partition, which holds about ``FILE_ROWS``."""
    held = [frame[["a", "b"]].to_numpy(np.int64) for frame in frames]
    if held:
        nodes, number = np.unique(np.concatenate(held).ravel(), return_inverse=True)
        label = smallest_labels(number[0::2], number[1::2], len(nodes))
        outer = np.flatnonzero(label != np.arange(len(nodes)))
        yield pd.DataFrame({"a": nodes[outer], "b": nodes[label[outer]]})


def smallest_labels(a: np.ndarray, b: np.ndarray, size: int, label: np.ndarray | None = None) -> np.ndarray:
    """The smallest position that each position reaches through the pairs (a, b)."""
    label = np.arange(size) if label is None else label
    while True:
        left, right = label[a], label[b]
        open_pairs = left != right
        if not open_pairs.any():
            return label
        a, b, left, right = a[open_pairs], b[open_pairs], left[open_pairs], right[open_pairs]
        np.minimum.at(label, np.maximum(left, right), np.minimum(left, right))
        while not np.array_equal(jumped := label[label], label):
            label = jumped


def connected_components(links: DataFrame, about: int | None = None) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); the component is its smallest node.

    ``about`` is a number of rows that the links hardly exceed, by which their files are sized.
    """
    at = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct()
    at = cut_lineage(at if about is None else at.coalesce(parts_for(about)))
    at = cut_lineage(at.coalesce(parts_for(at.count())).mapInPandas(_merge, "a long, b long"))
    before = _state(at)
    while before[0]:
        at = cut_lineage(_small_star(_large_star(at)).distinct().coalesce(parts_for(before[0])))
        after = _state(at)
        if after == before:
            break
        before = after
    return at.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(
        at.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
