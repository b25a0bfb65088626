"""Exact top-k search by inner product: term-at-a-time accumulation over blocks.

Components become integer weights. Candidates and queries are dealt into blocks of bounded rows by
a hash of their id, and each query block meets each candidate block once. There the candidates are
turned into postings (for each component the rows that have it, and their weights); a query, as a
sparse row, scatters its weighted postings into a dense array of scores, a partition selection
keeps its best rows, and the blocks' best rows are merged.

Defined results: vectors that are null or hold a null or non-finite component take no part, nor do
rows with a null ``vec_id``; of rows repeating a ``vec_id`` the smallest vector counts; missing
components of shorter vectors are zero; ties go to the smaller ``vec_id``; an empty table, or one
without queries, gives no rows; other columns are ignored. Scores are exact: where one may pass 64 bits,
by the largest component and the width, Python's integers are used, and what is beyond a long is
reported as the nearest long, ranked by its true value.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from timbre.llm.vectors import best, encode_scores, fits_long, merge_best, scores_to_long, usable, whole_weights
from timbre.session import cut_lineage

TOP = 10
SCALE = 1024
#: Rows of a candidate block and of a query block.
CANDIDATES, QUERIES = 8_192, 8_192


def _postings(weights: np.ndarray) -> list[tuple[np.ndarray | slice, np.ndarray]]:
    """For every term the rows that have it (a slice where all have) and their weights."""
    lists = []
    for term in range(weights.shape[1]):
        column = weights[:, term]
        rows = np.flatnonzero(column)
        lists.append((slice(None), column.copy()) if len(rows) == len(column) else (rows, column[rows]))
    return lists


def _search(queries: pa.Table, candidates: pa.Table, k: int, width: int, scale: int, small: bool) -> pa.Table:
    found: tuple[list, list, list] = ([], [], [])
    if len(queries) and len(candidates):
        ids = candidates.column("vec_id").to_numpy()
        order = np.argsort(ids)
        kind = np.int64 if small else object
        ids, weights = ids[order], whole_weights(candidates.column("embedding"), width, scale)[order].astype(kind, copy=False)
        asked = whole_weights(queries.column("embedding"), width, scale).astype(kind, copy=False)
        postings = _postings(weights)
        scores = np.empty(len(ids), kind)
        for query, row in zip(queries.column("vec_id").to_pylist(), asked, strict=True):
            scores[:] = 0
            for term in np.flatnonzero(row).tolist():
                rows, held = postings[term]
                scores[rows] += held * row[term]
            own = np.searchsorted(ids, query)
            other = np.arange(len(ids)) != own if own < len(ids) and ids[own] == query else slice(None)
            top = best(scores[other], ids[other], k)
            found[0].extend([query] * len(top))
            found[1].extend(ids[other][top].tolist())
            found[2].extend(scores[other][top].tolist())
    return pa.table([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), encode_scores(found[2], small)], ["query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, is_query, k: int = TOP, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows where ``is_query`` holds, against all other rows."""
    held = vectors.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    # one row an id, so that copies of a row don't meet in one block
    one = held.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    rows = cut_lineage(one.withColumn("_asks", is_query))
    n, width, small = fits_long(rows, scale)
    across, down = -(-n // CANDIDATES) or 1, -(-rows.filter("_asks").count() // QUERIES) or 1
    place = F.xxhash64("vec_id")
    candidates = rows.select("vec_id", "embedding", F.pmod(place, F.lit(across)).alias("across"), F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("down"))
    everywhere = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(across - 1).cast("bigint"))).alias("across")
    queries = rows.filter("_asks").select(*[F.col(c).alias(c) for c in ("vec_id", "embedding")], everywhere, F.pmod(place, F.lit(down)).cast("int").alias("down"))
    cells = queries.groupBy("across", "down").cogroup(candidates.groupBy("across", "down"))
    score = "long" if small else "string"
    partial = cells.applyInArrow(lambda q, c: _search(q, c, k, width, scale, small), f"query_id long, vec_id long, score {score}")
    found = merge_best(partial, k)
    return found if small else scores_to_long(found, "score")
