"""Approximate nearest neighbours by inner product: an inverted multi-index.

Each half of a vector is quantised with a codebook of its own; a pair of centroids is a cell. For a
query the pairs are visited in the order of their summed distance (the negated inner products of
its halves with the centroids) with a heap, until enough filled cells are seen, and all entries of
the visited cells are reranked with the original vectors.

Codebooks are fitted on a bounded sample; every row is indexed. On the same sample the share of
filled cells is measured that is needed for the wanted recall against brute force. Cells go to
shards by their first centroid; a crowded first centroid is split over several shards, so copies of
one vector never meet in one task.

Defined results: vectors that are null, zero, or hold a null or non-finite component take no part,
nor do rows with a null ``vec_id``; of rows repeating a ``vec_id`` the smallest vector counts;
components missing from shorter vectors are zero; ties go to the smaller ``vec_id``; an empty table,
or one without queries, gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from timbre.llm.vectors import best, matrix, merge_best, usable
from timbre.session import cut_lineage

TOP = 20
#: Rows that the codebooks and the visited share are fitted on, and the queries among them.
SAMPLE, SAMPLE_QUERIES = 8_192, 256
WANTED_RECALL = 0.96
#: Entries of a cell, about; fewest and most centroids of a half.
CELL_ENTRIES, FEWEST, MOST = 12, 8, 256
#: Entries of a shard.
SHARD_ENTRIES = 8_192
_ROUNDS = 12
_QUERIES_AT_ONCE = 256


@dataclass
class Index:
    width: int
    books: tuple[np.ndarray, np.ndarray]
    share: float = 1.0
    counts: np.ndarray | None = None

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        half = self.width // 2
        first, second = (_nearest(part, book) for part, book in zip((vectors[:, :half], vectors[:, half:]), self.books, strict=True))
        return first * len(self.books[1]) + second

    def visit(self, query: np.ndarray, enough: int) -> list[int]:
        """The first ``enough`` filled cells in the order of their summed distance."""
        half = self.width // 2
        away = [-(book @ part) for part, book in zip((query[:half], query[half:]), self.books, strict=True)]
        order = [np.argsort(a, kind="stable").tolist() for a in away]
        sorted_away = [a[o].tolist() for a, o in zip(away, order, strict=True)]
        left, right = sorted_away
        many, filled = len(right), self.counts
        heap, found = [(left[0] + right[0], 0, 0)], []
        # row i of the grid is opened when its left neighbour in the first column is taken
        while heap and len(found) < enough:
            _, i, j = heappop(heap)
            cell = order[0][i] * many + order[1][j]
            if filled[cell]:
                found.append(cell)
            if j + 1 < many:
                heappush(heap, (left[i] + right[j + 1], i, j + 1))
            if j == 0 and i + 1 < len(left):
                heappush(heap, (left[i + 1] + right[0], i + 1, 0))
        return found


def _nearest(points: np.ndarray, book: np.ndarray) -> np.ndarray:
    return np.argmin((book**2).sum(axis=1) - 2 * points @ book.T, axis=1)


def _codebook(points: np.ndarray, size: int) -> np.ndarray:
    """Lloyd's rounds from evenly spaced rows of the (hashed) sample."""
    book = np.unique(points, axis=0)
    book = book[np.linspace(0, len(book) - 1, min(size, len(book))).astype(int)].copy()
    for _ in range(_ROUNDS):
        at = _nearest(points, book)
        members = np.bincount(at, minlength=len(book))
        sums = np.zeros_like(book)
        np.add.at(sums, at, points)
        book[members > 0] = sums[members > 0] / members[members > 0, None]
    return book


def fit(sample: np.ndarray, rows: int, k: int = TOP, wanted: float = WANTED_RECALL) -> Index:
    """Codebooks for ``rows`` entries, and the share of filled cells that gives the wanted recall on the sample."""
    width = sample.shape[1]
    size = int(min(MOST, max(FEWEST, (rows / CELL_ENTRIES) ** 0.5)))
    index = Index(width, (_codebook(sample[:, : width // 2], size), _codebook(sample[:, width // 2 :], size)))
    cell = index.cells(sample)
    index.counts = np.bincount(cell, minlength=len(index.books[0]) * len(index.books[1]))
    filled = int((index.counts > 0).sum())
    needed = []
    for q in range(0, len(sample), max(1, len(sample) // SAMPLE_QUERIES)):
        scores = sample @ sample[q]
        scores[q] = -np.inf
        near = np.argsort(-scores, kind="stable")[: min(k, len(sample) - 1)]
        place = {c: n for n, c in enumerate(index.visit(sample[q], filled), start=1)}
        needed += [place[c] for c in cell[near].tolist()]
    if needed:
        index.share = float(np.quantile(needed, wanted)) / filled
    return index


def _shards(per_first: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(first shard, number of shards) of each first centroid; small ones share a shard."""
    base, parts, shard, held = np.zeros(len(per_first), np.int64), np.ones(len(per_first), np.int64), 0, 0
    for c, count in enumerate(per_first.tolist()):
        if held and held + count > SHARD_ENTRIES:
            shard, held = shard + 1, 0
        base[c], parts[c] = shard, max(1, -(-count // SHARD_ENTRIES))
        if parts[c] > 1:
            shard, held = shard + int(parts[c]), 0
        else:
            held += count
    return base, parts, shard + 1


def _rerank(queries: pa.Table, entries: pa.Table, width: int, k: int) -> pa.Table:
    """The best entries of one shard for every query that visits it."""
    out: tuple[list, list, list] = ([], [], [])
    if len(queries) and len(entries):
        ids = entries.column("vec_id").to_numpy()
        order = np.argsort(ids)
        ids, cell = ids[order], entries.column("cell").to_numpy()[order]
        vectors = matrix(entries.column("embedding"), width)[order]
        known, number = np.unique(cell, return_inverse=True)
        for at in range(0, len(queries), _QUERIES_AT_ONCE):
            part = queries.slice(at, _QUERIES_AT_ONCE)
            asked = matrix(part.column("embedding"), width)
            rough = asked @ vectors.T
            for q, (query, cells) in enumerate(zip(part.column("query_id").to_pylist(), part.column("cells").to_pylist(), strict=True)):
                seen = np.flatnonzero(np.isin(known, cells)[number] & (ids != query))
                if len(seen) > k:  # the product's last bits depend on the row's place: what is near the limit is computed again
                    scores = rough[q, seen]
                    limit = -np.partition(-scores, k - 1)[k - 1]
                    seen = seen[scores >= limit - 1e-9 * (1 + np.abs(asked[q]).sum() * np.abs(vectors[seen]).max())]
                scores = (vectors[seen] * asked[q]).sum(axis=1)
                top = best(scores, ids[seen], k)
                out[0].extend([query] * len(top))
                out[1].extend(ids[seen][top].tolist())
                out[2].extend(scores[top].tolist())
    return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["query_id", "vec_id", "score"])


def nearest(vectors: DataFrame, is_query, k: int = TOP, wanted: float = WANTED_RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows where ``is_query`` holds, against all other rows."""
    clean = vectors.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding"), zero=False))
    rows = cut_lineage(clean.groupBy("vec_id").agg(F.min("embedding").alias("embedding")))
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("width")).first()
    if not facts["n"]:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width = max(2, facts["width"])
    picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").toArrow()
    index = fit(matrix(picked.column("embedding"), width), facts["n"], k, wanted)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = index.cells(matrix(batch.column("embedding"), width))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("embedding"), pa.array(cell, pa.int64())], ["vec_id", "embedding", "cell"])

    placed = rows.mapInArrow(place, "vec_id long, embedding array<float>, cell long")
    # at most MOST * MOST counts
    counted = placed.groupBy("cell").count().collect()
    many = len(index.books[1])
    index.counts = np.zeros(len(index.books[0]) * many, np.int64)
    for row in counted:
        index.counts[row["cell"]] = row["count"]
    enough = int(np.ceil(index.share * len(counted)))
    base, parts, _ = _shards(index.counts.reshape(-1, many).sum(axis=1))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, shards, own, cells = [], [], [], []
            for k, (query, vector) in enumerate(zip(batch.column("vec_id").to_pylist(), matrix(batch.column("embedding"), width), strict=True)):
                by_shard: dict[int, list[int]] = {}
                for cell in index.visit(vector, enough):
                    first = cell // many
                    for shard in range(base[first], base[first] + parts[first]):
                        by_shard.setdefault(int(shard), []).append(cell)
                for shard, visited in by_shard.items():
                    ids.append(query)
                    shards.append(shard)
                    own.append(k)
                    cells.append(visited)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(shards, pa.int64()), batch.column("embedding").take(pa.array(own, pa.int64())), pa.array(cells, pa.list_(pa.int32()))],
                ["query_id", "shard", "embedding", "cells"],
            )

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = batch.column("cell").to_numpy() // many
            shard = base[first] + batch.column("vec_id").to_numpy() % parts[first]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard, pa.int64())], ["vec_id", "embedding", "cell", "shard"])

    queries = rows.filter(is_query).mapInArrow(route, "query_id long, shard long, embedding array<float>, cells array<int>")
    entries = placed.mapInArrow(deal, "vec_id long, embedding array<float>, cell long, shard long")
    cells = queries.groupBy("shard").cogroup(entries.groupBy("shard"))
    return merge_best(cells.applyInArrow(lambda q, e: _rerank(q, e, width, k), "query_id long, vec_id long, score double"), k)
