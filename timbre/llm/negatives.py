"""Hard negatives: rows of other labels that score just below an anchor's positives.

Components become whole weights and a score is an inner product, so everything is exact. Anchors and
candidates are dealt into blocks by a hash of their id, and blocks of anchors meet blocks of candidates.
Inside a task the scores of a tile come from Strassen's recursive multiplication of 64-bit integers:
odd sides are padded with zeros, and all sums are exact (those of 64-bit integers wrap, and the wraps
cancel, for the scores themselves are proven to fit).

A first pass over the blocks of the anchor's own label keeps a heap of positives for each anchor. A second
one over all blocks keeps, for each anchor and positive, a heap of the rows of other labels within the
window of scores that the positive opens. Heaps are merged tile by tile in a task and between tasks by a
ranked window. The work is anchors x rows, as the definition asks; a task holds two blocks and one tile.

Defined results: rows with a null id, label or vector, or a null or non-finite component, take no part; of
rows repeating an id that with the smallest (vector, label) counts; components missing from shorter
vectors are zero; ties go to the smaller id; anchors without positives, or positives without negatives,
give no rows, nor does an empty table; other columns are ignored. Scores that may pass 64 bits are
computed with Python's integers, ranked exactly, and reported as the nearest long.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from timbre.llm.vectors import best, decode_scores, encode_scores, fits_long, scores_to_long, usable, whole_weights
from timbre.session import cut_lineage

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
#: A negative's score lies between these hundredths of its positive's.
WINDOW = (50, 95)
#: Rows of a block of anchors or candidates, and of the tiles that are multiplied at once.
BLOCK_ROWS = 8_192
TILE_ANCHORS, TILE_CANDIDATES = 512, 4_096
#: Sides from which a product is cut in halves.
_SPLIT_FROM = 16


def _even(matrix: np.ndarray) -> np.ndarray:
    """Zeros below and beside a matrix until both sides are even."""
    m, n = matrix.shape
    if not m % 2 and not n % 2:
        return matrix
    out = np.zeros((m + m % 2, n + n % 2), matrix.dtype)
    out[:m, :n] = matrix
    return out


def strassen(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The product of two integer matrices by seven products of their quarters."""
    m, k, n = a.shape[0], a.shape[1], b.shape[1]
    if min(m, k, n) < _SPLIT_FROM:
        return a @ b if a.dtype != object else (a[:, :, None] * b[None]).sum(axis=1)
    a, b = _even(a), _even(b)
    mm, kk, nn = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:mm, :kk], a[:mm, kk:], a[mm:, :kk], a[mm:, kk:]
    b11, b12, b21, b22 = b[:kk, :nn], b[:kk, nn:], b[kk:, :nn], b[kk:, nn:]
    out = np.zeros((2 * mm, 2 * nn), a.dtype)
    c11, c12, c21, c22 = out[:mm, :nn], out[:mm, nn:], out[mm:, :nn], out[mm:, nn:]
    both = strassen(a11 + a22, b11 + b22)
    c11 += both
    c22 += both
    low = strassen(a21 + a22, b11)
    c21 += low
    c22 -= low
    right = strassen(a11, b12 - b22)
    c12 += right
    c22 += right
    left = strassen(a22, b21 - b11)
    c11 += left
    c21 += left
    top = strassen(a11 + a12, b22)
    c11 -= top
    c12 += top
    c22 += strassen(a21 - a11, b11 + b12)
    c11 += strassen(a12 - a22, b21 + b22)
    return out[:m, :n]


class TopHeap:
    """The ``k`` highest scores seen, ties to the smaller id; the root is the one that leaves next."""

    __slots__ = ("k", "held")

    def __init__(self, k: int) -> None:
        self.k, self.held = k, []

    def merge(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """``ids`` ascending."""
        for at in best(scores, ids, self.k).tolist():
            entry = (int(scores[at]), -int(ids[at]))
            if len(self.held) < self.k:
                heapq.heappush(self.held, entry)
            elif entry > self.held[0]:
                heapq.heapreplace(self.held, entry)
            else:
                break

    def least(self) -> int | None:
        """The score below which nothing enters any more."""
        return self.held[0][0] if len(self.held) == self.k else None

    def entries(self) -> list[tuple[int, int]]:
        return [(-least_id, score) for score, least_id in self.held]


class _Block:
    """Rows of a group, by ascending id."""

    def __init__(self, table: pa.Table, width: int) -> None:
        ids = table.column("vec_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        self.ids, self.label = ids[order], table.column("label").to_numpy()[order]
        self.weights = whole_weights(table.column("embedding"), width, SCALE)[order]
        self.windows = [table.column("positives")[k].as_py() for k in order.tolist()] if "positives" in table.column_names else None


def _tiles(anchors: _Block, candidates: _Block, small: bool) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first anchor, first candidate, scores) of each tile."""
    kind = np.int64 if small else object
    across = candidates.weights.astype(kind, copy=False)
    for c in range(0, len(across), TILE_CANDIDATES):
        right = np.ascontiguousarray(across[c : c + TILE_CANDIDATES].T)
        for a in range(0, len(anchors.ids), TILE_ANCHORS):
            yield a, c, strassen(anchors.weights[a : a + TILE_ANCHORS].astype(kind, copy=False), right)


def _positives(anchor_rows: pa.Table, candidate_rows: pa.Table, width: int, small: bool) -> pa.Table:
    """The best rows of one label in one block, for each anchor of that label."""
    out: tuple[list, list, list] = ([], [], [])
    if len(anchor_rows) and len(candidate_rows):
        anchors, candidates = _Block(anchor_rows, width), _Block(candidate_rows, width)
        heaps = [TopHeap(POSITIVES) for _ in anchors.ids]
        for a, c, scores in _tiles(anchors, candidates, small):
            ids = candidates.ids[c : c + scores.shape[1]]
            for row, own in zip(range(len(scores)), anchors.ids[a:].tolist(), strict=False):
                other = ids != own
                heaps[a + row].merge(scores[row][other], ids[other])
        for anchor, heap in zip(anchors.ids.tolist(), heaps, strict=True):
            for vec_id, score in heap.entries():
                out[0].append(anchor)
                out[1].append(vec_id)
                out[2].append(score)
    return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), encode_scores(out[2], small)], ["anchor_id", "positive_id", "positive_score"])


def _negatives(anchor_rows: pa.Table, candidate_rows: pa.Table, width: int, small: bool) -> pa.Table:
    """The best rows of other labels in one block, for each window of each anchor."""
    out: tuple[list, list, list, list] = ([], [], [], [])
    if len(anchor_rows) and len(candidate_rows):
        anchors, candidates = _Block(anchor_rows, width), _Block(candidate_rows, width)
        windows = []
        for held in anchors.windows:
            bounds = zip([w["positive_id"] for w in held], decode_scores([w["positive_score"] for w in held]), strict=True)
            windows.append([(p, s, -(-WINDOW[0] * s // 100), WINDOW[1] * s // 100, TopHeap(NEGATIVES)) for p, s in bounds])
        for a, c, scores in _tiles(anchors, candidates, small):
            ids, labels = candidates.ids[c : c + scores.shape[1]], candidates.label[c : c + scores.shape[1]]
            for row in range(len(scores)):
                wide = [w for w in windows[a + row] if w[2] <= w[3]]
                if not wide:
                    continue
                low = min(max(w[2], w[4].least() if w[4].least() is not None else w[2]) for w in wide)
                near = np.flatnonzero((scores[row] >= low) & (scores[row] <= max(w[3] for w in wide)) & (labels != anchors.label[a + row]))
                own, own_ids = scores[row][near], ids[near]
                for _, _, low, high, heap in wide:
                    inside = (own >= low) & (own <= high)
                    heap.merge(own[inside], own_ids[inside])
        for anchor, held in zip(anchors.ids.tolist(), windows, strict=True):
            for positive, score, _, _, heap in held:
                for vec_id, found in heap.entries():
                    for column, value in zip(out, (anchor, positive, vec_id, (score, found)), strict=True):
                        column.append(value)
    scores = [encode_scores([s[k] for s in out[3]], small) for k in (0, 1)]
    return pa.table([*[pa.array(c, pa.int64()) for c in out[:3]], *scores], ["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"])


def _copies(parts: Column, name: str) -> Column:
    """A row for each of ``parts`` blocks."""
    return F.explode(F.sequence(F.lit(0).cast("bigint"), parts.cast("bigint") - 1)).alias(name)


def _blocks(rows: Column) -> Column:
    return F.greatest(F.ceil(rows / BLOCK_ROWS), F.lit(1)).cast("bigint")


def hard_negatives(vectors: DataFrame, is_anchor: Column, label: Column | None = None) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); ``label`` may rewrite the column."""
    held = vectors.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("embedding")))
    one = held.groupBy("vec_id").agg(F.min(F.struct("embedding", F.col("label").cast("bigint").alias("label"))).alias("row"))
    rows = cut_lineage(one.select("vec_id", "row.embedding", "row.label").withColumn("label", label if label is not None else F.col("label")).withColumn("asks", is_anchor))
    n, width, small = fits_long(rows, SCALE)
    score = "long" if small else "string"
    place = F.xxhash64("vec_id")
    plain = ("vec_id", "embedding", "label")
    # columns of their own: both sides of a cogroup come from the same rows
    renewed = [F.col(c).alias(c) for c in plain]

    counted = rows.groupBy("label").agg(_blocks(F.count(F.lit(1))).alias("wide"), _blocks(F.count_if("asks")).alias("high"), F.count_if("asks").alias("anchors"))
    labelled = rows.join(counted.filter("anchors > 0"), "label")
    candidates = labelled.select(*plain, F.pmod(place, "wide").alias("across"), _copies(F.col("high"), "down"))
    anchors = labelled.filter("asks").select(*renewed, _copies(F.col("wide"), "across"), F.pmod(place, "high").alias("down"))
    keys = ("label", "across", "down")
    partial = anchors.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInArrow(
        lambda a, c: _positives(a, c, width, small), f"anchor_id long, positive_id long, positive_score {score}"
    )
    first = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id"))
    positives = partial.withColumn("place", first).filter(F.col("place") <= POSITIVES)
    windows = positives.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("positives"))

    asking = cut_lineage(rows.filter("asks").drop("asks").join(windows, "vec_id"))
    wide, high = -(-n // BLOCK_ROWS) or 1, -(-asking.count() // BLOCK_ROWS) or 1
    candidates = rows.select(*plain, F.pmod(place, F.lit(wide)).alias("across"), _copies(F.lit(high), "down"))
    anchors = asking.select(*renewed, "positives", _copies(F.lit(wide), "across"), F.pmod(place, F.lit(high)).alias("down"))
    partial = anchors.groupBy("across", "down").cogroup(candidates.groupBy("across", "down")).applyInArrow(
        lambda a, c: _negatives(a, c, width, small), f"anchor_id long, positive_id long, negative_id long, positive_score {score}, negative_score {score}"
    )
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    ranked = partial.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= NEGATIVES)
    found = ranked.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
    return found if small else scores_to_long(found, "positive_score", "negative_score")
