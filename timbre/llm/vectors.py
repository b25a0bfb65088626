"""Shared by the searches: vectors in Arrow batches, whole weights and their exact scores, the best rows of an array."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

#: Scores that may pass 64 bits travel as text: the score plus this, in as many digits, so that text order is score order.
_OFFSET, _DIGITS = 10**700, 701
_LONG = 1 << 63


def usable(embedding: Column, zero: bool = True) -> Column:
    """True where a vector is there and all its components are finite; ``zero=False``: and not all zero."""
    odd = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fine = embedding.isNotNull() & ~F.coalesce(odd, F.lit(True))
    return fine if zero else fine & F.exists(embedding, lambda x: x != 0)


def matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as doubles, shorter ones filled up with zeros, longer ones cut to ``width``."""
    out = np.zeros((len(column), width))
    at = 0
    for part in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        sizes = np.diff(part.offsets.to_numpy())
        flat = part.flatten().to_numpy(zero_copy_only=False).astype(float)
        row = np.repeat(np.arange(at, at + len(part)), sizes)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        fits = place < width
        out[row[fits], place[fits]] = flat[fits]
        at += len(part)
    return out


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` highest scores, ties to the smaller id; ``ids`` ascending."""
    if len(scores) > k:
        least = -np.partition(-scores, k - 1)[k - 1]
        above = np.flatnonzero(scores > least)
        level = np.flatnonzero(scores == least)[: k - len(above)]
        found = np.concatenate([above, level])
    else:
        found = np.arange(len(scores))
    return found[np.lexsort((ids[found], -scores[found]))]


def merge_best(partial: DataFrame, k: int) -> DataFrame:
    """The best ``k`` rows (query_id, vec_id, score) of each query over all parts, with ``rank`` from 1."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = partial.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def whole_weights(column: pa.ChunkedArray | pa.Array, width: int, scale: int) -> np.ndarray:
    """``floor(scale * x)`` of every component, exactly: 64-bit integers where they fit, else Python's."""
    given = matrix(column, width)
    if not given.size or np.abs(given).max() * scale < 1 << 53:
        return np.floor(given * scale).astype(np.int64)
    # a double beyond 2**53 is whole itself
    whole = [int(x) * scale if abs(x) >= 1 << 53 else int(np.floor(x * scale)) for x in given.ravel().tolist()]
    return np.array(whole, object).reshape(given.shape)


def fits_long(vectors: DataFrame, scale: int) -> tuple[int, int, bool]:
    """(rows, width, whether no inner product of whole weights can pass 64 bits), in one pass over ``embedding``."""
    size = F.array_max(F.transform("embedding", lambda x: F.abs(x.cast("double"))))
    facts = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("width"), F.max(size).alias("most")).first()
    width, most = max(1, facts["width"] or 0), (int(facts["most"] or 0) + 1) * scale + 1
    return facts["n"], width, width * most * most < _LONG


def encode_scores(scores: list[int], small: bool) -> pa.Array:
    """A column of scores that sorts as they do: longs, or text if they may pass 64 bits."""
    return pa.array(scores, pa.int64()) if small else pa.array([f"{s + _OFFSET:0{_DIGITS}d}" for s in scores], pa.string())


def decode_scores(values: list) -> list[int]:
    return [v if isinstance(v, int) else int(v) - _OFFSET for v in values]


def scores_to_long(found: DataFrame, *columns: str) -> DataFrame:
    """Text scores as longs; those beyond a long's range become its end."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = [
                pa.array([max(-_LONG, min(_LONG - 1, s)) for s in decode_scores(batch.column(k).to_pylist())], pa.int64()) if name in columns else batch.column(k)
                for k, name in enumerate(batch.schema.names)
            ]
            yield pa.RecordBatch.from_arrays(arrays, batch.schema.names)

    kinds = {name: kind for name, kind in found.dtypes}
    return found.mapInArrow(convert, ", ".join(f"{c} {'long' if c in columns else kinds[c]}" for c in found.columns))
