"""Embedding whitening through an incremental eigendecomposition.

Every component becomes a whole number; the covariance is that of the distinct vectors. Each task keeps the
eigenpairs of the centred scatter of its vectors, and adds one vector at a time: a rank-one update, whose
secular equation gives the new eigenvalues, directions that it hardly touches being deflated. Spectra of
tasks are combined in a tree, a few at a time, by one update for each eigenpair of the other and one for the
distance of the means. With the combined vectors as a basis the covariance is then summed once more over
all vectors, centred by the exact mean, and its small matrix solved (Rayleigh-Ritz): what rounding the
many updates left goes away there. One spectrum, of the square of the width, reaches the driver and the tasks.

Defined results: rows whose vector is null or holds a null or non-finite component are left out; repeated rows
and equal or null ids give rows of their own; components missing from shorter vectors are zero; whole numbers
beyond 64 bits become the nearest long; other columns are ignored unless ``keep`` names them. A component whose
eigenvalue is below ``LEAST_SHARE`` of the largest has no direction and gives no rows, so equal vectors alone,
one vector, or an empty table give none. ``deviation`` is exact, and null where it doesn't fit a long.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from timbre.llm.spectra import Spectrum, pack, unpack
from timbre.llm.vectors import usable
from timbre.session import cut_lineage

SCALE = 256
COMPONENTS = 4
#: Vectors whose spectrum one task finds, about, and states that one task combines.
TASK_VECTORS, COMBINED = 4_096, 8
#: Eigenvalues below this share of the largest are rounding.
LEAST_SHARE = 1e-11
_LONG = 1 << 63


def _whole(column: pa.Array) -> np.ndarray:
    """Rows of a column of equally long lists."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _states(rows: DataFrame, fold: Callable[[Iterator[np.ndarray]], bytes | None]) -> DataFrame:
    """(part, state): what ``fold`` makes of each partition's vectors; a partition without any has none."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = fold(_whole(b.column(0)) for b in batches if b.num_rows)
        held = [] if state is None else [state]
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["state"])

    return rows.mapInArrow(compute, "state binary").select(F.spark_partition_id().cast("long").alias("part"), "state")


def _combined(states: DataFrame, combine: Callable[[bytes, bytes], bytes]) -> bytes | None:
    """All states combined in a tree of checkpointed rounds, a few of them in a task at a time."""
    held = cut_lineage(states)
    parts = held.agg(F.max("part")).first()[0]

    def join(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("part").to_numpy())
        packed = [table.column("state")[k].as_py() for k in order.tolist()]
        state = packed[0]
        for other in packed[1:]:
            state = combine(state, other)
        return pa.table([pa.array([int(table.column("part")[0].as_py()) // COMBINED]), pa.array([state], pa.binary())], ["part", "state"])

    while parts:
        held = cut_lineage(held.groupBy(F.floor(F.col("part") / COMBINED)).applyInArrow(join, "part long, state binary"))
        parts //= COMBINED
    row = held.first()
    return None if row is None else bytes(row["state"])


def _sums(fit: DataFrame, width: int) -> tuple[int, list[int], int]:
    """(vectors, exact sum of each dimension, largest absolute entry)."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows, most = [0] * width, 0, 0
        for batch in batches:
            if batch.num_rows:
                whole = _whole(batch.column(0))
                most = max(most, abs(int(whole.max())), abs(int(whole.min())))
                own = whole.sum(axis=0) if most * len(whole) < _LONG else whole.astype(object).sum(axis=0)
                total, rows = [a + int(b) for a, b in zip(total, own, strict=True)], rows + len(whole)
        columns = [pa.array(list(range(width)), pa.int32()), pa.array([str(t) for t in total], pa.string()), pa.array([rows] * width, pa.int64()), pa.array([str(most)] * width, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["place", "total", "n", "most"])

    parts = fit.mapInArrow(compute, "place int, total string, n long, most string")
    decimal = "decimal(38,0)"
    found = parts.groupBy("place").agg(F.sum(F.col("total").cast(decimal)).alias("total"), F.sum("n").alias("n"), F.max(F.col("most").cast(decimal)).alias("most")).orderBy("place").collect()
    return (found[0]["n"], [int(r["total"]) for r in found], int(found[0]["most"])) if found else (0, [], 0)


def _spectrum(vectors: Iterator[np.ndarray]) -> bytes | None:
    seen = None
    for block in vectors:
        for vector in block.astype(float):
            seen = seen or Spectrum.empty(len(vector))
            seen.add(vector)
    return seen and seen.pack()


def _merge_spectra(one: bytes, other: bytes) -> bytes:
    left, right = sorted((Spectrum.unpack(one), Spectrum.unpack(other)), key=lambda s: -s.count)
    left.merge(right)
    return left.pack()


def _scatter(centre: np.ndarray, basis: np.ndarray) -> Callable[[Iterator[np.ndarray]], bytes | None]:
    """Count, mean and centred products of the projections of all vectors."""

    def fold(vectors: Iterator[np.ndarray]) -> bytes | None:
        state = None
        for block in vectors:
            own = (block - centre) @ basis
            mean = own.mean(axis=0)
            found = pack(np.array([len(own)], float), mean, (own - mean).T @ (own - mean))
            state = found if state is None else _merge_scatters(state, found)
        return state

    return fold


def _merge_scatters(one: bytes, other: bytes) -> bytes:
    (n, mean, products), (m, second, others) = unpack(one), unpack(other)
    both, apart = n + m, second - mean
    return pack(both, mean + apart * m / both, products + others + np.outer(apart, apart) * n * m / both)


def whiten(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE, keep: Sequence[str] = ("vec_id",)) -> DataFrame:
    """``keep`` with (component, n, deviation, whitened, explained, identity_error) of each row and component."""
    results = ("component", "n", "deviation", "whitened", "explained", "identity_error")
    rest = [c for c in keep if c.lower() not in results]
    clean = vectors.filter(usable(F.col("embedding")))
    width = clean.agg(F.max(F.size("embedding"))).first()[0] or 0
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("bigint"))
    filled = F.concat(whole, F.array_repeat(F.lit(0).cast("bigint"), (F.lit(width) - F.size("embedding")).cast("int")))
    # a batch function can't be given names with dots
    rows = clean.select(*[F.col(f"`{c}`").alias(f"_{k}") for k, c in enumerate(rest)], filled.alias("whole"))
    schema = vectors.select(*[F.col(f"`{c}`") for c in rest]).schema
    for name, kind in zip(results, ("integer", "long", "long", "double", "double", "double"), strict=True):
        schema = schema.add(name, kind)
    if not width:
        return vectors.sparkSession.createDataFrame([], schema)

    fit = cut_lineage(rows.select("whole").distinct())
    n, sums, most = _sums(fit, width)
    fit = fit.coalesce(-(-n // TASK_VECTORS))
    centre = np.array([s / n for s in sums])
    spectrum = Spectrum.unpack(_combined(_states(fit, _spectrum), _merge_spectra))
    basis, _ = np.linalg.qr(spectrum.vectors[:, ::-1])
    values, turn = np.linalg.eigh(unpack(_combined(_states(fit, _scatter(centre, basis)), _merge_scatters))[2] / n)
    values, basis = values[::-1], (basis @ turn)[:, ::-1]
    there = int((values[:components] > LEAST_SHARE * max(values[0], 0)).sum())
    if not there:
        return vectors.sparkSession.createDataFrame([], schema)
    project = basis[:, :there] / np.sqrt(values[:there])
    covariance = unpack(_combined(_states(fit, _scatter(centre, project)), _merge_scatters))[2] / n
    identity_error = float(np.abs(covariance - np.eye(there)).max())
    explained = values[:there] / values.sum()
    small = (n * most + max(abs(s) for s in sums)) ** 2 * width < _LONG

    def deviations(block: np.ndarray) -> list[int | None]:
        apart = n * (block if small else block.astype(object)) - np.array(sums, np.int64 if small else object)
        found = (apart * apart).sum(axis=1).tolist()
        return found if small else [d if d < _LONG else None for d in found]

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            block = _whole(batch.column(batch.num_columns - 1))
            row = np.repeat(np.arange(len(block)), there)
            again = pa.array(row)
            columns = [c.take(again) for c in batch.columns[:-1]]
            columns += [
                pa.array(np.tile(np.arange(1, there + 1, dtype=np.int32), len(block))),
                pa.array(np.full(len(row), n)),
                pa.array(deviations(block), pa.int64()).take(again),
                pa.array(((block - centre) @ project).ravel()),
                pa.array(np.tile(explained, len(block))),
                pa.array(np.full(len(row), identity_error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, [*rest, *results])

    return rows.mapInArrow(answer, schema)
