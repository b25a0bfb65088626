"""Hooks for user-supplied batch scorers and generators."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

# A loader builds the scorer once per task; the scorer maps a batch to one value per row.
Scorer = Callable[[pd.DataFrame], "pd.Series"]
Loader = Callable[[], Scorer]
#: Requests that are Python objects at once, and samples of results that are held.
_REQUESTS, _SAMPLES = 512, 1 << 22


def _isolated(scorer: Scorer, batch: pd.DataFrame) -> pd.Series:
    """Whole-batch call; a batch that fails is halved, down to the rows that fail, which become NULL."""
    try:
        return pd.Series(scorer(batch)).reset_index(drop=True)
    except Exception:
        if len(batch) <= 1:
            return pd.Series([None] * len(batch), dtype="object")
        middle = len(batch) // 2
        halves = [_isolated(scorer, part.reset_index(drop=True)) for part in (batch.iloc[:middle], batch.iloc[middle:])]
        return pd.concat([half.astype("object") for half in halves], ignore_index=True)


def score_pairs(df: DataFrame, scorers: dict[str, tuple[Loader, str]], partitions: int | None = None) -> DataFrame:
    """Add one column per scorer; a row that fails a scorer gets NULL for that metric only.

    ``scorers`` maps a column name to (loader, DDL type). A loader that fails disables its
    metric. ``partitions`` spreads heavy rows evenly over the cluster first.
    """
    schema = T.StructType(
        [*df.schema.fields, *[T.StructField(n, T._parse_datatype_string(d)) for n, (_, d) in scorers.items()]]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        loaded = {}
        for name, (loader, _) in scorers.items():
            try:
                loaded[name] = loader()
            except Exception:
                loaded[name] = None
        for batch in batches:
            batch = batch.reset_index(drop=True)
            columns = {
                name: pd.Series([None] * len(batch), dtype="object") if scorer is None else _isolated(scorer, batch)
                for name, scorer in loaded.items()
            }
            yield batch.assign(**columns)

    source = df if partitions is None else df.repartition(partitions)
    return source.mapInPandas(run, schema)


def score_distinct(df: DataFrame, keys: list[str], scorers: dict[str, tuple[Loader, str]]) -> DataFrame:
    """Score every distinct key once and join the result back."""
    scored = score_pairs(df.select(*keys).dropDuplicates(keys), scorers)
    return df.join(scored, keys, "left")


def _made(wave: np.ndarray, rate: int) -> tuple[np.ndarray, int]:
    return np.clip(np.nan_to_num(np.asarray(wave, dtype=np.float32)), -1.0, 1.0), int(rate)


def _generated(generate: Callable[[pd.DataFrame], Iterable[tuple[np.ndarray, int]]], batch: pd.DataFrame) -> list[tuple]:
    """(samples, rate, seconds, error) of each request; a batch that fails is halved, down to the requests that fail."""
    if not len(batch):
        return []
    started = time.perf_counter()
    try:
        made = [_made(wave, rate) for wave, rate in generate(batch)]
        if len(made) != len(batch):
            raise ValueError(f"{len(made)} results for {len(batch)} requests")
        seconds = (time.perf_counter() - started) / len(batch)
        return [(wave, rate, seconds, None) for wave, rate in made]
    except Exception as exc:
        if len(batch) == 1:
            return [(None, None, None, str(exc))]
        middle = len(batch) // 2
        return [row for part in (batch.iloc[:middle], batch.iloc[middle:]) for row in _generated(generate, part.reset_index(drop=True))]


def _generated_alone(generate: Callable[[dict], tuple[np.ndarray, int]], request: dict) -> tuple:
    """(samples, rate, seconds, error) of one request."""
    started = time.perf_counter()
    try:
        wave, rate = _made(*generate(request))
        return wave, rate, time.perf_counter() - started, None
    except Exception as exc:
        return None, None, None, str(exc)


def _synthesized(requests: DataFrame, loader: Callable[[], Callable], run: Callable[..., Iterator[tuple]], output_path: str) -> DataFrame:
    """The rows that ``run`` makes of a part of the requests with what ``loader`` returns, one for each request.

    Only so many requests at a time become Python objects, and results go on when they hold so many samples.
    """
    schema = "output_path string, samples array<float>, rate int, synthesis_time_sec double, error string"
    kinds = [pa.string(), pa.list_(pa.float32()), pa.int32(), pa.float64(), pa.string()]
    names = [f.split()[0] for f in schema.split(", ")]

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        generate = loader()
        for batch in batches:
            for at in range(0, batch.num_rows, _REQUESTS):
                part = pa.Table.from_batches([batch.slice(at, _REQUESTS)])
                paths, rows, held = part.column(output_path).to_pylist(), [], 0
                for path, row in zip(paths, run(generate, part.to_pandas(integer_object_nulls=True)), strict=True):
                    rows.append((path, *row))
                    held += 0 if row[0] is None else row[0].size
                    if held >= _SAMPLES:
                        yield packed(rows)
                        rows, held = [], 0
                if rows:
                    yield packed(rows)

    return requests.mapInArrow(compute, schema)


def synthesize_batches(
    requests: DataFrame,
    loader: Callable[[], Callable[[pd.DataFrame], Iterable[tuple[np.ndarray, int]]]],
    output_path: str = "output_path",
    batch_rows: int = 32,
) -> DataFrame:
    """Run a generator over a request table, at most ``batch_rows`` requests a call.

    The generator returns (wave, rate) for each row it is given. Returns ``(output_path, samples, rate,
    synthesis_time_sec, error)``; a failing request has NULL samples and the message instead, whatever it was called
    with. The time of a call is shared by its requests. Samples are made finite and clipped to [-1, 1].
    """

    def run(generate: Callable[[pd.DataFrame], Iterable[tuple[np.ndarray, int]]], part: pd.DataFrame) -> Iterator[tuple]:
        for at in range(0, len(part), batch_rows):
            yield from _generated(generate, part.iloc[at : at + batch_rows].reset_index(drop=True))

    return _synthesized(requests, loader, run, output_path)


def synthesize(
    requests: DataFrame, loader: Callable[[], Callable[[dict], tuple[np.ndarray, int]]], output_path: str = "output_path"
) -> DataFrame:
    """:func:`synthesize_batches` for a generator that takes one request, a mapping of its columns, and is timed by itself."""

    def run(generate: Callable[[dict], tuple[np.ndarray, int]], part: pd.DataFrame) -> Iterator[tuple]:
        return (_generated_alone(generate, request) for request in part.to_dict("records"))

    return _synthesized(requests, loader, run, output_path)


def synthesis_counts(results: DataFrame) -> DataFrame:
    """Requests, completed and failed rows of :func:`synthesize`."""
    return results.agg(
        F.count(F.lit(1)).alias("requested"),
        F.count_if(F.col("error").isNull()).alias("completed"),
        F.count_if(F.col("error").isNotNull()).alias("failed"),
    )
