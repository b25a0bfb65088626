"""Records of JSON manifests, with the text and the truth of each value as their producers see them."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from timbre.functions.expr import basename
from timbre.schema import FALSY, LEGACY_TO_CANONICAL, MANIFEST_COLUMNS
from timbre.sources.listing import opened
from timbre.sources.splits import SPLIT_BYTES, batched, json_objects


def value_text(value: object) -> str:
    """None and NaN as an empty string, list items joined by a blank, all else as Python writes it."""
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return ""
    return " ".join(map(str, value)) if isinstance(value, list) else str(value)


_FIELDS = f"fields map<string,string>, `{FALSY}` array<string>"
_ROWS = f"source_manifest string, source_row long, {_FIELDS}"


def _columns(items: list[dict]) -> list[pa.Array]:
    """The text of all fields of each record, and the names of those that are false."""
    fields = pa.array([[(k, value_text(v)) for k, v in i.items()] for i in items], pa.map_(pa.string(), pa.string()))
    return [fields, pa.array([[k for k, v in i.items() if not v] for i in items], pa.list_(pa.string()))]


def json_records(payloads: DataFrame, extras: list[str] | None = None) -> DataFrame:
    """One row per object of each JSON array in ``payloads`` (``source_manifest``, ``content``).

    Unreadable and non-list payloads give no rows, items that are not objects are dropped, and
    ``source_row`` counts the rest. All canonical and legacy fields become text columns, NULL where
    the record lacks the field. ``extras`` names further ones; by default all others stay together
    in a map column ``extras``.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):  # one at a time: contents may be large
                yield from _rows(name.as_py(), content.as_py())

    return _shaped(payloads.select("source_manifest", "content").mapInArrow(read, _ROWS), extras)


def json_folder_records(files: DataFrame, extras: list[str] | None = None) -> DataFrame:
    """:func:`json_records` of files (``path``) that one of Arrow's file systems knows, each read where it is parsed."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, inner, _ = opened(path)
                with system.open_input_stream(inner) as stream:
                    content = stream.read().decode()
                yield from _rows(path.rsplit("/", 1)[-1], content)

    spread = files.select("path").repartition(files.sparkSession.sparkContext.defaultParallelism, "path")
    return _shaped(spread.mapInArrow(read, _ROWS), extras)


def _rows(name: str, content: str | None) -> Iterator[pa.RecordBatch]:
    try:
        payload = json.loads(content)
    except (TypeError, ValueError, RecursionError):
        return
    items, number = (i for i in payload if isinstance(i, dict)) if isinstance(payload, list) else (), 0
    for held in batched(items):
        columns = [pa.array([name] * len(held), pa.string()), pa.array(range(number, number + len(held)), pa.int64()), *_columns(held)]
        number += len(held)
        yield pa.RecordBatch.from_arrays(columns, ["source_manifest", "source_row", "fields", FALSY])


def json_file_records(files: DataFrame, extras: list[str] | None = None, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Like :func:`json_records` for files (``path``, ``bytes``), each read by as many tasks as it has ranges.

    Here text that isn't JSON ends the job.
    """
    found = json_objects(files, _columns, _FIELDS, split_bytes)
    return _shaped(found.select(basename("path").alias("source_manifest"), "source_row", "fields", FALSY), extras)


def _shaped(found: DataFrame, extras: list[str] | None) -> DataFrame:
    known = [*MANIFEST_COLUMNS[:-2], *LEGACY_TO_CANONICAL]
    if extras is None:
        rest = F.map_filter("fields", lambda k, _: ~k.isin(*known, "source_manifest", "source_row")).alias("extras")
        kept = [rest]
    else:
        kept = [F.col("fields")[f].alias(f) for f in extras]
    return found.select("source_manifest", "source_row", *[F.col("fields")[f].alias(f) for f in known], *kept, FALSY)
