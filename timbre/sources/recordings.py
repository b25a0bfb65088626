"""Long WAV recordings in ranges of frames, so that no task holds a whole one.

A first pass walks the chunk headers of each file by ranged reads. The frames are then dealt as rows (path, first,
count), each of which one task opens at its place. Sums over ranges give what a whole decode gives. A file that
isn't a readable WAV keeps its row with NULLs; a storage error ends the task, so that Spark tries again.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from timbre.sources.audio import _plain_path, _with_suffix, format_fields, mono_samples
from timbre.sources.listing import known_to_arrow, list_files, opened

#: Frames that a task reads at once.
RANGE_FRAMES = 1 << 20
_LAYOUT = "path string, bytes long, code int, rate int, channels int, bits int, data_at long, frames long"
_RANGES = "path string, code int, rate int, channels int, bits int, data_at long, first long, count long"


def _layout(source, size: int) -> tuple | None:
    """(code, rate, channels, bits, place of the data, frames) of an open file; None if it isn't a readable WAV."""

    def at(place: int, length: int) -> bytes:
        source.seek(place)
        return source.read(length)

    head = at(0, 12)
    if head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        return None
    fields, data, place = None, None, 12
    while place + 8 <= size:
        tag, length = struct.unpack("<4sI", at(place, 8))
        if tag == b"fmt ":
            fields = format_fields(at(place + 8, min(length, 40)))
            if fields is None:
                return None
        elif tag == b"data":
            data = (place + 8, min(length, size - place - 8))
        place += 8 + length + (length & 1)
    if fields is None or data is None:
        return None
    code, channels, rate, bits = fields
    width = bits // 8
    if not channels or not width or (bits != 24 and data[1] % width):
        return None
    return code, rate, channels, bits, data[0], data[1] // (width * channels)


def recording_layouts(files: DataFrame) -> DataFrame:
    """Format, place and number of frames of each ``(path, bytes)``; only headers are read."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["code", "rate", "channels", "bits", "data_at", "frames"]
        for frame in frames:
            found = []
            for path, size in zip(frame["path"], frame["bytes"], strict=True):
                system, inner, _ = opened(path)
                with system.open_input_file(inner) as source:
                    found.append(_layout(source, int(size)) or (None,) * len(names))
            layouts = pd.DataFrame(found, columns=names, index=frame.index).astype("Int64")
            yield pd.concat([frame[["path", "bytes"]], layouts], axis=1)

    return files.select("path", "bytes").mapInPandas(read, _LAYOUT)


def frame_ranges(layouts: DataFrame, range_frames: int = RANGE_FRAMES) -> DataFrame:
    """(path, format, first, count): the frames of all recordings in ranges, spread over the cluster."""
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("frames") - 1, F.lit(range_frames).cast("long")))
    ranges = layouts.filter("frames > 0").withColumn("first", starts)
    ranges = ranges.withColumn("count", F.least(F.lit(range_frames), F.col("frames") - F.col("first")))
    tasks = layouts.sparkSession.sparkContext.defaultParallelism
    return ranges.select(*[f.split()[0] for f in _RANGES.split(", ")]).repartition(tasks, "path", "first")


def _read_range(row) -> np.ndarray:
    """Mono samples of one range, by a seek."""
    frame = row.channels * (row.bits // 8)
    system, inner, _ = opened(row.path)
    with system.open_input_file(inner) as source:
        source.seek(row.data_at + row.first * frame)
        return mono_samples(source.read(row.count * frame), row.code, row.channels, row.bits)


def range_samples(ranges: DataFrame) -> DataFrame:
    """(path, first, samples): the mono samples of each range, one range at a time."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                yield pd.DataFrame({"path": [row.path], "first": [row.first], "samples": [_read_range(row)]})

    return ranges.mapInPandas(read, "path string, first long, samples array<float>")


def _range_sums(ranges: DataFrame) -> DataFrame:
    """Sum, sum of squares and largest sample of each range; no sample leaves the task."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sums = []
            for row in frame.itertuples(index=False):
                wave = _read_range(row).astype(np.float64)
                sums.append((row.path, wave.sum(), np.dot(wave, wave), wave.max()))
            yield pd.DataFrame(sums, columns=["path", "total", "energy", "peak"])

    return ranges.mapInPandas(read, "path string, total double, energy double, peak double")


def wav_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, bytes) of the WAV files below ``root``, on a store that tasks can seek in."""
    if not known_to_arrow(root):
        raise ValueError(f"recordings below {root} can't be read in ranges")
    return _with_suffix(list_files(spark, root), (".wav",), False)


def recording_facts(spark: SparkSession, root: str, range_frames: int = RANGE_FRAMES) -> DataFrame:
    """(path, bytes, rate, channels, frames, duration_sec, total, energy, peak) of every recording below ``root``.

    ``total``, ``energy`` and ``peak`` are of the mono samples; they are NULL without a frame.
    """
    layouts = recording_layouts(wav_files(spark, root))
    sums = _range_sums(frame_ranges(layouts, range_frames)).groupBy("path").agg(
        F.sum("total").alias("total"), F.sum("energy").alias("energy"), F.max("peak").alias("peak")
    )
    seconds = F.when((F.col("rate") > 0) & (F.col("frames") > 0), F.col("frames") / F.col("rate"))
    return layouts.join(sums, "path", "left").select(
        _plain_path().alias("path"), "bytes", "rate", "channels", "frames", seconds.alias("duration_sec"), "total", "energy", "peak"
    )
