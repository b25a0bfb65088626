"""Audio file inventory and WAV decoding."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from timbre.functions.expr import basename, col, parent_name, path_order, stem
from timbre.operators.manifest import canonicalize
from timbre.operators.ordering import positions_by_sort
from timbre.sources.listing import file_contents, list_files

AUDIO_DDL = (
    "path string, name string, stem string, parent string, bytes bigint, rate int, channels int, "
    "frames bigint, duration_sec double, samples array<float>"
)


def inventory_columns(df: DataFrame, root: str | None = None) -> DataFrame:
    """File columns derived from ``path`` (and ``bytes`` when present)."""
    path = F.col("path")
    relative = path if root is None else F.regexp_replace(path, "^(?:file:)?" + _quoted(root) + "/*", "")
    size = F.col("bytes") if "bytes" in df.columns else F.lit(None).cast("bigint")
    return df.select(
        path,
        basename(path).alias("name"),
        stem(path).alias("stem"),
        parent_name(path).alias("parent"),
        size.alias("bytes"),
        relative.alias("relative_path"),
    )


def _quoted(root: str) -> str:
    return r"\Q" + root.rstrip("/").removeprefix("file:") + r"\E"


def _with_suffix(files: DataFrame, extensions: tuple[str, ...], any_case: bool) -> DataFrame:
    name = F.lower(basename("path")) if any_case else basename("path")
    wanted = [name.endswith(e.lower() if any_case else e) for e in extensions]
    return files.filter(reduce(lambda a, b: a | b, wanted))


def _plain_path(path: str = "path") -> Column:
    return F.regexp_replace(path, "^file:/+", "/")


def audio_inventory(
    spark: SparkSession, root: str, extensions: tuple[str, ...] = (".wav",), any_case: bool = False
) -> DataFrame:
    """Recursive listing of audio files, whatever their names begin with; contents are never read.

    ``any_case`` compares suffixes without regard to case, as audio-only datasets do.
    """
    files = _with_suffix(list_files(spark, root), extensions, any_case)
    return inventory_columns(files.select(_plain_path().alias("path"), "bytes"), root)


def audio_only_records(spark: SparkSession, root: str, dataset: str) -> DataFrame:
    """Manifest records of a dataset that is only a tree of audio files: no transcripts, the speaker
    is the file's folder (empty for files in the root), one record per file in path order."""
    files = audio_inventory(spark, root, (".wav", ".flac"), any_case=True)
    inside = F.instr("relative_path", "/") > 0
    placed = positions_by_sort(
        files.select("relative_path", F.when(inside, F.col("parent")).otherwise("").alias("speaker_id")),
        [path_order("relative_path")],
        out="source_row",
    )
    return canonicalize(
        placed.select(
            F.lit("").alias("source_manifest"),
            "source_row",
            "speaker_id",
            F.col("relative_path").alias("prompt_file_name"),
            F.lit("").alias("prompt_text"),
        ),
        dataset,
    )


def wav_header(content: Column | str) -> Column:
    """struct(rate, channels, bits, frames, duration_sec) of a canonical 44-byte RIFF header."""
    data = col(content)

    def little(offset: int, width: int) -> Column:
        parts = [F.hex(F.substring(data, offset + 1 + i, 1)) for i in reversed(range(width))]
        return F.conv(F.concat(*parts), 16, 10).cast("bigint")

    channels, rate, bits, size = little(22, 2), little(24, 4), little(34, 2), little(40, 4)
    frame = F.nullif((channels * bits / 8).cast("bigint"), F.lit(0))
    frames = F.floor(size / frame).cast("bigint")
    return F.struct(
        rate.cast("int").alias("rate"),
        channels.cast("int").alias("channels"),
        bits.cast("int").alias("bits"),
        frames.alias("frames"),
        F.when((rate > 0) & (frames > 0), frames / rate).alias("duration_sec"),
    )


def format_fields(body: bytes) -> tuple[int, int, int, int] | None:
    """(code, channels, rate, bits) of a format chunk; None if it is cut off."""
    extended = len(body) >= 2 and struct.unpack_from("<H", body)[0] == 0xFFFE
    if len(body) < (26 if extended else 16):
        return None
    code, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", body)
    return struct.unpack_from("<H", body, 24)[0] if extended else code, channels, rate, bits


def _channel_samples(data: bytes, code: int, channels: int, bits: int) -> np.ndarray:
    """samples[frames, channels] of interleaved bytes; an unfinished frame is left out."""
    if code == 3:
        wave = np.frombuffer(data, dtype=f"<f{bits // 8}").astype(np.float64)
    elif bits == 8:
        wave = (np.frombuffer(data, dtype=np.uint8).astype(np.float64) - 128.0) / 128.0
    elif bits == 24:
        raw = np.frombuffer(data[: len(data) // 3 * 3], dtype=np.uint8).reshape(-1, 3).astype(np.int32)
        joined = raw[:, 0] | (raw[:, 1] << 8) | (raw[:, 2] << 16)
        wave = ((joined ^ 0x800000) - 0x800000) / 8388608.0
    else:
        wave = np.frombuffer(data, dtype=f"<i{bits // 8}") / float(1 << (bits - 1))
    frames = wave.size // channels
    return wave[: frames * channels].reshape(frames, channels)


def mono_samples(data: bytes, code: int, channels: int, bits: int) -> np.ndarray:
    """Mean over channels, as 32-bit floats."""
    wave = _channel_samples(data, code, channels, bits)
    return (wave.mean(axis=1) if len(wave) else np.zeros(0)).astype(np.float32)


def _parse_wav(content: bytes) -> tuple[int, int, np.ndarray]:
    """(rate, channels, samples[frames, channels]); walks the chunks of one file."""
    if content[:4] != b"RIFF" or content[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    fields, data, at = None, None, 12
    while at + 8 <= len(content):
        tag, size = content[at : at + 4], struct.unpack_from("<I", content, at + 4)[0]
        body = content[at + 8 : at + 8 + size]
        if tag == b"fmt ":
            fields = format_fields(body)
            if fields is None:
                raise ValueError("format chunk is cut off")
        elif tag == b"data":
            data = body
        at += 8 + size + (size & 1)
    if fields is None or data is None:
        raise ValueError("missing fmt or data chunk")
    code, channels, rate, bits = fields
    return rate, channels, _channel_samples(data, code, channels, bits)


def decode_wav(files: DataFrame) -> DataFrame:
    """Decode ``(path, content)`` rows into mono float samples (mean over channels).

    Files that cannot be decoded keep their row with NULL audio columns.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for content in batch["content"]:
                try:
                    rate, channels, wave = _parse_wav(bytes(content))
                    frames = wave.shape[0]
                    seconds = frames / rate if rate > 0 and frames > 0 else None
                    mono = wave.mean(axis=1) if frames else np.zeros(0)
                    out.append((rate, channels, frames, seconds, mono.astype(np.float32)))
                except Exception:
                    out.append((None, None, None, None, None))
            audio = pd.DataFrame(out, columns=["rate", "channels", "frames", "duration_sec", "samples"])
            audio = audio.astype({"rate": "Int32", "channels": "Int32", "frames": "Int64"})
            yield pd.concat([batch.drop(columns="content").reset_index(drop=True), audio], axis=1)

    described = files.select(
        "path",
        basename("path").alias("name"),
        stem("path").alias("stem"),
        parent_name("path").alias("parent"),
        F.octet_length("content").cast("bigint").alias("bytes"),
        "content",
    )
    return described.mapInPandas(run, AUDIO_DDL)


def ingest_audio(spark: SparkSession, root: str, partitions: int | None = None) -> DataFrame:
    """Read and decode every WAV file below ``root``."""
    files = _with_suffix(list_files(spark, root), (".wav",), False).select("path")
    read = file_contents(spark, files, root).select(_plain_path().alias("path"), "content")
    return decode_wav(read if partitions is None else read.repartition(partitions))


def encode_pcm16(samples: Column | str, rate: int) -> Column:
    """16-bit mono WAV bytes of a float array, built from column expressions."""

    def little(value: Column, width: int) -> Column:
        digits = F.lpad(F.hex(value), width * 2, "0")
        return F.concat(*[F.substring(digits, width * 2 - 1 - 2 * i, 2) for i in range(width)])

    scaled = F.transform(
        col(samples),
        lambda x: F.pmod(F.round(F.least(F.greatest(x.cast("double"), F.lit(-1.0)), F.lit(1.0)) * 32767).cast("bigint"), F.lit(65536)),
    )
    body = F.array_join(F.transform(scaled, lambda v: little(v, 2)), "")
    size = (F.size(col(samples)) * 2).cast("bigint")
    text = lambda s: F.lit(s.encode().hex())
    number = lambda v, w: little(F.lit(v).cast("bigint"), w)
    header = F.concat(
        text("RIFF"), little(size + 36, 4), text("WAVEfmt "), number(16, 4), number(1, 2), number(1, 2),
        number(rate, 4), number(rate * 2, 4), number(2, 2), number(16, 2), text("data"), little(size, 4),
    )
    return F.unhex(F.concat(header, body))
