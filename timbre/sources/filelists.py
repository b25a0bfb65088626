"""Pipe-delimited file lists and evaluation lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from timbre.functions.expr import stem
from timbre.schema import FILELIST_FIELDS, RAW_FILELIST_FIELDS


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("value").alias("line"))


def split_fields(df: DataFrame, fields: list[str], line: str = "line", mode: str = "strict") -> DataFrame:
    """Split ``line`` at pipes into ``fields``.

    ``strict`` raises on a malformed line, ``lenient`` drops it, ``keep`` returns every line with
    a ``malformed`` flag.
    """
    parts = F.split(line, r"\|", -1)
    good = F.size(parts) == len(fields)
    if mode == "strict":
        message = F.concat(F.lit(f"malformed line, expected {len(fields)} fields: "), F.col(line))
        parts = F.when(good, parts).otherwise(F.raise_error(message).cast("array<string>"))
    named = [F.when(good, F.element_at(parts, i + 1)).alias(f) for i, f in enumerate(fields)] if mode != "strict" else [
        F.element_at(parts, i + 1).alias(f) for i, f in enumerate(fields)
    ]
    others = [c for c in df.columns if c != line]
    if mode == "keep":
        return df.select(*others, line, *named, (~good).alias("malformed"))
    kept = df.filter(good) if mode == "lenient" else df
    return kept.select(*others, *named)


def read_filelist(spark: SparkSession, path: str, mode: str = "strict") -> DataFrame:
    return split_fields(_lines(spark, path), FILELIST_FIELDS, mode=mode)


def read_raw_filelist(spark: SparkSession, path: str) -> DataFrame:
    stripped = _lines(spark, path).select(F.trim("line").alias("line"))
    return split_fields(stripped, RAW_FILELIST_FIELDS)


def pair_lines(df: DataFrame, by: list[str] | None = None, number: str = "line_no", line: str = "line") -> DataFrame:
    """Alternating ground-truth/synthesised lines -> one row per pair (and per ``by`` key).

    ``number`` is the 0-based line number; lines 2k and 2k+1 form pair k.
    """
    side = F.when(F.col(number) % 2 == 0, "gt").otherwise("syn")
    parts = F.split(line, r"\|", 2)
    tagged = df.select(
        *(by or []),
        F.floor(F.col(number) / 2).cast("bigint").alias("pair"),
        side.alias("side"),
        F.element_at(parts, 1).alias("path"),
        F.try_element_at(parts, F.lit(2)).alias("text"),
    )
    return tagged.groupBy(*(by or []), "pair").pivot("side", ["gt", "syn"]).agg(
        F.first("path").alias("path"), F.first("text").alias("text")
    )


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(file, line_no, line)`` of text files, read in parallel blocks.

    Inside a block the row ids of the scan follow the line order, so the 0-based line number is
    the line count of the earlier blocks plus the distance to the first id of the block.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_id"),
        F.col("value").alias("line"),
    )
    blocks = lines.groupBy("file", "_block").agg(
        F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    before = Window.partitionBy("file").orderBy("_block").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    starts = blocks.select(
        "file", "_block", (F.sum("_n").over(before) - F.col("_n") - F.col("_first")).alias("_shift")
    )
    return lines.join(starts, ["file", "_block"]).select(
        "file", (F.col("_id") + F.col("_shift")).alias("line_no"), "line"
    )


def read_eval_list(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation lists as ground-truth/synthesised pairs, one ``pair`` count per file."""
    return pair_lines(numbered_lines(spark, path), ["file"])


def format_filelist(fields: list[str] = FILELIST_FIELDS) -> Column:
    """One pipe-delimited line; list columns must already be blank-joined."""
    return F.concat_ws("|", *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields])


def write_filelist(df: DataFrame, path: str, fields: list[str] = FILELIST_FIELDS, mode: str = "overwrite") -> None:
    df.select(format_filelist(fields).alias("value")).write.mode(mode).text(path)


def rewrite_filelist(lines: DataFrame, replacements: DataFrame, line: str = "line") -> DataFrame:
    """Replace the audio path of file-list lines.

    ``replacements`` has ``old_path`` and ``new_path``. A line is matched by its exact path, then
    by the path of a line with the same signature (language, text, phones, tones, word2ph), then
    by file stem; malformed lines stay as they are. Returns the lines with ``new_line`` and
    ``updated``; on equal keys the greatest old path supplies the new one.
    """
    parsed = split_fields(lines, FILELIST_FIELDS, line, mode="keep").withColumn(
        "_sig", F.concat_ws("|", *FILELIST_FIELDS[2:])
    )
    by_path = replacements.groupBy(F.col("old_path").alias("_path")).agg(F.max("new_path").alias("_new_path"))
    listed = parsed.filter(~F.col("malformed")).select("audio_path", "_sig").distinct()
    by_sig = (
        listed.join(by_path, F.col("audio_path") == F.col("_path"))
        .groupBy(F.col("_sig").alias("_key"))
        .agg(F.max_by("_new_path", "audio_path").alias("_new_sig"))
    )
    by_stem = replacements.groupBy(stem("old_path").alias("_stem")).agg(
        F.max_by("new_path", "old_path").alias("_new_stem")
    )
    good = ~F.col("malformed")
    joined = (
        parsed.join(by_path, good & (F.col("audio_path") == F.col("_path")), "left")
        .join(by_sig, good & (F.col("_sig") == F.col("_key")), "left")
        .join(by_stem, good & (stem("audio_path") == F.col("_stem")), "left")
    )
    new = F.coalesce("_new_path", "_new_sig", "_new_stem")
    changed = F.coalesce(good & new.isNotNull() & (new != F.col("audio_path")), F.lit(False))
    new_line = F.concat_ws("|", new, *FILELIST_FIELDS[1:])
    keep = [c for c in lines.columns]
    return joined.withColumns(
        {"new_line": F.when(changed, new_line).otherwise(F.col(line)), "updated": changed}
    ).select(*keep, "new_line", "updated")


def rename_by_index(df: DataFrame, folder: str, tag: str) -> DataFrame:
    """Point every parsed file-list row at ``<folder>/<speaker>_<tag>_<last index>.wav``."""
    index = F.substring_index(stem("audio_path"), "_", -1)
    name = F.concat(F.col("speaker"), F.lit(f"_{tag}_"), index, F.lit(".wav"))
    return df.withColumn("audio_path", F.concat(F.lit(f"{folder.rstrip('/')}/"), name))
