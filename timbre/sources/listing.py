"""Listing, reading and writing files of any name.

Spark's file readers hide names that begin with ``_`` or ``.``, but a sanitised name often begins
with an underscore. Here folders are rows: tasks list them level by level, read the files they are
given, and write files under the names they are given. Tasks open files with Arrow's file systems
(local and mounted paths, HDFS, S3, GCS, Azure), whatever name Hadoop has for the store. Other schemes
are listed through Hadoop on the driver, one entry at a time, and their contents are read by Spark;
names that Spark hides end that job. Links to folders are not followed. A file or folder that can't be read
ends the task, so that Spark tries again and no row is lost in silence.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from timbre.functions.expr import basename
from timbre.session import cut_lineage

#: Arrow's scheme for each one that Hadoop knows the store by.
_ARROW_SCHEMES = {"": "file", "file": "file", "hdfs": "hdfs", "s3": "s3", "s3a": "s3", "s3n": "s3", "gs": "gs", "abfs": "abfs", "abfss": "abfss"}
_LISTED = "path string, bytes long, folder boolean"
_LISTED_AT_ONCE = 10_000


def opened(path: str):
    """(file system, path in it, prefix of its paths)."""
    from pyarrow import fs

    scheme = urlsplit(path).scheme
    if _ARROW_SCHEMES[scheme] == "file":
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/"), ""
    system, inner = fs.FileSystem.from_uri(_ARROW_SCHEMES[scheme] + path[len(scheme) :])
    return system, inner, path[: path.index(inner)] if inner and inner in path else ""


def _list_folders(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from pyarrow import fs

    for frame in frames:
        for folder in frame["path"]:
            system, inner, prefix = opened(folder)
            found = system.get_file_info(fs.FileSelector(inner, allow_not_found=True))
            for at in range(0, len(found), _LISTED_AT_ONCE):
                part = found[at : at + _LISTED_AT_ONCE]
                yield pd.DataFrame(
                    {
                        "path": [prefix + f.path for f in part],
                        "bytes": [int(f.size or 0) for f in part],
                        "folder": [f.type == fs.FileType.Directory for f in part],
                    }
                ).drop(index=[k for k, f in enumerate(part) if f.type == fs.FileType.Directory and not prefix and os.path.islink(f.path)])


def _hadoop_files(spark: SparkSession, root: str, recursive: bool) -> DataFrame:
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    rows = []
    if system.exists(path):
        entries = system.listFiles(path, recursive)
        while entries.hasNext():
            entry = entries.next()
            rows.append((entry.getPath().toString(), entry.getLen()))
    return spark.createDataFrame(rows, "path string, bytes long")


def list_files(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """``(path, bytes)`` of all files below ``root``, whatever their names; no rows if it is missing."""
    if not known_to_arrow(root):
        return _hadoop_files(spark, root, recursive)
    folders = spark.range(1).select(F.lit(root).alias("path"))
    levels = []
    while True:
        spread = folders.repartition("path") if levels else folders
        level = cut_lineage(spread.mapInPandas(_list_folders, _LISTED))
        levels.append(level.filter(~F.col("folder")).select("path", "bytes"))
        folders = level.filter("folder").select("path")
        if not recursive or folders.isEmpty():
            break
    files = levels[0]
    for level in levels[1:]:
        files = files.unionAll(level)
    return files


def read_files(files: DataFrame) -> DataFrame:
    """Add ``content`` (binary) to rows with a ``path``; one of Arrow's file systems must know it."""
    names = files.columns

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(len(frame)):  # one file at a time: contents may be large
                row = frame.iloc[at : at + 1].copy()
                system, inner, _ = opened(row["path"].iloc[0])
                with system.open_input_stream(inner) as stream:
                    row["content"] = [stream.read()]
                yield row

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema)
    spread = files.repartition(files.sparkSession.sparkContext.defaultParallelism, "path")
    return spread.select(*names).mapInPandas(read, f"{fields}, content binary")


def known_to_arrow(root: str) -> bool:
    return urlsplit(root).scheme in _ARROW_SCHEMES


def with_bytes(files: DataFrame) -> DataFrame:
    """``(path, bytes)`` of existing files, asked in tasks; a missing one ends the job."""

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for frame in frames:
            found = []
            for path in frame["path"]:
                system, inner, _ = opened(path)
                info = system.get_file_info(inner)
                if info.type != fs.FileType.File:
                    raise FileNotFoundError(path)
                found.append(int(info.size))
            yield frame.assign(bytes=found)

    return files.select("path").mapInPandas(ask, "path string, bytes long")


def file_contents(spark: SparkSession, files: DataFrame, root: str) -> DataFrame:
    """``files`` with their ``content``, by Arrow where it knows the scheme, else by Spark's reader."""
    if known_to_arrow(root):
        return read_files(files)
    hidden = files.filter(basename("path").rlike("^[_.]"))
    if not hidden.isEmpty():
        raise ValueError(f"Spark can't read files below {root} whose names begin with _ or .")
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "content")
    return files.join(read, "path")


def write_files(rows: DataFrame, root: str) -> int:
    """Write each row's ``content`` to ``root`` / ``path``, from tasks; returns the number of files.

    A file is written beside its place and then moved there, so a repeated task leaves whole files.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        attempt = TaskContext.get().taskAttemptId()
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                system, inner, _ = opened(f"{root.rstrip('/')}/{path}")
                system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(f"{inner}.{attempt}.part") as stream:
                    stream.write(content.as_buffer())
                system.move(f"{inner}.{attempt}.part", inner)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["written"])

    done = rows.select("path", F.col("content").cast("binary")).mapInArrow(write, "written long")
    return done.agg(F.sum("written")).first()[0] or 0
