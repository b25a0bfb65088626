"""Reading, building and writing pair manifests."""

from __future__ import annotations

from urllib.parse import urlsplit

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from timbre.functions.expr import basename
from timbre.operators.manifest import canonicalize, filter_speaker, order_columns, with_missing_columns
from timbre.schema import FILE_ORDER, MANIFEST_NAME
from timbre.sources.json_records import json_file_records, json_folder_records, json_records
from timbre.sources.listing import file_contents, known_to_arrow, list_files, with_bytes
from timbre.sources.splits import SPLIT_BYTES


def read_manifest(spark: SparkSession, root: str, manifest_name: str = MANIFEST_NAME, file_order: bool = False) -> DataFrame:
    """Canonical manifest below ``root``: missing columns as ``""``, canonical order first.

    ``file_order`` adds the place of each row in its file, by which samples are numbered.
    """
    df = spark.read.option("mergeSchema", True).parquet(f"{root}/{manifest_name}")
    if file_order:
        df = df.withColumns(dict(zip(FILE_ORDER, (F.col("_metadata.file_path"), F.col("_metadata.row_index")))))
    return order_columns(with_missing_columns(df))


def read_manifest_json(
    spark: SparkSession, path: str, dataset: str, extras: list[str] | None = None, split_bytes: int = SPLIT_BYTES
) -> DataFrame:
    """A manifest stored as one JSON array, canonicalised; any file name will do, and any size.

    A missing file, or one that isn't JSON, ends the job.
    """
    files = spark.range(1).select(F.lit(path).alias("path"))
    return read_manifests_json(spark, files, path.rsplit("/", 1)[0], dataset, extras, split_bytes)


def read_manifests_json(
    spark: SparkSession, files: DataFrame, root: str, dataset: str, extras: list[str] | None = None, split_bytes: int = SPLIT_BYTES
) -> DataFrame:
    """The manifests at the ``path`` of each row of ``files`` below ``root``, each one JSON array, read in ranges."""
    if known_to_arrow(root):
        records = json_file_records(with_bytes(files), extras, split_bytes)
    else:
        records = json_records(_named(file_contents(spark, files, root)), extras)
    return canonicalize(records, dataset)


def _named(read: DataFrame) -> DataFrame:
    return read.select(basename("path").alias("source_manifest"), F.col("content").cast("string").alias("content"))


def legacy_files(spark: SparkSession, root: str, speaker: str | None = None) -> DataFrame:
    """The ``path`` of the legacy files, skipping hidden and combined ones."""
    files = list_files(spark, f"{root}/filelists", recursive=False).withColumn("source_manifest", basename("path"))
    return keep_legacy_names(files, speaker).select("path")


def keep_legacy_names(named: DataFrame, speaker: str | None = None) -> DataFrame:
    name = F.col("source_manifest")
    kept = named.filter(name.endswith(".json") & ~name.startswith(".") & ~F.lower(name).startswith("all_speakers"))
    return kept if speaker is None else kept.filter(name == f"{speaker}.json")


def read_legacy_manifests(
    spark: SparkSession,
    root: str,
    dataset: str,
    speaker: str | None = None,
    extras: list[str] | None = None,
) -> DataFrame:
    """All legacy per-speaker files of a dataset, canonicalised."""
    files = legacy_files(spark, root, speaker)
    if known_to_arrow(root):
        records = json_folder_records(files, extras)
    else:
        records = json_records(_named(file_contents(spark, files, f"{root}/filelists")), extras)
    return canonicalize(records, dataset)


def load_dataset(
    spark: SparkSession,
    root: str,
    dataset: str | None = None,
    speaker: str | None = None,
    manifest_name: str = MANIFEST_NAME,
    extras: list[str] | None = None,
) -> DataFrame:
    """The canonical manifest if there is one (Parquet, or JSON by its suffix), else the legacy files.

    With ``speaker``, a canonical manifest is filtered by its column and legacy files by their name.
    """
    name = dataset or root.rstrip("/").rsplit("/", 1)[-1]
    path = f"{root}/{manifest_name}"
    if not _exists(spark, path):
        return read_legacy_manifests(spark, root, name, speaker, extras)
    if manifest_name.lower().endswith(".json"):
        df = read_manifest_json(spark, path, root.rstrip("/").rsplit("/", 1)[-1], extras)
    else:
        df = read_manifest(spark, root, manifest_name, file_order=speaker is None)
    return df if speaker is None else filter_speaker(df, speaker)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


def write_manifest(df: DataFrame, root: str, force: bool = False, manifest_name: str = MANIFEST_NAME) -> tuple[bool, str]:
    """Write a canonical manifest once; returns (written, status line)."""
    spark = df.sparkSession
    target = f"{root}/{manifest_name}"
    if _exists(spark, target) and not force:
        return False, f"skip existing manifest: {target}"
    df = order_columns(with_missing_columns(df))
    if df.isEmpty():
        return False, f"skip empty manifest: {root}"
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(target)
    return True, f"wrote {seen.get['rows']} rows -> {target}"


def read_registry(spark: SparkSession, config_dir: str) -> list[dict[str, str]]:
    """The datasets that the YAML files of a folder describe, for :func:`build_manifests`; one entry a file, by name.

    The key is the file's stem. ``root_path``, or else ``path``, is taken from the folder two levels above
    ``config_dir`` unless it is absolute; without either the root is empty. The name is ``name``, else the root's last
    part, else the stem. A file that isn't a YAML mapping ends the read. The folder lists configured
    datasets, not data, so its texts come to the driver.
    """
    try:
        import yaml
    except ImportError as missing:
        raise RuntimeError("configuration files need PyYAML") from missing
    folder = config_dir.rstrip("/")
    base = folder.rsplit("/", 2)[0]
    files = list_files(spark, folder, recursive=False).select("path").filter(F.col("path").endswith(".yaml"))
    registry = []
    for row in _named(file_contents(spark, files, folder)).collect():
        data = yaml.safe_load(row["content"]) or {}
        if not isinstance(data, dict):
            raise ValueError(f"{row['source_manifest']} is not a mapping")
        root = str(data.get("root_path") or data.get("path") or "")
        if root and not root.startswith("/") and not urlsplit(root).scheme:
            root = f"{base}/{root.removeprefix('./')}"
        key = row["source_manifest"].removesuffix(".yaml")
        name = str(data.get("name") or root.rstrip("/").rsplit("/", 1)[-1] or key.lower())
        registry.append({"key": key, "name": name, "root_path": root, "file": row["source_manifest"]})
    return sorted(registry, key=lambda e: e["file"])


def build_manifests(
    spark: SparkSession,
    registry: list[dict[str, str]],
    only: list[str] | None = None,
    force: bool = False,
    extras: list[str] | None = None,
) -> list[str]:
    """Build the canonical manifest of every registered dataset; one status line each.

    ``registry`` rows carry ``key``, ``name`` and ``root_path``, and ``file`` if they were read from one, by which
    the lines then go; ``only`` selects keys without regard to case. The loop runs over configured datasets, the data work is Spark's.
    """
    wanted = {k.lower() for k in only or []}
    lines = []
    for entry in sorted(registry, key=lambda e: e.get("file", e["key"])):
        if wanted and entry["key"].lower() not in wanted:
            continue
        root = entry["root_path"]
        if not root or not _exists(spark, root):
            status = f"skip missing root: {root}"
        elif not _exists(spark, f"{root}/filelists"):
            status = f"skip no filelists: {root}"
        else:
            name = entry.get("name") or root.rstrip("/").rsplit("/", 1)[-1] or entry["key"]
            status = write_manifest(read_legacy_manifests(spark, root, name, extras=extras), root, force)[1]
        lines.append(f"[{entry.get('file', entry['key'])}] {status}")
    return lines
