"""Timings, sample metrics, run summaries and JSON-lines output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from timbre.functions.expr import blank_to_null, float_text, strip
from timbre.functions.metrics import fidelity_row, generation_row
from timbre.schema import FIDELITY_METRICS, GENERATION_METRICS, TIMINGS, ddl_fields
from timbre.session import cut_lineage
from timbre.sources.listing import known_to_arrow
from timbre.sources.splits import SPLIT_BYTES, csv_records, splittable

# --- fixed value: folder layout <run_name>/<YYYYMMDD-HHMMSS>/ ----------------
RUN_PATH = r"([^/]+)/(\d{8}-\d{6})/[^/]*$"
_FLOAT = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"


def to_number(text: Column) -> Column:
    """Number written as text; also the spellings of infinity and not-a-number."""
    token = F.lower(strip(text))
    return (
        F.when(token.rlike(r"^\+?inf(inity)?$"), F.lit(float("inf")))
        .when(token.rlike(r"^-inf(inity)?$"), F.lit(float("-inf")))
        .when(token.rlike(r"^[+-]?nan$"), F.lit(float("nan")))
        .when(token.rlike(_FLOAT), token.try_cast("double"))
    )


def clean_timings(raw: DataFrame, order: str) -> DataFrame:
    """Drop rows with an empty path or an unreadable time; the last row of a path wins."""
    usable = raw.select("generated_path", to_number(F.col("synthesis_time_sec")).alias("_t"), order).filter(
        blank_to_null("generated_path").isNotNull() & F.col("_t").isNotNull()
    )
    return usable.groupBy("generated_path").agg(F.max_by("_t", order).alias("synthesis_time_sec"))


def read_synthesis_timings(spark: SparkSession, path: str) -> DataFrame:
    """Timing CSV files; rows keep their file order through block start and scan id."""
    raw = (
        spark.read.schema(TIMINGS)
        .option("header", True)
        .csv(path)
        .withColumn(
            "_order",
            F.struct(
                F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()
            ),
        )
    )
    return clean_timings(raw, "_order")


def run_columns(path: Column) -> dict[str, Column]:
    """``run_name`` and ``run_ts`` of a result file."""
    return {
        "run_name": blank_to_null(F.regexp_extract(path, RUN_PATH, 1)),
        "run_ts": blank_to_null(F.regexp_extract(path, RUN_PATH, 2)),
    }


def read_sample_metrics(spark: SparkSession, paths: str | list[str], kind: str = "generation", split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Per-sample metric files of many runs with their run identity.

    Texts may hold line breaks in quotes; still, a file is read by as many tasks as it has ranges.
    Compressed files, and those of stores that tasks can't open, are read whole, one by a task.
    """
    fields = ddl_fields(GENERATION_METRICS if kind == "generation" else FIDELITY_METRICS)
    schema = ", ".join(f"{n} STRING" for n, _ in fields)
    listed = spark.read.format("binaryFile").load(paths).select("path", F.col("length").alias("bytes"))
    files = cut_lineage(listed.withColumn("_split", splittable(F.col("path"))))
    whole = [r["path"] for r in files.filter(~F.col("_split")).select("path").toLocalIterator()]
    first = files.select("path").first()
    names = [n for n, _ in fields]
    if first is not None and known_to_arrow(first["path"]):
        records = csv_records(files.filter("_split").select("path", "bytes"), split_bytes)
        raw = records.select("path", F.from_csv("record", schema, {"escape": '"'}).alias("_r")).select("path", *[F.col(f"_r.{n}") for n in names])
    else:
        raw, whole = None, paths
    if whole:
        reader = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"')
        other = reader.csv(whole).select(F.col("_metadata.file_path").alias("path"), *names)
        raw = other if raw is None else raw.unionByName(other)
    typed = {
        n: to_number(F.col(n)) if t == "DOUBLE" else F.col(n).try_cast("boolean")
        for n, t in fields
        if t != "STRING"
    }
    return raw.withColumns({**run_columns(F.col("path")), **typed}).drop("path")


def write_sample_metrics(df: DataFrame, path: str, kind: str = "generation", mode: str = "overwrite") -> None:
    """Fixed-column CSV with a header; quotes are doubled and infinities written as ``inf``."""
    shaped = generation_row(df) if kind == "generation" else fidelity_row(df)
    fields = ddl_fields(GENERATION_METRICS if kind == "generation" else FIDELITY_METRICS)
    text = {n: float_text(n) for n, t in fields if t == "DOUBLE"}
    text |= {n: F.initcap(F.col(n).cast("string")) for n, t in fields if t == "BOOLEAN"}
    shaped.withColumns(text).write.mode(mode).option("header", True).option("escape", '"').csv(path)


def read_run_summaries(
    spark: SparkSession, paths: str | list[str], schema: str | None = None, multi_line: bool = True
) -> DataFrame:
    """Nested run summaries with the run folder's identity: one document per file, or (with
    ``multi_line=False``) one per line."""
    reader = spark.read.option("multiLine", multi_line).option("allowNonNumericNumbers", True)
    df = (reader.schema(schema) if schema else reader).json(paths)
    identity = run_columns(F.col("_metadata.file_path"))
    run_name = F.coalesce("run_name", identity["run_name"]) if "run_name" in df.columns else identity["run_name"]
    return df.withColumns({"run_name": run_name, "run_ts": identity["run_ts"]})


def write_run_summary(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Nested run summaries as JSON, one document per line; absent values stay as ``null`` and
    infinities become the strings the reader accepts."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_jsonl(df: DataFrame, path: str, partition: str | None = "model", mode: str = "overwrite") -> None:
    """JSON lines, one folder per ``partition`` value; text stays unescaped."""
    writer = df.write.mode(mode)
    (writer.partitionBy(partition) if partition else writer).json(path)
