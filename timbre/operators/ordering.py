"""Row positions without sending an ordered group to one task.

``row_number()`` over a hot group (or over the whole table) sorts that group in a
single task. The functions here give the same positions in two levels: rows are
counted per small bucket, the bucket counts are accumulated, and only the rows of one
bucket are ever sorted together.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from timbre.session import cut_lineage

_PARTITION_SHIFT = 33
_ROW_MASK = (1 << _PARTITION_SHIFT) - 1
#: Partitions for each split of a file whose rows are spread.
_PARTITIONS_A_SPLIT = 4


def spread_scan(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition a scan that may leave cores idle, for expensive work on each row.

    A split of a file is empty unless a block of rows begins in it, and one block may hold the whole file, so
    splits say little about a few files: their rows go to some partitions for each split. Scans of many
    files, and others with enough partitions, are returned unchanged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits, files = df.rdd.getNumPartitions(), len(df.inputFiles())
    if splits >= cores and (not files or files >= _PARTITIONS_A_SPLIT * cores):
        return df
    return df.repartition(max(cores, _PARTITIONS_A_SPLIT * splits if files else cores), *keys)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition by ``keys`` into a fixed number of partitions.

    Adaptive execution merges shuffle partitions by their bytes; ahead of work that is heavy per
    byte this keeps the partitions, and a following join or grouping on the keys reuses them.
    """
    spark = df.sparkSession
    wanted = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(wanted, *keys)


def positions_by_integer(
    df: DataFrame,
    order: str,
    by: list[str] | None = None,
    out: str = "position",
    ties: list[str] | None = None,
    width: int = 65_536,
) -> DataFrame:
    """0-based position of every row inside its ``by`` group, ordered by an integer column.

    Lazy and free of actions. ``width`` is the span of the order key that one task sorts;
    for a dense key that is also the row bound of the task.
    """
    by = by or []
    keyed = df.withColumn("_bucket", F.expr(f"`{order}` div {width}L"))
    keys = [*by, "_bucket"]
    counts = keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    offsets = counts.select(*keys, (F.sum("_rows").over(before) - F.col("_rows")).alias("_offset"))
    inside = Window.partitionBy(*keys).orderBy(order, *(ties or []))
    ranked = keyed.withColumn("_inside", F.row_number().over(inside) - 1)
    joined = ranked.join(offsets, keys) if not by else _null_safe_join(ranked, offsets, keys)
    return joined.withColumn(out, (F.col("_offset") + F.col("_inside")).cast("bigint")).drop(
        "_bucket", "_offset", "_inside"
    )


def _null_safe_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], "_offset")
    condition = F.lit(True)
    for key in keys:
        condition = condition & F.col(key).eqNullSafe(F.col(f"_r_{key}"))
    return left.join(renamed, condition).drop(*[f"_r_{k}" for k in keys])


def positions_by_sort(df: DataFrame, order: list[Column | str], out: str = "position") -> DataFrame:
    """0-based global position for any sort key.

    Rows are range-partitioned and sorted by Spark, the sorted rows are checkpointed so that
    every later read sees the same partitions, and the row count of each partition (one row
    per partition) supplies the offsets.
    """
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    fixed = cut_lineage(ordered.withColumn("_place", F.monotonically_increasing_id()))
    tagged = fixed.select(
        "*",
        F.shiftright("_place", _PARTITION_SHIFT).alias("_part"),
        F.col("_place").bitwiseAND(F.lit(_ROW_MASK)).alias("_inside"),
    )
    counts = tagged.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = counts.select("_part", (F.sum("_rows").over(before) - F.col("_rows")).alias("_offset"))
    return (
        tagged.join(offsets, "_part")
        .withColumn(out, (F.col("_offset") + F.col("_inside")).cast("bigint"))
        .drop("_place", "_part", "_inside", "_offset")
    )


def running_total(df: DataFrame, order: list[Column | str], value: str, out: str = "before") -> DataFrame:
    """The sum of the integer column ``value`` over all rows that come earlier in ``order``.

    Like :func:`positions_by_sort`, with sums in place of counts: each sorted partition adds up its
    own rows, one total a partition supplies the offsets. The result reads a checkpoint.
    """
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    at = ordered.columns.index(value)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            own = batch.column(at).to_numpy(zero_copy_only=False).astype("int64")
            inside = total + own.cumsum() - own
            total += int(own.sum())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(inside)], [*batch.schema.names, "_inside"])

    schema = StructType([*ordered.schema, StructField("_inside", LongType())])
    fixed = cut_lineage(ordered.mapInArrow(add_up, schema).withColumn("_part", F.spark_partition_id()))
    totals = fixed.groupBy("_part").agg(F.sum(value).alias("_total"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = totals.select("_part", (F.sum("_total").over(before) - F.col("_total")).alias("_offset"))
    return fixed.join(offsets, "_part").withColumn(out, F.col("_inside") + F.col("_offset")).drop("_part", "_inside", "_offset")


def top_n(df: DataFrame, by: list[str], order: list[Column | str], n: int, out: str = "rank") -> DataFrame:
    """First ``n`` rows per group; Spark limits every group map-side before the shuffle."""
    window = Window.partitionBy(*by).orderBy(*order)
    kept = df.withColumn(out, F.row_number().over(window)).filter(F.col(out) <= n)
    return kept.withColumn(out, F.col(out).cast("bigint"))


def salted_join(
    large: DataFrame,
    small: DataFrame,
    keys: list[str],
    spread_by: str,
    salt: int = 32,
    how: str = "inner",
) -> DataFrame:
    """Equi-join whose few keys are hot: rows of ``large`` are spread over ``salt`` sub-keys."""
    spread = large.withColumn("_salt", F.pmod(F.xxhash64(F.col(spread_by)), F.lit(salt)).cast("int"))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    return spread.join(copies, [*keys, "_salt"], how).drop("_salt")
