"""Fixed-order batches, padding, and length buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from timbre.functions.expr import unit_hash
from timbre.operators.ordering import positions_by_integer


def padded_batches(
    df: DataFrame,
    by: str,
    order: str,
    length: str,
    arrays: list[str],
    size: int,
) -> DataFrame:
    """Batches of ``size`` rows in manifest order per ``by`` value; inside a batch rows go by
    descending length and every array is zero-padded to the batch maximum.

    ``order`` is an integer that names a row of its ``by`` value; two rows that share it end the job. Positions, slots and
    maxima are found on keys and sizes alone, and join the arrays once.
    """
    rows = df.select(by, order, F.col(length).alias("_length"), *[F.size(a).alias(f"{a}_len") for a in arrays])
    told = [F.first(c).alias(c) for c in rows.columns[2:]]
    single = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit(f"rows share their {order}"))).cast("int")
    keys = rows.groupBy(by, order).agg(*told, single.alias("_single")).filter("_single IS NULL").drop("_single")
    placed = positions_by_integer(keys, order, [by], out="_position")
    batched = placed.withColumn("batch", F.floor(F.col("_position") / size).cast("bigint"))
    batch = Window.partitionBy(by, "batch")
    sized = batched.withColumns(
        {
            "slot": F.row_number().over(batch.orderBy(F.desc("_length"), "_position")) - 1,
            **{f"_max_{a}": F.max(f"{a}_len").over(batch) for a in arrays},
        }
    )
    names = [by, order]
    found = sized.select(*[F.col(c).alias(f"_{n}") for n, c in enumerate(names)], "batch", "slot", *[f"{a}_len" for a in arrays], *[f"_max_{a}" for a in arrays])
    same = F.col(by).eqNullSafe(F.col("_0")) & F.col(order).eqNullSafe(F.col("_1"))
    joined = df.join(found, same)
    pads = {
        a: F.concat(
            F.col(a),
            F.array_repeat(F.lit(0).cast(df.schema[a].dataType.elementType), F.col(f"_max_{a}") - F.size(a)),
        )
        for a in arrays
    }
    return joined.withColumns(pads).select(*df.columns, "batch", "slot", *[f"{a}_len" for a in arrays])


def bucket_of(length: Column, bounds: list[int]) -> Column:
    """Index i with bounds[i] < length <= bounds[i+1]; NULL outside."""
    out = F.lit(None).cast("int")
    for i, (low, high) in enumerate(zip(bounds, bounds[1:])):
        out = F.when((length > low) & (length <= high), F.lit(i)).otherwise(out)
    return out


def length_buckets(df: DataFrame, length: str, bounds: list[int]) -> DataFrame:
    """Rows with their bucket; rows outside the bounds are dropped and empty buckets vanish,
    which renumbers the remaining ones densely."""
    raw = df.withColumn("raw_bucket", bucket_of(F.col(length), bounds)).filter(F.col("raw_bucket").isNotNull())
    used = df.select(bucket_of(F.col(length), bounds).alias("_b")).agg(F.array_sort(F.collect_set("_b"))).scalar()
    dense = F.array_position(used, F.col("raw_bucket")) - 1
    return raw.withColumn("bucket", dense.cast("int"))


def replica_batches(
    df: DataFrame,
    key: str,
    bucket: str,
    batch_size: int,
    replicas: int,
    rank: int,
    epoch: int,
    shuffle: bool = True,
) -> DataFrame:
    """One replica's share: ``(key, bucket, batch, slot, batch_order)``.

    Each bucket is put into a seeded order, repeated cyclically up to a multiple of
    ``replicas * batch_size``, dealt out by rank and cut into batches; batches are then put
    into a seeded order as well.
    """
    total = replicas * batch_size
    order_key = unit_hash(F.concat_ws("|", F.lit(str(epoch)), F.col(key).cast("string")))
    hashed = df.select(key, bucket, (order_key if shuffle else F.lit(0)).alias("_h"))
    if shuffle:
        placed = positions_by_integer(hashed, "_h", [bucket], out="_p", ties=[key], width=1 << 20)
    else:
        placed = positions_by_integer(hashed, key, [bucket], out="_p")
    sizes = df.groupBy(bucket).agg(F.count(F.lit(1)).alias("_n"))
    padded = F.ceil(F.col("_n") / total) * total
    laps = F.floor((padded - 1 - F.col("_p")) / F.col("_n"))
    lapped = placed.join(sizes, bucket).withColumn("_lap", F.explode(F.sequence(F.lit(0).cast("bigint"), laps)))
    repeated = lapped.select(key, bucket, (F.col("_p") + F.col("_lap") * F.col("_n")).alias("_p"))
    mine = repeated.filter(F.pmod("_p", F.lit(replicas)) == rank).withColumn(
        "_q", F.floor(F.col("_p") / replicas)
    )
    out = mine.select(
        key,
        bucket,
        F.floor(F.col("_q") / batch_size).cast("bigint").alias("batch"),
        F.pmod("_q", F.lit(batch_size)).cast("bigint").alias("slot"),
    )
    token = F.concat_ws("|", F.lit(str(epoch)), F.lit("batch"), F.col(bucket).cast("string"), F.col("batch").cast("string"))
    return out.withColumn("batch_order", unit_hash(token) if shuffle else F.lit(None).cast("bigint"))
