"""Bootstrap confidence intervals of metric means.

The resampled means depend only on how often each value occurs, so values are counted first
(with map-side combine) and every later step works on distinct values. The n draws of a resample
are dealt down a binary tree over the bits of the values' hashes: every node splits its draws
between its two halves by a binomial draw whose generator is keyed by the node, until a node holds
one value, or, from a level on that follows from the group's distinct values, few rows, which are
then drawn by number. That is the n-out-of-n scheme with replacement.

A group whose distinct values fit one task walks the whole tree there. A larger group is cut into
buckets, the nodes of one level; each bucket walks its own path from the root and so agrees with all
others without exchanging anything, and the partial sums are added up per resample. The draws are
those of the tree in both cases, so neither ``bucket_values`` nor partitions change them.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from timbre.operators.counters import key_word, mix
from timbre.operators.ordering import spread

# --- fixed values ------------------------------------------------------------
DEFAULT_RESAMPLES = 1000
DEFAULT_LEVEL = 0.95
# -----------------------------------------------------------------------------

#: Distinct values that one task walks, about; it changes the work's division only.
_BUCKET_VALUES = 20_000
_HASH_BITS = 64
#: Distinct values of a leaf, about, and how often they may repeat there to be drawn row by row.
_LEAF_VALUES, _ROWS_PER_VALUE = 256, 16
_DRAWS_AT_ONCE = 4_000_000


@dataclass(frozen=True)
class BootstrapConfig:
    num_resamples: int = DEFAULT_RESAMPLES
    confidence_level: float = DEFAULT_LEVEL
    seed: int | None = None


def bootstrap_config(conf: Mapping | None) -> BootstrapConfig | None:
    """Validated settings, or None when bootstrapping is off."""
    if not conf or not bool(conf.get("enabled", False)):
        return None
    resamples = int(conf.get("num_samples", conf.get("num_resamples", DEFAULT_RESAMPLES)))
    if resamples <= 0:
        raise ValueError("num_samples must be > 0 when bootstrapping is enabled")
    level = float(conf.get("confidence_level", DEFAULT_LEVEL))
    if not 0.0 < level < 1.0:
        raise ValueError("confidence_level must be between 0 and 1")
    seed = conf.get("seed")
    return BootstrapConfig(resamples, level, None if seed is None else int(seed))


def finite_values(df: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """Long form ``(*by, metric, value)`` without NULL and non-finite values."""
    pairs = F.array(
        *[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]
    )
    long = df.select(*by, F.inline(pairs))
    value = F.col("value")
    return long.filter(value.isNotNull() & ~F.isnan(value) & ~value.isin(float("inf"), float("-inf")))


def _index_sums(rows: np.ndarray, draws: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Sum of ``draws[b]`` rows drawn with replacement, for every resample b."""
    sums, start = np.zeros(draws.size), 0
    while start < draws.size:
        ends = np.cumsum(draws[start:])
        stop = start + max(int(np.searchsorted(ends, _DRAWS_AT_ONCE, side="right")), 1)
        part = draws[start:stop]
        drawn = rows[rng.integers(0, rows.size, int(part.sum()))]
        filled = part > 0
        if filled.any():
            sums[start:stop][filled] = np.add.reduceat(drawn, (np.cumsum(part) - part)[filled])
        start = stop
    return sums


def _walk(
    values: np.ndarray, hashes: np.ndarray, counts: np.ndarray, draws: np.ndarray, leaf: int, seed: int, group: tuple
) -> np.ndarray:
    """Sum of the values drawn in every resample, below the node that holds ``values``.

    ``hashes`` ascend; ``draws`` are the node's draws. Nodes of level ``leaf`` whose values hardly
    repeat draw their rows by number.
    """
    before = np.concatenate([[0], np.cumsum(counts)])
    sums = np.zeros(draws.size)
    open_nodes = [(0, values.size, draws)]
    while open_nodes:
        low, high, here = open_nodes.pop()
        if high - low == 1:
            sums += here * values[low]
            continue
        last = int(hashes[high - 1])
        differing = (int(hashes[low]) ^ last).bit_length()
        total = before[high] - before[low]
        if not differing or (_HASH_BITS - differing >= leaf and total <= _ROWS_PER_VALUE * (high - low)):
            rng = _generator(seed, (*group, "rows", _HASH_BITS - differing, last >> differing))
            sums += _index_sums(np.repeat(values[low:high], counts[low:high]), here, rng)
            continue
        first_right = np.uint64(last >> (differing - 1) << (differing - 1))
        middle = low + int(np.searchsorted(hashes[low:high], first_right))
        rng = _generator(seed, (*group, _HASH_BITS - differing, last >> differing))
        left = rng.binomial(here, (before[middle] - before[low]) / total)
        open_nodes += [(middle, high, here - left), (low, middle, left)]
    return sums


def count_values(values: DataFrame, by: list[str], bucket_values: int) -> tuple[DataFrame, DataFrame]:
    """Distinct values with their counts, and per group its size, mean and the level of its buckets."""

    def level(size: int) -> Column:
        return F.greatest(F.lit(0), F.ceil(F.log2(F.count(F.lit(1)) / F.lit(size)) - F.lit(1e-9))).cast("int")

    counted = values.groupBy(*by, "value").agg(F.count(F.lit(1)).alias("_count"))
    stats = counted.groupBy(*by).agg(
        F.least(level(bucket_values), level(_LEAF_VALUES)).alias("_depth"),
        level(_LEAF_VALUES).alias("_leaf"),
        F.sum("_count").alias("n"),
        (F.sum(F.col("value") * F.col("_count")) / F.sum("_count")).alias("avg"),
    )
    return counted, stats


def _generator(seed: int, key: tuple) -> np.random.Generator:
    """Random numbers keyed by (seed, group, bucket), so a retried task draws the same."""
    text = "|".join(str(part) for part in (seed, *key))
    digest = hashlib.sha256(text.encode()).digest()[:16]
    return np.random.Generator(np.random.Philox(key=np.frombuffer(digest, dtype=np.uint64)))


def _ordered(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values, hashes and counts by ascending (unsigned) hash."""
    hashes = pdf["_hash"].to_numpy(np.int64).view(np.uint64)
    order = np.lexsort((pdf["value"].to_numpy(np.float64), hashes))
    return pdf["value"].to_numpy(np.float64)[order], hashes[order], pdf["_count"].to_numpy(np.int64)[order]


def _key_ddl(df: DataFrame, by: list[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)


def small_group_bounds(placed: DataFrame, by: list[str], config: BootstrapConfig) -> DataFrame:
    """Exact intervals of groups whose distinct values fit one task: ``(*by, lower, upper, std)``.

    The resample means never leave the task.
    """
    seed, resamples = config.seed or 0, config.num_resamples
    tail = 0.5 * (1.0 - config.confidence_level)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        values, hashes, counts = _ordered(pdf)
        size = int(counts.sum())
        draws = np.full(resamples, size, dtype=np.int64)
        means = _walk(values, hashes, counts, draws, int(pdf["_leaf"].iloc[0]), seed, key) / size
        lower, upper = np.quantile(means, [tail, 1.0 - tail])
        std = means.std(ddof=1) if resamples > 1 else 0.0
        return pd.DataFrame([[*key, lower, upper, std]], columns=[*by, "lower", "upper", "std"])

    ddl = f"{_key_ddl(placed, by)}, lower double, upper double, std double"
    return spread(placed, *by).groupBy(*by).applyInPandas(run, ddl)


def _path_sizes(bucketed: DataFrame, by: list[str]) -> DataFrame:
    """``(*by, _bucket, _path)``: sizes of the tree nodes from the root down to each bucket."""
    leaves = bucketed.groupBy(*by, "_depth", "_bucket").agg(F.sum("_count").alias("_size"))
    level = F.explode(F.sequence(F.lit(0), F.col("_depth"))).alias("_level")
    steps = leaves.select(*by, "_bucket", "_depth", "_size", level).withColumn(
        "_node", F.expr("shiftright(_bucket, _depth - _level)")
    )
    nodes = steps.groupBy(*by, "_level", "_node").agg(F.sum("_size").alias("_total"))
    ordered = F.array_sort(F.collect_list(F.struct("_level", "_total")))
    return (
        steps.select(*by, "_bucket", "_level", "_node")
        .join(nodes, [*by, "_level", "_node"])
        .groupBy(*by, "_bucket")
        .agg(F.transform(ordered, lambda p: p["_total"]).alias("_path"))
    )


def _bucket_draws(path: np.ndarray, bucket: int, resamples: int, seed: int, group: tuple) -> np.ndarray:
    """Draws of every resample that fall into a bucket."""
    depth = len(path) - 1
    draws = np.full(resamples, path[0], dtype=np.int64)
    for level in range(depth):
        left = (bucket >> (depth - 1 - level)) & 1 == 0
        left_size = path[level + 1] if left else path[level] - path[level + 1]
        rng = _generator(seed, (*group, level, bucket >> (depth - level)))
        to_left = rng.binomial(draws, left_size / path[level])
        draws = to_left if left else draws - to_left
    return draws


def large_group_sums(placed: DataFrame, by: list[str], config: BootstrapConfig) -> DataFrame:
    """``(*by, resample, total, weight)`` of groups that are cut into buckets."""
    seed, resamples = config.seed or 0, config.num_resamples

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        *group, bucket = key
        values, hashes, counts = _ordered(pdf)
        path = np.asarray(pdf["_path"].iloc[0], dtype=np.int64)
        draws = _bucket_draws(path, int(bucket), resamples, seed, tuple(group))
        sums = _walk(values, hashes, counts, draws, int(pdf["_leaf"].iloc[0]), seed, tuple(group))
        out = pd.DataFrame({"resample": np.arange(resamples), "total": sums, "weight": draws})
        for c, part in reversed(list(zip(by, group))):
            out.insert(0, c, part)
        return out

    bucketed = placed.withColumn("_bucket", F.expr(f"shiftrightunsigned(_hash, {_HASH_BITS} - _depth)"))
    paths = _path_sizes(bucketed, by)
    walked = bucketed.select(*by, "_bucket", "_leaf", "value", "_hash", "_count").join(paths, [*by, "_bucket"])
    ddl = f"{_key_ddl(placed, by)}, resample int, total double, weight bigint"
    parts = spread(walked, *by, "_bucket").groupBy(*by, "_bucket").applyInPandas(run, ddl)
    return parts.groupBy(*by, "resample").agg(F.sum("total").alias("total"), F.sum("weight").alias("weight"))


def interval(means: DataFrame, by: list[str], mean: Column | str, config: BootstrapConfig) -> DataFrame:
    """Interval bounds and spread over the resample means of every group."""
    tail = 0.5 * (1.0 - config.confidence_level)
    spread = F.stddev_samp(mean) if config.num_resamples > 1 else F.lit(0.0)
    return means.groupBy(*by).agg(
        F.percentile(mean, F.lit(tail)).alias("lower"),
        F.percentile(mean, F.lit(1.0 - tail)).alias("upper"),
        F.lit(config.confidence_level).alias("confidence_level"),
        F.lit(config.num_resamples).alias("num_resamples"),
        spread.alias("std"),
    )


def bootstrap_ci(
    df: DataFrame,
    by: list[str],
    metrics: list[str],
    config: BootstrapConfig = BootstrapConfig(),
    bucket_values: int = _BUCKET_VALUES,
) -> DataFrame:
    """One row per group and metric: ``lower, upper, confidence_level, num_resamples, std, avg, n``.
    A metric with fewer than two finite values has NULL bounds."""
    keys = [*by, "metric"]
    counted, stats = count_values(finite_values(df, by, metrics), keys, bucket_values)
    placed = counted.join(stats.filter("n > 1").select(*keys, "_depth", "_leaf"), keys).withColumn("_hash", F.xxhash64("value"))
    small = small_group_bounds(placed.filter("_depth = 0").drop("_depth"), keys, config)
    means = large_group_sums(placed.filter("_depth > 0"), keys, config).select(
        *keys, (F.col("total") / F.col("weight")).alias("_mean")
    )
    large = interval(means, keys, "_mean", config).select(*keys, "lower", "upper", "std")
    bounds = small.unionByName(large).withColumns(
        {"confidence_level": F.lit(config.confidence_level), "num_resamples": F.lit(config.num_resamples)}
    )
    enough = F.col("n") > 1
    known = ("lower", "upper", "confidence_level", "num_resamples", "std")
    return stats.join(bounds, keys, "left").select(
        *keys,
        *[F.when(enough, F.col(c)).alias(c) for c in (*known, "avg")],
        "n",
    )


def poisson_weight(uniform: Column) -> Column:
    """Poisson(1) weight of a uniform number in [0, 1) by inversion of the distribution."""
    out, cumulative, probability = F.lit(0), 0.0, float(np.exp(-1.0))
    for k in range(0, 12):
        cumulative += probability
        out = out + F.when(uniform >= F.lit(cumulative), 1).otherwise(0)
        probability /= k + 1
    return out


def hashed_resample_means(
    values: DataFrame, by: list[str], key: str, uniform, config: BootstrapConfig
) -> DataFrame:
    """Resample means from weights that are a pure function of (row key, resample).

    One scan with map-side sums and no random state: ``uniform(key, resample)`` gives the number
    behind each weight, so the draws can be repeated in any engine.
    """
    fanned = values.withColumn("resample", F.explode(F.sequence(F.lit(0), F.lit(config.num_resamples - 1))))
    weight = poisson_weight(uniform(F.col(key), F.col("resample")))
    return (
        fanned.select(*by, "resample", "value", weight.alias("_w"))
        .groupBy(*by, "resample")
        .agg((F.sum(F.col("_w") * F.col("value")) / F.nullif(F.sum("_w"), F.lit(0))).alias("mean"))
    )


_POISSON = np.cumsum([np.exp(-1.0) / math.factorial(k) for k in range(12)])
#: Weights of a batch that are held at once, groups whose sums a task holds, and sums that one task adds up.
_WEIGHTS_AT_ONCE, _GROUPS_HELD, _SUMS_ADDED = 1 << 22, 256, 64


def poisson_resample_means(values: DataFrame, by: list[str], key: str, config: BootstrapConfig) -> DataFrame:
    """``(*by, resample, mean)``: resample means with Poisson(1) weights that are a function of (seed, ``key``, resample).

    A task keeps one array of weighted sums and one of weights for each group, ``num_resamples`` long. These
    are merged element by element, a few tasks' arrays at a time, so no row is repeated for every resample.
    ``values`` has a column ``value``; rows without one don't count, nor do resamples without weight.
    """
    resamples, seed = config.num_resamples, config.seed or 0
    turns = mix(np.arange(resamples, dtype=np.uint64))
    width = len(by)
    names = [*by, "totals", "weights"]
    arrays = (pa.list_(pa.float64()), pa.list_(pa.int64()))

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[np.ndarray]] = {}
        for batch in batches:
            groups: dict[tuple, list[int]] = {}
            for k, group in enumerate(zip(*[batch.column(c).to_pylist() for c in range(width)], strict=True) if width else [()] * batch.num_rows):
                groups.setdefault(group, []).append(k)
            own, word = batch.column(width).to_numpy(), batch.column(width + 1).to_numpy().astype(np.uint64)
            step = max(1, _WEIGHTS_AT_ONCE // resamples)
            for group, rows in groups.items():
                sums = held.setdefault(group, [np.zeros(resamples), np.zeros(resamples, np.int64)])
                for at in range(0, len(rows), step):
                    part = np.array(rows[at : at + step])
                    uniform = mix(mix(word[part])[:, None] ^ turns[None, :]) / float(1 << 32)
                    weight = np.searchsorted(_POISSON, uniform, side="right")
                    sums[0] += own[part] @ weight
                    sums[1] += weight.sum(axis=0)
            if len(held) > _GROUPS_HELD:
                yield packed(held, batch.schema)
                held = {}
        if held:
            yield packed(held, batch.schema)

    def packed(held: dict[tuple, list[np.ndarray]], schema: pa.Schema) -> pa.RecordBatch:
        keys = [pa.array([g[c] for g in held], schema.field(c).type) for c in range(width)]
        sums = [pa.array([s[c].tolist() for s in held.values()], arrays[c]) for c in (0, 1)]
        return pa.RecordBatch.from_arrays([*keys, *sums], names)

    def merge(table: pa.Table) -> pa.Table:
        sums = [np.array(table.column(c).to_pylist()).sum(axis=0).tolist() for c in ("totals", "weights")]
        first = table.slice(0, 1)
        return pa.table([*[first.column(c) for c in by], *[pa.array([s], t) for s, t in zip(sums, arrays, strict=True)]], names)

    known = values.filter("value IS NOT NULL").select(*by, F.col("value").cast("double").alias("value"), key_word(F.col(key), seed, 0).alias("word"))
    ddl = ", ".join(filter(None, (_key_ddl(values, by), "totals array<double>, weights array<bigint>")))
    parts = known.mapInArrow(add_up, ddl)
    some = F.pmod(F.spark_partition_id(), F.lit(_SUMS_ADDED)).alias("_some")
    merged = parts.withColumn("_some", some).groupBy(*by, "_some").applyInArrow(merge, ddl).groupBy(*by).applyInArrow(merge, ddl)
    spread_out = merged.select(*by, F.posexplode(F.arrays_zip("totals", "weights")).alias("resample", "_s")).filter("_s.weights > 0")
    return spread_out.select(*by, "resample", (F.col("_s.totals") / F.col("_s.weights")).alias("mean"))


def attach_intervals(summary: DataFrame, intervals: DataFrame, by: list[str], names: dict[str, str]) -> DataFrame:
    """Add ``<summary column>_ci`` structs; ``names`` maps a metric to its summary column."""
    ci = F.when(
        F.col("lower").isNotNull(),
        F.struct("lower", "upper", "confidence_level", "num_resamples", "std", "avg"),
    )
    picked = [F.first(F.when(F.col("metric") == m, ci), ignorenulls=True).alias(f"{c}_ci") for m, c in names.items()]
    wide = intervals.groupBy(*by).agg(*picked)
    if by:
        return summary.join(wide, by, "left")
    return summary.withColumns({f"{c}_ci": wide.select(f"{c}_ci").scalar() for c in names.values()})
