"""Cross-run reports. Inputs are aggregated tables: one row per model, dataset or protection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from timbre.operators.ordering import positions_by_sort
from timbre.schema import CLEAN, HEAT_MAX, HEAT_TEXT_FLIP, METRIC_DIRECTIONS, PROTECTIONS

# --- fixed values: dataset columns grouped by what they test ------------------
DATASET_GROUPS = {
    "Baseline": ["LibriTTS"],
    "Input Robustness": ["VCTK", "Multi-spk", "BG-clean", "BG-noise", "Halluc."],
    "Generation Robustness": ["Long", "AISHELL", "French", "Bilingual"],
}
DATASET_ORDER = [d for group in DATASET_GROUPS.values() for d in group]
# -----------------------------------------------------------------------------


def round_half_even(value: Column, scale: int = 0) -> Column:
    return F.bround(value, scale)


def leaderboard(df: DataFrame, model: str = "model", score: str = "sim", order: str | None = None) -> DataFrame:
    """Models by descending score with sequential ranks; ties keep the ``order`` column."""
    best = df.agg(F.max(score)).scalar()
    placed = positions_by_sort(df, [F.desc(score), F.col(order or model)], out="_position")
    return placed.select(
        *df.columns,
        (F.col("_position") + 1).alias("rank"),
        (F.col("_position") < 3).alias("medal"),
        round_half_even(F.col(score) / best * 100, 1).alias("bar"),
    )


def best_per_column(df: DataFrame, metrics: dict[str, str] = METRIC_DIRECTIONS) -> DataFrame:
    """Flag the best value of every metric; ties are all flagged."""
    extremes = [(F.max if direction == "max" else F.min)(name).alias(name) for name, direction in metrics.items()]
    best = df.agg(F.struct(*extremes)).scalar()
    return df.withColumns({f"best_{name}": F.coalesce(F.col(name) == best[name], F.lit(False)) for name in metrics})


def robustness_matrix(df: DataFrame, score: str = "sim", by: str = "model", column: str = "protection") -> DataFrame:
    """Mean score per model and protection, the clean column first."""
    return df.groupBy(by).pivot(column, [CLEAN, *PROTECTIONS]).agg(F.avg(score))


def strongest_protection(matrix: DataFrame, model: str = "model", methods: list[str] = PROTECTIONS) -> DataFrame:
    """Per model the method with the lowest score and its drop from clean; a model without any
    protected score keeps its row with NULLs."""
    rows = F.filter(
        F.array(
            *[
                F.struct(F.col(m).alias("score"), F.lit(i).alias("place"), F.lit(m).alias("method"))
                for i, m in enumerate(methods)
            ]
        ),
        lambda r: r["score"].isNotNull(),
    )
    low = F.array_min(rows)
    return matrix.select(
        model,
        F.col(CLEAN).alias("clean"),
        low["method"].alias("method"),
        low["score"].alias("score"),
        (F.col(CLEAN) - low["score"]).alias("drop"),
    )


def most_protected_model(matrix: DataFrame, model: str = "model", methods: list[str] = PROTECTIONS) -> DataFrame:
    """Per method the model with the lowest score."""
    long = matrix.unpivot([model], methods, "method", "score").filter(F.col("score").isNotNull())
    return long.groupBy("method").agg(
        F.min_by(model, F.struct("score", model)).alias("model"), F.min("score").alias("score")
    )


def cross_dataset_matrix(
    df: DataFrame, datasets: list[str] = DATASET_ORDER, score: str = "sim", by: str = "model", column: str = "dataset"
) -> DataFrame:
    """Mean score per model and dataset, columns in group order."""
    return df.groupBy(by).pivot(column, datasets).agg(F.avg(score))


def dataset_dimension(column: Column, groups: dict[str, list[str]] = DATASET_GROUPS) -> Column:
    out = F.lit(None).cast("string")
    for label, members in groups.items():
        out = F.when(column.isin(members), F.lit(label)).otherwise(out)
    return out


def heat_scale(value: Column | str) -> dict[str, Column]:
    """Colour position, its percentage and whether the text flips colour."""
    v = F.col(value) if isinstance(value, str) else value
    t = F.when(v.isNotNull(), F.least(F.greatest(v / HEAT_MAX, F.lit(0.0)), F.lit(1.0)))
    return {
        "heat": t,
        "heat_percent": round_half_even(t * 100).cast("int"),
        "heat_flip": t > HEAT_TEXT_FLIP,
    }


def coverage_matrix(
    runs: DataFrame,
    dims: dict[str, list[str]] | None = None,
    keys: tuple[str, ...] = ("model", "dataset", "protection"),
    ran: Column | None = None,
) -> DataFrame:
    """Every cell of the experiment grid with its run count and a ``covered`` flag.

    The axes are the configured values, or the distinct ones of the runs; the grid is the report
    itself, spread by its first axis. ``ran`` tells rows that were run from planned ones.
    """
    counted = runs.groupBy(*keys).agg(F.count_if(F.lit(True) if ran is None else ran).alias("runs"))
    first, *others = keys

    def axis(key: str) -> Column:
        if dims and key in dims:
            return F.array(*[F.lit(v) for v in dims[key]])
        return counted.agg(F.array_sort(F.collect_set(key))).scalar()

    if dims and first in dims:
        grid = runs.sparkSession.range(1).select(F.explode(axis(first)).alias(first))
    else:
        grid = counted.select(first).filter(F.col(first).isNotNull()).distinct()
    for key in others:
        grid = grid.withColumn(key, F.explode(axis(key)))
    return grid.join(counted, list(keys), "left").select(
        *keys, F.coalesce("runs", F.lit(0)).cast("bigint").alias("runs"), (F.coalesce("runs", F.lit(0)) > 0).alias("covered")
    )


def corpus_stats(df: DataFrame, dataset: str, speaker: str, language: str, seconds: str) -> DataFrame:
    """Pairs, speakers, languages and mean seconds per dataset and overall (dataset NULL)."""
    return df.rollup(dataset).agg(
        F.count(F.lit(1)).alias("pairs"),
        F.countDistinct(speaker).alias("speakers"),
        F.countDistinct(language).alias("languages"),
        F.avg(seconds).alias("mean_seconds"),
    )


def corpus_sketches(df: DataFrame, dataset: str, speaker: str, language: str, seconds: str, lg_k: int = 12) -> DataFrame:
    """:func:`corpus_stats` in one pass: speakers and languages are estimated by sketches of 2^``lg_k`` registers.

    Every task sends one sketch for each dataset and column, whatever the number of speakers, and the total merges
    the datasets' sketches instead of counting again. The standard error is about 1.04 / sqrt(2^``lg_k``).
    """
    parts = df.groupBy(dataset).agg(
        F.count(F.lit(1)).alias("pairs"),
        F.hll_sketch_agg(F.col(speaker).cast("string"), lg_k).alias("speakers"),
        F.hll_sketch_agg(F.col(language).cast("string"), lg_k).alias("languages"),
        F.sum(seconds).alias("seconds"),
        F.count(seconds).alias("timed"),
    )
    return parts.rollup(dataset).agg(
        F.sum("pairs").alias("pairs"),
        *[F.hll_sketch_estimate(F.hll_union_agg(c)).alias(c) for c in ("speakers", "languages")],
        (F.sum("seconds") / F.sum("timed")).alias("mean_seconds"),
    )


def wide_to_long(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """``(*keys, metric, value)`` from metric columns; a CI struct becomes one row per field."""
    plain = [m for m in metrics if df.schema[m].dataType.typeName() != "struct"]
    nested = [m for m in metrics if m not in plain]
    flat = df.select(
        *keys,
        *[F.col(m).cast("double").alias(m) for m in plain],
        *[
            F.col(f"{m}.{f.name}").cast("double").alias(f"{m}_{f.name}")
            for m in nested
            for f in df.schema[m].dataType.fields
        ],
    )
    return flat.unpivot(keys, [c for c in flat.columns if c not in keys], "metric", "value")


def long_to_wide(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    return df.groupBy(*keys).pivot("metric", metrics).agg(F.first("value", ignorenulls=True))


def compare_runs(df: DataFrame, model: str, stage: str, stages: list[str], metrics: list[str]) -> DataFrame:
    """Metric values of the stages side by side with the change from the first stage."""
    first, *rest = stages
    wide = df.groupBy(model).agg(
        *[F.max(F.when(F.col(stage) == s, F.col(m))).alias(f"{m}_{s}") for m in metrics for s in stages]
    )
    return wide.withColumns(
        {f"{m}_{s}_delta": F.col(f"{m}_{s}") - F.col(f"{m}_{first}") for m in metrics for s in rest}
    )
