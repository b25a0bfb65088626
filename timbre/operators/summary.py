"""Null-aware run summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# --- fixed values: metric column -> summary stem -----------------------------
GENERATION_MEANS = {
    "mcd": "mcd",
    "wer": "wer",
    "sim": "sim",
    "speechmos_mos": "speechmos",
    "dnsmos_ovrl": "dnsmos",
}
FIDELITY_MEANS = {"stoi": "stoi", "speechmos_mos": "speechmos", "dnsmos_ovrl": "dnsmos", "mcd": "mcd", "sim": "sim", "wer": "wer"}
EXTREMES = {
    "generation": ["speechmos_mos", "dnsmos_ovrl"],
    "fidelity": ["stoi", "speechmos_mos", "dnsmos_ovrl", "mcd"],
}
NO_PAIRS = "No evaluation pairs provided."
NO_MATCHES = "No matching protected files found for fidelity evaluation."
# -----------------------------------------------------------------------------


def metric_means(metrics: dict[str, str]) -> list[Column]:
    """``avg_<column>`` and ``<stem>_pairs`` over the non-NULL values of every metric."""
    out = []
    for column, name in metrics.items():
        out += [F.avg(column).alias(f"avg_{column}"), F.count(column).alias(f"{name}_pairs")]
    return out


def metric_extremes(columns: list[str]) -> list[Column]:
    return [f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))]


def rate_mean(flag: Column | str) -> Column:
    """Share of true among the non-NULL flags."""
    value = F.col(flag) if isinstance(flag, str) else flag
    return F.avg(value.cast("double"))


def rtf(synthesis_time: Column, duration: Column | str) -> list[Column]:
    """Total audio seconds (0.0 when none) and the real-time factor of a stage."""
    total = F.sum(duration)
    usable = F.coalesce(total, F.lit(0.0)) > 0
    return [
        F.when(usable, total).otherwise(F.lit(0.0)).alias("total_audio_duration_sec"),
        F.when(usable, synthesis_time / total).alias("rtf"),
        synthesis_time.alias("synthesis_time_sec"),
    ]


def generation_summary(
    df: DataFrame, by: list[str] | None = None, synthesis_time: float | Column | None = None, strict: bool = False
) -> DataFrame:
    """Summary of a generation run (or of every group of ``by``).

    ``synthesis_time`` is the wall-clock of the whole stage: a number, or an aggregate column.
    In strict mode an empty input raises; otherwise it gives the record of zeros and NULLs.
    """
    spent = synthesis_time if isinstance(synthesis_time, Column) else F.lit(synthesis_time).cast("double")
    rows = F.count(F.lit(1))
    if strict:
        rows = F.when(rows == 0, F.raise_error(F.lit(NO_PAIRS)).cast("bigint")).otherwise(rows)
    return df.groupBy(*(by or [])).agg(
        rows.alias("evaluated_pairs"),
        *metric_means(GENERATION_MEANS),
        F.avg("dnsmos_sig").alias("avg_dnsmos_sig"),
        F.avg("dnsmos_bak").alias("avg_dnsmos_bak"),
        *metric_extremes(EXTREMES["generation"]),
        rate_mean("sva").alias("avg_sva"),
        F.count("sva").alias("sva_pairs"),
        rate_mean("emotion_match").alias("emotion_match_rate"),
        F.count("emotion_match").alias("emotion_pairs"),
        *rtf(spent, "generated_duration_sec"),
    )


def fidelity_summary(df: DataFrame, by: list[str] | None = None, matched: Column | str = "protected_path") -> DataFrame:
    """Summary over matched and missing rows; without a match only ``error`` and counts are set.

    Rows whose ``matched`` column is NULL are the missing ones and enter no metric.
    """
    hit = (F.col(matched) if isinstance(matched, str) else matched).isNotNull()
    used = sorted({*FIDELITY_MEANS, "snr_db", "dnsmos_sig", "dnsmos_bak"})
    seen = df.withColumns({"_hit": hit, **{c: F.when(hit, F.col(c)) for c in used}})
    pairs = F.count_if("_hit")
    return seen.groupBy(*(by or [])).agg(
        pairs.alias("num_pairs"),
        F.count_if(~F.col("_hit")).alias("num_missing"),
        F.when(pairs == 0, F.lit(NO_MATCHES)).alias("error"),
        F.avg("snr_db").alias("avg_snr_db"),
        *metric_means(FIDELITY_MEANS),
        F.avg("dnsmos_sig").alias("avg_dnsmos_sig"),
        F.avg("dnsmos_bak").alias("avg_dnsmos_bak"),
        *metric_extremes(EXTREMES["fidelity"]),
    )


def attack_success_rate(df: DataFrame, accepted: str, similarity: str, by: list[str] | None = None) -> DataFrame:
    """Mean similarity and share of accepted pairs; an undecided pair counts as rejected."""
    return df.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("pairs"),
        F.avg(similarity).alias("sim"),
        F.avg(F.coalesce(F.col(accepted), F.lit(False)).cast("double")).alias("asr"),
    )


def gt_vs_syn_wer(df: DataFrame, line_no: str, wer: str) -> DataFrame:
    """Word error per side of an alternating list, divided by half the line count.

    Only the odd (synthesised) lines are scored, so the ground-truth side stays 0.
    """
    odd = F.col(line_no) % 2 == 1
    half = F.nullif(F.floor(F.count(F.lit(1)) / 2), F.lit(0))
    return df.agg(
        (F.lit(0.0) / half).alias("wer_gt"),
        (F.sum(F.when(odd, F.col(wer)).otherwise(0.0)) / half).alias("wer_syn"),
    )


def summary_by(df: DataFrame, sets: list[list[str]], synthesis_time: Column | None = None) -> DataFrame:
    """Generation summary for several grouping sets in one pass; unused keys are NULL and
    ``grouping_level`` tells the sets apart."""
    keys = sorted({k for s in sets for k in s})
    spent = synthesis_time if synthesis_time is not None else F.lit(None).cast("double")
    return df.groupingSets([[F.col(k) for k in s] for s in sets], *keys).agg(
        F.grouping_id(*keys).alias("grouping_level"),
        F.count(F.lit(1)).alias("evaluated_pairs"),
        *metric_means(GENERATION_MEANS),
        rate_mean("sva").alias("avg_sva"),
        F.count("sva").alias("sva_pairs"),
        rate_mean("emotion_match").alias("emotion_match_rate"),
        F.count("emotion_match").alias("emotion_pairs"),
        *rtf(spent, "generated_duration_sec"),
    )
