"""Waveform columns: noise, projection, blending, mixtures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from timbre.functions.expr import col, let
from timbre.functions.metrics import clamp, power
from timbre.operators.counters import key_word, mix
from timbre.operators.ordering import salted_join

# --- fixed value: default noise level ----------------------------------------
DEFAULT_EPSILON = 8 / 255


def add_gaussian(df: DataFrame, clip: str, samples: str, epsilon: float = DEFAULT_EPSILON, seed: int = 0) -> DataFrame:
    """Add N(0, epsilon^2) to every clip and clamp to [-1, 1]; a null clip of samples stays null.

    The noise of a sample is a function of (seed, clip, place): two uniform numbers for each pair of places,
    turned into two normal ones (Box-Muller). So any task, and any engine, finds the same noise, and the
    samples of a whole batch are done at once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            waves = batch.column(1)
            sizes = np.where(waves.is_valid().to_numpy(zero_copy_only=False), pc.fill_null(pc.list_value_length(waves), 0).to_numpy(zero_copy_only=False), 0)
            clean = waves.flatten().to_numpy(zero_copy_only=False).astype(float)
            first, second = (np.repeat(batch.column(k).to_numpy().astype(np.uint64), sizes) for k in (2, 3))
            place = (np.arange(len(clean)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.uint64)
            pair, low = place >> np.uint64(1), np.uint64(0xFFFFFFFF)
            one = (mix(mix(pair + first & low) ^ second).astype(float) + 1) / (1 << 32)
            other = mix(mix(pair + second & low) ^ first).astype(float) / (1 << 32)
            angle = 2 * np.pi * other
            normal = np.sqrt(-2 * np.log(one)) * np.where(place & np.uint64(1), np.sin(angle), np.cos(angle))
            noisy = np.clip(clean + normal * epsilon, -1.0, 1.0).astype(np.float32)
            ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            mask = pa.array(~waves.is_valid().to_numpy(zero_copy_only=False))
            lists = pa.ListArray.from_arrays(ends, pa.array(noisy, from_pandas=True), mask=mask)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], [clip, samples])

    kind = df.schema[clip].dataType.simpleString()
    keyed = df.select(F.col(clip).alias("_clip"), F.col(samples).alias("_samples"), key_word(F.col(clip), seed, 0).alias("_first"), key_word(F.col(clip), seed, 1).alias("_second"))
    return keyed.mapInArrow(run, f"`{clip}` {kind}, `{samples}` array<float>")


def apply_noise(samples: Column | str, noise: Column | str, epsilon: float = DEFAULT_EPSILON) -> Column:
    """struct(protected, effective): clamped noise, clamped sum, and what really was added."""
    source = F.transform(col(samples), lambda x: x.cast("double"))
    summed = F.zip_with(
        source,
        F.slice(col(noise), 1, F.size(col(samples))),
        lambda x, n: clamp(x + clamp(F.coalesce(n.cast("double"), F.lit(0.0)), -epsilon, epsilon), -1.0, 1.0),
    )
    return F.struct(
        summed.alias("protected"),
        F.zip_with(summed, source, lambda p, x: p - x).alias("effective"),
    )


def fit_length(samples: Column, length: Column) -> Column:
    """Cut, or zero-pad on the right, to exactly ``length`` samples."""
    missing = F.greatest(length - F.size(samples), F.lit(0)).cast("int")
    return F.slice(F.concat(samples, F.array_repeat(F.lit(0.0), missing)), 1, length)


def dry_wet_blend(estimate: Column | str, source: Column | str, dry: float = 0.0) -> Column:
    """(1 - dry)·estimate + dry·source, fitted to the source length and clamped."""
    src = F.transform(col(source), lambda x: x.cast("double"))
    est = fit_length(F.transform(col(estimate), lambda x: x.cast("double")), F.size(src))
    blended = F.zip_with(est, src, lambda e, s: e * (1.0 - dry) + s * dry) if dry else est
    return F.transform(blended, lambda x: clamp(x, -1.0, 1.0))


def mix_at_snr(clean: Column, interferer: Column, snr: Column) -> Column:
    """Clean plus the interferer scaled to ``snr`` dB; a short interferer is repeated."""
    n = F.size(clean)
    copies = F.ceil(n / F.size(interferer)).cast("int")
    fitted = F.slice(F.flatten(F.array_repeat(interferer, copies)), 1, n)

    def scaled(other: Column) -> Column:
        gain = F.sqrt(power(clean) / (power(other) * F.pow(F.lit(10.0), snr / 10.0)))
        return let(gain, lambda g: F.zip_with(clean, other, lambda c, i: c.cast("double") + g * i.cast("double")))

    return let(fitted, scaled)


def noise_mixtures(
    clean: DataFrame,
    interferers: DataFrame,
    interferer_ids: list,
    snr_levels: list[float],
    clip: str,
    samples: str,
    salt: int = 32,
) -> DataFrame:
    """Every clean clip at every SNR level with every chosen interferer.

    The fan-out is two literal lists, so a clean row is multiplied by a constant; the few hot
    interferer keys are salted.
    """
    fanned = clean.select(clip, F.col(samples).alias("_clean")).select(
        "*", F.explode(F.array(*[F.lit(i) for i in interferer_ids])).alias("interferer")
    )
    chosen = interferers.filter(F.col(clip).isin(interferer_ids)).select(
        F.col(clip).alias("interferer"), F.col(samples).alias("_other")
    )
    joined = salted_join(fanned, chosen, ["interferer"], spread_by=clip, salt=salt)
    levels = F.explode(F.array(*[F.lit(float(s)) for s in snr_levels])).alias("snr_db")
    return joined.select(clip, "interferer", "_clean", "_other", levels).select(
        clip, "interferer", "snr_db", mix_at_snr(F.col("_clean"), F.col("_other"), F.col("snr_db")).alias("mixture")
    )
