"""Per-pair metric columns."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from timbre.functions.expr import blank_to_null, col, let, strip
from timbre.functions.text import norm_en_space, wer_tokens, words
from timbre.schema import FIDELITY_METRICS, GENERATION_METRICS, ddl_fields

# --- fixed values ------------------------------------------------------------
ACCEPT_TOKENS = ["y", "yes", "true", "same", "positive", "match", "1"]
REJECT_TOKENS = ["n", "no", "false", "different", "negative", "mismatch", "0"]
DNSMOS_RATE = 16_000
DNSMOS_WINDOW_SEC = 9.01
# Polynomial coefficients, highest power first.
DNSMOS_POLYNOMIALS = {
    False: {
        "ovr": [-0.06766283, 1.11546468, 0.04602535],
        "sig": [-0.08397278, 1.22083953, 0.0052439],
        "bak": [-0.13166888, 1.60915514, -0.39604546],
    },
    True: {
        "ovr": [-0.00533021, 0.005101, 1.18058466, -0.11236046],
        "sig": [-0.01019296, 0.02751166, 1.19576786, -0.24348726],
        "bak": [-0.04976499, 0.44276479, -0.1644611, 0.96883132],
    },
}
# -----------------------------------------------------------------------------

# Code points used for the word alphabet; the two lowest mark words of one side only.
_ALPHABET_START = 0x10000


def _word_string(tokens: Column, shared: Column, own_mark: int) -> Column:
    """One character per word, so that the built-in edit distance counts words.

    Only words on both sides can ever be matched, hence they alone need distinct
    characters; every other word of a side may carry the same mark.
    """
    codes = F.transform(
        tokens,
        lambda w: F.lpad(
            F.hex(
                F.coalesce(F.nullif(F.array_position(shared, w), F.lit(0).cast("bigint")) + 1, F.lit(own_mark))
                + _ALPHABET_START
            ),
            8,
            "0",
        ),
    )
    return F.decode(F.unhex(F.array_join(codes, "")), "UTF-32")


def word_distance(reference: Column, hypothesis: Column) -> Column:
    """Word-level edit distance of two token arrays."""
    return let(
        F.array_intersect(reference, hypothesis),
        lambda shared: F.levenshtein(_word_string(reference, shared, 0), _word_string(hypothesis, shared, 1)),
    )


def wer(reference: Column | str, hypothesis: Column | str) -> Column:
    """Word error rate of two token arrays; NULL without reference words or hypothesis."""
    pair = F.struct(col(reference).alias("ref"), col(hypothesis).alias("hyp"))
    return let(
        pair,
        lambda p: F.when(F.size(p["ref"]) > 0, word_distance(p["ref"], p["hyp"]) / F.size(p["ref"])),
    )


def generation_wer(
    reference: Column | str, hypothesis: Column | str, detected_language: Column | None = None
) -> Column:
    """Word error rate of a generated clip; a failed transcription (NULL) is not counted."""
    ref = F.coalesce(col(reference), F.lit(""))
    return wer(
        wer_tokens(ref, ref, detected_language), wer_tokens(col(hypothesis), ref, detected_language)
    )


def fidelity_wer(reference: Column | str, hypothesis: Column | str) -> Column:
    """Word error rate of a protected clip; a failed transcription (NULL) counts as empty, a
    missing transcript is not counted."""
    return wer(
        words(norm_en_space(blank_to_null(reference))),
        words(norm_en_space(F.coalesce(col(hypothesis), F.lit("")))),
    )


def cer(reference: Column | str, hypothesis: Column | str) -> Column:
    """Character error rate; a missing hypothesis counts as empty."""
    ref = blank_to_null(reference)
    return F.levenshtein(ref, F.coalesce(col(hypothesis), F.lit(""))) / F.char_length(ref)


def _sum(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda acc, x: acc + x)


def power(samples: Column) -> Column:
    return F.aggregate(samples, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))


def difference_power(left: Column, right: Column) -> Column:
    gaps = F.zip_with(left, right, lambda a, b: a.cast("double") - b.cast("double"))
    return power(gaps)


def _ratio_db(signal: Column, noise: Column) -> Column:
    return (
        F.when(noise == 0, F.lit(float("inf")))
        .when(signal == 0, F.lit(float("-inf")))
        .otherwise(10 * F.log10(signal / noise))
    )


def snr_db(original: Column | str, processed: Column | str) -> Column:
    """Signal-to-noise ratio in dB; infinite for identical audio. For short arrays."""
    return _ratio_db(power(col(original)), difference_power(col(original), col(processed)))


def _segment_sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sum of each run of ``lengths`` values; empty runs sum to zero."""
    sums = np.zeros(lengths.size)
    filled = lengths > 0
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])[filled]
    if starts.size:
        sums[filled] = np.add.reduceat(values, starts)
    return sums


def clip_powers(original: Column | str, processed: Column | str) -> Column:
    """struct(signal, noise): sums of squares of aligned, equally long clips, in Arrow batches.

    Built-in array functions visit one boxed element at a time; for clips of many thousand samples
    one vectorised pass over the batch is several times faster.
    """

    @F.arrow_udf("struct<signal: double, noise: double>")
    def powers(left: pa.Array, right: pa.Array) -> pa.Array:
        valid = pc.and_(left.is_valid(), right.is_valid())
        clean, other = left.filter(valid), right.filter(valid)
        lengths = pc.list_value_length(clean).to_numpy(zero_copy_only=False).astype(np.int64)
        x = clean.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        y = other.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        kept = [pa.array(_segment_sums(v, lengths)) for v in (x * x, (x - y) ** 2)]
        places = pa.array(np.flatnonzero(valid.to_numpy(zero_copy_only=False)))
        rows = pc.index_in(pa.array(np.arange(len(left))), value_set=places)
        return pa.StructArray.from_arrays([v.take(rows) for v in kept], ["signal", "noise"])

    return powers(col(original), col(processed))


def snr_db_clips(original: Column | str, processed: Column | str) -> Column:
    """:func:`snr_db` for long clips."""
    return let(clip_powers(original, processed), lambda p: _ratio_db(p["signal"], p["noise"]))


def align_pair(df: DataFrame, left: str, right: str) -> DataFrame:
    """Cut both arrays to the shorter one; pairs without overlap are dropped."""
    shared = F.least(F.size(left), F.size(right))
    return df.filter(shared > 0).withColumns(
        {left: F.slice(left, 1, shared), right: F.slice(right, 1, shared)}
    )


def mix_down(channels: Column | str) -> Column:
    """Mean over channels of an array of equally long channel arrays."""
    first = F.element_at(col(channels), 1)
    return F.transform(
        first,
        lambda _, i: F.aggregate(
            col(channels), F.lit(0.0), lambda acc, c: acc + F.element_at(c, i + 1).cast("double")
        )
        / F.size(col(channels)),
    )


def pad_min_length(samples: Column | str, minimum: Column | int) -> Column:
    """Zero-pad on the right up to ``minimum`` samples."""
    missing = F.greatest(F.lit(minimum) - F.size(col(samples)), F.lit(0))
    return F.concat(col(samples), F.array_repeat(F.lit(0.0), missing.cast("int")))


def relative_noise_energy(clean: Column | str, noisy: Column | str, eps: float = 1e-8) -> Column:
    n = F.size(col(clean))
    return (difference_power(col(noisy), col(clean)) / n) / (power(col(clean)) / n + F.lit(eps))


def cosine_sim(left: Column | str, right: Column | str) -> Column:
    dot = _sum(F.zip_with(col(left), col(right), lambda a, b: a.cast("double") * b.cast("double")))
    norms = F.sqrt(power(col(left))) * F.sqrt(power(col(right)))
    return dot / F.nullif(norms, F.lit(0.0))


def verify_decision(value: Column | str, dtype: str = "string") -> Column:
    """Verification decision as a boolean; unknown tokens are NULL."""
    if dtype == "boolean":
        return col(value)
    if dtype in ("int", "bigint", "float", "double"):
        return col(value) != 0
    token = F.lower(strip(value))
    return F.when(token.isin(ACCEPT_TOKENS), True).when(token.isin(REJECT_TOKENS), False)


def accept_at(similarity: Column | str, threshold: float) -> Column:
    return col(similarity) >= F.lit(threshold)


def emotion_match(reference: Column | str, generated: Column | str) -> Column:
    return col(reference) == col(generated)


def duration_sec(frames: Column | str, rate: Column | str) -> Column:
    n, r = col(frames), col(rate)
    return F.when((n > 0) & (r > 0), n / r)


def cap_duration(samples: Column | str, rate: Column | str, max_seconds: Column | float | None) -> Column:
    """First int(max·rate) samples when the clip is longer; invalid caps change nothing."""
    cap = F.lit(max_seconds).cast("double")
    frames = (cap * col(rate)).cast("bigint")
    usable = cap.isNotNull() & (cap > 0) & (frames > 0) & (F.size(col(samples)) > frames)
    return F.when(F.coalesce(usable, F.lit(False)), F.slice(col(samples), 1, frames.cast("int"))).otherwise(
        col(samples)
    )


def capped_frames(frames: Column | str, rate: Column | str, max_seconds: Column | float | None) -> Column:
    """Frame count after :func:`cap_duration`, for tables without samples."""
    cap = F.lit(max_seconds).cast("double")
    limit = (cap * col(rate)).cast("bigint")
    usable = cap.isNotNull() & (cap > 0) & (limit > 0) & (col(frames) > limit)
    return F.when(F.coalesce(usable, F.lit(False)), limit).otherwise(col(frames))


def dnsmos_segments(
    df: DataFrame,
    clip: str,
    samples: str,
    rate: int = DNSMOS_RATE,
    window_sec: float = DNSMOS_WINDOW_SEC,
) -> DataFrame:
    """Score windows of every clip: ``(clip, segment, start, stop, window)``.

    Short clips are doubled until one window fits, windows start every second, and windows
    that would run past the end are skipped. Empty clips have none.
    """
    need = int(window_sec * rate)
    length = F.size(samples)
    ratio = F.log2(F.lit(float(need)) / length) - F.lit(1e-9)
    doublings = F.greatest(F.ceil(ratio), F.lit(0)).cast("int")
    copies = F.pow(F.lit(2.0), doublings).cast("int")
    full = df.filter(length > 0).select(
        clip, F.flatten(F.array_repeat(F.col(samples), copies)).alias("_audio")
    )
    hops = (F.floor(F.size("_audio") / F.lit(rate)) - F.lit(window_sec)).cast("int") + 1
    windows = full.withColumn("segment", F.explode(F.sequence(F.lit(0), F.greatest(hops, F.lit(1)) - 1)))
    start = (F.col("segment") * F.lit(rate)).cast("int")
    stop = ((F.col("segment") + F.lit(window_sec)) * F.lit(rate)).cast("int")
    return (
        windows.select(clip, "segment", start.alias("start"), stop.alias("stop"), "_audio")
        .filter((F.least(F.col("stop"), F.size("_audio")) - F.col("start")) >= need)
        .select(
            clip,
            "segment",
            "start",
            "stop",
            F.slice("_audio", F.col("start") + 1, F.col("stop") - F.col("start")).alias("window"),
        )
    )


def polynomial(x: Column | str, coefficients: list[float]) -> Column:
    out = F.lit(0.0)
    for c in coefficients:
        out = out * col(x) + F.lit(c)
    return out


def dnsmos_calibrate(df: DataFrame, clip: str, personalized: bool = False, p808: str | None = None) -> DataFrame:
    """Mean calibrated and raw scores per clip from raw per-segment ``sig``, ``bak``, ``ovr``."""
    curves = DNSMOS_POLYNOMIALS[personalized]
    names = {"ovr": "ovrl", "sig": "sig", "bak": "bak"}
    scores = [F.avg(polynomial(k, curves[k])).alias(v) for k, v in names.items()]
    raw = [F.avg(k).alias(f"{v}_raw") for k, v in names.items()]
    extra = [F.avg(p808).alias("p808_mos")] if p808 else []
    return df.groupBy(clip).agg(*scores, *raw, *extra)


def partial_slices(
    df: DataFrame,
    clip: str,
    n_samples: str,
    frames: int = 160,
    samples_per_frame: int = 160,
    overlap: float = 0.5,
    coverage: float = 0.75,
) -> DataFrame:
    """Overlapping windows per clip; the last one is dropped when poorly covered."""
    if not 0 <= overlap < 1 or not 0 < coverage <= 1:
        raise ValueError("overlap must be in [0, 1) and coverage in (0, 1]")
    step = max(round(frames * (1 - overlap)), 1)
    n_frames = F.ceil((F.col(n_samples) + 1) / F.lit(samples_per_frame))
    steps = F.greatest(F.lit(1), n_frames - frames + step + 1).cast("bigint")
    last = F.floor((steps - 1) / F.lit(step)).cast("int")
    covered = (F.col(n_samples) - last * step * samples_per_frame) / F.lit(float(frames * samples_per_frame))
    keep_to = F.when((covered < coverage) & (last > 0), last - 1).otherwise(last)
    return df.select(
        clip, n_samples, F.explode(F.sequence(F.lit(0), keep_to.cast("int"))).alias("slice")
    ).select(
        clip,
        "slice",
        (F.col("slice") * step).cast("bigint").alias("mel_start"),
        (F.col("slice") * step + frames).cast("bigint").alias("mel_stop"),
        (F.col("slice") * step * samples_per_frame).cast("bigint").alias("wav_start"),
        ((F.col("slice") * step + frames) * samples_per_frame).cast("bigint").alias("wav_stop"),
    )


def normalize_waveform(samples: Column | str, full_scale: float = 32768.0, only_if_loud: bool = False) -> Column:
    """Divide by full scale: always, or only when the peak exceeds 1.5."""
    scaled = F.transform(col(samples), lambda x: x.cast("double") / full_scale)
    if not only_if_loud:
        return scaled
    peak = F.array_max(F.transform(col(samples), lambda x: F.abs(x.cast("double"))))
    return F.when(peak > 1.5, scaled).otherwise(F.transform(col(samples), lambda x: x.cast("double")))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def finite_clip(samples: Column | str) -> Column:
    """NaN to zero, everything into [-1, 1]."""
    return F.transform(col(samples), lambda x: clamp(F.nanvl(x.cast("double"), F.lit(0.0)), -1.0, 1.0))


def mcd_dist(df: DataFrame, pair: list[str], left: str, right: str) -> DataFrame:
    """Mel-cepstral distortion of a frame-aligned cepstra table, averaged per pair."""
    factor = 10.0 / math.log(10.0)
    return df.groupBy(*pair).agg(
        F.avg(F.lit(factor) * F.sqrt(2 * difference_power(F.col(left), F.col(right)))).alias("mcd")
    )


def _sample_row(df: DataFrame, ddl: str) -> DataFrame:
    present = set(df.columns)
    return df.select(
        *[
            (F.col(name) if name in present else F.lit(None)).cast(kind).alias(name)
            for name, kind in ddl_fields(ddl)
        ]
    )


def generation_row(df: DataFrame) -> DataFrame:
    """The per-sample row of a generation run; absent metrics become NULL."""
    return _sample_row(df, GENERATION_METRICS)


def fidelity_row(df: DataFrame) -> DataFrame:
    """The per-sample row of a fidelity run; absent metrics become NULL."""
    return _sample_row(df, FIDELITY_METRICS)
