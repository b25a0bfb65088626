"""Column layouts and fixed values shared by the operators."""

from __future__ import annotations


def ddl_fields(ddl: str) -> list[tuple[str, str]]:
    """(name, type) pairs of a flat DDL string."""
    return [tuple(field.strip().split(" ", 1)) for field in ddl.split(",")]


# --- fixed values: the canonical pair-manifest layout ------------------------
MANIFEST_COLUMNS = [
    "dataset_name",
    "split",
    "pair_id",
    "speaker_id",
    "prompt_file_name",
    "prompt_speaker_id",
    "prompt_language",
    "prompt_text",
    "prompt_phonemes",
    "prompt_tone",
    "prompt_word2ph",
    "target_file_name",
    "target_speaker_id",
    "target_language",
    "target_text",
    "target_phonemes",
    "target_tone",
    "target_word2ph",
    "source_manifest",
    "source_row",
]

# --- fixed values: legacy column -> canonical column --------------------------
LEGACY_TO_CANONICAL = {
    "ori_pth": "prompt_file_name",
    "ori_spk": "prompt_speaker_id",
    "ori_lang": "prompt_language",
    "ori_text": "prompt_text",
    "ori_phonemes": "prompt_phonemes",
    "ori_tone": "prompt_tone",
    "ori_word2ph": "prompt_word2ph",
    "gt_pth": "target_file_name",
    "gt_spk": "target_speaker_id",
    "gt_lang": "target_language",
    "gt_text": "target_text",
    "gt_phonemes": "target_phonemes",
    "gt_tone": "target_tone",
    "gt_word2ph": "target_word2ph",
}
CANONICAL_TO_LEGACY = {new: old for old, new in LEGACY_TO_CANONICAL.items()}

MANIFEST_NAME = "metadata.parquet"

# names of a JSON record's fields whose values count as missing in a chain of alternatives
FALSY = "__falsy"
# place of a row in its manifest file
FILE_ORDER = ("_file", "_row")

# --- fixed values: pipe-delimited file lists ---------------------------------
FILELIST_FIELDS = ["audio_path", "speaker", "language", "norm_text", "phones", "tones", "word2ph"]
RAW_FILELIST_FIELDS = ["utt", "spk", "unused", "text"]

# --- fixed values: per-sample metric files -----------------------------------
GENERATION_METRICS = (
    "ground_truth_path STRING, generated_path STRING, speaker_id STRING, "
    "ground_truth_text STRING, predicted_text STRING, mcd DOUBLE, wer DOUBLE, sim DOUBLE, "
    "speechmos_mos DOUBLE, dnsmos_ovrl DOUBLE, dnsmos_sig DOUBLE, dnsmos_bak DOUBLE, "
    "sva BOOLEAN, generated_duration_sec DOUBLE, synthesis_time_sec DOUBLE, "
    "reference_emotion STRING, generated_emotion STRING, emotion_match BOOLEAN"
)
FIDELITY_METRICS = (
    "ground_truth_path STRING, protected_path STRING, ground_truth_text STRING, "
    "predicted_text STRING, snr_db DOUBLE, stoi DOUBLE, wer DOUBLE, sim DOUBLE, "
    "speechmos_mos DOUBLE, dnsmos_ovrl DOUBLE, dnsmos_sig DOUBLE, dnsmos_bak DOUBLE, "
    "mcd DOUBLE, protected_duration_sec DOUBLE"
)
TIMINGS = "generated_path STRING, synthesis_time_sec STRING"
INTERVAL_DDL = (
    "STRUCT<lower: DOUBLE, upper: DOUBLE, confidence_level: DOUBLE, "
    "num_resamples: INT, std: DOUBLE, avg: DOUBLE>"
)

# --- fixed values: report vocabulary -----------------------------------------
PROTECTIONS = ["ss", "ek", "sp", "gr", "em"]
CLEAN = "clean"
HEAT_MAX = 0.78
HEAT_TEXT_FLIP = 0.52
METRIC_DIRECTIONS = {
    "sim": "max",
    "wer": "min",
    "mos": "max",
    "mcd": "min",
    "rtf": "min",
    "sva": "max",
    "emo": "max",
}
