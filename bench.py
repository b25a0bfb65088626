"""Time the headline queries and print one JSON line.

Environment: ``BENCH_SF_DIR`` (default /root/testdata/sf0.1), ``BENCH_CPUS`` (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from timbre.plans import QUERIES  # noqa: E402
from timbre.session import build_session  # noqa: E402

HEADLINE = [
    "M1_canonicalize",
    "M10_zero_shot_samples",
    "P2_locate_clone",
    "P5_match_protected",
    "P9_resolve_across_models",
    "T6_wer_tokens",
    "T9_lexicon_phonemes",
    "K1_wer",
    "K2_cer",
    "K3_snr_db",
    "K13_dnsmos_calibrate",
    "A5_fidelity_summary",
    "A6_generation_summary",
    "A7_bootstrap_ci",
    "A12_summary_by",
    "R1_leaderboard",
    "R3_robustness_matrix",
    "D1_deepfake_set",
    "D2_longest_per_speaker",
    "D6_cross_emotion_pairs",
    "B4_padded_batches",
    "U1_score_pairs",
    "P3_resolve_generated",
    "P4_collect_pairs_with_claims",
    "D3_compression_set",
    "D10_farthest_target",
    "S3_read_legacy_manifests",
    "S17_build_manifests",
    "A7_bootstrap_hashed_weights",
]
_RUNS = 3
#: Further runs of a query stop once all its runs have taken this long.
_LONG_S = 20.0


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "timbre-bench",
        master=f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["A1_metric_means"](spark, sf_dir).collect()  # start the JVM code paths
    times = {}
    for name in HEADLINE:
        spent: list[float] = []
        while len(spent) < _RUNS and sum(spent) < _LONG_S:  # the first run warms up
            started = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            spent.append(time.perf_counter() - started)
        times[name] = round(min(spent), 3)
    scale = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": scale}
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
