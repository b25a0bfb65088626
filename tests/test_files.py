"""Sources and sinks on real files."""

import json
import math
import os
import struct
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from timbre.operators.matching import attach_timings
from timbre.session import scratch_path, shared_dir
from timbre.sources import audio, filelists, manifests, results


def write_wav(path, samples, rate=8000, channels=1, width=2):
    path.parent.mkdir(parents=True, exist_ok=True)
    with wave.open(str(path), "wb") as handle:
        handle.setnchannels(channels)
        handle.setsampwidth(width)
        handle.setframerate(rate)
        handle.writeframes(samples)


def test_shared_dir_follows_the_session(spark):
    assert scratch_path(spark, "x").startswith(shared_dir(spark))
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_legacy_files(spark, tmp_path):
    lists = tmp_path / "filelists"
    lists.mkdir()
    record = {"ori_pth": "a.wav", "ori_spk": "s", "ori_phonemes": ["h", "i"], "ori_tone": [1, 2], "spam_type": "tax", "gt_text": "größe"}
    (lists / "s2.json").write_text(json.dumps([record, "noise", 5, {"ori_pth": "b.wav"}]), encoding="utf-8")
    (lists / "s1.json").write_text(json.dumps([{"ori_pth": "c.wav", "prompt_text": None, "ori_text": "x"}]))
    (lists / "All_Speakers_v2.json").write_text(json.dumps([record]))
    (lists / "broken.json").write_text("[{")
    (lists / "object.json").write_text(json.dumps({"ori_pth": "d.wav"}))
    out = manifests.read_legacy_manifests(spark, str(tmp_path), "set").orderBy("source_manifest", "source_row").collect()
    assert [(o["source_manifest"], o["source_row"], o["prompt_file_name"]) for o in out] == [("s1.json", 0, "c.wav"), ("s2.json", 0, "a.wav"), ("s2.json", 1, "b.wav")]
    assert out[1]["prompt_phonemes"] == "h i" and out[1]["prompt_tone"] == "1 2"
    assert out[1]["extras"] == {"spam_type": "tax"} and out[1]["target_text"] == "größe" and out[2]["pair_id"] == "set-unknown-000001"
    assert out[0]["prompt_text"] == ""  # the canonical key is there, so its null counts
    named = manifests.read_legacy_manifests(spark, str(tmp_path), "set", extras=["spam_type"])
    assert {r["spam_type"] for r in named.collect()} == {"tax", None}
    only = manifests.read_legacy_manifests(spark, str(tmp_path), "set", speaker="s1").collect()
    assert len(only) == 1


def test_names_that_spark_hides(spark, tmp_path):
    for name in ("_anna_/a_cloned.wav", "bob/_x_cloned.wav", "bob/y_cloned.wav", "bob/Z.WAV", ".h/q.wav", "filelists/_u.json", "filelists/v.json", "filelists/.hidden.json", "filelists/deep/w.json"):
        (tmp_path / name).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / name).write_text('[{"ori_pth": "a.wav"}]')
    listed = sorted(r["relative_path"] for r in audio.audio_inventory(spark, str(tmp_path)).collect())
    assert listed == [".h/q.wav", "_anna_/a_cloned.wav", "bob/_x_cloned.wav", "bob/y_cloned.wav"]
    assert audio.audio_inventory(spark, str(tmp_path), (".wav", ".flac"), any_case=True).count() == 5
    assert audio.ingest_audio(spark, str(tmp_path)).filter("rate IS NULL").count() == 4
    assert sorted(r["source_manifest"] for r in manifests.read_legacy_manifests(spark, str(tmp_path), "set").collect()) == ["_u.json", "v.json"]
    assert manifests.read_manifest_json(spark, str(tmp_path / "filelists" / "_u.json"), "set").count() == 1
    assert audio.audio_inventory(spark, str(tmp_path / "gone")).collect() == []


def test_json_values(spark, tmp_path):
    (tmp_path / "filelists").mkdir()
    record = {"speaker_id": 0, "prompt_speaker_id": "", "target_speaker_id": "t", "split": False, "prompt_text": True, "prompt_tone": [1, None, 2.0], "target_text": 10000000.0}
    rows = [record, {"speaker_id": 7, "target_text": 1e-5, "prompt_text": None, "ori_text": "old"}, {"target_file_name": 0, "prompt_file_name": 5}]
    (tmp_path / "filelists" / "s.json").write_text(json.dumps(rows))
    a, b, c = manifests.read_legacy_manifests(spark, str(tmp_path), "set").orderBy("source_row").collect()
    assert (a["prompt_speaker_id"], a["speaker_id"], a["target_speaker_id"], a["split"]) == ("0", "0", "t", "default")
    assert (a["prompt_text"], a["prompt_tone"], a["target_text"]) == ("True", "1 None 2.0", "10000000.0")
    assert (b["speaker_id"], b["target_text"], b["prompt_text"], c["target_file_name"]) == ("7", "1e-05", "", "5")


def test_dataset_loader(spark, tmp_path):
    root = tmp_path / "set"
    (root / "filelists").mkdir(parents=True)
    (root / "filelists" / "s1.json").write_text(json.dumps([{"ori_pth": "a.wav", "ori_spk": "s1"}]))
    (root / "filelists" / "s2.json").write_text(json.dumps([{"ori_pth": "b.wav", "ori_spk": "s2"}] * 2))
    (root / "pairs.json").write_text(json.dumps([{"ori_pth": "c.wav", "ori_spk": "s3"}, 4]))
    load = lambda **o: manifests.load_dataset(spark, str(root), **o)
    assert load().count() == 3 and load(speaker="s2").count() == 2
    assert [r["prompt_file_name"] for r in load(manifest_name="pairs.json").collect()] == ["c.wav"]
    assert load(manifest_name="pairs.json", speaker="s1").count() == 0
    load().drop("extras").write.parquet(str(root / "metadata.parquet"))
    assert load(speaker="s2").count() == 2 and {"_file", "_row"} <= set(load().columns)


def test_build_manifests_reports_status(spark, tmp_path):
    good, bare, blank = tmp_path / "good", tmp_path / "bare", tmp_path / "blank"
    for root in (good, blank):
        (root / "filelists").mkdir(parents=True)
    bare.mkdir()
    (good / "filelists" / "s.json").write_text(json.dumps([{"ori_pth": "a.wav", "ori_spk": "s"}] * 3))
    (blank / "filelists" / "s.json").write_text("[]")
    registry = [{"key": k, "name": k, "root_path": str(tmp_path / k)} for k in ("good", "bare", "blank", "gone")]
    first = manifests.build_manifests(spark, registry)
    assert [line.split("] ")[1].split(":")[0].split(" ->")[0] for line in first] == ["skip no filelists", "skip empty manifest", "skip missing root", "wrote 3 rows"]
    assert "skip existing" in manifests.build_manifests(spark, registry, only=["GOOD"])[0]
    assert "wrote 3 rows" in manifests.build_manifests(spark, registry, only=["good"], force=True)[0]
    assert manifests.read_manifest(spark, str(good)).count() == 3


def test_manifest_json_file(spark, tmp_path):
    path = tmp_path / "pairs.json"
    path.write_text(json.dumps([{"ori_pth": "a.wav"}, 3]))
    rows = manifests.read_manifest_json(spark, str(path), "noise").collect()
    assert [(x["source_manifest"], x["dataset_name"], x["speaker_id"]) for x in rows] == [("pairs.json", "noise", "")]


def test_audio_tree(spark, tmp_path):
    ramp = np.linspace(-1, 1, 400)
    write_wav(tmp_path / "audios" / "s1" / "a.b.wav", (ramp * 32767).astype("<i2").tobytes())
    stereo = np.stack([np.full(100, 0.5), np.full(100, -0.25)], axis=1)
    write_wav(tmp_path / "audios" / "s2" / "st.wav", (stereo * 32767).astype("<i2").tobytes(), 16000, 2)
    write_wav(tmp_path / "audios" / "s2" / "deep.wav", struct.pack("<i", 4194304)[:3] * 10, 8000, 1, 3)
    (tmp_path / "audios" / "s2" / "bad.wav").write_bytes(b"nothing")
    (tmp_path / "audios" / "s2" / "skip.txt").write_text("x")
    listing = {x["name"]: x for x in audio.audio_inventory(spark, str(tmp_path)).collect()}
    assert set(listing) == {"a.b.wav", "st.wav", "deep.wav", "bad.wav"}
    assert listing["a.b.wav"]["stem"] == "a.b" and listing["a.b.wav"]["parent"] == "s1"
    assert listing["a.b.wav"]["relative_path"] == "audios/s1/a.b.wav" and listing["a.b.wav"]["bytes"] == 844
    decoded = {x["name"]: x for x in audio.ingest_audio(spark, str(tmp_path)).collect()}
    assert decoded["a.b.wav"]["duration_sec"] == 0.05
    assert decoded["a.b.wav"]["samples"] == pytest.approx(np.trunc(ramp * 32767) / 32768, abs=1e-6)
    assert (decoded["st.wav"]["channels"], decoded["st.wav"]["frames"]) == (2, 100)
    assert decoded["st.wav"]["samples"][0] == pytest.approx(0.125, abs=1e-4)
    assert decoded["deep.wav"]["samples"] == pytest.approx([0.5] * 10)
    assert decoded["bad.wav"]["samples"] is None and decoded["bad.wav"]["bytes"] == 7


def test_pcm_round_trip(spark):
    df = spark.createDataFrame([("x/a.wav", [0.0, 0.5, -1.0, 2.0])], "path string, s array<double>")
    files = df.select("path", audio.encode_pcm16("s", 8000).alias("content"))
    row = audio.decode_wav(files).first()
    assert row["samples"] == pytest.approx([0.0, 0.5, -1.0, 1.0], abs=1e-4)
    header = files.select(audio.wav_header("content").alias("h")).first()["h"]
    assert (header["rate"], header["channels"], header["bits"], header["frames"]) == (8000, 1, 16, 4)


def test_filelist_modes(spark, tmp_path):
    path = tmp_path / "list.txt"
    path.write_text("a.wav|s|EN|hi|h i|1 2|2\nbad line\n")
    assert filelists.read_filelist(spark, str(path), mode="lenient").count() == 1
    with pytest.raises(Exception, match="malformed line"):
        filelists.read_filelist(spark, str(path)).collect()
    kept = filelists.split_fields(spark.read.text(str(path)).withColumnRenamed("value", "line"), ["a", "b", "c", "d", "e", "f", "g"], mode="keep")
    assert sorted(x["malformed"] for x in kept.collect()) == [False, True]


def test_line_numbers_across_blocks(spark, tmp_path):
    path = tmp_path / "eval.txt"
    path.write_text("".join(f"{'gt' if i % 2 == 0 else 'syn'}/{i // 2}.wav|text {i // 2}\n" for i in range(3000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = filelists.read_eval_list(spark, str(path)).orderBy("pair").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(rows) == 1500
    assert all((x["gt_path"], x["syn_path"], x["gt_text"]) == (f"gt/{i}.wav", f"syn/{i}.wav", f"text {i}") for i, x in enumerate(rows))


def test_rename_by_index(spark):
    df = spark.createDataFrame([("d/x_000_7.wav", "s")], "audio_path string, speaker string")
    assert filelists.rename_by_index(df, "out/", "SPEC").first()["audio_path"] == "out/s_SPEC_7.wav"


def test_timings(spark, tmp_path):
    path = tmp_path / "synthesis_timings.csv"
    path.write_text("generated_path,synthesis_time_sec\na.wav,1.5\n,2\nb.wav,\nb.wav,oops\na.wav,2.5\n")
    timings = results.read_synthesis_timings(spark, str(path))
    assert [tuple(x) for x in timings.collect()] == [("a.wav", 2.5)]
    pairs = spark.createDataFrame([("a.wav",), ("z.wav",)], "clone_path string")
    assert {x["clone_path"]: x["synthesis_time_sec"] for x in attach_timings(pairs, timings).collect()} == {"a.wav": 2.5, "z.wav": None}


def test_foreign_metric_csv(spark, tmp_path):
    folder = tmp_path / "my_run" / "20250102-030405"
    folder.mkdir(parents=True)
    header = "ground_truth_path,protected_path,ground_truth_text,predicted_text,snr_db,stoi,wer,sim,speechmos_mos,dnsmos_ovrl,dnsmos_sig,dnsmos_bak,mcd,protected_duration_sec"
    (folder / "fidelity_sample_metrics.csv").write_text(header + '\na,b,"say ""hi"", you",x,inf,0.5,,,,,,,,1e-05\n')
    row = results.read_sample_metrics(spark, str(folder), kind="fidelity").first()
    assert (row["run_name"], row["run_ts"]) == ("my_run", "20250102-030405")
    assert row["ground_truth_text"] == 'say "hi", you' and row["snr_db"] == math.inf and row["wer"] is None
    assert row["protected_duration_sec"] == 1e-05


def test_foreign_run_summary(spark, tmp_path):
    folder = tmp_path / "my_run" / "20250102-030405"
    folder.mkdir(parents=True)
    (folder / "metrics.json").write_text(json.dumps({"run_name": "named", "generation_evaluation": {"avg_sim": 0.5, "avg_sim_ci": {"lower": 0.4}, "x": float("inf")}}, indent=2))
    row = results.read_run_summaries(spark, str(folder)).first()
    assert row["run_name"] == "named" and row["run_ts"] == "20250102-030405" and row["generation_evaluation"]["avg_sim_ci"]["lower"] == 0.4


def test_jsonl_per_model(spark, tmp_path):
    df = spark.createDataFrame([("m1", "é"), ("m2", "x")], "model string, text string")
    results.write_jsonl(df, str(tmp_path / "out"))
    assert {d for d in os.listdir(tmp_path / "out") if d.startswith("model=")} == {"model=m1", "model=m2"}
    assert spark.read.json(str(tmp_path / "out")).filter(F.col("text") == "é").count() == 1
