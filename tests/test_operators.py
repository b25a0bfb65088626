"""Manifest rules, ordering, matching trees, summaries, bootstrap, reports, builders."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from timbre.operators import batching, bootstrap as b, builders, manifest as m, matching as mt, reports as r, scoring, signal, summary as s
from timbre.operators.ordering import positions_by_integer, positions_by_sort, salted_join, spread_scan
from timbre.schema import MANIFEST_COLUMNS


# --- manifest ---------------------------------------------------------------------------------------
def test_canonicalize_fallbacks(spark):
    rows = [
        ("f.json", 0, "", "s1", None, "p.wav", "", None, "EN", "x"),
        ("f.json", 1, "t9", None, None, "p.wav", "q.wav", "ZH", "EN", "y"),
        ("f.json", 2, None, None, "z", "p.wav", None, None, None, "z"),
    ]
    ddl = "source_manifest string, source_row int, gt_spk string, ori_spk string, speaker_id string, ori_pth string, gt_pth string, gt_lang string, ori_lang string, spam_type string"
    out = m.canonicalize(spark.createDataFrame(rows, ddl), "set").orderBy("source_row").collect()
    assert out[0].asDict().keys() == {*MANIFEST_COLUMNS, "spam_type"}
    assert [(o["speaker_id"], o["prompt_speaker_id"], o["target_speaker_id"]) for o in out] == [("s1", "s1", "s1"), ("t9", "t9", "t9"), ("z", "z", "z")]
    assert [o["pair_id"] for o in out] == ["set-s1-000000", "set-t9-000001", "set-z-000002"]
    assert [o["target_file_name"] for o in out] == ["p.wav", "q.wav", "p.wav"]
    assert [o["target_language"] for o in out] == ["EN", "ZH", ""] and {o["split"] for o in out} == {"default"}


def test_canonical_column_wins_over_legacy(spark):
    df = spark.createDataFrame([("f", 0, "new", "old"), ("f", 1, None, "old")], "source_manifest string, source_row int, prompt_text string, ori_text string")
    assert [o["prompt_text"] for o in m.canonicalize(df, "d").orderBy("source_row").collect()] == ["new", "old"]


def test_numbers_and_nan_in_fallbacks(spark):
    df = spark.createDataFrame([("f", 0, 0, float("nan")), ("f", 1, 7, 2.5)], "source_manifest string, source_row int, speaker_id int, prompt_text double")
    out = m.canonicalize(df, "d").orderBy("source_row").collect()
    assert [(o["speaker_id"], o["prompt_text"]) for o in out] == [("0", ""), ("7", "2.5")]


def test_sample_index_runs_over_files(spark):
    rows = [(f"{f}.json", i, f, "") for f, n in (("b", 3), ("a", 2)) for i in range(n)]
    df = m.canonicalize(spark.createDataFrame(rows, "source_manifest string, source_row int, ori_spk string, ori_pth string"), "d")
    got = m.zero_shot_samples(df).orderBy("index").select("index", "speaker_id", "source_row").collect()
    assert [tuple(g) for g in got] == [(0, "a", 0), (1, "a", 1), (2, "b", 0), (3, "b", 1), (4, "b", 2)]


def test_discover_speakers_levels(spark):
    empty = spark.createDataFrame([], "speaker_id string")
    files = spark.createDataFrame([("audios/s2/x.wav",), ("audios/s1/x.wav",), ("other/y.wav",)], "relative_path string")
    top = spark.createDataFrame([("b/x.wav",), ("a/x.wav",)], "relative_path string")
    names = lambda df: [x["speaker_id"] for x in df.collect()]
    assert names(m.discover_speakers(empty, explicit=5)) == ["5"]
    assert names(m.discover_speakers(empty, inventory=files)) == ["s1", "s2"]
    assert names(m.discover_speakers(empty, inventory=top)) == ["a", "b"]
    assert names(m.discover_speakers(empty)) == ["default"]


def test_encode_phones_rejects_unknown(spark):
    df = spark.createDataFrame([(["a", "b"], [1, 2], "EN")], "p array<string>, t array<int>, l string")
    row = df.select(m.encode_phones("p", "t", "l", {"a": 4, "b": 5}).alias("e")).first()["e"]
    assert (row["phone_ids"], row["tone_ids"], row["language_ids"]) == ([4, 5], [9, 10], [2, 2])
    with pytest.raises(Exception, match="unknown symbol"):
        df.select(m.encode_phones("p", "t", "l", {"a": 4})).collect()


def test_blank_insertion(spark):
    df = spark.createDataFrame([([3, 4], [2, 1]), ([], [])], "p array<int>, w array<int>")
    got = df.select(m.intersperse_blank("p"), m.intersperse_word2ph("w")).collect()
    assert [tuple(g) for g in got] == [([0, 3, 0, 4, 0], [5, 2]), ([0], [])]


def test_clone_filename_forms(spark):
    rows = [("a/p 1.wav", "b/t+2.wav", 0), ("a/p.x.wav", None, 1), (None, "b/t.wav", 2), (None, None, 3)]
    df = spark.createDataFrame(rows, "p string, t string, i int").orderBy("i")
    got = [x[0] for x in df.select(m.clone_filename("p", "t", "i")).collect()]
    assert got == ["p_1_to_t+2_cloned.wav", "p_x_cloned.wav", "t_cloned.wav", "sample_3_cloned.wav"]


def test_request_policies(spark):
    rows = [(0, "s", "in/p.wav", "t/dir/a.wav", "", "", "EN", ""), (1, "s", "in/q.wav", None, " hi ", "", "", "")]
    ddl = "index bigint, speaker_id string, prompt_path string, target_path string, prompt_text string, target_text string, target_language string, prompt_language string"
    samples = spark.createDataFrame(rows, ddl)
    out = m.synthesis_requests(samples, transcript_policy="default", default_text="hello", folder="target").orderBy("index").collect()
    assert [(x["text"], x["prompt_transcript"], x["x_vector_only"]) for x in out] == [("hello", "hello", False), ("hi", "hi", False)]
    assert [x["output_path"] for x in out] == ["generated_audio/dir/p_to_a_cloned.wav", "generated_audio/s/q_cloned.wav"]
    assert m.synthesis_requests(samples, default_text=None).count() == 1
    assert m.synthesis_requests(samples, transcript_policy="drop").count() == 1
    assert m.synthesis_requests(samples, samples.select(F.lit("in/q.wav").alias("path"))).first()["index"] == 1


# --- ordering ---------------------------------------------------------------------------------------
def test_positions_with_a_hot_group(spark):
    rng = random.Random(1)
    rows = [(n, "hot" if rng.random() < 0.6 else rng.choice(["a", "b", None])) for n in rng.sample(range(5000), 900)]
    df = spark.createDataFrame(rows, "n int, g string")
    got = {x["n"]: x["position"] for x in positions_by_integer(df, "n", ["g"], width=64).collect()}
    for g in {g for _, g in rows}:
        members = sorted(n for n, h in rows if h == g)
        assert [got[n] for n in members] == list(range(len(members)))
    assert len(got) == len(rows)


def test_positions_by_sort(spark):
    words = [f"{random.Random(i).random():.6f}" for i in range(500)]
    df = spark.createDataFrame([(w,) for w in words], "w string").repartition(7)
    got = {x["w"]: x["position"] for x in positions_by_sort(df, ["w"]).collect()}
    assert got == {w: i for i, w in enumerate(sorted(words))}


def test_salted_join_keeps_all_rows(spark):
    large = spark.range(300).select("id", F.lit("k").alias("key"))
    small = spark.createDataFrame([("k", 1), ("k", 2)], "key string, v int")
    assert salted_join(large, small, ["key"], "id", salt=5).count() == 600


def test_spread_scan_keeps_wide_scans(spark):
    wide = spark.range(0, 1000, 1, 64)
    assert spread_scan(wide, "id") is wide


# --- matching ---------------------------------------------------------------------------------------
def test_missing_parent_folder_means_missing(spark):
    samples = spark.createDataFrame([(0, "s", "in/p.wav", "x/here/t.wav"), (1, "s", "in/p.wav", "x/gone/t.wav")], "index bigint, speaker_id string, prompt_path string, target_path string")
    files = spark.createDataFrame([("g/here/p_to_t_cloned.wav", "p_to_t_cloned.wav", "here"), ("g/s/t_cloned.wav", "t_cloned.wav", "s")], "path string, name string, parent string")
    got = {x["index"]: x for x in mt.collect_pairs(samples, files).collect()}
    assert got[0]["clone_path"] == "g/here/p_to_t_cloned.wav" and got[0]["rule"] == "direct"
    assert got[1]["status"] == "no_clone"


def test_direct_hits_close_files_for_later_samples(spark):
    samples = spark.createDataFrame([(0, "s", "in/p.wav", "x/d/t.wav"), (1, "s", "in/q.wav", "x/d/p.wav"), (2, "s", None, "x/d/p.wav")], "index bigint, speaker_id string, prompt_path string, target_path string")
    files = spark.createDataFrame([("g/d/p_cloned.wav", "p_cloned.wav", "d"), ("g/d/p_cloned_b.wav", "p_cloned_b.wav", "d")], "path string, name string, parent string")
    got = {x["index"]: (x["clone_path"], x["rule"]) for x in mt.collect_pairs(samples, files).collect()}
    assert got == {0: ("g/d/p_cloned.wav", "direct"), 1: ("g/d/p_cloned.wav", "direct"), 2: ("g/d/p_cloned.wav", "direct")}


def test_match_protected_rules(spark):
    originals = spark.createDataFrame([(0, "o/a_1_2.wav"), (1, "o/b.wav"), (2, "o/c_7_8.wav"), (3, "o/d.wav")], "index bigint, path string")
    files = spark.createDataFrame([("z/x_1_2.wav",), ("q/y_1_2.wav",), ("q/b_SafeSpeech_protected.wav",), ("q/c_7_8.wav",), ("q/0_SPEC_10.wav",), ("q/0_spec_2.wav",)], "path string")
    out = {x["index"]: x for x in mt.match_protected(originals, files).collect()}
    assert (out[0]["protected"], out[0]["rule"], out[0]["candidates"]) == ("q/y_1_2.wav", "suffix", 2)
    assert (out[1]["protected"], out[1]["rule"], out[1]["name_mismatch"]) == ("q/b_SafeSpeech_protected.wav", "stem", True)
    assert (out[2]["rule"], out[2]["name_mismatch"]) == ("stem", False)
    assert out[3]["protected"] is None
    with pytest.raises(Exception, match="file names differ"):
        mt.require_same_names(mt.match_protected(originals, files)).collect()


def test_numbered_files_follow_their_number(spark):
    originals = spark.createDataFrame([(i, f"o/n{i}.wav") for i in range(3)], "index bigint, path string")
    files = spark.createDataFrame([("q/0_SPEC_10.wav",), ("q/0_SPEC_9.wav",)], "path string")
    out = {x["index"]: x["protected"] for x in mt.match_protected(originals, files).collect()}
    assert out == {0: "q/0_SPEC_9.wav", 1: "q/0_SPEC_10.wav", 2: None}


def test_override_prompts_strict(spark):
    samples = spark.createDataFrame([(0, "s", "in/dir/a.wav"), (1, "s", "in/dir/b.wav")], "index bigint, speaker_id string, prompt_path string")
    files = spark.createDataFrame([("safe/dir/a.wav",), ("safe/a.wav",)], "path string")
    loose = {x["index"]: (x["prompt_path"], x["prompt_missing"]) for x in mt.override_prompts(samples, files, "safe/", strict=False).collect()}
    assert loose == {0: ("safe/dir/a.wav", False), 1: ("in/dir/b.wav", True)}
    with pytest.raises(Exception, match="protected audio not found"):
        mt.override_prompts(samples, files, "safe").collect()


def test_pair_by_index_strict(spark):
    lines = spark.createDataFrame([(0, "g/a.wav", "s1"), (1, "g/b.wav", "s2")], "line_no bigint, path string, speaker string")
    good = spark.createDataFrame([("o/0_s1_0.wav",), ("o/0_s2_1.wav",)], "path string")
    assert [x["synthesized_path"] for x in mt.pair_by_index(lines, good).orderBy("line_no").collect()] == ["o/0_s1_0.wav", "o/0_s2_1.wav"]
    with pytest.raises(Exception, match="speaker of file"):
        mt.pair_by_index(lines, good.withColumn("path", F.replace("path", F.lit("s2"), F.lit("s9")))).collect()
    with pytest.raises(Exception, match="file count"):
        mt.pair_by_index(lines, good.limit(1)).collect()


def test_extension_preference(spark):
    utterances = spark.createDataFrame([(1, "s", "u_cloned.wav", "gone/u.wav")], "utterance int, speaker_id string, gen_basename string, ground_truth_path string")
    files = spark.createDataFrame([("m", "s", n, f"r/s/{n}") for n in ("u_cloned.mp3", "u_cloned.flac", "u.m4a", "u.flac")], "model string, parent string, name string, path string")
    assert mt.resolve_across_models(utterances, files).first()["path"] == "r/s/u_cloned.flac"
    assert mt.resolve_reference(utterances, files).first()["reference_path"] == "r/s/u.flac"


# --- summaries --------------------------------------------------------------------------------------
EMPTY = "mcd double, wer double, sim double, speechmos_mos double, dnsmos_ovrl double, dnsmos_sig double, dnsmos_bak double, sva boolean, emotion_match boolean, generated_duration_sec double"


def test_empty_generation_run(spark):
    nothing = spark.createDataFrame([], EMPTY)
    record = s.generation_summary(nothing, synthesis_time=3.0).first()
    assert record["evaluated_pairs"] == 0 and record["avg_wer"] is None and record["wer_pairs"] == 0
    assert record["total_audio_duration_sec"] == 0.0 and record["rtf"] is None and record["synthesis_time_sec"] == 3.0
    with pytest.raises(Exception, match="No evaluation pairs"):
        s.generation_summary(nothing, strict=True).collect()


def test_each_metric_has_its_own_count(spark):
    rows = [(None, 0.5, 0.1, 3.0, 3.0, 3.0, 3.0, True, None, 2.0), (4.0, None, 0.3, 4.0, None, None, None, None, True, None)]
    record = s.generation_summary(spark.createDataFrame(rows, EMPTY), synthesis_time=1.0).first()
    assert (record["mcd_pairs"], record["wer_pairs"], record["sim_pairs"], record["sva_pairs"], record["emotion_pairs"]) == (1, 1, 2, 1, 1)
    assert record["avg_sim"] == pytest.approx(0.2) and record["rtf"] == 0.5 and record["avg_sva"] == 1.0


def test_infinite_snr_reaches_mean_but_not_interval(spark):
    df = spark.createDataFrame([("m", math.inf), ("m", 1.0), ("m", 3.0)], "model string, snr_db double")
    assert df.agg(F.avg("snr_db")).first()[0] == math.inf
    ci = b.bootstrap_ci(df, ["model"], ["snr_db"], b.BootstrapConfig(200, 0.95, 1)).first()
    assert ci["n"] == 2 and ci["avg"] == 2.0 and 1.0 <= ci["lower"] <= 2.0 <= ci["upper"] <= 3.0


# --- bootstrap --------------------------------------------------------------------------------------
def brute_force(values, resamples, level, seed):
    rng = np.random.default_rng(seed)
    means = np.array([rng.choice(values, values.size).mean() for _ in range(resamples)])
    tail = (1 - level) / 2
    return np.quantile(means, tail), np.quantile(means, 1 - tail), means.std(ddof=1)


@pytest.mark.parametrize("bucket_values", [20_000, 50])
def test_interval_agrees_with_brute_force(spark, monkeypatch, bucket_values):
    monkeypatch.setattr(b, "_LEAF_VALUES", 40)
    values = np.random.default_rng(3).gamma(2.0, 1.0, 800)
    df = spark.createDataFrame([("g", float(v)) for v in values] + [("tiny", 1.0)], "model string, x double")
    got = {x["model"]: x for x in b.bootstrap_ci(df, ["model"], ["x"], b.BootstrapConfig(2000, 0.9, 5), bucket_values).collect()}
    low, high, std = brute_force(values, 2000, 0.9, 9)
    assert got["g"]["lower"] == pytest.approx(low, abs=0.02) and got["g"]["upper"] == pytest.approx(high, abs=0.02)
    assert got["g"]["std"] == pytest.approx(std, rel=0.1) and got["g"]["avg"] == pytest.approx(values.mean())
    assert got["tiny"]["lower"] is None and got["tiny"]["avg"] is None and got["tiny"]["n"] == 1


def test_large_groups_draw_exactly_n(spark, monkeypatch):
    rows = [("a", float(v % 97)) for v in range(1000)] + [("b", float(v)) for v in range(40)]
    values = spark.createDataFrame(rows, "model string, value double")
    monkeypatch.setattr(b, "_LEAF_VALUES", 4)
    counted, stats = b.count_values(values, ["model"], 9)
    placed = counted.join(stats.select("model", "_depth", "_leaf"), "model").withColumn("_hash", F.xxhash64("value"))
    sums = b.large_group_sums(placed, ["model"], b.BootstrapConfig(30, seed=2)).collect()
    assert len(sums) == 60 and {x["weight"] for x in sums if x["model"] == "a"} == {1000}
    assert {x["weight"] for x in sums if x["model"] == "b"} == {40}
    means = np.array([x["total"] / x["weight"] for x in sums if x["model"] == "b"])
    assert abs(means.mean() - 19.5) < 1.5 and means.std() > 0.5


@pytest.mark.parametrize("leaf", [256, 8])
def test_draws_depend_on_the_seed_alone(spark, monkeypatch, leaf):
    monkeypatch.setattr(b, "_LEAF_VALUES", leaf)
    values = np.random.default_rng(3).gamma(2.0, 1.0, 700).round(2)
    df = spark.createDataFrame([("g", float(v)) for v in values] + [("h", float(i % 3)) for i in range(50)], "model string, x double")
    config = b.BootstrapConfig(300, 0.9, 5)
    bounds = {}
    for tuning, parts in ((20_000, 1), (20_000, 7), (300, 3), (50, 2), (7, 5), (1, 4)):
        for r in b.bootstrap_ci(df.repartition(parts), ["model"], ["x"], config, tuning).collect():
            bounds.setdefault(r["model"], []).append([r["lower"], r["upper"], r["std"]])
    for found in bounds.values():
        assert len(found) == 6 and np.allclose(found, found[0], rtol=1e-12, atol=0)
    other = b.bootstrap_ci(df, ["model"], ["x"], b.BootstrapConfig(300, 0.9, 6)).filter("model = 'g'").first()
    assert other["lower"] != bounds["g"][0][0]


def test_repeated_values_and_seeds(spark):
    df = spark.createDataFrame([("g", float(i % 2)) for i in range(5000)], "model string, x double")
    config = b.BootstrapConfig(400, 0.95, 8)
    first, second = (b.bootstrap_ci(df, ["model"], ["x"], config).first() for _ in range(2))
    assert first == second
    assert first["std"] == pytest.approx(0.5 / math.sqrt(5000), rel=0.15)


def test_bootstrap_config():
    assert b.bootstrap_config(None) is None and b.bootstrap_config({"enabled": False}) is None
    assert b.bootstrap_config({"enabled": True}) == b.BootstrapConfig(1000, 0.95, None)
    assert b.bootstrap_config({"enabled": True, "num_samples": 5, "num_resamples": 9, "seed": 3}).num_resamples == 5
    for bad in ({"num_samples": 0}, {"confidence_level": 1.0}, {"confidence_level": 0.0}):
        with pytest.raises(ValueError):
            b.bootstrap_config({"enabled": True, **bad})


def test_attached_interval_struct(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,)], "x double").withColumn("model", F.lit("m"))
    board = df.groupBy().agg(F.avg("x").alias("avg_x"))
    ci = b.bootstrap_ci(df, ["model"], ["x"], b.BootstrapConfig(50, seed=1))
    row = b.attach_intervals(board, ci, [], {"x": "avg_x"}).first()
    assert row["avg_x_ci"]["avg"] == pytest.approx(7 / 3) and row["avg_x_ci"]["num_resamples"] == 50


# --- reports: published similarity scores of 18 systems, best first -----------------------------------
CLEAN = [0.614, 0.606, 0.602, 0.579, 0.570, 0.570, 0.559, 0.559, 0.539, 0.506, 0.492, 0.480, 0.472, 0.454, 0.408, 0.388, 0.244, 0.228]
PROTECTED = [
    (0.384, 0.502, 0.363, 0.408, 0.582), (0.346, 0.475, 0.318, 0.392, 0.572), (0.321, 0.447, 0.301, 0.384, 0.549), (0.287, 0.435, 0.262, 0.258, 0.543),
    (0.303, 0.407, 0.281, 0.312, 0.530), (0.330, 0.445, 0.311, 0.388, 0.532), (0.207, 0.431, 0.176, 0.137, 0.520), (0.264, 0.435, 0.236, 0.272, 0.521),
    (0.184, 0.316, 0.166, 0.229, 0.491), (0.173, None, 0.149, 0.162, 0.466), (0.242, 0.335, 0.216, 0.247, 0.453), (0.272, 0.367, 0.253, 0.280, 0.442),
    (0.238, 0.334, 0.212, 0.235, 0.439), (0.260, 0.308, 0.241, 0.237, 0.414), (0.129, 0.137, 0.108, 0.062, 0.359), (0.156, 0.187, 0.147, 0.148, 0.337),
    (0.185, 0.188, 0.180, 0.175, 0.236), (0.089, 0.125, 0.081, 0.030, 0.207),
]


def board(spark):
    rows = [(f"m{i:02d}", c, *p) for i, (c, p) in enumerate(zip(CLEAN, PROTECTED))]
    return spark.createDataFrame(rows, "model string, clean double, ss double, ek double, sp double, gr double, em double")


def test_published_ranking(spark):
    ranked = r.leaderboard(board(spark).withColumnRenamed("clean", "sim")).orderBy("rank").collect()
    assert [x["model"] for x in ranked] == [f"m{i:02d}" for i in range(18)]
    assert [x["rank"] for x in ranked] == list(range(1, 19)) and [x["medal"] for x in ranked][:4] == [True, True, True, False]
    assert ranked[0]["bar"] == 100.0 and ranked[17]["bar"] == 37.1


def test_published_protection_labels(spark):
    low = {x["model"]: x for x in r.strongest_protection(board(spark)).collect()}
    expected = {m: min(((v, i) for i, v in enumerate(p) if v is not None))[1] for m, p in zip(sorted(low), PROTECTED)}
    assert {m: x["method"] for m, x in low.items()} == {m: ["ss", "ek", "sp", "gr", "em"][i] for m, i in expected.items()}
    assert low["m00"]["drop"] == pytest.approx(0.251)
    hardest = {x["method"]: x["model"] for x in r.most_protected_model(board(spark)).collect()}
    assert set(hardest.values()) == {"m17"}


def test_pivot_keeps_missing_cells(spark):
    long = board(spark).unpivot(["model"], ["clean", "ss", "ek"], "protection", "sim")
    row = r.robustness_matrix(long).filter("model = 'm09'").first()
    assert row["ek"] is None and row["em"] is None and row["ss"] == 0.173


def test_heat_scale(spark):
    df = spark.createDataFrame([(0.78,), (1.0,), (-1.0,), (0.39,), (None,)], "v double")
    got = [tuple(x) for x in df.select(*r.heat_scale("v").values()).collect()]
    assert got == [(1.0, 100, True), (1.0, 100, True), (0.0, 0, False), (0.5, 50, False), (None, None, None)]


# --- builders, batching, signal, scoring --------------------------------------------------------------
def test_compression_manifest(spark):
    rows = [("s2", "v/b.wav", "g/b_cloned.wav"), ("s1", "v/c.wav", "g/c_cloned.wav"), ("s1", "v/a.wav", "g/a_cloned.wav")]
    listed = spark.createDataFrame(rows, "speaker_id string, ground_truth_path string, generated_path string")
    assert [x["gt_stem"] for x in builders.compression_manifest(listed).collect()] == ["a", "c", "b"]
    assert builders.compression_manifest(listed, ["s2"]).count() == 1
    with pytest.raises(ValueError, match="generated_path"):
        builders.compression_manifest(listed.drop("generated_path"))


def test_model_folders(spark):
    df = spark.createDataFrame([("f5_ots_on_robotcall",), ("f5_ots_on_other",)], "folder string")
    assert [x[0] for x in df.select(builders.model_of_folder("folder")).collect()] == ["f5", None]


def test_cross_emotion_pairs_are_linear(spark):
    rows = [(n, "hot", e) for n, e in enumerate(["ang"] * 500 + ["neu"] * 3 + ["sad"] * 40)] + [(1000, "one", "ang")]
    pairs = builders.cross_emotion_pairs(spark.createDataFrame(rows, "k int, speaker string, emotion string"), "speaker", "emotion", "k").collect()
    assert len(pairs) == 543 and all(p["prompt_emotion"] != p["target_emotion"] for p in pairs)


def test_farthest_target_blocks_agree(spark):
    rng = np.random.default_rng(4)
    rows = [(f"s{i}", e, rng.normal(size=4).tolist()) for i in range(12) for e in ("x", "y")]
    frame = spark.createDataFrame(rows, "speaker string, encoder string, embedding array<double>")
    sources, candidates = frame.filter("speaker < 's4'"), frame.filter("speaker >= 's4'")
    got = {x["speaker"]: x["target"] for x in builders.farthest_target(sources, candidates, block_size=2).collect()}
    table = {(s_, e): np.array(v) for s_, e, v in rows}
    names = sorted({s_ for s_, _, _ in rows})
    for source in [n for n in names if n < "s4"]:
        targets = [n for n in names if n >= "s4"]
        total = np.zeros(len(targets))
        for e in ("x", "y"):
            gaps = np.array([np.abs(table[source, e] - table[t_, e]).sum() for t_ in targets])
            total += gaps / gaps.mean()
        assert got[source] == targets[int(total.argmax())]


def test_mixture_reaches_the_level(spark):
    rng = np.random.default_rng(2)
    clips = spark.createDataFrame([(i, rng.normal(size=50 if i else 20).tolist()) for i in range(4)], "id int, x array<double>")
    clean = {x["id"]: np.array(x["x"]) for x in clips.collect()}
    mixed = signal.noise_mixtures(clips, clips, [0], [-5.0, 10.0], "id", "x").collect()
    assert len(mixed) == 8
    for row in mixed:
        c = clean[row["id"]]
        noise = np.array(row["mixture"]) - c
        assert 10 * np.log10((c**2).sum() / (noise**2).sum()) == pytest.approx(row["snr_db"])


def test_gaussian_noise_is_reproducible(spark):
    clips = spark.createDataFrame([(i, [0.0] * 2000) for i in range(3)], "id int, x array<float>")
    once = {x["id"]: x["x"] for x in signal.add_gaussian(clips, "id", "x", 0.05, seed=1).collect()}
    again = {x["id"]: x["x"] for x in signal.add_gaussian(clips.repartition(3), "id", "x", 0.05, seed=1).collect()}
    assert once == again and once[0] != once[1]
    assert np.std(once[0]) == pytest.approx(0.05, rel=0.1)


def test_replica_batches_cover_all_rows(spark):
    rows = spark.range(50).select("id", F.when(F.col("id") < 37, "hot").when(F.col("id") < 49, "mid").otherwise("one").alias("g"))
    seen = []
    for rank in range(2):
        out = batching.replica_batches(rows, "id", "g", 4, 2, rank, epoch=3).collect()
        assert len(out) == (40 + 16 + 8) / 2
        sizes = {}
        for x in out:
            sizes[(x["g"], x["batch"])] = sizes.get((x["g"], x["batch"]), 0) + 1
        assert set(sizes.values()) == {4}
        seen += [x["id"] for x in out]
    assert set(seen) == set(range(50))


def test_synthesis_failures_stay_visible(spark):
    def loader():
        def generate(request):
            if request["output_path"].endswith("1"):
                raise RuntimeError("no voice")
            return np.array([np.nan, 2.0]), 8000

        return generate

    made = scoring.synthesize(spark.range(4).select(F.concat(F.lit("o"), F.col("id").cast("string")).alias("output_path")), loader)
    rows = {x["output_path"]: x for x in made.collect()}
    assert rows["o1"]["error"] == "no voice" and rows["o1"]["samples"] is None
    assert rows["o0"]["samples"] == [0.0, 1.0] and rows["o0"]["rate"] == 8000
    counts = scoring.synthesis_counts(made).first()
    assert (counts["requested"], counts["completed"], counts["failed"]) == (4, 3, 1)


def test_sample_index_counts_stored_rows(spark, tmp_path):
    from timbre.operators.manifest import zero_shot_samples
    from timbre.sources.manifests import read_manifest

    rows = [("b", 5, "b5"), ("a", 9, "a9"), ("b", 2, "b2"), ("a", 0, "a0"), ("c", 0, "c0")]
    frame = spark.createDataFrame(rows, "source_manifest string, source_row long, pair_id string")
    full = read_columns(frame)
    got = {r["pair_id"]: r["index"] for r in zero_shot_samples(full).collect()}
    assert got == {"a0": 0, "a9": 1, "b2": 2, "b5": 3, "c0": 4}
    # without source_row the place in the stored file counts
    stored = spark.createDataFrame([(p,) for *_, p in rows], "pair_id string").coalesce(1)
    stored.write.parquet(str(tmp_path / "metadata.parquet"))
    samples = zero_shot_samples(read_manifest(spark, str(tmp_path), file_order=True)).orderBy("index").collect()
    assert [r["pair_id"] for r in samples] == [p for *_, p in rows]


def read_columns(frame):
    from timbre.operators.manifest import order_columns, with_missing_columns

    return order_columns(with_missing_columns(frame))


def test_odd_numbers(spark):
    from timbre.functions.expr import float_text
    from timbre.functions.text import duration_tag
    from timbre.operators.manifest import digit_tokens

    values = [0.0, -0.0, 1e7, -1e-4, 1e16, 1.5e16, 1e-5, 0.00012345, 123456789.125, 2.0**-24, 999999.5, 0.000099999996, 1e300, 100.0]
    frame = spark.createDataFrame([(v,) for v in values], "v double").select("v", float_text("v").alias("t"), duration_tag("v").alias("d"))
    for r in frame.collect():
        assert r["t"] == repr(r["v"])
        assert r["d"] == ("%g" % abs(r["v"]) if r["v"] == 0 else "%g" % r["v"]).replace(".", "p")
    digits = spark.range(1).select(digit_tokens(F.lit("1 99999999999 99999999999999999999999 x")).alias("d")).first()["d"]
    assert digits == [1, 99999999999, None]
