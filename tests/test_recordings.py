"""Recordings in ranges, datasets from configuration files, sketches, batch generators."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from timbre.operators import reports, scoring
from timbre.sources import audio, manifests, recordings


def riff(chunks):
    body = b"".join(tag + struct.pack("<I", len(data) if size is None else size) + data + b"\0" * (len(data) & 1) for tag, data, size in chunks)
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WAVE" + body


def form(code, channels, bits, rate=8000, extended=False):
    frame = channels * bits // 8
    plain = struct.pack("<HHIIHH", 0xFFFE if extended else code, channels, rate, rate * frame, frame, bits)
    return plain + (struct.pack("<HHIH", 22, bits, 0, code) + b"\0" * 14 if extended else b"")


@pytest.fixture
def folder(tmp_path):
    rng = np.random.default_rng(3)
    whole = rng.integers(-3000, 3000, 600).astype("<i2").tobytes()
    files = {
        "mono": riff([(b"fmt ", form(1, 1, 16), None), (b"data", whole, None)]),
        "_stereo": riff([(b"LIST", b"odd", None), (b"fmt ", form(1, 2, 16, extended=True), None), (b"data", whole, None), (b"note", b"xy", None)]),
        "bytes": riff([(b"fmt ", form(1, 1, 8), None), (b"data", bytes(range(251)), None)]),
        "wide": riff([(b"fmt ", form(1, 2, 24), None), (b"data", bytes(range(200)) + b"ab", None)]),
        "float": riff([(b"fmt ", form(3, 1, 32), None), (b"data", rng.random(77).astype("<f4").tobytes(), None)]),
        "streamed": riff([(b"fmt ", form(1, 1, 16), None), (b"data", whole, 0xFFFFFFFF)]),
        "uneven": riff([(b"fmt ", form(1, 1, 16), None), (b"data", whole[:-1], None)]),
        "empty": riff([(b"fmt ", form(1, 1, 16), None), (b"data", b"", None)]),
        "no data": riff([(b"fmt ", form(1, 1, 16), None)]),
        "cut": riff([(b"fmt ", form(1, 1, 16)[:7], None), (b"data", whole, None)]),
        "no channel": riff([(b"fmt ", form(1, 0, 16), None), (b"data", whole, None)]),
        "text": b"hello",
        "nothing": b"",
    }
    for name, content in files.items():
        (tmp_path / f"{name}.wav").write_bytes(content)
    return str(tmp_path)


@pytest.mark.parametrize("range_frames", [1, 7, 100_000])
def test_ranges_equal_the_whole_decode(spark, folder, range_frames):
    whole = {r["name"]: r for r in audio.ingest_audio(spark, folder).collect()}
    facts = recordings.recording_facts(spark, folder, range_frames).collect()
    assert len(facts) == len(whole) == 13
    for got in facts:
        want = whole[got["path"].rsplit("/", 1)[1]]
        assert [got[c] for c in ("bytes", "rate", "channels", "frames", "duration_sec")] == [want[c] for c in ("bytes", "rate", "channels", "frames", "duration_sec")], want["name"]
        wave = np.array(want["samples"] or [], np.float64)
        if not len(wave):
            assert got["total"] is got["energy"] is got["peak"] is None
        else:
            assert np.allclose([got["total"], got["energy"], got["peak"]], [wave.sum(), np.dot(wave, wave), wave.max()], rtol=1e-12, atol=1e-12)
    assert sum(r["frames"] is not None for r in facts) == 7


def test_ranges_join_to_the_samples(spark, folder):
    ranges = recordings.frame_ranges(recordings.recording_layouts(recordings.wav_files(spark, folder)), 13)
    joined = {}
    for row in recordings.range_samples(ranges).orderBy("path", "first").collect():
        assert len(row["samples"]) <= 13
        joined.setdefault(row["path"].rsplit("/", 1)[1], []).extend(row["samples"])
    whole = {r["name"]: r["samples"] for r in audio.ingest_audio(spark, folder).filter("frames > 0").collect()}
    assert joined == whole


def test_no_recordings(spark, tmp_path):
    assert recordings.recording_facts(spark, str(tmp_path)).count() == 0


def test_registry_from_configuration_files(spark, tmp_path):
    pytest.importorskip("yaml")
    configs = tmp_path / "configs" / "dataset"
    configs.mkdir(parents=True)
    (tmp_path / "data" / "one" / "filelists").mkdir(parents=True)
    (tmp_path / "data" / "one" / "filelists" / "s.json").write_text('[{"ori_pth": "a.wav"}]')
    (tmp_path / "bare").mkdir()
    (configs / "One.yaml").write_text("# a comment\nname: first\nroot_path: ./data/one\nextra: [1, 2]\n")
    (configs / "bare.yaml").write_text(f"path: {tmp_path}/bare\n")
    (configs / "blank.yaml").write_text("")
    (configs / "other.txt").write_text("name: unread")
    registry = manifests.read_registry(spark, f"{configs}/")
    assert [(e["key"], e["name"], e["root_path"]) for e in registry] == [
        ("One", "first", f"{tmp_path}/data/one"), ("bare", "bare", f"{tmp_path}/bare"), ("blank", "blank", ""),
    ]
    lines = manifests.build_manifests(spark, registry)
    assert lines[0].startswith("[One.yaml] wrote 1 rows") and lines[1].startswith("[bare.yaml] skip no filelists") and lines[2].startswith("[blank.yaml] skip missing root")
    assert [line.split("]")[0] for line in manifests.build_manifests(spark, registry, only=["ONE"])] == ["[One.yaml"]
    (configs / "list.yaml").write_text("- a\n")
    with pytest.raises(ValueError, match="list.yaml"):
        manifests.read_registry(spark, str(configs))


def test_sketches_merge_over_datasets(spark):
    rows = spark.range(20_000).select(
        F.when(F.col("id") % 3 != 2, (F.col("id") % 3).cast("string")).alias("d"), (F.col("id") % 5_000).alias("s"),
        F.when(F.col("id") % 2 == 0, F.lit("en")).alias("l"), F.when(F.col("id") % 4 == 0, 2.0).alias("t"),
    )
    got = {(r["d"], r["pairs"]): r for r in reports.corpus_sketches(rows, "d", "s", "l", "t").collect()}
    want = {(r["d"], r["pairs"]): r for r in reports.corpus_stats(rows, "d", "s", "l", "t").collect()}
    assert got.keys() == want.keys() and len(got) == 4
    for key, row in want.items():
        assert abs(got[key]["speakers"] - row["speakers"]) <= 0.065 * row["speakers"]
        assert got[key]["languages"] == row["languages"] == 1 and got[key]["mean_seconds"] == row["mean_seconds"] == 2.0
    assert reports.corpus_sketches(rows.limit(0), "d", "s", "l", "t").filter("pairs > 0").count() == 0


def test_a_failing_request_leaves_its_batch_alone(spark):
    def loader():
        def generate(batch):
            assert 0 < len(batch) <= 8
            if (batch["id"] % 10 == 3).any():
                raise RuntimeError("no voice")
            waves = [(np.array([float(i), -2.0, np.nan]), 8000) for i in batch["id"]]
            return waves[:-1] if 20 in set(batch["id"]) else waves  # one result too few

        return generate

    requests = spark.range(40).withColumn("output_path", F.concat(F.lit("o"), F.col("id").cast("string")))
    rows = {int(r["output_path"][1:]): r for r in scoring.synthesize_batches(requests, loader, batch_rows=8).collect()}
    assert sorted(rows) == list(range(40))
    assert {i for i, r in rows.items() if r["error"] == "no voice" and r["samples"] is None} == {3, 13, 23, 33}
    assert "0 results for 1" in rows[20]["error"]
    good = [r for i, r in rows.items() if i % 10 != 3 and i != 20]
    assert all(r["samples"] == [min(float(r["output_path"][1:]), 1.0), -1.0, 0.0] and r["rate"] == 8000 and r["synthesis_time_sec"] >= 0 and r["error"] is None for r in good)
    assert scoring.synthesize_batches(requests.limit(0), loader).count() == 0
