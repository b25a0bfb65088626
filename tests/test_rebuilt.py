"""Noise, batches, farthest targets and Poisson resamples on odd rows."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from timbre.functions.text import lexicon_phonemes
from timbre.operators import batching, bootstrap, builders, signal


def plain_mix(v):
    for shift, factor in ((16, 0x7FEB352D), (15, 0x846CA68B)):
        v = ((v ^ (v >> shift)) * factor) % 2**32
    return v ^ (v >> 16)


def words(seed, key):
    digest = hashlib.md5(f"{seed}|{key}".encode()).hexdigest()
    return int(digest[:8], 16), int(digest[8:16], 16)


def test_noise_is_a_function_of_clip_and_place(spark):
    clips = [(1, [0.0] * 7), (2, []), (3, None), (4, [0.99, -0.99]), (1, [0.5])]
    frame = spark.createDataFrame(clips, "clip long, wave array<float>")
    got = sorted(map(repr, ((r.clip, r.wave and [round(x, 6) for x in r.wave]) for r in signal.add_gaussian(frame, "clip", "wave", 0.1, 9).collect())))
    want = []
    for clip, wave in clips:
        one, two = words(9, clip)
        noisy = []
        for i, x in enumerate(wave or []):
            u = (plain_mix(plain_mix((i // 2 + one) % 2**32) ^ two) + 1) / 2**32
            angle = 2 * math.pi * plain_mix(plain_mix((i // 2 + two) % 2**32) ^ one) / 2**32
            z = math.sqrt(-2 * math.log(u)) * (math.sin(angle) if i % 2 else math.cos(angle))
            noisy.append(round(float(np.float32(min(1, max(-1, x + z * 0.1)))), 6))
        want.append((clip, None if wave is None else noisy))
    assert got == sorted(map(repr, want))


def test_noise_is_normal(spark):
    frame = spark.createDataFrame([(k, [0.0] * 999) for k in range(100)], "clip long, wave array<float>")
    values = np.concatenate([r.wave for r in signal.add_gaussian(frame, "clip", "wave", 0.1).collect()]) / 0.1
    assert abs(values.mean()) < 0.01 and abs(values.std() - 1) < 0.01 and abs((values**3).mean()) < 0.03 and abs((values**4).mean() - 3) < 0.1
    assert abs(np.corrcoef(values[:-1], values[1:])[0, 1]) < 0.01


def test_batches_of_rows_that_share_their_order(spark):
    rows = spark.createDataFrame([("a", 1, [1, 2]), ("a", 2, [3]), (None, 1, [4])], "by string, at long, tokens array<int>").withColumn("size", F.size("tokens"))
    got = {(r["by"], r["at"]): (r["batch"], r["slot"], r["tokens"]) for r in batching.padded_batches(rows, "by", "at", "size", ["tokens"], 2).collect()}
    assert got == {("a", 1): (0, 0, [1, 2]), ("a", 2): (0, 1, [3, 0]), (None, 1): (0, 0, [4])}
    with pytest.raises(Exception, match="rows share their at"):
        batching.padded_batches(rows.unionAll(rows), "by", "at", "size", ["tokens"], 2).collect()


def test_farthest_target_of_odd_embeddings(spark):
    ddl = "speaker string, encoder string, embedding array<float>"
    sources = spark.createDataFrame([("s", "x", [0.0, 0.0]), ("s", "y", [1.0]), ("t", "x", [5.0, None]), ("u", "z", [1.0]), ("v", "y", [2.0]), (None, "x", [0.0, 0.0])], ddl)
    others = spark.createDataFrame([("a", "x", [1.0, 1.0]), ("b", "x", [4.0, 2.0]), ("a", "y", [3.0]), ("b", "y", [2.0]), ("c", "x", [9.0]), ("d", "x", None), ("b", "x", [4.0, 2.0])], ddl)
    for block in (1, 100):
        got = {r.speaker: (r.target, round(r.difference, 6)) for r in builders.farthest_target(sources, others, block_size=block).collect()}
        # s: x gaps 2 and 6 (mean 4), y gaps 2 and 1 (mean 1.5); v: y gaps 1 and 0
        assert got == {"s": ("b", round(6 / 4 + 1 / 1.5, 6)), "v": ("a", 2.0)}
    assert builders.farthest_target(sources, others.filter("false")).collect() == []


def test_poisson_resamples(spark):
    draw = np.random.default_rng(2)
    rows = [(draw.choice(["a", "b"]).item(), k, float(draw.normal()) if k % 7 else None) for k in range(300)]
    config = bootstrap.BootstrapConfig(num_resamples=25, seed=4)
    frame = spark.createDataFrame(rows, "g string, key long, value double").repartition(5)
    got = {(r.g, r.resample): r["mean"] for r in bootstrap.poisson_resample_means(frame, ["g"], "key", config).collect()}
    steps = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
    for g in "ab":
        for b in range(25):
            pairs = [(v, sum(plain_mix(words(4, k)[0]) >= 0 and plain_mix(plain_mix(words(4, k)[0]) ^ plain_mix(b)) / 2**32 >= s for s in steps)) for h, k, v in rows if h == g and v is not None]
            assert abs(got[g, b] - sum(v * w for v, w in pairs) / sum(w for _, w in pairs)) < 1e-9
    assert len(got) == 50 and bootstrap.poisson_resample_means(frame.filter("false"), ["g"], "key", config).collect() == []


def test_words_of_texts_without_any(spark):
    texts = spark.createDataFrame([(1, "go go, gone"), (2, ""), (3, None)], "k long, t string")
    lexicon = spark.createDataFrame([("GO", ["G", "OW1"])], "word string, phones array<string>")
    got = {r.k: (r.phones, r.word2ph, r.oov) for r in lexicon_phonemes(texts, "k", "t", lexicon, ["g", "ow", ",", "_"]).collect()}
    assert got == {1: (["_", "g", "ow", "g", "ow", ",", "_"], [1, 2, 2, 1, 0, 1], 1), 2: (["_", "_"], [1, 1], 0), 3: (["_", "_"], [1, 1], 0)}
