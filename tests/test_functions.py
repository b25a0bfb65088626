"""Text, language and metric columns on literal rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from timbre.functions import metrics as k, text as t
from timbre.functions.expr import first_truthy, parent_name, path_order, stem, suffix
from timbre.functions.language import normalize_language, select_language


def values(spark, rows, ddl, *columns):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {ddl}")
    return [tuple(r)[1:] for r in df.select("i", *columns).orderBy("i").collect()]


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        previous, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            previous, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, previous + (x != y))
    return row[-1]


def test_paths(spark):
    rows = [("a/b/c.d.wav",), (".hidden",), ("x.",), ("plain",), ("/top.wav",)]
    got = values(spark, rows, "p string", stem("p"), suffix("p"), parent_name("p"))
    assert got == [("c.d", ".wav", "b"), (".hidden", "", ""), ("x.", "", ""), ("plain", "", ""), ("top", ".wav", "")]


def test_path_order_compares_components(spark):
    rows = [("a/b-c/x",), ("a/b/z",), ("a/b/y",)]
    df = spark.createDataFrame(rows, "p string").orderBy(path_order("p"))
    assert [r["p"] for r in df.collect()] == sorted([r[0] for r in rows], key=lambda p: p.split("/"))


def test_falsy_fallback(spark):
    assert values(spark, [("", None, "x"), ("a", "b", "c"), (None, "", "")], "a string, b string, c string", first_truthy("a", "b", "c")) == [("x",), ("a",), (None,)]


def test_two_english_normalisers_differ(spark):
    got = values(spark, [("It's  a-b, OK!",)], "x string", t.norm_en_delete("x"), t.norm_en_space("x"))
    assert got == [("its  ab ok", "it s a b ok")]


def test_cjk_ranges(spark):
    got = values(spark, [("摩",), ("㐀",), ("abc",), (None,)], "x string", t.contains_cjk("x"), t.contains_cjk("x", wide=True))
    assert got == [(True, True), (False, True), (False, False), (False, False)]


def test_zh_normalisation(spark):
    got = values(spark, [("摩 洛，哥。  A b「c」…",), (None,)], "x string", t.norm_zh("x"))
    assert got == [("摩洛哥 A bc",), ("",)]


def test_words_keep_single_line_breaks(spark):
    assert values(spark, [(" a\nb  c \t d ",)], "x string", t.words("x")) == [(["a\nb", "c", "d"],)]


def test_numbers(spark):
    cases = {
        "1,234 and 12,345.5": "1234 and 12345 point 5",
        "$1.01 $2 $0.50 $0.00 $1.2.3": "1 dollar, 1 cent 2 dollars 50 cents zero dollars 1 point 2. 3 dollars",
        "£20,now": "20 pounds, now",
    }
    got = values(spark, [(x,) for x in cases], "x string", t.en_numbers_regex("x"))
    assert [g[0] for g in got] == list(cases.values())


def test_duration_tags(spark):
    numbers = [10.0, 7.5, 0.1, 1e-5, 1234567.0, 100.0, 0.333333333, 123456.0]
    got = values(spark, [(n,) for n in numbers], "x double", t.duration_tag("x"))
    assert [g[0] for g in got] == [f"{n:g}".replace(".", "p") for n in numbers]


def test_speaker_prefix(spark):
    rows = [("p227robocall",), ("p12",), ("p1a",), ("x123",), ("p1234",)]
    assert [g[0] for g in values(spark, rows, "x string", t.speaker_prefix("x"))] == ["p227", "p12", None, None, "p123"]


def test_distribute_phones_is_greedy(spark):
    rows = [(n, w) for n in range(8) for w in range(1, 5)]

    def greedy(n, w):
        out = [0] * w
        for _ in range(n):
            out[out.index(min(out))] += 1
        return out

    assert [g[0] for g in values(spark, rows, "n int, w int", t.distribute_phones("n", "w"))] == [greedy(*r) for r in rows]


def test_lexicon_hot_word_and_unknown(spark):
    lexicon = spark.createDataFrame([("THE", ["DH", "AH0"]), ("CAT", ["K", "AE1", "T"])], "word string, phones array<string>")
    texts = spark.createDataFrame([(1, "the cat, the dog"), (2, "")], "id int, x string")
    symbols = ["_", "dh", "ah", "k", "ae", "t", ","]
    got = {r["id"]: r for r in t.lexicon_phonemes(texts, "id", "x", lexicon, symbols).collect()}
    assert got[1]["phones"] == ["_", "dh", "ah", "k", "ae", "t", ",", "dh", "ah", "_"]
    assert got[1]["tones"] == [0, 3, 1, 3, 2, 3, 0, 3, 1, 0]
    assert got[1]["word2ph"] == [1, 2, 3, 1, 2, 0, 1] and got[1]["oov"] == 1
    assert got[2]["phones"] == ["_", "_"] and got[2]["oov"] == 0


def test_languages(spark):
    got = values(spark, [("ZH-cn",), (" english ",), ("Klingon",), (" ",), (None,)], "x string", normalize_language("x"), normalize_language("x", "codes"))
    assert got == [("Chinese", "zh-cn"), ("english", "en"), ("Klingon", "Klingon"), (None, None), (None, None)]
    picked = values(spark, [("en", "fr"), ("", "fr"), (None, ""), (" ", "fr")], "a string, b string", select_language("a", "b"), select_language("a", "b", "target", None, "codes"))
    assert picked == [("English", "en"), ("French", "fr"), ("Auto", "en"), (None, "fr")]


def test_error_rates_against_brute_force(spark):
    rng = random.Random(5)
    pairs = [([rng.choice("abcdé") for _ in range(rng.randrange(0, 9))], [rng.choice("abcxé") for _ in range(rng.randrange(0, 9))]) for _ in range(60)]
    got = values(spark, pairs, "r array<string>, h array<string>", k.wer("r", "h"), k.cer(F.array_join("r", ""), F.array_join("h", "")))
    for (r, h), (wer, cer) in zip(pairs, got):
        expected = edit_distance(r, h) / len(r) if r else None
        assert wer == expected and cer == expected


def test_wer_of_long_texts_with_many_words(spark):
    rng = random.Random(6)
    reference = [f"w{i}" for i in range(700)]
    hypothesis = [w for w in reference if rng.random() > 0.2]
    hypothesis[100:100] = ["new"] * 10
    got = values(spark, [(reference, hypothesis), (reference, None), ([], ["a"]), (["a"], [])], "r array<string>, h array<string>", k.wer("r", "h"))
    assert [g[0] for g in got] == [edit_distance(reference, hypothesis) / 700, None, None, 1.0]


def test_failed_transcriptions(spark):
    rows = [("It's ok", None), ("", "x"), (None, "x"), ("It's ok", "it s ok"), ("摩洛 哥", "摩洛")]
    got = values(spark, rows, "r string, h string", k.generation_wer("r", "h"), k.fidelity_wer("r", "h"))
    assert [g[0] for g in got] == [None, None, None, 1.0, pytest.approx(1 / 3)]
    assert [g[1] for g in got] == [1.0, None, None, 0.0, 0.5]


def test_cer_edges(spark):
    assert [g[0] for g in values(spark, [("ab", None), ("", "x"), (None, "x"), ("ab", "abcdef")], "r string, h string", k.cer("r", "h"))] == [1.0, None, None, 2.0]


def test_snr_edges(spark):
    got = values(spark, [([0.5, -0.5], [0.5, -0.5]), ([1.0, 1.0], [0.9, 1.1]), ([0.0], [1.0])], "a array<double>, b array<double>", k.snr_db("a", "b"))
    assert got[0] == (math.inf,) and got[1][0] == pytest.approx(20.0) and got[2] == (-math.inf,)


def test_batched_snr_agrees(spark):
    rng = random.Random(9)
    clip = lambda n: [rng.uniform(-1, 1) for _ in range(n)]
    rows = [(clip(n), clip(n)) for n in (5, 0, 300)] + [([0.5], [0.5]), (None, [1.0]), ([0.0], [1.0])]
    got = values(spark, rows, "a array<double>, b array<double>", k.snr_db("a", "b"), k.snr_db_clips("a", "b"))
    for native, batched in got:
        assert batched == (pytest.approx(native) if native is not None else None)


def test_verification_tokens(spark):
    rows = [(" YES ",), ("0",), ("maybe",), (None,)]
    assert [g[0] for g in values(spark, rows, "x string", k.verify_decision("x"))] == [True, False, None, None]


def test_cap_and_pad(spark):
    rows = [([1.0] * 10, 0.5), ([1.0] * 10, None), ([1.0] * 10, -1.0), ([1.0] * 10, 9.0)]
    got = values(spark, rows, "x array<double>, c double", F.size(k.cap_duration("x", F.lit(10), F.col("c"))), F.size(k.pad_min_length("x", 16)))
    assert got == [(5, 16), (10, 16), (10, 16), (10, 16)]


def test_dnsmos_windows(spark):
    rate, need = 10, int(9.01 * 10)

    def windows(n):
        while n < need:
            n *= 2
        hops = max(int(n // rate - 9.01) + 1, 1)
        return [(i * rate, int((i + 9.01) * rate)) for i in range(hops) if min(int((i + 9.01) * rate), n) - i * rate >= need]

    sizes = [1, 7, 45, 90, 91, 100, 155, 300]
    clips = spark.createDataFrame([(n, [0.1] * n) for n in sizes] + [(0, [])], "clip int, x array<double>")
    rows = k.dnsmos_segments(clips, "clip", "x", rate=rate).select("clip", "start", "stop").collect()
    for n in sizes:
        assert sorted((r["start"], r["stop"]) for r in rows if r["clip"] == n) == windows(n)
    assert not [r for r in rows if r["clip"] == 0]


def test_partial_slices(spark):
    def slices(n, frames=160, per=160, overlap=0.5, coverage=0.75):
        count, step = -(-(n + 1) // per), max(round(frames * (1 - overlap)), 1)
        starts = list(range(0, max(1, count - frames + step + 1), step))
        if (n - starts[-1] * per) / (frames * per) < coverage and len(starts) > 1:
            starts.pop()
        return starts

    sizes = [0, 100, 25600, 30000, 44000, 51200, 80001]
    clips = spark.createDataFrame([(n, n) for n in sizes], "clip int, n int")
    rows = k.partial_slices(clips, "clip", "n").collect()
    for n in sizes:
        assert sorted(r["mel_start"] for r in rows if r["clip"] == n) == slices(n)
