"""Work that must stay bounded, or spread, when tables grow."""

import json
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from timbre.functions import text
from timbre.functions.text import lexicon_phonemes
from timbre.operators import builders, scoring
from timbre.operators.ordering import spread_scan
from timbre.sources import json_records, manifests


class Captured:
    """Stands for a DataFrame; keeps the function that tasks would run."""

    def select(self, *columns):
        return self

    def mapInArrow(self, compute, schema):
        return compute


def test_rows_of_one_block_are_spread(spark, tmp_path):
    cores = spark.sparkContext.defaultParallelism
    path = str(tmp_path / "t.parquet")
    spark.range(20_000).select("id", F.md5(F.col("id").cast("string")).alias("x")).coalesce(1).write.parquet(path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        scan = spark.read.parquet(path)
        assert scan.rdd.getNumPartitions() >= cores  # but one split has all rows
        many = [r["count"] for r in spread_scan(scan, "id").groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sum(many) == 20_000 and max(many) <= 2 * 20_000 / cores


def test_small_blocks_grow_before_rows_are_copied_often():
    assert builders._blocks(12, 2, builders._DOWN) == 6  # as asked for
    assert builders._blocks(90_000, 16, builders._DOWN) == 44 and builders._blocks(10_000, 16, builders._ACROSS) == 8


def test_total_distances_by_sorted_components():
    rng = np.random.default_rng(1)
    one, other = rng.normal(size=(40, 5)), rng.normal(size=(300, 5))
    want = np.abs(one[:, None] - other[None]).sum(axis=(1, 2))
    assert np.allclose(builders._total_distances(one, other), want, rtol=1e-12)
    same = np.full((7, 3), 0.1)
    assert builders._total_distances(same[:1], same).tolist() == [0.0]  # exactly, as a mean of zero says nothing
    other[3, 2] = np.inf
    assert np.isinf(builders._total_distances(one, other)).all()


def test_requests_and_results_are_held_in_parts():
    run = scoring.synthesize(Captured(), lambda: lambda request: (np.full(request["n"], 0.5), 8000))
    small = pa.RecordBatch.from_pydict({"output_path": [f"o{k}" for k in range(1500)], "n": [1] * 1500})
    assert [b.num_rows for b in run(iter([small]))] == [512, 512, 476]
    large = pa.RecordBatch.from_pydict({"output_path": ["a", "b", "c"], "n": [1 << 21] * 3})
    assert [b.num_rows for b in run(iter([large]))] == [2, 1]
    seen = []
    batches = scoring.synthesize_batches(Captured(), lambda: lambda part: seen.append(len(part)) or [(np.zeros(1), 1)] * len(part))
    assert sum(b.num_rows for b in batches(iter([small]))) == 1500 and max(seen) == 32


def test_objects_of_a_file_go_on_in_parts(monkeypatch):
    monkeypatch.setattr(json_records, "_shaped", lambda found, extras: found)
    read = json_records.json_records(Captured())
    content = json.dumps([{"a": k} if k % 2 else k for k in range(10_000)])
    parts = list(read(iter([pa.RecordBatch.from_pydict({"source_manifest": ["f", "g"], "content": [content, "[{"]})])))
    assert max(p.num_rows for p in parts) <= 2_048 and [r for p in parts for r in p.column(1).to_pylist()] == list(range(5_000))


def test_legacy_files_are_parsed_where_they_are_read(spark, tmp_path, monkeypatch):
    (tmp_path / "filelists").mkdir()
    (tmp_path / "filelists" / "s.json").write_text('[{"ori_pth": "a.wav"}, 3]')

    def refuse(*_):
        raise AssertionError("whole contents as rows")

    monkeypatch.setattr(manifests, "file_contents", refuse)
    assert [r["prompt_file_name"] for r in manifests.read_legacy_manifests(spark, str(tmp_path), "set").collect()] == ["a.wav"]


def test_phonemes_keep_their_partitions(spark):
    texts = spark.createDataFrame([(k, f"Go w{k}, go!") for k in range(600)], "k int, x string")
    lexicon = spark.createDataFrame([("GO", ["G", "OW1"])], "word string, phones array<string>")
    out = lexicon_phonemes(texts, "k", "x", lexicon, ["_", "g", "ow", ","])
    rows = out.withColumn("part", F.spark_partition_id()).collect()
    assert len({r["part"] for r in rows}) > 1 and sorted(r["k"] for r in rows) == list(range(600))
    assert {tuple(r["phones"]) for r in rows} == {("_", "g", "ow", ",", "g", "ow", "UNK", "_")}
    assert {(*r["tones"],) for r in rows} == {(0, 3, 2, 0, 3, 2, 0, 0)} and {(*r["word2ph"], r["oov"]) for r in rows} == {(1, 2, 0, 1, 2, 1, 1, 1)}


def test_words_meet_the_lexicon_once_for_many_texts(spark, monkeypatch):
    rows, given = [], text.spread
    monkeypatch.setattr(text, "spread", lambda df, *keys: rows.append(df) or given(df, *keys))
    lexicon = spark.createDataFrame([(f"W{k}", ["W", "AH1"]) for k in range(100)], "word string, phones array<string>")
    texts = spark.createDataFrame([(k, " ".join(f"w{j} x{j}" for j in range(100))) for k in range(300)], "k int, x string").coalesce(1)
    found = lexicon_phonemes(texts, "k", "x", lexicon, ["w", "ah"]).collect()
    assert rows[0].count() <= 1_000  # 300 texts of 100 known words each
    assert len(found) == 300 and {(len(r["phones"]), sum(r["word2ph"]), r["oov"]) for r in found} == {(202, 202, 100)}
    # chunks don't depend on the order in which rows come
    chunks = []
    for ascending in (True, False):
        lexicon_phonemes(texts.sort("k", ascending=ascending).coalesce(1), "k", "x", lexicon, ["w", "ah"])
        chunks.append({(r["_chunk"], bytes(r["_texts"])) for r in rows[-1].filter("_texts IS NOT NULL").collect()})
    assert chunks[0] == chunks[1]


def test_phonemes_of_many_chunks_against_brute_force(spark):
    rng = random.Random(9)
    known = {f"K{k}": [rng.choice(["AH0", "EH2", "T", "V", "Q"]) for _ in range(k % 4)] for k in range(400)} | {"İS": ["AH1"], "'": ["T"]}
    words = [*(f"k{k}" for k in range(900)), "İs", "'", "!", "…", "?", "-", "it's"]
    texts = [(f"t{k}", " ".join(rng.choices(words, k=rng.randrange(1_500)))) for k in range(200)] + [(None, "k1 k2, k900"), (None, "k3"), ("n", None), ("e", " ")]
    symbols, marks = ["_", "ah", "eh", "t", "V", "!", "-", "'"], "!?…,.'-"

    def spoken(row):
        phones, tones, counts, oov = ["_"], [0], [1], 0
        for word in re.findall(r"[\w']+|[!?…,.-]", row[1] or ""):
            if word in marks:
                each = [(word, 0)]
            else:
                oov += word.upper() not in known
                each = [(re.sub(r"\d$", "", p).lower(), int(p[-1]) + 1 if p[-1].isdigit() else 3) for p in known.get(word.upper(), [])]
            each = [("V" if p == "v" else p, tone) for p, tone in each]
            phones += [p if p in symbols else "UNK" for p, _ in each]
            tones += [tone for _, tone in each]
            counts.append(len(each))
        return row[0] or "", [*phones, "_"], [*tones, 0], [*counts, 1], oov

    lexicon = spark.createDataFrame([*known.items()], "word string, phones array<string>")
    # the same rows again: a row is a text, whatever its key
    frame = spark.createDataFrame([*texts, *texts[-30:]], "k string, x string").coalesce(2)
    got = sorted((r["k"] or "", r["phones"], r["tones"], r["word2ph"], r["oov"]) for r in lexicon_phonemes(frame, "k", "x", lexicon, symbols).collect())
    assert got == sorted(spoken(row) for row in [*texts, *texts[-30:]])


def test_a_word_that_comes_twice_in_the_lexicon_is_refused(spark):
    lexicon = spark.createDataFrame([("GO", ["G"]), ("GO", ["OW1"])], "word string, phones array<string>")
    with pytest.raises(Exception, match="twice in the lexicon"):
        lexicon_phonemes(spark.createDataFrame([(1, "go")], "k int, x string"), "k", "x", lexicon, ["g"]).collect()
