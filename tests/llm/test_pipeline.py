import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from compare import spark_rows

DDL = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


def corpus():
    filler = lambda seed, n: " ".join(f"w{(seed * 7919 + k * k * 31 + k) % 9973}" for k in range(n))
    docs = [(i, filler(i, 30 + i % 50), "en", "src0", 0) for i in range(120)]
    docs += [(i, filler(i, 20) + " idiot scum moron " + filler(i + 1, 5), "en", "src1", 0) for i in range(200, 260)]
    docs += [(300, docs[3][1], "en", "copy", 0), (301, docs[3][1], "en", "copy", 0), (302, filler(500, 10) + " " + docs[5][1] + " " + filler(501, 40), "en", "quote", 0)]
    docs += [(400, None, "en", "odd", 0), (401, "", "en", "odd", 0), (402, "long " + filler(6000, 9000), "en", "odd", 0), (None, "no id at all", "en", "odd", 0)]
    labels = [(d[0], 1, int(200 <= d[0] < 260)) for d in docs if d[0] is not None]
    return [(*d[:4], len(d[1] or "")) for d in docs], labels


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("pipeline"))
    docs, labels = corpus()
    spark.createDataFrame(docs, DDL).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{folder}/labels.parquet")
    return folder


@pytest.fixture(scope="module")
def stages(spark, tables):
    docs, results = spark.read.parquet(f"{tables}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, tables).write.parquet(f"{tables}/{name}")
        docs = results[name] = spark.read.parquet(f"{tables}/{name}")
    return results


def ids(frame):
    return sorted((r.doc_id for r in frame.select("doc_id").collect()), key=str)


def test_all_but_the_last_stage_return_the_columns_of_documents(stages):
    for name, frame in list(stages.items())[:-1]:
        assert frame.columns == ["doc_id", "text", "lang", "source", "n_chars"], name


def test_toxic_documents_go_and_clean_ones_stay(stages):
    docs, _ = corpus()
    assert ids(stages["toxicity"]) == sorted((d[0] for d in docs if d[0] is None or not 200 <= d[0] < 260), key=str)


def test_one_document_of_each_group_stays(stages):
    kept = ids(stages["simhash_near_dedup"])
    # null and empty texts share a fingerprint; a row without an id stays
    assert kept == sorted(set(ids(stages["toxicity"])) - {300, 301, 401}, key=str)


def test_quoted_passages_go(stages):
    docs = {d[0]: d[1] for d in corpus()[0]}
    left = {r.doc_id: r for r in stages["substring_dedup"].collect()}
    assert ids(stages["substring_dedup"]) == ids(stages["simhash_near_dedup"])
    quote = left[302]
    assert docs[5] not in quote.text and quote.n_chars == len(quote.text) and left[5].text == docs[5]
    assert len(quote.text.split()) == len(docs[302].split()) - len(docs[5].split())
    assert left[402].text == " ".join(re.findall(r"\S+", docs[402]))


def test_packing_covers_what_is_left(spark, stages):
    packed = stages["best_fit_packing"]
    assert ids(packed.select("doc_id").distinct()) == ids(stages["substring_dedup"])
    fills = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).collect()
    assert all(f.n == f.end <= 2048 for f in fills)


def test_run_is_the_stages(spark, tables, stages):
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert spark_rows(corpus_pipeline.run(spark, tables).select(*columns)) == spark_rows(stages["best_fit_packing"].select(*columns))


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], DDL).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
