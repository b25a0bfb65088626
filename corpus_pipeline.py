"""From raw documents to packed training sequences, in four stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from timbre.llm.near_copies import near_copies
from timbre.llm.packing import pack, tokenize_pieces
from timbre.llm.substrings import remove_repeats
from timbre.llm.toxicity import THRESHOLD, fit, score
from timbre.session import cut_lineage, scratch_path

#: No SQL can express the classifier, near-copy components or the tokenizer; tests use brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier doesn't reject."""
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score(docs, model, docs.columns, "__toxicity")
    return scored.filter(F.col("__toxicity") < THRESHOLD).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest ``doc_id`` of each near-duplicate group, and rows without a ``doc_id``.

    Texts are linked if their sets of five-word shingles have a Jaccard similarity of 0.8 or more. SimHash
    fingerprints of five words in vantage-point trees offer the pairs, inside shards of shared shingles; the
    texts decide. Of rows repeating a ``doc_id`` the smallest one stays.
    """
    kept = cut_lineage(near_copies(docs).filter("component_id IS NOT NULL").select(F.col("component_id").alias("doc_id")).distinct())
    rest = [c for c in docs.columns if c != "doc_id"]
    chosen = docs.join(kept, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*rest)).alias("_row"))
    chosen = chosen.select("doc_id", *[F.col(f"_row.`{c}`").alias(c) for c in rest]).select(*docs.columns)
    return chosen.unionByName(docs.filter(F.col("doc_id").isNull()))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one holds; words joined by one space."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    left = remove_repeats(docs, keep=rest)
    if "n_chars" in rest:
        left = left.withColumn("n_chars", F.length("text").cast("bigint"))
    return left.select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all token pieces in sequences of 2048 tokens."""
    return pack(tokenize_pieces(docs, public_tokenizers.path("word_bpe_49k.json"))).drop("fill")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("best_fit_packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
