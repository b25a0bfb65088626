"""op3: all documents packed into sequences of 2048 tokens."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from timbre.llm.packing import pack, tokenize_pieces


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(tokenize_pieces(docs, public_tokenizers.path("word_bpe_49k.json"))).drop("fill")


QUERIES = {"op3_best_fit_packing": op3_best_fit_packing}
