"""op11: all vectors, whitened along the first four principal components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from timbre.llm.whitening import whiten


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op11_whitening": op11_whitening}
