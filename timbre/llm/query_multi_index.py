"""op10: the twenty nearest found of every twentieth vector."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from timbre.llm.multi_index import nearest


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


QUERIES = {"op10_nearest": op10_nearest}
