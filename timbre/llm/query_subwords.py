"""op8: four distinct segmentations of every document and conversation turn, sampled without replacement."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from timbre.llm.subwords import sampled


_KEYS = ["doc_id", "conv_id", "turn"]


def op8_sampled_subwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row's keys in the other table are null."""
    tables = [spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "conversations")]
    none = F.lit(None).cast("bigint")
    documents, turns = [t.select(*[F.col(k) if k in t.columns else none.alias(k) for k in _KEYS], "text") for t in tables]
    return sampled(documents.unionAll(turns), _KEYS, public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {"op8_sampled_subwords": op8_sampled_subwords}
