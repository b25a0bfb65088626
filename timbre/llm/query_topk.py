"""op4: exact top ten of every hundredth vector against all others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from timbre.llm.topk import top_k


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


SQL = """
WITH weights AS (
    SELECT vec_id, i, CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) AS w
    FROM (SELECT vec_id, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings)
    WHERE vec_id NOT IN (
        SELECT vec_id FROM (SELECT vec_id, unnest(embedding) AS x FROM embeddings) WHERE x IS NULL OR isnan(x) OR isinf(x)
    )
), scores AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.w * c.w) AS BIGINT) AS score
    FROM weights q JOIN weights c ON q.i = c.i AND q.vec_id <> c.vec_id
    WHERE q.vec_id % 100 = 0 GROUP BY ALL
), ranked AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scores
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""

QUERIES = {"op4_exact_topk": op4_exact_topk}
ORACLES = {"op4_exact_topk": SQL}
