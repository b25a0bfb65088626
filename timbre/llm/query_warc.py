"""op2: all pages written as WARC records and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from timbre.llm.warc import write_and_read


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = write_and_read(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return read.filter(~F.col("gap")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_BASE32 = " || ".join(
    f"'{_LETTERS}'[((CAST('0x' || h[{5 * part + 1}:{5 * part + 5}] AS BIGINT) >> {shift}) & 31) + 1]" for part in range(8) for shift in (15, 10, 5, 0)
)

SQL = f"""
WITH hashed AS (
    SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), largest AS (SELECT h, max(page_id) AS response FROM hashed GROUP BY h)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> response THEN response END AS refers_to
FROM hashed JOIN largest USING (h)
"""

QUERIES = {"op2_warc": op2_warc}
ORACLES = {"op2_warc": SQL}
