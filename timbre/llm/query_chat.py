"""op1: all conversations formatted, read back and digested."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from timbre.llm.chat import CHATML, digest, format_conversations

_ODD_TEXT = "</s>[INST] ok [/INST]"


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    odd = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(_ODD_TEXT).alias("text"),
    )
    return digest(format_conversations(rows.unionByName(odd)))


def _escaped_length(column: str) -> str:
    marked = f"replace({column}, '\\', '\\b')"
    breaks = " + ".join(f"2 * ((length({marked}) - length(replace({marked}, '{c}', ''))) // {len(c)})" for c in CHATML["controls"])
    return f"length({marked}) + {breaks}"


_FRAME = len(CHATML["open"]) + len(CHATML["close"]) + 2
_LEGAL = ", ".join(f"'{state}>{role}'" for state, row in CHATML["transitions"].items() for role in row)

SQL = f"""
WITH rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '{_ODD_TEXT}' UNION ALL SELECT -1, 1, 'assistant', '{_ODD_TEXT}'
), placed AS (
    SELECT *, coalesce(lag(role) OVER w, 'start') AS before, lead(role) OVER w IS NULL AS is_last
    FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), sums AS (
    SELECT conv_id, count(*) AS n_turns,
           string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
           coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
           CAST(sum({_FRAME} + {_escaped_length("role")} + length(role) - length(replace(role, chr(10), '')) + {_escaped_length("text")}) AS BIGINT) AS formatted_chars,
           bool_and(before || '>' || role IN ({_LEGAL})) AS valid,
           bool_or(is_last AND role IN ('assistant')) AS ends_well
    FROM placed GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
       sha256(loss) AS loss_sha256, formatted_chars, valid, valid AND ends_well AS complete
FROM sums
"""

QUERIES = {"op1_chat_format": op1_chat_format}
ORACLES = {"op1_chat_format": SQL}
