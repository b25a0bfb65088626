"""op7: passages of 13 words that an earlier document holds, removed from all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from timbre.llm.substrings import remove_repeats


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


SQL = """
WITH words AS (
    SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS pos
    FROM (SELECT doc_id, string_split_regex(regexp_replace(text, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'), '[\\x20\\x09-\\x0D]+') AS w FROM documents WHERE regexp_matches(text, '[^\\x20\\x09-\\x0D]'))
), windows AS (
    SELECT doc_id, pos, string_agg(word, ' ') OVER next AS win, count(*) OVER next AS n
    FROM words WINDOW next AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)
), firsts AS (SELECT win, min(doc_id) AS least FROM windows WHERE n = 13 GROUP BY win),
starts AS (SELECT doc_id, pos FROM windows JOIN firsts USING (win) WHERE n = 13 AND least < doc_id),
marked AS (
    SELECT w.doc_id, w.pos, w.word,
           max(CASE WHEN s.pos IS NOT NULL THEN 1 ELSE 0 END)
               OVER (PARTITION BY w.doc_id ORDER BY w.pos ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone
    FROM words w LEFT JOIN starts s ON w.doc_id = s.doc_id AND w.pos = s.pos
), kept AS (
    SELECT doc_id, count(*) AS n_words, CAST(sum(gone) AS BIGINT) AS n_removed,
           coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (gone = 0), '') AS text
    FROM marked GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k USING (doc_id)
"""

QUERIES = {"op7_substring_dedup": op7_substring_dedup}
ORACLES = {"op7_substring_dedup": SQL}
