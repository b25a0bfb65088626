"""op9: licences in all documents. The SQL matches the same templates by regular expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from timbre.llm.licenses import PHRASES, TEMPLATES, parse, scan


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")


def _expression(parts: list) -> str:
    """The parts as an expression over words that are each followed by a space."""
    out = ""
    for part in parts:
        if isinstance(part, bytes):
            out += part.decode() + " "
        elif part[0] == "optional":
            out += f"(?:{_expression(part[1])})?"
        else:
            out += f"(?:{part[3].replace('.+', '[^ ]+')} ){{{part[1]},{part[2]}}}"
    return out


_BASE = " ".join(
    "WHEN " + " AND ".join(f"w{i} = '{w}'" for i, w in enumerate(phrase.split())) + f" THEN '{label}'" for phrase, label in PHRASES.items()
)
_FOUND = ", ".join(f"CASE WHEN regexp_matches(joined, ' {_expression(parse(text))}') THEN '{label}' END" for label, text in TEMPLATES.items())

SQL = f"""
WITH plain AS (
    SELECT doc_id, trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                  '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g'), ' ') AS t FROM documents
), split AS (
    SELECT doc_id, CASE WHEN t = '' THEN [] ELSE string_split(t, ' ') END AS w, ' ' || t || ' ' AS joined FROM plain
), tokens AS (
    SELECT doc_id, unnest(w) AS w0, unnest(range(len(w))) AS pos FROM split
), next AS (
    SELECT doc_id, pos, w0, lead(w0) OVER d AS w1, lead(w0, 2) OVER d AS w2, lead(w0, 3) OVER d AS w3
    FROM tokens WINDOW d AS (PARTITION BY doc_id ORDER BY pos)
), places AS (
    SELECT * FROM (SELECT doc_id, pos, CASE {_BASE} END AS label FROM next) WHERE label IS NOT NULL
), base AS (
    SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list(DISTINCT label) AS base FROM places GROUP BY doc_id
), own AS (
    SELECT doc_id, list(label) AS own FROM (SELECT doc_id, unnest([{_FOUND}]) AS label FROM split) WHERE label IS NOT NULL GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(array_to_string(list_sort(base), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(own, [])))), ','), '') AS labels,
       CASE WHEN own IS NOT NULL THEN 1.0 WHEN base IS NOT NULL THEN 0.5 ELSE 0.0 END::DOUBLE AS score
FROM split LEFT JOIN base USING (doc_id) LEFT JOIN own USING (doc_id)
"""

QUERIES = {"op9_license_scan": op9_license_scan}
ORACLES = {"op9_license_scan": SQL}
