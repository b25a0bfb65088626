"""op13: the verdict on every page's URL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from timbre.llm.urls import ALLOW, BLOCK, Rule, judge_urls

HOST_RULES = [
    Rule(ALLOW, "org/"),
    Rule(BLOCK, "example.org/es/"),
    Rule(BLOCK, "example.org/en/1"),
    Rule(ALLOW, "com/fr/"),
    Rule(BLOCK, "com/de/"),
]
#: What no host rule decides: sellers' hosts, pages for machines, and links that only follow or share others.
PATTERNS = [
    Rule(BLOCK, "^cheap-pills^", pattern=True),
    Rule(BLOCK, "^spam-farm^", pattern=True),
    Rule(BLOCK, "^wp-login.php^", pattern=True),
    Rule(BLOCK, "/cgi-bin/*", pattern=True),
    Rule(BLOCK, "*.example.*^sessionid=*", pattern=True),
]


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge_urls(pages, [*HOST_RULES, *PATTERNS]).drop("url")


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_VALUES = ", ".join("('{0}', '{1}', '{2}', '{3}')".format(r.text, r.text.partition("/")[0], r.text[r.text.index("/") :], r.verdict) for r in HOST_RULES)
_SEPARATOR = "([^a-z0-9]|^|$)"
_BLOCKED = " OR ".join(
    f"regexp_matches(lowered, '(?s){p}')"
    for p in (f"{_SEPARATOR}cheap-pills{_SEPARATOR}", f"{_SEPARATOR}spam-farm{_SEPARATOR}", f"{_SEPARATOR}wp-login[.]php{_SEPARATOR}", "/cgi-bin/", f"[.]example[.].*{_SEPARATOR}sessionid=")
)

SQL = f"""
WITH rests AS (
    SELECT page_id, translate(coalesce(url, ''), '{_UPPER}', '{_UPPER.lower()}') AS lowered,
           CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest,
           row_number() OVER () AS row_no
    FROM pages
), hosts AS (
    SELECT *, regexp_extract(rest, '^[^/?#]*') AS raw FROM rests
), places AS (
    SELECT page_id, row_no, lowered, translate(raw, '{_UPPER}', '{_UPPER.lower()}') AS host,
           regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path
    FROM hosts
), rules(rule, rule_host, rule_path, verdict) AS (VALUES {_VALUES}),
held AS (
    SELECT row_no, rule, rules.verdict, row_number() OVER (PARTITION BY row_no ORDER BY length(rule) DESC, rule) AS place
    FROM places JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
)
SELECT page_id, host, path, held.rule, coalesce(held.verdict, CASE WHEN {_BLOCKED} THEN 'block' ELSE 'allow' END) AS verdict
FROM places LEFT JOIN held ON held.row_no = places.row_no AND held.place = 1
"""

QUERIES = {"op13_url_filter": op13_url_filter}
ORACLES = {"op13_url_filter": SQL}
