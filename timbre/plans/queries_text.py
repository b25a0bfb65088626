"""Queries for the text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from timbre.functions import text as t
from timbre.plans import fixtures as fx
from timbre.plans.registry import query

# Whitespace and punctuation as DuckDB's regex engine spells them.
_WS = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_PUNCT = t.ASCII_PUNCTUATION.replace("'", "''")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "documents")


@query("T1_norm_en_delete", f"SELECT doc_id, lower(translate(text, '{_PUNCT}', '')) AS norm FROM documents")
def t1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", t.norm_en_delete("text").alias("norm"))


@query(
    "T2_norm_en_space",
    f"""SELECT doc_id, lower(trim(regexp_replace(translate(text, '{_PUNCT}', repeat(' ', 32)), '{_WS}+', ' ', 'g'))) AS norm FROM documents""",
)
def t2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", t.norm_en_space("text").alias("norm"))


# CJK characters do not occur in the tables, so vowels are mapped onto some of both ranges
_CJK_FROM, _CJK_TO = "aeoué", "摩洛哥㐀豈"


@query(
    "T3_contains_cjk",
    rf"""SELECT doc_id, regexp_matches(z, '[\x{{4e00}}-\x{{9fff}}]') AS basic,
      regexp_matches(z, '[\x{{4e00}}-\x{{9fff}}\x{{3400}}-\x{{4dbf}}\x{{20000}}-\x{{2a6df}}\x{{2a700}}-\x{{2b73f}}\x{{2b740}}-\x{{2b81f}}\x{{2b820}}-\x{{2ceaf}}\x{{f900}}-\x{{faff}}\x{{2f800}}-\x{{2fa1f}}]') AS wide
    FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN translate(text, 'é', '豈') ELSE translate(text, '{_CJK_FROM}', '{_CJK_TO}') END AS z FROM documents)""",
)
def t3(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.col("doc_id")
    mixed = (
        F.when(doc % 3 == 0, F.col("text")).when(doc % 3 == 1, F.translate("text", "é", "豈")).otherwise(F.translate("text", _CJK_FROM, _CJK_TO))
    )
    return _docs(spark, sf_dir).select(
        "doc_id", t.contains_cjk(mixed).alias("basic"), t.contains_cjk(mixed, wide=True).alias("wide")
    )


_ZH_FROM, _ZH_TO = "aeou,.!?:;", "摩洛哥国，。！？：；"
_ZH_SQL = rf"""regexp_replace(regexp_replace(
  trim(regexp_replace(regexp_replace(replace({{z}}, '，', ', '), '[^\p{{{{L}}}}\p{{{{N}}}}_\x{{{{4e00}}}}-\x{{{{9fff}}}}{_WS[1:-1].replace('{', '{{').replace('}', '}}')}]', '', 'g'), '{_WS.replace('{', '{{').replace('}', '}}')}+', ' ', 'g')),
  '([\x{{{{4e00}}}}-\x{{{{9fff}}}}]) ([\x{{{{4e00}}}}-\x{{{{9fff}}}}])', '\1\2', 'g'),
  '([\x{{{{4e00}}}}-\x{{{{9fff}}}}]) ([\x{{{{4e00}}}}-\x{{{{9fff}}}}])', '\1\2', 'g')""".replace("{{{{", "{").replace("}}}}", "}").replace("{{", "{").replace("}}", "}")


def _zh(value: str) -> str:
    return _ZH_SQL.replace("{z}", value)


@query("T4_norm_zh", f"SELECT doc_id, {_zh('z')} AS norm FROM (SELECT doc_id, translate(text, '{_ZH_FROM}', '{_ZH_TO}') AS z FROM documents)")
def t4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", t.norm_zh(F.translate("text", _ZH_FROM, _ZH_TO)).alias("norm"))


_TABLE = {"國": "国", "語": "语", "學": "学"}


@query("T5_to_simplified", "SELECT doc_id, translate(translate(text, 'aei', '國語學'), '國語學', '国语学') AS simplified, text AS plain FROM documents")
def t5(spark: SparkSession, sf_dir: str) -> DataFrame:
    traditional = F.translate("text", "aei", "國語學")
    return _docs(spark, sf_dir).select(
        "doc_id", t.to_simplified(traditional, _TABLE).alias("simplified"), t.to_simplified("text").alias("plain")
    )


_EN_TOKENS = rf"list_filter(string_split(regexp_replace(regexp_replace(lower(translate({{x}}, '{_PUNCT}', '')), '{_WS}{_WS}+', ' ', 'g'), '^{_WS}+|{_WS}+$', '', 'g'), ' '), lambda w: w <> '')"
_ZH_TOKENS = rf"regexp_extract_all({{x}}, '[\x{{4e00}}-\x{{9fff}}]|[^\x{{4e00}}-\x{{9fff}}{_WS[1:-1]}]+')"


@query(
    "T6_wer_tokens",
    f"""SELECT doc_id, CASE WHEN chinese THEN array_to_string({_ZH_TOKENS.replace('{x}', _zh('z'))}, ' ')
      ELSE array_to_string({_EN_TOKENS.replace('{x}', 'z')}, ' ') END AS tokens
    FROM (SELECT doc_id, lang = 'es' OR doc_id % 4 = 0 AS chinese,
      CASE WHEN doc_id % 4 = 0 THEN translate('漢' || text, '{_ZH_FROM}', '{_ZH_TO}') ELSE text END AS z FROM documents)""",
)
def t6(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = F.when(F.col("doc_id") % 4 == 0, F.translate(F.concat(F.lit("漢"), "text"), _ZH_FROM, _ZH_TO)).otherwise(F.col("text"))
    docs = _docs(spark, sf_dir).select("doc_id", "lang", mixed.alias("z"))
    detected = F.when(F.col("lang") == "es", "zh").otherwise(F.col("lang"))
    return docs.select("doc_id", F.array_join(t.wer_tokens("z", "z", detected), " ").alias("tokens"))


# prices are spliced into the texts, because they are rare there
_PRICED = """(SELECT doc_id, 'It cost $' || (doc_id % 3) || '.' || (doc_id % 2) || ' or £' || n_chars || ',500 and 1,234,' || (100 + doc_id % 900) || '.5 or $' || doc_id || '.2.1,ok ' || text AS z FROM documents)"""


@query(
    "T7_en_numbers_regex",
    rf"""WITH a AS (SELECT doc_id, z, string_split_regex(z, '[0-9][0-9,]+[0-9]') AS p, regexp_extract_all(z, '[0-9][0-9,]+[0-9]') AS m FROM {_PRICED}),
      b AS (SELECT doc_id, array_to_string(list_transform(range(1, len(p) + 1), lambda i: p[i] || coalesce(replace(m[i], ',', ''), '')), '') AS z FROM a),
      c AS (SELECT doc_id, regexp_replace(z, '£([0-9,]*[0-9]+)', '\1 pounds', 'g') AS z FROM b),
      d AS (SELECT doc_id, string_split_regex(z, '\$[0-9.,]*[0-9]+') AS p,
        list_transform(regexp_extract_all(z, '\$([0-9.,]*[0-9]+)', 1), lambda x: {{'x': x, 'n': len(string_split(x, '.')),
          'd': coalesce(try_cast(string_split(x, '.')[1] AS BIGINT), 0), 'c': coalesce(try_cast(string_split(x, '.')[2] AS BIGINT), 0)}}) AS m FROM c),
      e AS (SELECT doc_id, array_to_string(list_transform(range(1, len(p) + 1), lambda i: p[i] || CASE WHEN i > len(m) THEN ''
          WHEN m[i].n > 2 THEN m[i].x || ' dollars'
          WHEN m[i].d <> 0 AND m[i].c <> 0 THEN m[i].d || CASE WHEN m[i].d = 1 THEN ' dollar' ELSE ' dollars' END || ', ' || m[i].c || CASE WHEN m[i].c = 1 THEN ' cent' ELSE ' cents' END
          WHEN m[i].d <> 0 THEN m[i].d || CASE WHEN m[i].d = 1 THEN ' dollar' ELSE ' dollars' END
          WHEN m[i].c <> 0 THEN m[i].c || CASE WHEN m[i].c = 1 THEN ' cent' ELSE ' cents' END
          ELSE 'zero dollars' END), '') AS z FROM d),
      f AS (SELECT doc_id, regexp_replace(z, '([0-9]+)\.([0-9]+)', '\1 point \2', 'g') AS z FROM e)
    SELECT doc_id, regexp_replace(translate(z, chr(10) || '$"()[]~', '..''''''''''-'), '([,;.?!])([\p{{L}}\p{{N}}_])', '\1 \2', 'g') AS norm FROM f""",
)
def t7(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc, n = F.col("doc_id"), F.col("n_chars").cast("string")
    text = lambda c: c.cast("string")
    priced = F.concat(
        F.lit("It cost $"), text(doc % 3), F.lit("."), text(doc % 2), F.lit(" or £"), n, F.lit(",500 and 1,234,"),
        text(100 + doc % 900), F.lit(".5 or $"), text(doc), F.lit(".2.1,ok "), F.col("text"),
    )
    return _docs(spark, sf_dir).select("doc_id", t.en_numbers_regex(priced).alias("norm"))


_SPEECH_FROM, _SPEECH_TO = "aeiou;:", "嗯摩呣きア；…"
_ASCII_MARKS = "translate({x}, chr(10) || '$\"()[]~', '..''''''''''-')"


@query(
    "T8_map_punctuation",
    rf"""SELECT doc_id, {_ASCII_MARKS.format(x='text')} AS en,
      regexp_replace(translate({_ASCII_MARKS.format(x="replace(translate(z, '嗯呣', '恩母'), '...', '…')")}, '；', ','), '[^\x{{4e00}}-\x{{9fa5}}!?…,.''-]+', '', 'g') AS zh,
      regexp_replace(translate({_ASCII_MARKS.format(x="replace(z, '…', '...')")}, '；', ','),
        '[^\x{{3040}}-\x{{309f}}\x{{30a0}}-\x{{30ff}}\x{{4e00}}-\x{{9fff}}\x{{3400}}-\x{{4dbf}}\x{{3005}}!?…,.''-]+', '', 'g') AS jp
    FROM (SELECT doc_id, text, translate(text, '{_SPEECH_FROM}', '{_SPEECH_TO}') AS z FROM documents)""",
)
def t8(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = F.translate("text", _SPEECH_FROM, _SPEECH_TO)
    return _docs(spark, sf_dir).select(
        "doc_id",
        t.map_punctuation("text", "EN").alias("en"),
        t.map_punctuation(mixed, "ZH").alias("zh"),
        t.map_punctuation(mixed, "JP").alias("jp"),
    )


# the lexicon: every word of the benchmark texts spelt by its letters, vowels stressed
_VOWELS = "AEIOU"
_LEXICON_SYMBOLS = ["_", *"abcdefghijklmnopqrstuwxyzV", "!", "?", "…", ",", ".", "'", "-", "UNK"]


def _lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    token = F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}']+"), F.lit(0))
    tokens = fx.table(spark, sf_dir, "benchmark").select(F.explode(token).alias("word"))
    found = tokens.select(F.upper("word").alias("word")).distinct()
    letters = F.filter(F.split("word", ""), lambda c: c != "")
    phones = F.transform(letters, lambda c: F.when(c.isin(list(_VOWELS)), F.concat(c, F.lit("1"))).otherwise(c))
    return found.select("word", phones.alias("phones"))


@query(
    "T9_lexicon_phonemes",
    rf"""WITH lex AS (SELECT DISTINCT upper(replace(unnest(regexp_extract_all(text, '[\p{{L}}\p{{N}}'']+')), 'ß', 'SS')) AS word FROM benchmark),
      w AS (SELECT doc_id, unnest(toks) AS tok, unnest(range(1, len(toks) + 1)) AS pos
        FROM (SELECT doc_id, regexp_extract_all(text, '[\p{{L}}\p{{N}}'']+|[!?…,.-]') AS toks FROM documents)),
      s AS (SELECT doc_id, pos, tok IN ('!','?','…',',','.','''','-') AS mark, lex.word IS NULL AND NOT (tok IN ('!','?','…',',','.','''','-')) AS oov,
          CASE WHEN tok IN ('!','?','…',',','.','''','-') THEN [tok] WHEN lex.word IS NULL THEN [] ELSE list_filter(string_split(lex.word, ''), lambda c: c <> '') END AS ch
        FROM w LEFT JOIN lex ON upper(replace(tok, 'ß', 'SS')) = lex.word),
      g AS (SELECT doc_id, flatten(list(list_transform(ch, lambda c: CASE WHEN mark THEN c WHEN c = 'V' THEN 'V'
            WHEN (lower(c) >= 'a' AND lower(c) <= 'z' AND ascii(lower(c)) < 128) THEN lower(c) WHEN c IN ('''') THEN c ELSE 'UNK' END) ORDER BY pos)) AS phones,
          flatten(list(list_transform(ch, lambda c: CASE WHEN mark THEN 0 WHEN c IN ('A','E','I','O','U') THEN 2 WHEN regexp_full_match(c, '[0-9]') THEN c::INT + 1 ELSE 3 END) ORDER BY pos)) AS tones,
          list(len(ch) ORDER BY pos) AS counts, sum(oov::INT)::BIGINT AS oov
        FROM s GROUP BY doc_id)
    SELECT d.doc_id, '_' || coalesce(list_reduce(list_transform(phones, lambda p: ' ' || p), lambda a, b: a || b, ''), '') || ' _' AS phones,
      '0' || coalesce(list_reduce(list_transform(tones, lambda p: ' ' || p), lambda a, b: a || b, ''), '') || ' 0' AS tones,
      '1' || coalesce(list_reduce(list_transform(counts, lambda p: ' ' || p), lambda a, b: a || b, ''), '') || ' 1' AS word2ph, coalesce(oov, 0) AS oov
    FROM documents d LEFT JOIN g USING (doc_id)""",
)
def t9(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = t.lexicon_phonemes(_docs(spark, sf_dir), "doc_id", "text", _lexicon(spark, sf_dir), _LEXICON_SYMBOLS)
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), " ").alias(c)
    return out.select("doc_id", joined("phones"), joined("tones"), joined("word2ph"), "oov")


@query(
    "T10_distribute_phones",
    """SELECT l_orderkey, l_linenumber, l_partkey, array_to_string(list_transform(range(0, l_linenumber),
        lambda i: (l_quantity::INT // l_linenumber + CASE WHEN i < l_quantity::INT % l_linenumber THEN 1 ELSE 0 END)::VARCHAR), ' ') AS word2ph FROM lineitem""",
)
def t10(spark: SparkSession, sf_dir: str) -> DataFrame:
    spread = t.distribute_phones("l_quantity", "l_linenumber")
    return fx.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.array_join(F.transform(spread, lambda v: v.cast("string")), " ").alias("word2ph"),
    )


@query(
    "T11_sanitize",
    """SELECT page_id, regexp_replace(url, '[^0-9A-Za-z_.-]', '_', 'g') AS speaker, regexp_replace(url, '[^0-9A-Za-z_+-]', '_', 'g') AS clone,
      regexp_replace(url, '[^a-zA-Z0-9_-]', '_', 'g') AS legacy FROM pages""",
)
def t11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "pages").select("page_id", *[t.sanitize("url", k).alias(k) for k in ("speaker", "clone", "legacy")])


@query(
    "T12_trim_name",
    """SELECT event_id, 'v.' || user_id || '_cap' || replace(replace(printf('%g', value), '.', 'p'), 'e-0', 'e-0') || '_' || md5('out/v.' || user_id || '.wav')[1:8] || '.wav' AS name,
      'v.' || user_id || '_cap' || replace(printf('%g', value * 12345.678), '.', 'p') || '_' || md5('out/v.' || user_id || '.wav')[1:8] || '.wav' AS long_name FROM events""",
)
def t12(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("out/v."), F.col("user_id").cast("string"), F.lit(".wav"))
    return fx.table(spark, sf_dir, "events").select(
        "event_id", t.trim_name(path, "value").alias("name"), t.trim_name(path, F.col("value") * 12345.678).alias("long_name")
    )


@query(
    "T13_speaker_prefix",
    """SELECT c_custkey, CASE WHEN c_custkey < 100 THEN f WHEN c_custkey < 1000 THEN 'p' || c_custkey ELSE substr(f, 1, 4) END AS prefix
    FROM (SELECT c_custkey, 'p' || c_custkey || CASE WHEN c_custkey >= 100 THEN c_mktsegment ELSE '' END AS f FROM customer)""",
)
def t13(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    folder = F.concat(F.lit("p"), key.cast("string"), F.when(key >= 100, F.col("c_mktsegment")).otherwise(""))
    return fx.table(spark, sf_dir, "customer").select("c_custkey", t.speaker_prefix(folder).alias("prefix"))
