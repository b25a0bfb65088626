"""Queries for the manifest operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from timbre.functions.language import LANGUAGE_CODES, LANGUAGE_NAMES, normalize_language, select_language
from timbre.operators import manifest as m
from timbre.plans import fixtures as fx
from timbre.plans.fixtures import with_ctes
from timbre.plans.registry import query
from timbre.schema import CANONICAL_TO_LEGACY
from timbre.session import scratch_path
from timbre.sources.manifests import read_manifest

_M = ["legacy", "manifest"]
_S = [*_M, "samples"]


def _map_sql(mapping: dict, value: str, default: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"CASE {value} {cases} ELSE {default} END"


@query("M1_canonicalize", with_ctes(_M, "SELECT * FROM manifest"))
def m1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.manifest(spark, sf_dir)


@query(
    "M2_make_pair_id",
    """SELECT o_orderkey, 'orders-' || CASE WHEN o_custkey % 10 = 0 THEN 'unknown' ELSE 'c' || o_custkey END || '-' ||
      CASE WHEN length(o_orderkey::VARCHAR) >= 6 THEN o_orderkey::VARCHAR ELSE lpad(o_orderkey::VARCHAR, 6, '0') END AS pair_id
    FROM orders""",
)
def m2(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = F.col("o_custkey")
    speaker = F.when(customer % 10 == 0, "").otherwise(F.concat(F.lit("c"), customer.cast("string")))
    return fx.table(spark, sf_dir, "orders").select(
        "o_orderkey", m.make_pair_id(F.lit("orders"), speaker, "o_orderkey").alias("pair_id")
    )


@query(
    "M3_stringify",
    """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN '' ELSE value::VARCHAR END AS number,
      coalesce(event_type, '') AS word, CASE WHEN value > 50 THEN 'True' ELSE 'False' END AS flag,
      event_type || ' ' || user_id AS list, (round(value) * 10000000 + 0.5)::VARCHAR AS large, (round(value) / 4096 / 4096)::VARCHAR AS small,
      event_type || ' None ' || user_id AS gaps FROM events""",
)
def m3(spark: SparkSession, sf_dir: str) -> DataFrame:
    event = F.col("event_id")
    raw = fx.table(spark, sf_dir, "events").select(
        "event_id",
        F.when(event % 10 == 0, F.lit(float("nan"))).when(event % 5 != 0, F.col("value")).alias("number"),
        F.col("event_type").alias("word"),
        (F.col("value") > 50).alias("flag"),
        F.array("event_type", F.col("user_id").cast("string")).alias("list"),
        (F.round("value") * 10_000_000 + 0.5).alias("large"),
        (F.round("value") / 4096 / 4096).alias("small"),
        F.array("event_type", F.lit(None).cast("string"), F.col("user_id").cast("string")).alias("gaps"),
    )
    texts = {c: m.stringify(c, raw.schema[c].dataType) for c in ("number", "word", "flag", "list", "large", "small", "gaps")}
    return raw.select("event_id", *[t.alias(c) for c, t in texts.items()])


@query("M4_passthrough_extras", with_ctes(["legacy"], "SELECT source_manifest, source_row, doc_id, n_chars FROM legacy"))
def m4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.passthrough_extras(fx.legacy(spark, sf_dir))


@query(
    "M5_to_internal",
    with_ctes(_M, "SELECT pair_id, " + ", ".join(f"{new} AS {old}" for new, old in CANONICAL_TO_LEGACY.items() if new != "prompt_text")
              + ", 'kept' AS ori_text FROM manifest"),
)
def m5(spark: SparkSession, sf_dir: str) -> DataFrame:
    internal = m.to_internal(fx.manifest(spark, sf_dir).withColumn("ori_text", F.lit("kept")))
    return internal.select("pair_id", *CANONICAL_TO_LEGACY.values())


@query("M6_filter_speaker", with_ctes(_M, "SELECT pair_id, speaker_id, target_file_name FROM manifest WHERE speaker_id = 'src7'"))
def m6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.filter_speaker(fx.manifest(spark, sf_dir), "src7").select("pair_id", "speaker_id", "target_file_name")


@query("M7_discover_speakers", "SELECT DISTINCT source AS speaker_id FROM documents WHERE source <> ''")
def m7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.discover_speakers(fx.manifest(spark, sf_dir))


@query(
    "M8_speaker_index",
    "SELECT speaker_id, row_number() OVER (ORDER BY speaker_id) - 1 AS speaker_index FROM (SELECT DISTINCT user_id::VARCHAR AS speaker_id FROM events)",
)
def m8(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = fx.table(spark, sf_dir, "events")
    return m.speaker_index(events.select(F.col("user_id").cast("string").alias("speaker_id")))


@query(
    "M9_union_manifests",
    with_ctes(_M, """SELECT pair_id, speaker_id, source_row, n_chars, NULL::INTEGER AS quality FROM manifest
      UNION ALL SELECT 'label-' || doc_id, NULL, doc_id, NULL, quality FROM labels"""),
)
def m9(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = fx.table(spark, sf_dir, "labels").select(
        F.concat(F.lit("label-"), F.col("doc_id").cast("string")).alias("pair_id"),
        F.col("doc_id").alias("source_row"),
        "quality",
    )
    base = fx.manifest(spark, sf_dir).select("pair_id", "speaker_id", "source_row", "n_chars")
    return m.union_manifests(base, labels)


@query("M10_zero_shot_samples", with_ctes(_S, "SELECT * FROM samples"))
def m10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.samples(spark, sf_dir)


def _stored_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the stored rows are numbered, whatever their source_row says
    root = scratch_path(spark, "manifest")
    order = ["source_manifest", "source_row"]
    stored = fx.manifest(spark, sf_dir).drop("doc_id").repartitionByRange(*order).sortWithinPartitions(*order)
    stored.write.parquet(f"{root}/metadata.parquet")
    return m.zero_shot_samples(read_manifest(spark, root, file_order=True))


@query("M10_stored_manifest_samples", with_ctes(_S, "SELECT * EXCLUDE (doc_id) FROM samples"))
def m10_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored_samples(spark, sf_dir)


@query(
    "M10_samples_with_gaps",
    with_ctes(_M, """SELECT pair_id, source_row * 3 AS source_row, row_number() OVER (ORDER BY source_manifest, source_row) - 1 AS "index" FROM manifest"""),
)
def m10_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    spread = fx.manifest(spark, sf_dir).withColumn("source_row", F.col("source_row") * 3)
    return m.zero_shot_samples(spread).select("pair_id", "source_row", "index")


@query(
    "M10_zero_shot_samples_limit",
    with_ctes(_S, """SELECT "index", pair_id, target_path FROM samples WHERE speaker_id = 'src4' ORDER BY "index" LIMIT 25"""),
)
def m10_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.zero_shot_samples(fx.manifest(spark, sf_dir), speaker="src4", max_samples=25).select(
        "index", "pair_id", "target_path"
    )


@query(
    "M11_resolve_audio_path",
    """SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN NULL WHEN doc_id % 10 = 1 THEN '/abs/utt' || doc_id || '.wav'
      ELSE CASE WHEN doc_id % 10 <> 3 AND doc_id % 4 <> 0 THEN 'data/' WHEN doc_id % 10 <> 3 THEN 'data/set/' ELSE 'data/' END
        || 'audios/' || source || '/utt' || doc_id || '.wav' END AS resolved_path FROM documents""",
)
def m11(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.col("doc_id")
    relative = F.concat(F.lit("audios/"), "source", F.lit("/utt"), doc.cast("string"), F.lit(".wav"))
    absolute = F.concat(F.lit("/abs/utt"), doc.cast("string"), F.lit(".wav"))
    docs = fx.table(spark, sf_dir, "documents").select(
        "doc_id", F.when(doc % 10 == 0, "").when(doc % 10 == 1, absolute).otherwise(relative).alias("path"), relative.alias("_file")
    )
    # files exist below one of two roots, and nowhere for one residue class
    root = F.when(doc % 4 == 0, "data/set/").otherwise("data/")
    files = docs.filter(doc % 10 != 3).select(F.concat(root, "_file").alias("path"))
    return m.resolve_audio_path(docs.drop("_file"), "path", files, ["data", "data/set"]).drop("path")


# targets repeat on purpose: every sample also claims the path of its block of three
_REPEATED = """SELECT *, 'shared/' || (doc_id // 3) || '.wav' AS shared FROM samples"""


@query(
    "M12_evaluation_map",
    with_ctes(_S, f"""SELECT shared AS target_path, arg_max(speaker_id, "index") AS speaker_id, arg_max(target_text, "index") AS text,
      arg_max(coalesce(nullif(target_language, ''), nullif(prompt_language, '')), "index") AS language FROM ({_REPEATED}) GROUP BY shared"""),
)
def m12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.evaluation_map(_shared(spark, sf_dir, "target_path"))


def _shared(spark: SparkSession, sf_dir: str, column: str) -> DataFrame:
    block = F.floor(F.col("doc_id") / 3).cast("bigint").cast("string")
    return fx.samples(spark, sf_dir).withColumn(column, F.concat(F.lit("shared/"), block, F.lit(".wav")))


@query(
    "M13_transcript_map",
    with_ctes(_S, f"""SELECT shared AS prompt_path, arg_max(coalesce(nullif(CASE WHEN doc_id % 2 = 0 THEN '' ELSE prompt_text END, ''), target_text, ''), "index") AS transcript
      FROM ({_REPEATED}) GROUP BY shared"""),
)
def m13(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _shared(spark, sf_dir, "prompt_path")
    return m.transcript_map(rows.withColumn("prompt_text", F.when(F.col("doc_id") % 2 != 0, F.col("prompt_text")).otherwise("")))


_TRAINABLE = """
  SELECT m.pair_id, m.speaker_id, m.prompt_tone, m.target_word2ph, string_split(m.prompt_text, ' ') AS p, string_split(m.target_text, ' ') AS t
  FROM manifest m WHERE len(string_split(m.prompt_text, ' ')) BETWEEN 1 AND 640 AND len(string_split(m.target_text, ' ')) BETWEEN 1 AND 640
    AND m.doc_id % 10 <> 3 AND (m.doc_id + 1) % 10 <> 3
"""


def _trainable(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    # words stand in for phones; some audio files do not exist
    rows = fx.manifest(spark, sf_dir).withColumns({"prompt_phonemes": F.col("prompt_text"), "target_phonemes": F.col("target_text")})
    docs = fx.table(spark, sf_dir, "documents").filter(F.col("doc_id") % 10 != 3)
    files = docs.select(F.concat(F.lit("audios/"), "source", F.lit("/utt"), F.col("doc_id").cast("string"), F.lit(".wav")).alias("path"))
    return rows, m.filter_trainable(rows, files)


_DIGITS = "array_to_string(list_filter(string_split({c}, ' '), lambda x: regexp_full_match(x, '[0-9]+')), ' ')"


@query(
    "M14_filter_trainable",
    with_ctes(_M, f"""SELECT pair_id, len(p) AS prompt_phones, len(t) AS target_phones, {_DIGITS.format(c='prompt_tone')} AS prompt_tone,
      {_DIGITS.format(c='target_word2ph')} AS target_word2ph FROM ({_TRAINABLE})"""),
)
def m14(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = _trainable(spark, sf_dir)[1]
    text = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), " ").alias(c)
    return kept.select(
        "pair_id",
        F.size("prompt_phonemes").cast("bigint").alias("prompt_phones"),
        F.size("target_phonemes").cast("bigint").alias("target_phones"),
        text("prompt_tone"),
        text("target_word2ph"),
    )


@query(
    "M15_skip_report",
    with_ctes(_M, f"""SELECT speaker_id, count(*) AS total, count(k.pair_id) AS kept, round((count(*) - count(k.pair_id)) / count(*), 6) AS skipped_fraction
      FROM manifest m LEFT JOIN ({_TRAINABLE.replace('manifest m', 'manifest m')}) k USING (pair_id, speaker_id) GROUP BY speaker_id"""),
)
def m15(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = _trainable(spark, sf_dir)
    report = m.skip_report(before, after, ["speaker_id"])
    return report.withColumn("skipped_fraction", F.round("skipped_fraction", 6))


@query("M16_spec_length", "SELECT doc_id, n_chars // (2 * 512) AS frames FROM documents")
def m16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "documents").select("doc_id", m.spec_length("n_chars", 512).alias("frames"))


@query(
    "M17_canonical_speaker",
    """SELECT page_id, lower(regexp_extract(string_split(regexp_replace(url, '^\\s+|\\s+$', '', 'g'), '/')[-1], '^([^._\\-]*)', 1)) AS speaker FROM pages""",
)
def m17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "pages").select("page_id", m.canonical_speaker("url").alias("speaker"))


@query(
    "M18_speaker_number",
    """WITH t AS (SELECT doc_id, CASE WHEN doc_id % 7 = 3 THEN lang || '99999999999999999999' || doc_id % 2 WHEN doc_id % 2 = 0 THEN source || '_x.wav' ELSE 'd/' || lang || '-' || doc_id END AS speaker FROM documents),
      u AS (SELECT *, lower(regexp_extract(string_split(speaker, '/')[-1], '^([^._\\-]*)', 1)) AS token FROM t),
      f AS (SELECT token, row_number() OVER (ORDER BY min(doc_id)) - 1 AS id FROM u WHERE try_cast(nullif(regexp_extract(token, '([0-9]+)$', 1), '') AS BIGINT) IS NULL GROUP BY token)
    SELECT doc_id, coalesce(try_cast(nullif(regexp_extract(token, '([0-9]+)$', 1), '') AS BIGINT), id) AS speaker_number
    FROM u LEFT JOIN f USING (token)""",
)
def m18(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("doc_id").cast("string")
    rows = fx.table(spark, sf_dir, "documents").select(
        "doc_id",
        F.when(F.col("doc_id") % 7 == 3, F.concat("lang", F.lit("99999999999999999999"), (F.col("doc_id") % 2).cast("string")))
        .when(F.col("doc_id") % 2 == 0, F.concat("source", F.lit("_x.wav")))
        .otherwise(F.concat(F.lit("d/"), "lang", F.lit("-"), number))
        .alias("speaker"),
    )
    return m.speaker_number(rows, "speaker", "doc_id").select("doc_id", "speaker_number")


# symbols of the query: the letters that occur, numbered in alphabetical order
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_SYMBOLS = {s: i for i, s in enumerate(["_", *_LETTERS])}
_PHONES_SQL = "list_filter(string_split(lower(text), ''), lambda c: c >= 'a' AND c <= 'z' AND length(c) = 1 AND ascii(c) < 128)"
_LANG_SQL = "CASE lang WHEN 'en' THEN 'EN' WHEN 'fr' THEN 'JP' ELSE 'ZH' END"


def _phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    letters = F.split(F.regexp_replace(F.lower("text"), "[^a-z]", ""), "")
    phones = F.filter(letters, lambda c: c != "")
    return fx.table(spark, sf_dir, "documents").select(
        "doc_id",
        phones.alias("phones"),
        F.transform(phones, lambda _, i: i % 4).alias("tones"),
        F.when(F.col("lang") == "en", "EN").when(F.col("lang") == "fr", "JP").otherwise("ZH").alias("language"),
    )


@query(
    "M19_encode_phones",
    f"""SELECT doc_id, array_to_string(list_transform({_PHONES_SQL}, lambda c: (ascii(c) - 96)::VARCHAR), ' ') AS phone_ids,
      array_to_string(list_transform(range(0, len({_PHONES_SQL})), lambda i: (i % 4 + CASE {_LANG_SQL} WHEN 'ZH' THEN 0 WHEN 'JP' THEN 6 ELSE 8 END)::VARCHAR), ' ') AS tone_ids,
      CASE {_LANG_SQL} WHEN 'ZH' THEN 0 WHEN 'JP' THEN 1 ELSE 2 END AS language_id, len({_PHONES_SQL}) AS n
    FROM documents WHERE len({_PHONES_SQL}) > 0""",
)
def m19(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = _phones(spark, sf_dir).filter(F.size("phones") > 0).select(
        "doc_id", m.encode_phones("phones", "tones", "language", _SYMBOLS).alias("e")
    )
    text = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), " ")
    return coded.select(
        "doc_id",
        text(F.col("e.phone_ids")).alias("phone_ids"),
        text(F.col("e.tone_ids")).alias("tone_ids"),
        F.element_at("e.language_ids", 1).alias("language_id"),
        F.size("e.language_ids").cast("bigint").alias("n"),
    )


@query(
    "M20_intersperse_blank",
    f"""SELECT doc_id, array_to_string(list_concat(['0'], flatten(list_transform({_PHONES_SQL}, lambda c: [(ascii(c) - 96)::VARCHAR, '0']))), ' ') AS phones,
      (n_chars * 2 + 1) || ' ' || (doc_id * 2) AS word2ph FROM documents""",
)
def m20(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fx.table(spark, sf_dir, "documents").select("doc_id", F.array("n_chars", "doc_id").alias("word2ph"))
    ids = _phones(spark, sf_dir).select("doc_id", F.transform("phones", lambda p: F.ascii(p) - 96).alias("ids"))
    text = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), " ")
    return ids.join(docs, "doc_id").select(
        "doc_id",
        text(m.intersperse_blank("ids")).alias("phones"),
        text(m.intersperse_word2ph("word2ph")).alias("word2ph"),
    )


_TAG_SQL = "CASE WHEN doc_id % 9 = 0 THEN '  ' WHEN doc_id % 9 = 1 THEN ' ' || upper(lang) || ' ' WHEN doc_id % 9 = 2 THEN 'xx' ELSE lang END"


def _tag() -> Column:
    doc = F.col("doc_id")
    return (
        F.when(doc % 9 == 0, "  ")
        .when(doc % 9 == 1, F.concat(F.lit(" "), F.upper("lang"), F.lit(" ")))
        .when(doc % 9 == 2, "xx")
        .otherwise(F.col("lang"))
    )


def _lang_sql(mapping: dict, value: str) -> str:
    return _map_sql(mapping, f"lower(trim({value}))", f"nullif(trim({value}), '')")


@query(
    "M21_normalize_language",
    f"SELECT doc_id, {_lang_sql(LANGUAGE_NAMES, _TAG_SQL)} AS name, {_lang_sql(LANGUAGE_CODES, _TAG_SQL)} AS code FROM documents",
)
def m21(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "documents").select(
        "doc_id", normalize_language(_tag(), "names").alias("name"), normalize_language(_tag(), "codes").alias("code")
    )


@query(
    "M22_select_language",
    f"""SELECT doc_id, coalesce({_lang_sql(LANGUAGE_CODES, 'p')}, {_lang_sql(LANGUAGE_CODES, 't')}, 'ja') AS code,
      CASE WHEN coalesce(nullif(t, ''), nullif(p, '')) IS NULL THEN 'Auto'
        ELSE {_lang_sql(LANGUAGE_NAMES, "coalesce(nullif(t, ''), nullif(p, ''))")} END AS name
    FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '' ELSE {_TAG_SQL} END AS t,
      CASE WHEN doc_id % 5 = 0 THEN NULL ELSE {_TAG_SQL} END AS p FROM documents)""",
)
def m22(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.col("doc_id")
    sides = fx.table(spark, sf_dir, "documents").select(
        "doc_id", F.when(doc % 2 == 0, "").otherwise(_tag()).alias("t"), F.when(doc % 5 != 0, _tag()).alias("p")
    )
    return sides.select(
        "doc_id",
        select_language("t", "p", "prompt", "jp", "codes").alias("code"),
        select_language("t", "p", "target", "auto", "names").alias("name"),
    )


_REQUEST_SQL = """
  SELECT "index", speaker_id, prompt_path, target_path, p AS prompt_transcript, coalesce(nullif({a}, ''), nullif({b}, ''){default}) AS text,
    {language} AS language, {flag} AS x_vector_only,
    'generated_audio/' || speaker_id || '/utt' || doc_id || CASE WHEN target_path = prompt_path THEN '_to_utt' || doc_id
      ELSE '_to_utt' || (doc_id + 1) END || '_cloned.wav' AS output_path
  FROM (SELECT *, regexp_replace(CASE WHEN doc_id % 4 = 0 THEN ' ' ELSE prompt_text END, '^\\s+|\\s+$', '', 'g') AS p,
      regexp_replace(CASE WHEN doc_id % 3 = 0 THEN '' ELSE target_text END, '^\\s+|\\s+$', '', 'g') AS t FROM samples)
  WHERE doc_id % 10 <> 3
"""


def _request_samples(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    doc = F.col("doc_id")
    rows = fx.samples(spark, sf_dir).withColumns(
        {
            "prompt_text": F.when(doc % 4 == 0, " ").otherwise(F.col("prompt_text")),
            "target_text": F.when(doc % 3 == 0, "").otherwise(F.col("target_text")),
        }
    )
    # one residue class of prompt files does not exist
    files = fx.table(spark, sf_dir, "documents").filter(doc % 10 != 3)
    return rows, files.select(F.concat(F.lit("audios/"), "source", F.lit("/utt"), doc.cast("string"), F.lit(".wav")).alias("path"))


_REQUEST_NAME = _lang_sql(LANGUAGE_NAMES, "coalesce(nullif(target_language, ''), prompt_language)")


@query(
    "M23_synthesis_requests",
    with_ctes(_S, _REQUEST_SQL.format(a="t", b="p", default=", 'Here is a sample of the desired voice.'", language=_REQUEST_NAME, flag="p = ''")),
)
def m23(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.synthesis_requests(*_request_samples(spark, sf_dir))


@query(
    "M23_synthesis_requests_prompt_first",
    with_ctes(_S, "SELECT * FROM (" + _REQUEST_SQL.format(a="p", b="t", default="", language=_lang_sql(LANGUAGE_CODES, "prompt_language"), flag="false")
              + ") WHERE text IS NOT NULL AND prompt_transcript <> ''"),
)
def m23_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, files = _request_samples(spark, sf_dir)
    return m.synthesis_requests(
        rows, files, text_policy="prompt_first", default_text=None, transcript_policy="drop", language_source="prompt",
        default_language="en", language_table="codes",
    )


@query(
    "M24_plan_counts",
    with_ctes(_S, """SELECT count(*) AS utterances, count(DISTINCT speaker_id) AS speakers, count_if(doc_id % 10 <> 3)::BIGINT AS available_prompts,
      (SELECT string_agg(speaker_id, ', ' ORDER BY speaker_id) FROM (SELECT DISTINCT speaker_id FROM samples ORDER BY 1 LIMIT 8)) AS speaker_preview
    FROM samples"""),
)
def m24(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.plan_counts(*_request_samples(spark, sf_dir))


@query(
    "M26_relative_output_path",
    """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN source || '/utt' || doc_id ELSE 'audios/' || source || '/utt.' || doc_id END || '.wav' AS output
    FROM documents""",
)
def m26(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.col("doc_id").cast("string")
    inside = F.concat(F.lit("/data/set/audios/"), "source", F.lit("/utt."), doc, F.lit(".flac"))
    outside = F.concat(F.lit("/other/utt"), doc, F.lit(".mp3"))
    rows = fx.table(spark, sf_dir, "documents").select(
        "doc_id", "source", F.when(F.col("doc_id") % 3 == 0, outside).otherwise(inside).alias("path")
    )
    return rows.select("doc_id", m.relative_output_path("path", "source", "/data/set").alias("output"))
