"""Queries for the sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from timbre.functions.expr import basename
from timbre.operators.summary import generation_summary
from timbre.plans import fixtures as fx
from timbre.plans.fixtures import with_ctes
from timbre.plans.registry import query
from timbre.schema import FILELIST_FIELDS, GENERATION_METRICS, FIDELITY_METRICS, MANIFEST_COLUMNS, ddl_fields
from timbre.session import cut_lineage, scratch_path
from timbre.sources.audio import audio_inventory, audio_only_records, encode_pcm16, ingest_audio, wav_header
from timbre.sources.filelists import (
    format_filelist,
    numbered_lines,
    pair_lines,
    read_filelist,
    read_raw_filelist,
    write_filelist,
)
from timbre.sources.listing import list_files, write_files
from timbre.sources.manifests import (
    build_manifests,
    load_dataset,
    read_legacy_manifests,
    read_manifest,
    read_manifest_json,
    read_manifests_json,
    read_registry,
    write_manifest,
)
from timbre.sources.recordings import recording_facts
from timbre.sources.results import (
    read_run_summaries,
    read_sample_metrics,
    read_synthesis_timings,
    write_jsonl,
    write_run_summary,
    write_sample_metrics,
)

_M = ["legacy", "manifest"]
_CANONICAL = ", ".join(MANIFEST_COLUMNS)
_LEGACY_FIELDS = [
    "ori_pth", "ori_spk", "ori_lang", "ori_text", "ori_phonemes", "ori_tone", "ori_word2ph",
    "gt_pth", "gt_spk", "gt_lang", "gt_text", "gt_phonemes", "gt_tone", "gt_word2ph", "split",
]
_FILE_ROWS = 64


@query(
    "S1_read_manifest",
    with_ctes(
        _M,
        f"SELECT {', '.join(c for c in MANIFEST_COLUMNS if c not in ('prompt_tone', 'target_word2ph'))}, "
        "'' AS prompt_tone, '' AS target_word2ph, n_chars FROM manifest",
    ),
)
def s1(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_path(spark, "manifest")
    fx.manifest(spark, sf_dir).drop("prompt_tone", "target_word2ph", "doc_id").write.parquet(f"{root}/metadata.parquet")
    return read_manifest(spark, root)


def _json_files(spark: SparkSession, sf_dir: str, folder: str = "filelists") -> str:
    """One JSON array file per (source, block of rows), written by tasks; every second record is
    followed by items that are not objects. Some names begin with an underscore or a dot, some are
    combined files. Returns the root."""
    records = fx.legacy(spark, sf_dir)
    source = F.regexp_replace("source_manifest", r"\.json$", "")
    prefix = F.when(source == "src17", "_").when(source == "src18", ".").when(source == "src19", "ALL_speakers_").otherwise("")
    block = F.floor(F.col("source_row") / _FILE_ROWS).cast("string")
    number = F.col("doc_id").cast("string")
    fields = F.to_json(F.struct(*_LEGACY_FIELDS, "n_chars"), {"ignoreNullFields": "false"})
    odd = F.concat(  # values whose text depends on their JSON type
        F.lit(',"flag":'), (F.col("doc_id") % 2 == 0).cast("string"), F.lit(',"whole":'), number, F.lit('.0,"mixed":['), number,
        F.lit(',null,true],"large":1e7,"small":1e-4,"speaker_id":'), F.when(F.col("doc_id") % 3 == 0, "0").otherwise("null"), F.lit("}"),
    )
    items = records.select(
        F.concat(F.lit(f"{folder}/"), prefix, source, F.lit("_"), block, F.lit(".json")).alias("path"),
        "source_row",
        F.concat(F.regexp_replace(fields, r"\}$", ""), odd, F.when(F.col("source_row") % 2 == 0, ',"note",3').otherwise("")).alias("item"),
    )
    files = items.groupBy("path").agg(
        F.concat(
            F.lit("["),
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("source_row", "item"))), lambda r: r["item"]), ","),
            F.lit("]"),
        ).alias("content")
    )
    root = scratch_path(spark, "legacy")
    write_files(files, root)
    return root


_FILE_MANIFEST = with_ctes(
    _M,
    f"""SELECT {', '.join(c for c in MANIFEST_COLUMNS if c not in ('source_manifest', 'source_row', 'pair_id'))},
      CASE speaker_id WHEN 'src17' THEN '_' ELSE '' END || replace(source_manifest, '.json', '') || '_' || (source_row // {_FILE_ROWS}) || '.json' AS source_manifest,
      source_row % {_FILE_ROWS} AS source_row,
      'docs-' || speaker_id || '-' || lpad((source_row % {_FILE_ROWS})::VARCHAR, 6, '0') AS pair_id,
      n_chars::VARCHAR AS n_chars, CASE WHEN doc_id % 2 = 0 THEN 'True' ELSE 'False' END AS flag, doc_id || '.0' AS whole,
      doc_id || ' None True' AS mixed, '10000000.0' AS large, '0.0001' AS small
    FROM manifest WHERE speaker_id NOT IN ('src18', 'src19')""",
)
_EXTRAS = ["n_chars", "flag", "whole", "mixed", "large", "small"]


@query("S2_read_manifest_json", with_ctes(
    _M,
    f"""SELECT {', '.join(c for c in MANIFEST_COLUMNS if c not in ('source_manifest', 'source_row', 'pair_id'))},
      CASE speaker_id WHEN 'src17' THEN '_' WHEN 'src18' THEN '.' WHEN 'src19' THEN 'ALL_speakers_' ELSE '' END
        || replace(source_manifest, '.json', '') || '_' || (source_row // {_FILE_ROWS}) || '.json' AS source_manifest,
      source_row % {_FILE_ROWS} AS source_row,
      'docs-' || speaker_id || '-' || lpad((source_row % {_FILE_ROWS})::VARCHAR, 6, '0') AS pair_id,
      n_chars::VARCHAR AS n_chars, CASE WHEN doc_id % 2 = 0 THEN 'True' ELSE 'False' END AS flag, doc_id || '.0' AS whole,
      doc_id || ' None True' AS mixed, '10000000.0' AS large, '0.0001' AS small
    FROM manifest""",
))
def s2(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a manifest of a bounded block of rows each, whatever its name
    folder = f"{_json_files(spark, sf_dir)}/filelists"
    return read_manifests_json(spark, list_files(spark, folder, recursive=False).select("path"), folder, fx.DATASET, _EXTRAS)


@query("S3_read_legacy_manifests", _FILE_MANIFEST)
def s3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_legacy_manifests(spark, _json_files(spark, sf_dir), fx.DATASET, extras=_EXTRAS)


@query("S3_load_dataset_legacy", f"SELECT * FROM ({_FILE_MANIFEST}) WHERE source_manifest = 'src4_0.json'")
def s3_speaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_dataset(spark, _json_files(spark, sf_dir), fx.DATASET, speaker="src4_0", extras=_EXTRAS)


@query("S1_load_dataset_canonical", with_ctes(_M, f"SELECT {_CANONICAL}, n_chars FROM manifest WHERE speaker_id = 'src4'"))
def s1_speaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_path(spark, "manifest")
    fx.manifest(spark, sf_dir).drop("doc_id").write.parquet(f"{root}/metadata.parquet")
    return load_dataset(spark, root, fx.DATASET, speaker="src4")


_LINE_FIELDS = """
  SELECT doc_id, 'audios/' || source || '/utt' || doc_id || '.wav' AS audio_path, source AS speaker,
    upper(lang) AS language, translate(text, chr(10) || chr(13) || '|', '   ') AS norm_text,
    lang || ' ' || source AS phones, n_chars::VARCHAR AS tones, doc_id || ' 1' AS word2ph
  FROM documents
"""


def _line_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("doc_id").cast("string")
    return fx.table(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat(F.lit("audios/"), "source", F.lit("/utt"), number, F.lit(".wav")).alias("audio_path"),
        F.col("source").alias("speaker"),
        F.upper("lang").alias("language"),
        F.translate("text", "\n\r|", "   ").alias("norm_text"),
        F.concat("lang", F.lit(" "), "source").alias("phones"),
        F.col("n_chars").cast("string").alias("tones"),
        F.concat(number, F.lit(" 1")).alias("word2ph"),
    )


@query("S4_read_filelist", f"SELECT {', '.join(FILELIST_FIELDS)} FROM ({_LINE_FIELDS}) WHERE doc_id % 13 <> 0")
def s4(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _line_fields(spark, sf_dir)
    # a line with an extra field is malformed and must not come back
    value = F.concat(format_filelist(), F.when(F.col("doc_id") % 13 == 0, "|extra").otherwise(""))
    path = scratch_path(spark, "filelist")
    lines.select(value.alias("value")).write.text(path)
    return read_filelist(spark, path, mode="lenient")


@query("S5_read_raw_filelist", f"SELECT audio_path AS utt, speaker AS spk, language AS unused, rtrim(norm_text, ' ') AS text FROM ({_LINE_FIELDS})")
def s5(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "raw")
    write_filelist(_line_fields(spark, sf_dir), path, ["audio_path", "speaker", "language", "norm_text"])
    return read_raw_filelist(spark, path)


@query("S6_read_eval_list", f"SELECT audio_path AS gt_path, norm_text AS gt_text, 'syn/' || doc_id || '.wav' AS syn_path, norm_text AS syn_text FROM ({_LINE_FIELDS})")
def s6(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "evallist")
    synthesized = F.concat(F.lit("syn/"), F.col("doc_id").cast("string"), F.lit(".wav"))
    _line_fields(spark, sf_dir).select(
        F.explode(
            F.array(F.concat_ws("|", "audio_path", "norm_text"), F.concat_ws("|", synthesized, "norm_text"))
        ).alias("value")
    ).write.text(path)
    return pair_lines(numbered_lines(spark, path), ["file"]).drop("file", "pair")


_WAV_SQL = "CASE doc_id % 3 WHEN 0 THEN '_' ELSE '' END || 'utt.' || doc_id || CASE doc_id % 5 WHEN 0 THEN '.WAV' ELSE '.wav' END"
_FOLDER_SQL = "CASE source WHEN 'src2' THEN '_anna_' ELSE source END"


def _audio_tree(spark: SparkSession, sf_dir: str) -> str:
    """A file for each document, in folders and under names some of which begin with an underscore."""
    doc, source = F.col("doc_id"), F.col("source")
    name = F.concat(F.when(doc % 3 == 0, "_").otherwise(""), F.lit("utt."), doc.cast("string"), F.when(doc % 5 == 0, ".WAV").otherwise(".wav"))
    folder = F.when(source == "src2", "_anna_").otherwise(source)
    files = fx.table(spark, sf_dir, "documents").select(F.concat(F.lit("audios/"), folder, F.lit("/"), name).alias("path"), F.col("n_chars").cast("string").alias("content"))
    root = scratch_path(spark, "tree")
    write_files(files, root)
    return root


@query(
    "S7_audio_inventory",
    f"""SELECT {_WAV_SQL} AS name, regexp_replace({_WAV_SQL}, '[.][^.]+$', '') AS stem, {_FOLDER_SQL} AS parent,
      length(n_chars::VARCHAR) AS bytes, 'audios/' || {_FOLDER_SQL} || '/' || {_WAV_SQL} AS relative_path FROM documents WHERE doc_id % 5 <> 0""",
)
def s7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio_inventory(spark, _audio_tree(spark, sf_dir)).drop("path")


@query(
    "S7_audio_only_records",
    f"""SELECT source_row, speaker_id, prompt_file_name, target_file_name, prompt_text, 'tree-' || speaker_id || '-' || lpad(source_row::VARCHAR, 6, '0') AS pair_id
    FROM (SELECT row_number() OVER (ORDER BY 'audios', {_FOLDER_SQL}, {_WAV_SQL}) - 1 AS source_row, {_FOLDER_SQL} AS speaker_id,
      'audios/' || {_FOLDER_SQL} || '/' || {_WAV_SQL} AS prompt_file_name, 'audios/' || {_FOLDER_SQL} || '/' || {_WAV_SQL} AS target_file_name,
      '' AS prompt_text FROM documents)""",
)
def s7_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio_only_records(spark, _audio_tree(spark, sf_dir), "tree").select(
        "source_row", "speaker_id", "prompt_file_name", "target_file_name", "prompt_text", "pair_id"
    )


_PCM = "list_transform(embedding, lambda x: round(least(greatest(x::DOUBLE, -1.0::DOUBLE), 1.0::DOUBLE) * 32767) / 32768)"


@query(
    "S8_ingest_audio",
    f"""SELECT '_v' || vec_id || '.wav' AS name, '_v' || vec_id AS stem, label::VARCHAR AS parent,
      (44 + 2 * len(embedding))::BIGINT AS bytes, 16000 AS rate, 1 AS channels, len(embedding)::BIGINT AS frames,
      len(embedding)::BIGINT AS header_frames, len(embedding) / 16000.0::DOUBLE AS duration_sec,
      round(list_sum({_PCM}), 6) AS total, round(list_max({_PCM}), 6) AS peak
    FROM embeddings""",
)
def s8(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = fx.table(spark, sf_dir, "embeddings")
    path = F.concat(F.lit("clips/"), F.col("label").cast("string"), F.lit("/_v"), F.col("vec_id").cast("string"), F.lit(".wav"))
    files = cut_lineage(vectors.select(path.alias("path"), encode_pcm16("embedding", 16_000).alias("content")))
    root = scratch_path(spark, "clips")
    write_files(files, root)
    headers = files.select(basename("path").alias("name"), wav_header("content")["frames"].alias("header_frames"))
    samples = F.transform("samples", lambda x: x.cast("double"))
    return ingest_audio(spark, root).join(headers, "name").select(
        "name", "stem", "parent", "bytes", "rate", "channels", "frames", "header_frames", "duration_sec",
        F.round(F.aggregate(samples, F.lit(0.0), lambda a, x: a + x), 6).alias("total"),
        F.round(F.array_max(samples), 6).alias("peak"),
    )


_TAKE = 64


@query(
    "S8_recordings_in_ranges",
    f"""SELECT 'take' || block || '.wav' AS name, (44 + 2 * frames)::BIGINT AS bytes, 16000 AS rate, 1 AS channels, frames,
      frames / 16000.0::DOUBLE AS duration_sec, round(total, 6) AS total, round(energy, 6) AS energy, round(peak, 6) AS peak
    FROM (SELECT vec_id // {_TAKE} AS block, sum(len(pcm))::BIGINT AS frames, sum(list_sum(pcm)) AS total, max(list_max(pcm)) AS peak,
      sum(list_sum(list_transform(pcm, lambda x: x * x))) AS energy FROM (SELECT vec_id, {_PCM} AS pcm FROM embeddings) GROUP BY 1)""",
)
def s8_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a recording of a bounded block of rows each, read in ranges that end inside it
    block = F.floor(F.col("vec_id") / _TAKE)
    takes = fx.table(spark, sf_dir, "embeddings").groupBy(block.alias("block")).agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("rows"))
    path = F.concat(F.lit("takes/take"), F.col("block").cast("string"), F.lit(".wav"))
    wave = takes.select(path.alias("path"), F.flatten(F.col("rows.embedding")).alias("wave"))
    root = scratch_path(spark, "takes")
    write_files(wave.select("path", encode_pcm16("wave", 16_000).alias("content")), root)
    facts = recording_facts(spark, root, range_frames=1_000)
    sums = [F.round(c, 6).alias(c) for c in ("total", "energy", "peak")]
    return facts.select(basename("path").alias("name"), "bytes", "rate", "channels", "frames", "duration_sec", *sums)


@query(
    "S9_read_synthesis_timings",
    """SELECT 'out/' || user_id || '.wav' AS generated_path, arg_max(value, event_id) AS synthesis_time_sec
    FROM events WHERE event_id % 7 <> 0 AND event_id % 11 <> 0 AND user_id % 31 <> 0 GROUP BY user_id""",
)
def s9(spark: SparkSession, sf_dir: str) -> DataFrame:
    # rows without a path, without a time or with an unreadable time must be skipped by the reader
    event, user = F.col("event_id"), F.col("user_id")
    rows = fx.table(spark, sf_dir, "events").select(
        F.when(user % 31 == 0, "").otherwise(F.concat(F.lit("out/"), user.cast("string"), F.lit(".wav"))).alias("generated_path"),
        F.when(event % 7 == 0, "").when(event % 11 == 0, "n/a").otherwise(F.col("value").cast("string")).alias("synthesis_time_sec"),
        "event_id",
    )
    path = scratch_path(spark, "timings")
    rows.repartitionByRange("event_id").sortWithinPartitions("event_id").drop("event_id").write.option("header", True).csv(path)
    return read_synthesis_timings(spark, path)


_GEN = [n for n, _ in ddl_fields(GENERATION_METRICS)]
_FID = [n for n, _ in ddl_fields(FIDELITY_METRICS)]


@query(
    "S10_read_sample_metrics",
    with_ctes(["metrics"], f"SELECT 'demo_run' AS run_name, '20240101-120000' AS run_ts, {', '.join(_GEN)} FROM metrics"),
)
def s10(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch_path(spark, 'results')}/demo_run/20240101-120000"
    write_sample_metrics(fx.metrics(spark, sf_dir), path)
    return read_sample_metrics(spark, path)


_SUMMARY_COLUMNS = "model, evaluated_pairs, avg_wer, wer_pairs, avg_sim, sim_pairs, avg_sva, total_audio_duration_sec"
_SUMMARY_SQL = """SELECT model, count(*) AS evaluated_pairs, round(avg(wer), 6) AS avg_wer, count(wer) AS wer_pairs,
  round(avg(sim), 6) AS avg_sim, count(sim) AS sim_pairs, round(avg(sva::INT), 6) AS avg_sva,
  round(sum(generated_duration_sec), 6) AS total_audio_duration_sec FROM metrics GROUP BY model"""


def _run_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = generation_summary(fx.metrics(spark, sf_dir), ["model"])
    rounded = [F.round(c, 6).alias(c) if c.startswith(("avg", "total")) else F.col(c) for c in _SUMMARY_COLUMNS.split(", ")]
    return summary.select(
        F.lit("nightly").alias("run_name"),
        F.struct("model").alias("config"),
        F.struct(*rounded).alias("generation_evaluation"),
    )


@query("S11_read_run_summaries", with_ctes(["metrics"], f"SELECT 'nightly' AS run_name, '20240101-120000' AS run_ts, * FROM ({_SUMMARY_SQL})"))
def s11(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch_path(spark, 'summaries')}/other/20240101-120000"
    write_run_summary(_run_summaries(spark, sf_dir), path)
    return read_run_summaries(spark, path, multi_line=False).select("run_name", "run_ts", "generation_evaluation.*")


@query("S12_write_manifest", with_ctes(_M, f"SELECT {_CANONICAL}, n_chars, true AS written, false AS written_again FROM manifest"))
def s12(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_path(spark, "canonical")
    df = fx.manifest(spark, sf_dir).drop("doc_id")
    first, _ = write_manifest(df, root)
    second, _ = write_manifest(df.limit(0), root)
    return read_manifest(spark, root).withColumns({"written": F.lit(first), "written_again": F.lit(second)})


@query("S13_write_sample_metrics", with_ctes(["metrics"], f"SELECT NULL::VARCHAR AS run_name, NULL::VARCHAR AS run_ts, {', '.join(_FID)} FROM metrics"))
def s13(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "fidelity")
    write_sample_metrics(fx.metrics(spark, sf_dir), path, kind="fidelity")
    return read_sample_metrics(spark, path, kind="fidelity")


@query(
    "S14_write_run_summary",
    with_ctes(["metrics"], "SELECT model, count(*) AS num_pairs, avg(snr_db) AS avg_snr_db, NULL::DOUBLE AS avg_absent FROM metrics GROUP BY model"),
)
def s14(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = fx.metrics(spark, sf_dir).groupBy("model").agg(
        F.struct(F.count(F.lit(1)).alias("num_pairs"), F.avg("snr_db").alias("avg_snr_db"), F.lit(None).cast("double").alias("avg_absent")).alias("fidelity_evaluation")
    )
    path = scratch_path(spark, "summary")
    write_run_summary(nested, path)
    schema = "model STRING, fidelity_evaluation STRUCT<num_pairs: BIGINT, avg_snr_db: DOUBLE, avg_absent: DOUBLE>"
    return read_run_summaries(spark, path, schema, multi_line=False).select("model", "fidelity_evaluation.*")


@query("S15_write_jsonl", "SELECT source AS model, doc_id AS key, text, 'user' AS role, source || '/' || doc_id AS audio FROM documents")
def s15(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fx.table(spark, sf_dir, "documents")
    rows = docs.select(
        F.col("source").alias("model"),
        F.col("doc_id").alias("key"),
        F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content"))).alias("messages"),
        F.array(F.concat_ws("/", "source", F.col("doc_id").cast("string"))).alias("audios"),
    )
    path = scratch_path(spark, "jsonl")
    write_jsonl(rows, path)
    schema = "key BIGINT, messages ARRAY<STRUCT<role: STRING, content: STRING>>, audios ARRAY<STRING>, model STRING"
    message = F.element_at("messages", 1)
    return spark.read.schema(schema).json(path).select(
        "model", "key", message["content"].alias("text"), message["role"].alias("role"), F.element_at("audios", 1).alias("audio")
    )


@query("S16_write_filelist", f"SELECT concat_ws('|', {', '.join(FILELIST_FIELDS)}) AS line FROM ({_LINE_FIELDS})")
def s16(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "filelist")
    write_filelist(_line_fields(spark, sf_dir), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query(
    "S17_build_manifests",
    f"SELECT * EXCLUDE (source_manifest), 'docs' AS built FROM ({_FILE_MANIFEST})",
)
def s17(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _json_files(spark, sf_dir)
    registry = [
        {"key": "docs", "name": fx.DATASET, "root_path": root},
        {"key": "absent", "name": "absent", "root_path": f"{root}/absent"},
    ]
    build_manifests(spark, registry, only=["DOCS", "absent"], extras=_EXTRAS)
    return read_manifest(spark, root).drop("source_manifest").withColumn("built", F.lit("docs"))


@query("S17_build_from_configs", f"SELECT * EXCLUDE (source_manifest), '[corpus.yaml] wrote' AS status FROM ({_FILE_MANIFEST})")
def s17_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _json_files(spark, sf_dir, "data/corpus/filelists")
    texts = {
        "corpus.yaml": f"name: {fx.DATASET}\nroot_path: data/corpus\n",
        "absent.yaml": "path: data/absent\n",
        "unasked.yaml": "name: unasked\nroot_path: data/corpus\n",
    }
    configs = [F.struct(F.lit(f"configs/dataset/{n}").alias("path"), F.lit(t).alias("content")) for n, t in texts.items()]
    write_files(spark.range(1).select(F.inline(F.array(*configs))), root)
    lines = build_manifests(spark, read_registry(spark, f"{root}/configs/dataset"), only=["CORPUS", "absent"], extras=_EXTRAS)
    built = next((line for line in lines if " wrote " in line), "")
    status = " ".join(built.split(" ")[:2])
    return read_manifest(spark, f"{root}/data/corpus").drop("source_manifest").withColumn("status", F.lit(status))
