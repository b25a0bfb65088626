"""Adapters: the shapes the operators expect, derived from the given tables.

Every adapter exists twice, as a DataFrame and as a DuckDB common table expression of the same
name, and covers the whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from timbre.operators.counters import MIX
from timbre.operators.manifest import canonicalize, zero_shot_samples
from timbre.operators.ordering import positions_by_integer, spread, spread_scan

DATASET = "docs"
PROTECTION_CYCLE = ["clean", "ss", "ek", "sp", "gr", "em"]


# tables whose rows are expensive to work on, with the keys that spread them
_HEAVY = {"documents": ["doc_id"], "conversations": ["conv_id", "turn"]}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread_scan(df, *_HEAVY[name]) if name in _HEAVY else df


def with_ctes(names: list[str], body: str) -> str:
    """``WITH`` clause of the named expressions (in order) in front of ``body``."""
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n]})" for n in names) + "\n" + body


def mix_sql(name: str, source: str, column: str, then: str) -> tuple[str, str]:
    """Expressions that scramble a 32-bit ``column`` of ``source`` (see ``counters.mix``), and the name of the last one.

    DuckDB has no 32-bit multiplication that wraps, so products are taken in 128 bits.
    """
    steps = []
    for k, (shift, factor) in enumerate(MIX):
        value = f"((xor({column}, {column} >> {shift})::HUGEINT * {factor}) % 4294967296)::BIGINT"
        steps.append(f"{name}{k} AS (SELECT * REPLACE ({value} AS {column}) FROM {source}),")
        source = f"{name}{k}"
    ended = then.format(f"xor({column}, {column} >> 16)")
    return "\n  ".join([*steps, f"{name} AS (SELECT * REPLACE ({ended} AS {column}) FROM {source}),"]), name


CTES: dict[str, str] = {}

# --- legacy manifest: a document is the prompt, the next document the target ---------------------
CTES["legacy"] = """
  SELECT d.doc_id,
    d.source || '.json' AS source_manifest,
    row_number() OVER (PARTITION BY d.source ORDER BY d.doc_id) - 1 AS source_row,
    'audios/' || d.source || '/utt' || d.doc_id || '.wav' AS ori_pth,
    d.source AS ori_spk,
    upper(d.lang) AS ori_lang,
    d.text AS ori_text,
    d.lang || ' ' || d.source AS ori_phonemes,
    d.n_chars || ' x ' || d.doc_id AS ori_tone,
    d.doc_id || ' ' || d.n_chars AS ori_word2ph,
    'audios/' || n.source || '/utt' || n.doc_id || '.wav' AS gt_pth,
    CASE WHEN d.doc_id % 3 = 0 THEN NULL ELSE n.source END AS gt_spk,
    CASE WHEN d.doc_id % 5 = 0 THEN '' ELSE upper(n.lang) END AS gt_lang,
    n.text AS gt_text,
    n.lang || ' ' || n.source AS gt_phonemes,
    n.n_chars || ' y ' || n.doc_id AS gt_tone,
    n.doc_id || ' ' || n.n_chars AS gt_word2ph,
    CASE WHEN d.doc_id % 7 = 0 THEN NULL ELSE d.lang END AS split,
    d.n_chars
  FROM documents d LEFT JOIN documents n ON n.doc_id = d.doc_id + 1
"""


def legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    places = positions_by_integer(docs.select("doc_id", "source"), "doc_id", ["source"], out="source_row")
    following = docs.select(
        (F.col("doc_id") - 1).alias("doc_id"), *[F.col(c).alias(f"n_{c}") for c in ("source", "lang", "text")],
        F.col("n_chars").alias("n_size"),
    )
    joined = docs.join(places.select("doc_id", "source_row"), "doc_id").join(following, "doc_id", "left")
    number, after = F.col("doc_id").cast("string"), (F.col("doc_id") + 1).cast("string")

    def path(source: str, doc: Column) -> Column:
        return F.concat(F.lit("audios/"), F.col(source), F.lit("/utt"), doc, F.lit(".wav"))

    def spaced(*parts: Column) -> Column:
        out = [parts[0]]
        for part in parts[1:]:
            out += [F.lit(" "), part]
        return F.concat(*out)

    size, next_size = F.col("n_chars").cast("string"), F.col("n_size").cast("string")
    return joined.select(
        "doc_id",
        F.concat("source", F.lit(".json")).alias("source_manifest"),
        "source_row",
        path("source", number).alias("ori_pth"),
        F.col("source").alias("ori_spk"),
        F.upper("lang").alias("ori_lang"),
        F.col("text").alias("ori_text"),
        spaced(F.col("lang"), F.col("source")).alias("ori_phonemes"),
        spaced(size, F.lit("x"), number).alias("ori_tone"),
        spaced(number, size).alias("ori_word2ph"),
        path("n_source", after).alias("gt_pth"),
        F.when(F.col("doc_id") % 3 != 0, F.col("n_source")).alias("gt_spk"),
        F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.upper("n_lang")).alias("gt_lang"),
        F.col("n_text").alias("gt_text"),
        spaced(F.col("n_lang"), F.col("n_source")).alias("gt_phonemes"),
        spaced(next_size, F.lit("y"), after).alias("gt_tone"),
        F.when(F.col("n_size").isNotNull(), spaced(after, next_size)).alias("gt_word2ph"),
        F.when(F.col("doc_id") % 7 != 0, F.col("lang")).alias("split"),
        "n_chars",
    )


CTES["manifest"] = f"""
  SELECT '{DATASET}' AS dataset_name,
    coalesce(nullif(split, ''), 'default') AS split,
    '{DATASET}-' || ori_spk || '-' || CASE WHEN length(source_row::VARCHAR) >= 6 THEN source_row::VARCHAR
      ELSE lpad(source_row::VARCHAR, 6, '0') END AS pair_id,
    ori_spk AS speaker_id,
    ori_pth AS prompt_file_name,
    ori_spk AS prompt_speaker_id,
    ori_lang AS prompt_language,
    ori_text AS prompt_text,
    ori_phonemes AS prompt_phonemes,
    ori_tone AS prompt_tone,
    ori_word2ph AS prompt_word2ph,
    coalesce(nullif(gt_pth, ''), ori_pth) AS target_file_name,
    coalesce(nullif(gt_spk, ''), ori_spk) AS target_speaker_id,
    coalesce(nullif(gt_lang, ''), ori_lang) AS target_language,
    coalesce(gt_text, '') AS target_text,
    coalesce(gt_phonemes, '') AS target_phonemes,
    coalesce(gt_tone, '') AS target_tone,
    coalesce(gt_word2ph, '') AS target_word2ph,
    source_manifest, source_row, doc_id, n_chars
  FROM legacy
"""


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonicalize(legacy(spark, sf_dir), DATASET)


CTES["samples"] = """
  SELECT speaker_id,
    row_number() OVER (ORDER BY source_manifest, source_row) - 1 AS "index",
    prompt_file_name AS prompt_path, prompt_text, prompt_language,
    target_file_name AS target_path,
    coalesce(nullif(target_text, ''), prompt_text) AS target_text,
    target_language, pair_id, source_manifest, source_row, doc_id, n_chars
  FROM manifest
"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zero_shot_samples(manifest(spark, sf_dir))


# --- generated files: one of three names per pair, plus numbered decoys --------------------------
CTES["generated"] = """
  SELECT path, string_split(path, '/')[-1] AS name, string_split(path, '/')[-2] AS parent
  FROM (
    SELECT 'generated/' || n.source || '/' || CASE
        WHEN d.doc_id % 3 = 0 THEN 'utt' || d.doc_id || '_to_utt' || n.doc_id || '_cloned.wav'
        WHEN d.doc_id % 3 = 1 THEN 'utt' || d.doc_id || '_cloned.wav'
        ELSE 'utt' || n.doc_id || '_cloned.wav' END AS path
    FROM documents d JOIN documents n ON n.doc_id = d.doc_id + 1
    WHERE d.source <> 'src3'
    UNION ALL
    SELECT unnest(['generated/' || source || '/utt' || doc_id || '_1.wav',
                   'generated/' || source || '/utt' || doc_id || '_10.wav'])
    FROM documents
  )
"""


def generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    following = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("source").alias("n_source"))
    here = F.concat(F.lit("utt"), F.col("doc_id").cast("string"))
    there = F.concat(F.lit("utt"), (F.col("doc_id") + 1).cast("string"))
    name = (
        F.when(F.col("doc_id") % 3 == 0, F.concat(here, F.lit("_to_"), there))
        .when(F.col("doc_id") % 3 == 1, here)
        .otherwise(there)
    )
    clones = (
        docs.filter(F.col("source") != "src3")
        .join(following, "doc_id")
        .select(F.concat(F.lit("generated/"), "n_source", F.lit("/"), name, F.lit("_cloned.wav")).alias("path"))
    )
    base = F.concat(F.lit("generated/"), F.col("source"), F.lit("/"), here)
    decoys = docs.select(
        F.explode(F.array(F.concat(base, F.lit("_1.wav")), F.concat(base, F.lit("_10.wav")))).alias("path")
    )
    parts = F.split("path", "/")
    return clones.unionByName(decoys).select(
        "path", F.element_at(parts, -1).alias("name"), F.element_at(parts, -2).alias("parent")
    )


# --- turn pairs: a turn is the reference, the next turn of the conversation the hypothesis -------
CTES["turns"] = """
  SELECT a.conv_id, a.turn, a.role AS ref_role, b.role AS hyp_role, a.text AS ref, b.text AS hyp
  FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1
"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    answer = said.select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("role").alias("hyp_role"), F.col("text").alias("hyp")
    )
    asked = said.select("conv_id", "turn", F.col("role").alias("ref_role"), F.col("text").alias("ref"))
    keys = ["conv_id", "turn"]
    return spread(asked, *keys).join(spread(answer, *keys), keys)


# Corrupted copies: every 7th token is lost; some hypotheses are NULL and some references empty.
CTES["copies"] = """
  SELECT conv_id, turn,
    CASE WHEN (conv_id + turn) % 29 = 0 THEN '' ELSE text END AS ref,
    CASE WHEN (conv_id + turn) % 13 = 0 THEN NULL ELSE array_to_string(
      list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda p: p[2] % 7 <> 0), lambda p: p[1]), ' ')
    END AS hyp
  FROM (SELECT *, list_filter(string_split_regex(text, '[ \\n]+'), lambda t: t <> '') AS w FROM conversations)
"""


def copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations")
    tokens = F.filter(F.split("text", "[ \n]+", -1), lambda t: t != "")
    place = F.col("conv_id") + F.col("turn")
    return said.select(
        "conv_id",
        "turn",
        F.when(place % 29 == 0, "").otherwise(F.col("text")).alias("ref"),
        F.when(place % 13 != 0, F.array_join(F.filter(tokens, lambda t, i: (i + 1) % 7 != 0), " ")).alias("hyp"),
    )


# --- per-sample metrics of many runs ------------------------------------------------------------
CTES["metrics"] = """
  SELECT event_id, event_type AS model,
    list_extract(['clean', 'ss', 'ek', 'sp', 'gr', 'em'], 1 + user_id % 6) AS protection,
    'ds' || (user_id % 10) AS dataset,
    user_id::VARCHAR AS speaker_id,
    'gt/' || user_id || '/' || event_id || '.wav' AS ground_truth_path,
    'out/' || user_id || '/' || event_id || '.wav' AS generated_path,
    'out/' || user_id || '/' || event_id || '.wav' AS protected_path,
    'say ' || event_id AS ground_truth_text,
    'said "' || event_id || '", ok' AS predicted_text,
    CASE WHEN event_id % 23 = 0 THEN NULL ELSE sqrt(k + 0.5::DOUBLE) END AS mcd,
    CASE WHEN event_id % 29 = 0 THEN NULL ELSE sqrt((event_id % 13)::DOUBLE) / 4 END AS wer,
    CASE WHEN event_id % 17 = 0 THEN NULL ELSE sqrt(value) / 25 END AS sim,
    1 + sqrt(k::DOUBLE) / 3 AS speechmos_mos,
    1 + sqrt(k::DOUBLE) / 4 AS dnsmos_ovrl,
    1 + sqrt(k + 1.0::DOUBLE) / 4 AS dnsmos_sig,
    1 + sqrt(k + 2.0::DOUBLE) / 5 AS dnsmos_bak,
    CASE WHEN event_id % 19 = 0 THEN NULL ELSE value > 50 END AS sva,
    CASE WHEN event_id % 31 = 0 THEN NULL ELSE 1.0::DOUBLE + event_id % 10 END AS generated_duration_sec,
    value / 100 AS synthesis_time_sec,
    CASE WHEN event_id % 37 = 0 THEN NULL ELSE list_extract(['ang', 'hap', 'neu', 'sad'], 1 + event_id % 4) END AS reference_emotion,
    list_extract(['ang', 'hap', 'neu', 'sad'], 1 + k % 4) AS generated_emotion,
    CASE WHEN event_id % 37 = 0 THEN NULL ELSE event_id % 4 = k % 4 END AS emotion_match,
    CASE WHEN event_id % 101 = 0 THEN 'inf'::DOUBLE ELSE value END AS snr_db,
    sqrt(k::DOUBLE) / 11 AS stoi,
    1.0::DOUBLE + event_id % 10 AS protected_duration_sec
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
"""


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    event, user = F.col("event_id"), F.col("user_id")
    k = F.get_json_object("props", "$.k").cast("int")
    emotions = F.array(*[F.lit(e) for e in ("ang", "hap", "neu", "sad")])

    def unless(divisor: int, value: Column) -> Column:
        return F.when(event % divisor != 0, value)

    def path(root: str) -> Column:
        return F.concat(F.lit(f"{root}/"), user.cast("string"), F.lit("/"), event.cast("string"), F.lit(".wav"))

    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("event_type").alias("model"),
        F.element_at(F.array(*[F.lit(p) for p in PROTECTION_CYCLE]), (user % 6 + 1).cast("int")).alias("protection"),
        F.concat(F.lit("ds"), (user % 10).cast("string")).alias("dataset"),
        user.cast("string").alias("speaker_id"),
        path("gt").alias("ground_truth_path"),
        path("out").alias("generated_path"),
        path("out").alias("protected_path"),
        F.concat(F.lit("say "), event.cast("string")).alias("ground_truth_text"),
        F.concat(F.lit('said "'), event.cast("string"), F.lit('", ok')).alias("predicted_text"),
        unless(23, F.sqrt(k + 0.5)).alias("mcd"),
        unless(29, F.sqrt(event % 13) / 4).alias("wer"),
        unless(17, F.sqrt("value") / 25).alias("sim"),
        (1 + F.sqrt(k) / 3).alias("speechmos_mos"),
        (1 + F.sqrt(k) / 4).alias("dnsmos_ovrl"),
        (1 + F.sqrt(k + 1) / 4).alias("dnsmos_sig"),
        (1 + F.sqrt(k + 2) / 5).alias("dnsmos_bak"),
        unless(19, F.col("value") > 50).alias("sva"),
        unless(31, 1.0 + event % 10).alias("generated_duration_sec"),
        (F.col("value") / 100).alias("synthesis_time_sec"),
        unless(37, F.element_at(emotions, (event % 4 + 1).cast("int"))).alias("reference_emotion"),
        F.element_at(emotions, k % 4 + 1).alias("generated_emotion"),
        unless(37, event % 4 == k % 4).alias("emotion_match"),
        F.when(event % 101 == 0, F.lit(float("inf"))).otherwise(F.col("value")).alias("snr_db"),
        (F.sqrt(k) / 11).alias("stoi"),
        (1.0 + event % 10).alias("protected_duration_sec"),
    )


# --- waveforms: an embedding is a short clip, its successor the noise -----------------------------
CTES["waves"] = """
  SELECT a.vec_id AS clip, a.label, b.label AS next_label,
    a.embedding::DOUBLE[] AS orig,
    b.embedding::DOUBLE[] AS noise,
    CASE WHEN a.vec_id % 50 = 0 THEN a.embedding::DOUBLE[]
      ELSE list_slice(list_transform(list_zip(a.embedding::DOUBLE[], b.embedding::DOUBLE[]),
                      lambda p: p[1] + 0.05::DOUBLE * p[2]),
                      1, CASE WHEN a.vec_id % 9 = 0 THEN len(a.embedding) - 3 ELSE len(a.embedding) END)
    END AS proc
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1
"""


def waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    table_ = table(spark, sf_dir, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))
    following = table_.select(
        (F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("noise"), F.col("label").alias("next_label")
    )
    joined = table_.join(following, "vec_id")
    mixed = F.zip_with("embedding", "noise", lambda x, n: x + 0.05 * n)
    length = F.size("embedding") - F.when(F.col("vec_id") % 9 == 0, 3).otherwise(0)
    return joined.select(
        F.col("vec_id").alias("clip"),
        "label",
        "next_label",
        F.col("embedding").alias("orig"),
        "noise",
        F.when(F.col("vec_id") % 50 == 0, F.col("embedding")).otherwise(F.slice(mixed, 1, length)).alias("proc"),
    )


# --- run folders ----------------------------------------------------------------------------------
CTES["runs"] = """
  SELECT o_orderkey, o_custkey, o_orderpriority AS model, o_orderstatus AS status, o_totalprice AS price,
    CASE WHEN o_orderkey % 19 = 0 THEN 'tmp-' || o_orderkey
      ELSE strftime(o_orderdate, '%Y%m%d-') || lpad((o_orderkey % 86400)::VARCHAR, 6, '0') END AS run
  FROM orders
"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    stamp = F.concat(
        F.date_format("o_orderdate", "yyyyMMdd"), F.lit("-"), F.lpad((key % 86400).cast("string"), 6, "0")
    )
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        "o_custkey",
        F.col("o_orderpriority").alias("model"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").alias("price"),
        F.when(key % 19 == 0, F.concat(F.lit("tmp-"), key.cast("string"))).otherwise(stamp).alias("run"),
    )


# --- speakers with strata ---------------------------------------------------------------------------
CTES["speakers"] = """
  SELECT c.c_custkey AS speaker, r.r_name AS region, c.c_mktsegment AS segment, c.c_acctbal AS balance
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
"""


def speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, nation, region = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    return (
        customer.join(nation, customer.c_nationkey == nation.n_nationkey)
        .join(region, nation.n_regionkey == region.r_regionkey)
        .select(
            F.col("c_custkey").alias("speaker"),
            F.col("r_name").alias("region"),
            F.col("c_mktsegment").alias("segment"),
            F.col("c_acctbal").alias("balance"),
        )
    )
