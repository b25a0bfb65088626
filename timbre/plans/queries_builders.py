"""Queries for derived datasets, waveform columns, batching and the scorer hooks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from timbre.operators import batching as bt, builders as bd, scoring as sc, signal as sg
from timbre.operators.manifest import synthesis_requests
from timbre.plans import fixtures as fx
from timbre.plans.fixtures import with_ctes
from timbre.plans.queries_matching import _across, _references
from timbre.plans.registry import query

_HASH = "('0x' || md5({x}::VARCHAR)[1:8])::UBIGINT"
_SUM = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda a, x: a + x), 6)


# Fakes: an order is a generated file of its customer's speaker folder; reals: the customers' lines.
_FAKES = "SELECT model, run, 'p' || (100 + o_custkey % 900) || status AS folder, 'gen/' || model || '/' || run || '/' || o_orderkey || '.wav' AS path FROM runs"
_REALS = "SELECT 'p' || (100 + l_suppkey % 900) AS speaker, 'real/' || l_suppkey % 900 || '/' || lpad(l_orderkey::VARCHAR, 9, '0') || '_' || l_linenumber || '_' || l_partkey || '.wav' AS path FROM lineitem"


@query(
    "D1_deepfake_set",
    with_ctes(["runs"], f""", f AS ({_FAKES}), last AS (SELECT model, max(run) AS run FROM f WHERE regexp_full_match(run, '[0-9]{{8}}-[0-9]{{6}}') GROUP BY model),
      fakes AS (SELECT f.model, f.folder[1:4] AS speaker, f.path FROM f JOIN last USING (model, run)),
      reals AS (SELECT speaker, path FROM (SELECT *, row_number() OVER (PARTITION BY speaker ORDER BY path) AS n FROM ({_REALS})) WHERE n <= 30)
      SELECT model, string_split(path, '/')[-1] AS key, 'FakeDetection' AS task, path AS audio, 'user' AS role, '<audio> Determine if this speech is real or a deepfake.' AS content, 'fake' AS labels, speaker FROM fakes
      UNION ALL SELECT s.model, string_split(path, '/')[-1], 'FakeDetection', path, 'user', '<audio> Determine if this speech is real or a deepfake.', 'real', speaker
      FROM reals JOIN (SELECT DISTINCT model, speaker FROM fakes) s USING (speaker)""").replace("\n, f AS", ", f AS"),
)
def d1(spark: SparkSession, sf_dir: str) -> DataFrame:
    order, text = F.col("o_orderkey").cast("string"), lambda c: c.cast("string")
    runs = fx.runs(spark, sf_dir)
    fakes = runs.select(
        "model", "run",
        F.concat(F.lit("p"), text(100 + F.col("o_custkey") % 900), "status").alias("folder"),
        F.concat_ws("/", F.lit("gen"), "model", "run", F.concat(order, F.lit(".wav"))).alias("path"),
    )
    supplier = F.col("l_suppkey") % 900
    line = F.concat_ws("_", F.lpad(text(F.col("l_orderkey")), 9, "0"), text(F.col("l_linenumber")), text(F.col("l_partkey")))
    reals = fx.table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("p"), text(100 + supplier)).alias("speaker"),
        F.concat_ws("/", F.lit("real"), text(supplier), F.concat(line, F.lit(".wav"))).alias("path"),
    )
    message = F.element_at("messages", 1)
    return bd.deepfake_set(fakes, reals).select(
        "model", "key", "task", F.element_at("audios", 1).alias("audio"), message["role"].alias("role"),
        message["content"].alias("content"), "labels", "speaker",
    )


@query(
    "D2_longest_per_speaker",
    "SELECT source, doc_id, gt_len, rank, text FROM (SELECT source, doc_id, text, length(text) AS gt_len, row_number() OVER (PARTITION BY source ORDER BY length(text) DESC, doc_id) AS rank FROM documents) WHERE rank <= 10",
)
def d2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fx.table(spark, sf_dir, "documents")
    return bd.longest_per_speaker(docs, "source", "text", "doc_id").join(docs.select("doc_id", "text"), "doc_id")


@query(
    "D3_compression_set",
    """WITH u AS (SELECT doc_id, source FROM documents),
      refs AS (SELECT doc_id, source, CASE doc_id % 4 WHEN 0 THEN 'vault/' || source || '/utt' || doc_id || '.wav' ELSE 'ref/' || source || '/utt' || doc_id || '.flac' END AS src FROM u WHERE doc_id % 4 <> 3),
      gens AS (SELECT doc_id, source, m.model, m.model || '/' || source || '/' || CASE m.i WHEN 0 THEN 'utt' || doc_id || '_cloned.wav' WHEN 1 THEN 'ref_to_utt' || doc_id || '_cloned.wav'
          WHEN 2 THEN 'a_to_b_to_utt' || doc_id || '_cloned.mp3' ELSE 'utt' || doc_id || '_cloned.v2.flac' END AS src
        FROM u, (SELECT unnest(range(0, 4)) AS i, 'm' || unnest(range(0, 4)) AS model) m WHERE (doc_id + m.i) % 6 <> 0)
    SELECT 'reference' AS kind, 'reference' AS model, doc_id AS utterance, src, 'out/compression/reference/' || source || '/' || string_split(src, '/')[-1] AS dst FROM refs
    UNION ALL SELECT 'generated', model, doc_id, src, 'out/compression/' || model || '/' || source || '/' || string_split(src, '/')[-1] FROM gens""",
)
def d3(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.col("doc_id").cast("string")
    listed = fx.table(spark, sf_dir, "documents").select(
        F.col("source").alias("speaker_id"),
        F.concat(F.lit("vault/"), "source", F.lit("/utt"), doc, F.lit(".wav")).alias("ground_truth_path"),
        F.concat(F.lit("gen/"), "source", F.lit("/utt"), doc, F.lit("_cloned.wav")).alias("generated_path"),
    )
    chosen = bd.compression_manifest(listed)
    keyed = chosen.withColumn("utterance", F.regexp_extract("gt_stem", r"utt(\d+)", 1).cast("bigint"))
    return bd.compression_set(keyed, _across(spark, sf_dir), _references(spark, sf_dir), "out")


@query(
    "D4_noise_mixtures",
    """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS x, list_sum(list_transform(embedding::DOUBLE[], lambda v: v * v)) AS p FROM embeddings),
      g AS (SELECT c.vec_id, i.vec_id AS interferer, s AS snr_db, c.x, i.x AS y, sqrt(c.p / (i.p * pow(10.0::DOUBLE, s / 10))) AS gain
        FROM e c JOIN e i ON i.vec_id IN (3, 7), (SELECT unnest([-5.0::DOUBLE, 0.0, 5.0, 10.0]) AS s))
    SELECT vec_id, interferer, snr_db, round(list_sum(list_transform(list_zip(x, y), lambda z: z[1] + gain * z[2])), 6) AS total FROM g""",
)
def d4(spark: SparkSession, sf_dir: str) -> DataFrame:
    clips = fx.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    mixed = sg.noise_mixtures(clips, clips, [3, 7], bd.MIXTURE_SNR_DB, "vec_id", "embedding", salt=4)
    return mixed.select("vec_id", F.col("interferer").cast("bigint").alias("interferer"), "snr_db", _SUM("mixture").alias("total"))


@query(
    "D5_noisy_clean_pairs",
    """WITH n AS (SELECT 's' || user_id % 40 AS speaker, event_id // 7 AS utterance, event_type AS environment, 'noisy/' || event_id || '.wav' AS path FROM events),
      c AS (SELECT 's' || user_id % 40 AS speaker, event_id // 7 + CASE WHEN event_id % 10 = 0 THEN 1000000000 ELSE 0 END AS utterance, min('clean/' || lpad(event_id::VARCHAR, 9, '0') || '.wav') AS clean_path FROM events WHERE event_id % 2 = 0 GROUP BY ALL)
    SELECT * FROM (SELECT speaker, environment, utterance, path AS noisy_path, clean_path, row_number() OVER (PARTITION BY speaker ORDER BY utterance, environment, path) AS rank FROM n JOIN c USING (speaker, utterance)) WHERE rank <= 20
    UNION ALL SELECT * FROM (SELECT speaker, NULL, utterance, NULL, clean_path, row_number() OVER (PARTITION BY speaker ORDER BY utterance) AS rank FROM c ANTI JOIN n USING (speaker, utterance)) WHERE rank <= 10""",
)
def d5(spark: SparkSession, sf_dir: str) -> DataFrame:
    event = F.col("event_id")
    base = fx.table(spark, sf_dir, "events").select(
        F.concat(F.lit("s"), (F.col("user_id") % 40).cast("string")).alias("speaker"),
        F.floor(event / 7).cast("bigint").alias("utterance"),
        "event_type", "event_id",
    )
    noisy = base.select("speaker", "utterance", F.col("event_type").alias("environment"), F.concat(F.lit("noisy/"), event.cast("string"), F.lit(".wav")).alias("path"))
    apart = F.when(event % 10 == 0, 1_000_000_000).otherwise(0)  # utterances without a noisy take
    clean = base.filter(event % 2 == 0).select("speaker", (F.col("utterance") + apart).alias("utterance"), F.concat(F.lit("clean/"), F.lpad(event.cast("string"), 9, "0"), F.lit(".wav")).alias("path"))
    return bd.noisy_clean_pairs(noisy, clean)


@query(
    "D6_cross_emotion_pairs",
    """WITH e AS (SELECT user_id AS speaker, event_type AS emotion, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) - 1 AS k, count(*) OVER (PARTITION BY user_id, event_type) AS n FROM events),
      ring AS (SELECT speaker, emotion, n, row_number() OVER (PARTITION BY speaker ORDER BY emotion) - 1 AS i, count(*) OVER (PARTITION BY speaker) AS m FROM (SELECT DISTINCT speaker, emotion, n FROM e)),
      step AS (SELECT a.speaker, a.emotion, b.emotion AS next, b.n AS next_n FROM ring a JOIN ring b ON a.speaker = b.speaker AND b.i = (a.i + 1) % a.m WHERE a.m > 1)
    SELECT e.speaker, e.event_id AS prompt_key, t.event_id AS target_key, e.emotion AS prompt_emotion, t.emotion AS target_emotion
    FROM e JOIN step s ON s.speaker = e.speaker AND s.emotion = e.emotion JOIN e t ON t.speaker = e.speaker AND t.emotion = s.next AND t.k = e.k % s.next_n""",
)
def d6(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = fx.table(spark, sf_dir, "events").select(F.col("user_id").alias("speaker"), F.col("event_type").alias("emotion"), "event_id")
    return bd.cross_emotion_pairs(events, "speaker", "emotion", "event_id")


@query(
    "D7_bilingual_pairs",
    """WITH o AS (SELECT o_orderpriority AS speaker, o_custkey AS sentence, o_orderstatus AS lang, min(o_orderkey) AS k FROM orders GROUP BY ALL)
    SELECT * FROM (SELECT a.speaker, a.sentence, a.lang AS prompt_language, b.lang AS target_language, a.k AS prompt_key, b.k AS target_key,
      row_number() OVER (PARTITION BY a.speaker, a.lang, b.lang ORDER BY a.sentence) AS rank FROM o a JOIN o b ON a.speaker = b.speaker AND a.sentence = b.sentence
      WHERE (a.lang = 'F' AND b.lang = 'O') OR (a.lang = 'O' AND b.lang = 'F')) WHERE rank <= 25""",
)
def d7(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("speaker"), F.col("o_custkey").alias("sentence"), F.col("o_orderstatus").alias("lang"), "o_orderkey"
    )
    return bd.bilingual_pairs(rows, "speaker", "sentence", "lang", "o_orderkey", [("F", "O"), ("O", "F")])


@query(
    "D8_balanced_speakers",
    f"WITH speakers AS ({fx.CTES['speakers']}) SELECT region, segment, speaker, rank FROM (SELECT *, row_number() OVER (PARTITION BY region, segment ORDER BY {_HASH.format(x='speaker')}, speaker) AS rank FROM speakers WHERE speaker NOT IN (0, 1, 2)) WHERE rank <= 4",
)
def d8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bd.balanced_speakers(fx.speakers(spark, sf_dir), ["region", "segment"], "speaker", 4, exclude=[0, 1, 2])


@query(
    "D8_quotas",
    f"WITH speakers AS ({fx.CTES['speakers']}) SELECT region, segment, speaker, rank FROM (SELECT *, row_number() OVER (PARTITION BY region, segment ORDER BY {_HASH.format(x='speaker')}, speaker) AS rank FROM speakers) WHERE rank <= 4 + length(region) % 3",
)
def d8_quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    speakers = fx.speakers(spark, sf_dir)
    quotas = speakers.select("region", "segment").distinct().withColumn("quota", 4 + F.length("region") % 3)
    return bd.balanced_speakers(speakers, ["region", "segment"], "speaker", quotas)


@query(
    "D8_pairs_of_speakers",
    f"""WITH speakers AS ({fx.CTES['speakers']}), chosen AS (SELECT speaker FROM (SELECT *, row_number() OVER (PARTITION BY region, segment ORDER BY {_HASH.format(x='speaker')}, speaker) AS rank FROM speakers) WHERE rank <= 4)
    SELECT * FROM (SELECT o_custkey AS speaker, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rank FROM orders WHERE o_custkey IN (SELECT speaker FROM chosen)) WHERE rank <= 50""",
)
def d8_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = bd.balanced_speakers(fx.speakers(spark, sf_dir), ["region", "segment"], "speaker", 4)
    pairs = fx.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("speaker"), "o_orderkey")
    return bd.pairs_of_speakers(pairs, chosen, "speaker", "o_orderkey")


@query(
    "D9_disjoint_split",
    f"SELECT o_orderkey, o_custkey AS speaker, CASE WHEN {_HASH.format(x='o_custkey')} < 1288490188 THEN 'dev' ELSE 'test' END AS split FROM orders",
)
def d9(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("speaker"))
    return bd.disjoint_split(rows, "speaker", 0.3)


@query(
    "D9_split_overlap",
    f"""WITH s AS (SELECT DISTINCT o_custkey AS speaker, CASE WHEN o_orderkey % 97 = 0 THEN 'test' WHEN {_HASH.format(x='o_custkey')} < 2147483648 THEN 'dev' ELSE 'test' END AS split FROM orders)
    SELECT speaker FROM s WHERE split = 'dev' INTERSECT SELECT speaker FROM s WHERE split = 'test'""",
)
def d9_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    # some rows were moved by hand, which the report must find
    rows = fx.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("speaker"))
    moved = bd.disjoint_split(rows, "speaker").withColumn("split", F.when(F.col("o_orderkey") % 97 == 0, "test").otherwise(F.col("split")))
    return bd.split_overlap(moved, "speaker")


_L1 = "list_sum(list_transform(list_zip(s.x, c.x), lambda z: abs(z[1] - z[2])))"


@query(
    "D10_farthest_target",
    f"""WITH e AS (SELECT vec_id AS speaker, 'full' AS encoder, embedding::DOUBLE[] AS x, label FROM embeddings UNION ALL SELECT vec_id, 'half', embedding[1:32]::DOUBLE[], label FROM embeddings),
      gaps AS (SELECT s.speaker, s.encoder, c.speaker AS target, {_L1} AS gap FROM e s JOIN e c ON s.encoder = c.encoder AND c.label = 3 WHERE s.label <> 3),
      shares AS (SELECT speaker, target, sum(gap / mean) AS difference FROM (SELECT *, avg(gap) OVER (PARTITION BY speaker, encoder) AS mean FROM gaps) GROUP BY ALL)
    SELECT speaker, first(target ORDER BY difference DESC, target) AS target, round(max(difference), 6) AS difference FROM shares GROUP BY speaker""",
)
def d10(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = fx.table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("speaker"), "label", F.col("embedding").cast("array<double>").alias("embedding")
    )
    encoders = F.array(
        F.struct(F.lit("full").alias("encoder"), F.col("embedding").alias("embedding")),
        F.struct(F.lit("half").alias("encoder"), F.slice("embedding", 1, 32).alias("embedding")),
    )
    long = vectors.select("speaker", "label", F.inline(encoders))
    # speakers of one label are the candidates, all others look for their farthest one
    far = bd.farthest_target(long.filter("label <> 3").drop("label"), long.filter("label = 3").drop("label"), block_size=16)
    return far.withColumn("difference", F.round("difference", 6))


# --- waveform columns -------------------------------------------------------------------------------
_NOISE = f"""
  WITH words AS (SELECT vec_id, embedding, ('0x' || substr(md5('3|' || vec_id), 1, 8))::BIGINT AS k1, ('0x' || substr(md5('3|' || vec_id), 9, 8))::BIGINT AS k2 FROM embeddings),
  places AS (SELECT vec_id, k1, k2, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM words),
  a0 AS (SELECT *, (i // 2 + k1) % 4294967296 AS a, (i // 2 + k2) % 4294967296 AS b FROM places),
  {{rounds}}
  uniform AS (SELECT vec_id, i, x, (a + 1) / 4294967296.0::DOUBLE AS u, 2 * pi() * (b / 4294967296.0::DOUBLE) AS angle FROM {{last}}),
  noisy AS (SELECT vec_id, x, least(greatest(x + sqrt(-2 * ln(u)) * CASE WHEN i % 2 = 1 THEN sin(angle) ELSE cos(angle) END * {sg.DEFAULT_EPSILON!r}::DOUBLE, -1), 1)::FLOAT::DOUBLE AS y FROM uniform)
  SELECT vec_id, round(sum(y - x), 4) AS added, round(sum(y * y), 4) AS energy FROM noisy GROUP BY vec_id
"""


def _noise_sql() -> str:
    first, one = fx.mix_sql("n1", "a0", "a", "xor({}, k2)")
    second, two = fx.mix_sql("n2", one, "b", "xor({}, k1)")
    third, three = fx.mix_sql("n3", two, "a", "{}")
    fourth, last = fx.mix_sql("n4", three, "b", "{}")
    return _NOISE.format(rounds="\n  ".join((first, second, third, fourth)), last=last)


@query("B1_add_gaussian", _noise_sql())
def b1(spark: SparkSession, sf_dir: str) -> DataFrame:
    clips = fx.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    noisy = sg.add_gaussian(clips, "vec_id", "embedding", seed=3).withColumnRenamed("embedding", "noisy")
    total = lambda array: F.round(F.aggregate(array, F.lit(0.0), lambda a, x: a + x), 4)
    gap = F.zip_with("noisy", "embedding", lambda n, c: n.cast("double") - c.cast("double"))
    energy = F.transform("noisy", lambda n: n.cast("double") * n.cast("double"))
    return noisy.join(clips, "vec_id").select("vec_id", total(gap).alias("added"), total(energy).alias("energy"))


@query(
    "B2_apply_noise",
    with_ctes(["waves"], """SELECT clip, round(list_sum(p), 6) AS protected, round(list_sum(list_transform(list_zip(p, orig), lambda z: z[1] - z[2])), 6) AS effective
      FROM (SELECT clip, orig, list_transform(list_zip(orig, noise), lambda z: least(greatest(z[1] + least(greatest(z[2], -0.1), 0.1), -1), 1)) AS p FROM waves)"""),
)
def b2(spark: SparkSession, sf_dir: str) -> DataFrame:
    applied = fx.waves(spark, sf_dir).select("clip", sg.apply_noise("orig", "noise", 0.1).alias("n"))
    return applied.select("clip", _SUM(F.col("n.protected")).alias("protected"), _SUM(F.col("n.effective")).alias("effective"))


@query(
    "B3_dry_wet_blend",
    with_ctes(["waves"], """SELECT clip, len(orig) AS frames, round(list_sum(list_transform(range(1, len(orig) + 1), lambda i: least(greatest(coalesce(proc[i], 0) * 0.7::DOUBLE + orig[i] * 0.3::DOUBLE, -1), 1))), 6) AS total FROM waves"""),
)
def b3(spark: SparkSession, sf_dir: str) -> DataFrame:
    blended = fx.waves(spark, sf_dir).select("clip", sg.dry_wet_blend("proc", "orig", 0.3).alias("b"))
    return blended.select("clip", F.size("b").cast("bigint").alias("frames"), _SUM("b").alias("total"))


@query(
    "B4_padded_batches",
    """WITH p AS (SELECT source, doc_id, list_filter(string_split(text, ' '), lambda w: true) AS w, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 4 AS batch FROM documents)
    SELECT source, batch, doc_id, row_number() OVER (PARTITION BY source, batch ORDER BY len(w) DESC, doc_id) - 1 AS slot, len(w) AS tokens_len, max(len(w)) OVER (PARTITION BY source, batch) AS padded,
      list_sum(list_transform(w, lambda x: length(x)))::BIGINT AS total FROM p""",
)
def b4(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = F.transform(F.split("text", " ", -1), lambda w: F.char_length(w))
    docs = fx.table(spark, sf_dir, "documents").select("doc_id", "source", lengths.alias("tokens"))
    batches = bt.padded_batches(docs.withColumn("spec_len", F.size("tokens")), "source", "doc_id", "spec_len", ["tokens"], 4)
    return batches.select(
        "source", "batch", "doc_id", F.col("slot").cast("bigint").alias("slot"), F.col("tokens_len").cast("bigint").alias("tokens_len"),
        F.size("tokens").cast("bigint").alias("padded"), F.aggregate("tokens", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"),
    )


_BOUNDS = [0, 1, 500, 1000, 2000, 5000]


@query(
    "B5_length_buckets",
    """WITH b AS (SELECT doc_id, n_chars, CASE WHEN n_chars > 0 AND n_chars <= 1 THEN 0 WHEN n_chars > 1 AND n_chars <= 500 THEN 1 WHEN n_chars > 500 AND n_chars <= 1000 THEN 2 WHEN n_chars > 1000 AND n_chars <= 2000 THEN 3 WHEN n_chars > 2000 AND n_chars <= 5000 THEN 4 END AS raw_bucket FROM documents)
    SELECT doc_id, raw_bucket, (dense_rank() OVER (ORDER BY raw_bucket) - 1)::INTEGER AS bucket FROM b WHERE raw_bucket IS NOT NULL""",
)
def b5(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = fx.table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return bt.length_buckets(lengths, "n_chars", _BOUNDS).select("doc_id", "raw_bucket", "bucket")


@query(
    "B6_replica_batches",
    f"""WITH h AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {_HASH.format(x="('5|' || doc_id)")}, doc_id) - 1 AS p, count(*) OVER (PARTITION BY lang) AS n FROM documents),
      r AS (SELECT doc_id, lang, p + unnest(range(0, (CAST(ceil(n / 12.0) AS BIGINT) * 12 - 1 - p) // n + 1)) * n AS p FROM h),
      q AS (SELECT doc_id, lang, p // 3 AS q FROM r WHERE p % 3 = 1)
    SELECT doc_id, lang, q // 4 AS batch, q % 4 AS slot, {_HASH.format(x="('5|batch|' || lang || '|' || (q // 4))")}::BIGINT AS batch_order FROM q""",
)
def b6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fx.table(spark, sf_dir, "documents").select("doc_id", "lang")
    return bt.replica_batches(docs, "doc_id", "lang", batch_size=4, replicas=3, rank=1, epoch=5)


# --- scorer hooks -----------------------------------------------------------------------------------
def _length_scorer():
    def score(batch: pd.DataFrame) -> pd.Series:
        return batch["text"].str.len() / 100.0

    return score


def _fragile_scorer():
    def score(batch: pd.DataFrame) -> pd.Series:
        if (batch["doc_id"] % 10 == 0).any():
            raise ValueError("cannot score")
        return batch["doc_id"] * 2.0

    return score


def _broken_loader():
    raise RuntimeError("model is not installed")


_SCORERS = {"length": (_length_scorer, "double"), "fragile": (_fragile_scorer, "double"), "absent": (_broken_loader, "double")}


@query("U1_score_pairs", "SELECT doc_id, round(length(text) / 100.0::DOUBLE, 6) AS length, CASE WHEN doc_id % 10 = 0 THEN NULL ELSE doc_id * 2.0::DOUBLE END AS fragile, NULL::DOUBLE AS absent FROM documents")
def u1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fx.table(spark, sf_dir, "documents").select("doc_id", "text")
    return sc.score_pairs(docs, _SCORERS).select("doc_id", F.round("length", 6).alias("length"), "fragile", "absent")


def _word_scorer():
    def score(batch: pd.DataFrame) -> pd.Series:
        return batch["event_type"].str.len().astype("float64") + batch["user_id"]

    return score


@query("U2_score_distinct", "SELECT event_id, event_type, length(event_type) + user_id::DOUBLE AS score FROM events")
def u2(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = fx.table(spark, sf_dir, "events").select("event_id", "event_type", "user_id")
    scored = sc.score_distinct(events, ["event_type", "user_id"], {"score": (_word_scorer, "double")})
    return scored.select("event_id", "event_type", "score")


def _tone_generator():
    def generate(request: dict) -> tuple[np.ndarray, int]:
        if request["index"] % 10 == 0:
            raise RuntimeError("no voice")
        return np.array([len(request["text"]), np.nan, -3.0, 0.5]), 16_000

    return generate


@query(
    "U3_synthesize",
    with_ctes(["legacy", "manifest", "samples"], """SELECT "index" % 10 = 0 AS failed, count(*) AS requests, sum(CASE WHEN "index" % 10 = 0 THEN NULL ELSE 4 END)::BIGINT AS frames,
      round(sum(CASE WHEN "index" % 10 = 0 THEN NULL ELSE 0.5::DOUBLE END), 6) AS total, count(CASE WHEN "index" % 10 <> 0 THEN 1 END) AS timed FROM samples GROUP BY 1"""),
)
def u3(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = sc.synthesize(synthesis_requests(fx.samples(spark, sf_dir)), _tone_generator)
    samples = F.transform("samples", lambda x: x.cast("double"))
    return made.groupBy(F.col("error").isNotNull().alias("failed")).agg(
        F.count(F.lit(1)).alias("requests"),
        F.sum(F.size("samples")).cast("bigint").alias("frames"),
        F.round(F.sum(F.aggregate(samples, F.lit(0.0), lambda a, x: a + x)), 6).alias("total"),
        F.count("synthesis_time_sec").alias("timed"),
    )


def _batch_generator():
    def generate(batch: pd.DataFrame) -> list[tuple[np.ndarray, int]]:
        if (batch["index"] % 100 == 0).any():
            raise RuntimeError("no voice")
        return [(np.append(np.full(int(i) % 7, 0.25), np.nan), 8_000) for i in batch["index"]]

    return generate


@query(
    "U3_synthesize_batches",
    with_ctes(["legacy", "manifest", "samples"], """SELECT 'generated_audio/' || speaker_id || '/utt' || doc_id || CASE WHEN target_path = prompt_path THEN '_to_utt' || doc_id
        ELSE '_to_utt' || (doc_id + 1) END || '_cloned.wav' AS output_path,
      CASE WHEN "index" % 100 <> 0 THEN "index" % 7 + 1 END::BIGINT AS frames, CASE WHEN "index" % 100 <> 0 THEN ("index" % 7) * 0.25::DOUBLE END AS total,
      CASE WHEN "index" % 100 <> 0 THEN 8000 END AS rate, CASE WHEN "index" % 100 = 0 THEN 'no voice' END AS error, "index" % 100 <> 0 AS timed FROM samples"""),
)
def u3_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a request that fails takes no other one of its batch along
    made = sc.synthesize_batches(synthesis_requests(fx.samples(spark, sf_dir)), _batch_generator)
    samples = F.transform("samples", lambda x: x.cast("double"))
    return made.select(
        "output_path", F.size("samples").cast("bigint").alias("frames"), F.aggregate(samples, F.lit(0.0), lambda a, x: a + x).alias("total"),
        "rate", "error", F.col("synthesis_time_sec").isNotNull().alias("timed"),
    )
