"""Queries for the per-pair metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from timbre.functions import metrics as k
from timbre.functions.text import norm_en_delete, norm_en_space, words
from timbre.plans import fixtures as fx
from timbre.plans.fixtures import with_ctes
from timbre.plans.registry import ORACLES, query
from timbre.schema import FIDELITY_METRICS, GENERATION_METRICS, ddl_fields

_PUNCT = "!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~"
# DuckDB's levenshtein counts bytes. Words only one side has can share a mark, the words of both
# sides get one byte each; a turn pair has far fewer than 120 words in common.
_WORDS = f"list_filter(string_split(trim(regexp_replace(lower(translate({{x}}, '{_PUNCT}', '')), '\\s\\s+', ' ', 'g'), chr(10) || ' '), ' '), lambda w: w <> '')"
_CODES = "array_to_string(list_transform({t}, lambda w: CASE WHEN list_contains(c, w) THEN chr((list_position(c, w) + 2)::INT) ELSE chr({mark}) END), '')"


def _wer_sql(source: str, keys: str) -> str:
    return f"""SELECT {keys}, r, h, CASE WHEN len(r) > 0 THEN levenshtein({_CODES.format(t='r', mark=1)}, {_CODES.format(t='h', mark=2)})::DOUBLE / len(r) END AS w
      FROM (SELECT *, list_distinct(list_intersect(r, h)) AS c FROM (SELECT *, {_WORDS.replace('{x}', 'ref')} AS r, {_WORDS.replace('{x}', 'hyp')} AS h FROM {source}))"""


def turn_wer(df: DataFrame) -> DataFrame:
    return df.withColumns({"_r": words(norm_en_delete("ref")), "wer": k.generation_wer("ref", "hyp")})


@query(
    "K1_wer",
    with_ctes(["turns"], f"SELECT conv_id, turn, len(r) AS ref_words, round(w, 6) AS wer FROM ({_wer_sql('turns', 'conv_id, turn')})"),
)
def k1(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = turn_wer(fx.turns(spark, sf_dir))
    return scored.select("conv_id", "turn", F.size("_r").cast("bigint").alias("ref_words"), F.round("wer", 6).alias("wer"))


# a copy that lost tokens is as far away as the number of tokens lost
@query(
    "K1_wer_copies",
    """SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 29 = 0 OR (conv_id + turn) % 13 = 0 THEN NULL ELSE round((len(w) // 7)::DOUBLE / len(w), 6) END AS wer
    FROM (SELECT *, list_filter(string_split_regex(text, '[ \\n]+'), lambda t: t <> '') AS w FROM conversations)""",
)
def k1_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = lambda c: F.filter(F.split(c, "[ \n]+", -1), lambda t: t != "")
    pairs = fx.copies(spark, sf_dir)
    return pairs.select("conv_id", "turn", F.round(k.wer(split("ref"), split("hyp")), 6).alias("wer"))


# every character of the table gets one byte, so that bytes and characters are the same
_ALPHABET = """alphabet AS (SELECT string_agg(c, '' ORDER BY c) AS chars, string_agg(chr(n::INT), '' ORDER BY c) AS codes
  FROM (SELECT c, row_number() OVER (ORDER BY c) AS n FROM (SELECT DISTINCT unnest(string_split(text, '')) AS c FROM conversations)))"""


@query(
    "K2_cer",
    with_ctes(["copies"], f"""SELECT conv_id, turn, CASE WHEN ref = '' THEN NULL ELSE
        round(levenshtein(translate(ref, chars, codes), translate(coalesce(hyp, ''), chars, codes))::DOUBLE / length(ref), 6) END AS cer FROM copies, alphabet""").replace(
        "\nSELECT conv_id, turn, CASE WHEN ref = '' THEN NULL ELSE\n", f",\n{_ALPHABET}\nSELECT conv_id, turn, CASE WHEN ref = '' THEN NULL ELSE\n"
    ),
)
def k2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.copies(spark, sf_dir).select("conv_id", "turn", F.round(k.cer("ref", "hyp"), 6).alias("cer"))


_ALIGNED = "(SELECT *, list_slice(orig, 1, len(proc)) AS o, proc AS p FROM waves)"
_POWER = "list_sum(list_transform({x}, lambda v: v * v))"
_GAP = "list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


def _aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return k.align_pair(fx.waves(spark, sf_dir), "orig", "proc")


@query(
    "K3_snr_db",
    with_ctes(["waves"], f"""SELECT clip, CASE WHEN {_GAP.format(a='o', b='p')} = 0 THEN 'inf'::DOUBLE
      ELSE round(10 * log10({_POWER.format(x='o')} / {_GAP.format(a='o', b='p')}), 6) END AS snr_db FROM {_ALIGNED}"""),
)
def k3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _aligned(spark, sf_dir).select("clip", F.round(k.snr_db("orig", "proc"), 6).alias("snr_db"))


@query("K3_snr_db_clips", ORACLES["K3_snr_db"])
def k3_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _aligned(spark, sf_dir).select("clip", F.round(k.snr_db_clips("orig", "proc"), 6).alias("snr_db"))


@query(
    "K4_align_pair",
    with_ctes(["waves"], f"SELECT clip, len(o) AS frames, len(p) AS processed_frames, round(list_sum(o), 6) AS total FROM {_ALIGNED} WHERE len(p) > 0 AND clip % 20 <> 0"),
)
def k4(spark: SparkSession, sf_dir: str) -> DataFrame:
    # empty processed clips have no overlap and must disappear
    waves = fx.waves(spark, sf_dir)
    emptied = waves.withColumn("proc", F.when(F.col("clip") % 20 == 0, F.array().cast("array<double>")).otherwise(F.col("proc")))
    return k.align_pair(emptied, "orig", "proc").select(
        "clip", F.size("orig").cast("bigint").alias("frames"), F.size("proc").cast("bigint").alias("processed_frames"),
        F.round(F.aggregate("orig", F.lit(0.0), lambda a, x: a + x), 6).alias("total"),
    )


@query(
    "K4_mix_down",
    with_ctes(["waves"], f"""SELECT clip, len(p) AS frames, round((list_sum(o) + list_sum(p)) / 2, 6) AS total,
      round(list_max(list_transform(list_zip(o, p), lambda z: (z[1] + z[2]) / 2)), 6) AS peak FROM {_ALIGNED} WHERE len(p) > 0"""),
)
def k4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    # both versions of a clip as the channels of one
    mono = _aligned(spark, sf_dir).select("clip", k.mix_down(F.array("orig", "proc")).alias("mono"))
    return mono.select(
        "clip", F.size("mono").cast("bigint").alias("frames"),
        F.round(F.aggregate("mono", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.round(F.array_max("mono"), 6).alias("peak"),
    )


@query("K5_pad_min_length", with_ctes(["waves"], "SELECT clip, 64::BIGINT AS frames, round(list_sum(proc), 6) AS total, 0.0::DOUBLE + CASE WHEN clip % 9 = 0 AND clip % 50 <> 0 THEN 0.0::DOUBLE ELSE round(proc[64], 6) END AS last FROM waves"))
def k5(spark: SparkSession, sf_dir: str) -> DataFrame:
    padded = fx.waves(spark, sf_dir).select("clip", k.pad_min_length("proc", 64).alias("p"))
    return padded.select(
        "clip", F.size("p").cast("bigint").alias("frames"),
        F.round(F.aggregate("p", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.round(F.element_at("p", 64), 6).alias("last"),
    )


@query(
    "K6_relative_noise_energy",
    with_ctes(["waves"], f"SELECT clip, round(({_GAP.format(a='o', b='p')} / len(o)) / ({_POWER.format(x='o')} / len(o) + 1e-8), 8) AS energy FROM {_ALIGNED}"),
)
def k6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _aligned(spark, sf_dir).select("clip", F.round(k.relative_noise_energy("orig", "proc"), 8).alias("energy"))


_DOT = "list_sum(list_transform(list_zip(orig, noise), lambda z: z[1] * z[2]))"


@query(
    "K7_cosine_sim",
    with_ctes(["waves"], f"SELECT clip, round({_DOT} / (sqrt({_POWER.format(x='orig')}) * sqrt({_POWER.format(x='noise')})), 6) AS sim FROM waves"),
)
def k7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.waves(spark, sf_dir).select("clip", F.round(k.cosine_sim("orig", "noise"), 6).alias("sim"))


_TOKENS = ["yes", " No ", "TRUE", "0", "maybe", "Same", "mismatch", "1", "n", "y"]


@query(
    "K8_verify_decision",
    f"""SELECT doc_id, CASE WHEN lower(trim(t)) IN ('y','yes','true','same','positive','match','1') THEN true
        WHEN lower(trim(t)) IN ('n','no','false','different','negative','mismatch','0') THEN false END AS decision, quality <> 0 AS numeric_decision, accepted
      FROM (SELECT doc_id, quality, {_TOKENS!r}[1 + (doc_id + quality) % 10] AS t, doc_id / 1000.0::DOUBLE >= 0.25 AS accepted FROM labels)""",
)
def k8(spark: SparkSession, sf_dir: str) -> DataFrame:
    token = F.element_at(F.array(*[F.lit(t) for t in _TOKENS]), ((F.col("doc_id") + F.col("quality")) % 10 + 1).cast("int"))
    return fx.table(spark, sf_dir, "labels").select(
        "doc_id",
        k.verify_decision(token).alias("decision"),
        k.verify_decision("quality", "int").alias("numeric_decision"),
        k.accept_at(F.col("doc_id") / 1000.0, 0.25).alias("accepted"),
    )


@query(
    "K9_emotion_match",
    with_ctes(["waves"], "SELECT clip, CASE WHEN clip % 11 = 0 THEN NULL ELSE label = next_label END AS emotion_match FROM waves"),
)
def k9(spark: SparkSession, sf_dir: str) -> DataFrame:
    reference = F.when(F.col("clip") % 11 != 0, F.col("label"))
    return fx.waves(spark, sf_dir).select("clip", k.emotion_match(reference, "next_label").alias("emotion_match"))


@query(
    "K10_duration_sec",
    "SELECT o_orderkey, CASE WHEN o_custkey % 5 = 0 OR o_orderkey % 7 = 0 THEN NULL ELSE round(o_custkey::DOUBLE / ((o_orderkey % 7) * 8000), 10) END AS duration FROM orders",
)
def k10(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = F.when(F.col("o_custkey") % 5 == 0, 0).otherwise(F.col("o_custkey"))
    rate = (F.col("o_orderkey") % 7) * 8000
    return fx.table(spark, sf_dir, "orders").select("o_orderkey", F.round(k.duration_sec(frames, rate), 10).alias("duration"))


@query(
    "K11_cap_duration",
    with_ctes(["waves"], "SELECT clip, CASE WHEN clip % 3 = 0 THEN 25 ELSE len(proc) END AS frames, CASE WHEN clip % 3 = 0 THEN 25 ELSE len(proc) END AS frame_count, round(list_sum(CASE WHEN clip % 3 = 0 THEN list_slice(proc, 1, 25) ELSE proc END), 6) AS total FROM waves"),
)
def k11(spark: SparkSession, sf_dir: str) -> DataFrame:
    cap = F.when(F.col("clip") % 3 == 0, 2.55).when(F.col("clip") % 3 == 1, -1.0)
    waves = fx.waves(spark, sf_dir).withColumn("n", F.size("proc").cast("bigint"))
    capped = waves.select("clip", k.cap_duration("proc", F.lit(10), cap).alias("c"), k.capped_frames("n", F.lit(10), cap).alias("frame_count"))
    return capped.select(
        "clip", F.size("c").cast("bigint").alias("frames"), "frame_count",
        F.round(F.aggregate("c", F.lit(0.0), lambda a, x: a + x), 6).alias("total"),
    )


# 4 samples per second: a window has 36 samples, and every clip is long or gets doubled
_SEGMENTS = """
  SELECT clip, segment, segment * 4 AS start, CAST(floor((segment + 9.01::DOUBLE) * 4) AS INTEGER) AS stop, audio
  FROM (SELECT clip, audio, unnest(range(0, greatest(CAST(trunc(len(audio) // 4 - 9.01::DOUBLE) AS INTEGER) + 1, 1))) AS segment
    FROM (SELECT clip, CASE WHEN clip % 4 = 0 THEN list_concat(list_concat(x, x), list_concat(x, x)) ELSE x END AS audio
      FROM (SELECT clip, CASE WHEN clip % 4 = 0 THEN list_slice(orig, 1, 10) ELSE orig END AS x FROM waves)))
"""


@query(
    "K12_dnsmos_segments",
    with_ctes(["waves"], f"SELECT clip, segment, start, stop, round(list_sum(list_slice(audio, start + 1, stop)), 6) AS total FROM ({_SEGMENTS}) WHERE least(stop, len(audio)) - start >= 36"),
)
def k12(spark: SparkSession, sf_dir: str) -> DataFrame:
    short = F.when(F.col("clip") % 4 == 0, F.slice("orig", 1, 10)).otherwise(F.col("orig"))
    segments = k.dnsmos_segments(fx.waves(spark, sf_dir).select("clip", short.alias("x")), "clip", "x", rate=4)
    return segments.select(
        "clip", F.col("segment").cast("bigint").alias("segment"), F.col("start").cast("bigint").alias("start"), "stop",
        F.round(F.aggregate("window", F.lit(0.0), lambda a, x: a + x), 6).alias("total"),
    )


def _poly(x: str, c: list[float]) -> str:
    out = f"{c[0]!r}::DOUBLE"
    for v in c[1:]:
        out = f"(({out}) * {x} + ({v!r}::DOUBLE))"
    return out


_RAW = "(SELECT l_orderkey AS clip, 1 + 4 * sqrt(l_discount + 0.03) AS sig, 1 + 4 * sqrt(l_tax + 0.03) AS bak, sqrt(l_quantity + 2.5) / 2 AS ovr, ln(l_extendedprice) AS p808 FROM lineitem)"


def _calibrated(personalized: bool) -> str:
    curves = k.DNSMOS_POLYNOMIALS[personalized]
    names = {"ovr": "ovrl", "sig": "sig", "bak": "bak"}
    scores = ", ".join(f"round(avg({_poly(c, curves[c])}), 6) AS {n}" for c, n in names.items())
    raw = ", ".join(f"round(avg({c}), 6) AS {n}_raw" for c, n in names.items())
    return f"SELECT clip, {scores}, {raw}, round(avg(p808), 6) AS p808_mos FROM {_RAW} GROUP BY clip"


def _calibrate(spark: SparkSession, sf_dir: str, personalized: bool) -> DataFrame:
    raw = fx.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("clip"),
        (1 + 4 * F.sqrt(F.col("l_discount") + 0.03)).alias("sig"),
        (1 + 4 * F.sqrt(F.col("l_tax") + 0.03)).alias("bak"),
        (F.sqrt(F.col("l_quantity") + 2.5) / 2).alias("ovr"),
        F.ln("l_extendedprice").alias("p808"),
    )
    out = k.dnsmos_calibrate(raw, "clip", personalized, p808="p808")
    return out.select("clip", *[F.round(c, 6).alias(c) for c in out.columns if c != "clip"])


@query("K13_dnsmos_calibrate", _calibrated(False))
def k13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _calibrate(spark, sf_dir, False)


@query("K13_dnsmos_calibrate_personalized", _calibrated(True))
def k13_personalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _calibrate(spark, sf_dir, True)


@query(
    "K14_partial_slices",
    """WITH f AS (SELECT doc_id, n_chars AS n, CAST(ceil((n_chars + 1) / 10.0::DOUBLE) AS BIGINT) AS frames FROM documents),
      s AS (SELECT doc_id, n, (greatest(1, frames - 16 + 8 + 1) - 1) // 8 AS last FROM f),
      c AS (SELECT *, CASE WHEN (n - last * 80) / 160.0::DOUBLE < 0.75 AND last > 0 THEN last - 1 ELSE last END AS keep FROM s)
    SELECT doc_id, slice::INTEGER AS slice, slice * 8 AS mel_start, slice * 8 + 16 AS mel_stop, slice * 80 AS wav_start, slice * 80 + 160 AS wav_stop
    FROM (SELECT doc_id, unnest(range(0, keep + 1)) AS slice FROM c)""",
)
def k14(spark: SparkSession, sf_dir: str) -> DataFrame:
    clips = fx.table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return k.partial_slices(clips, "doc_id", "n_chars", frames=16, samples_per_frame=10)


_GEN = ", ".join(n for n, _ in ddl_fields(GENERATION_METRICS))
_FID = ", ".join(n for n, _ in ddl_fields(FIDELITY_METRICS) if n != "stoi")


@query("K15_sample_metric_row", with_ctes(["metrics"], f"SELECT {_GEN} FROM metrics"))
def k15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return k.generation_row(fx.metrics(spark, sf_dir))


@query("K15_sample_metric_row_fidelity", with_ctes(["metrics"], f"SELECT {_FID}, NULL::DOUBLE AS stoi FROM metrics"))
def k15_fidelity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return k.fidelity_row(fx.metrics(spark, sf_dir).drop("stoi"))


@query(
    "K16_normalize_waveform",
    with_ctes(["waves"], """SELECT clip, round(list_max(loud) / 32768, 8) AS always, CASE WHEN list_max(list_transform(loud, lambda v: abs(v))) > 1.5 THEN round(list_max(loud) / 32768, 8) ELSE round(list_max(loud), 8) END AS if_loud
      FROM (SELECT clip, list_transform(orig, lambda v: v * (CASE WHEN clip % 2 = 0 THEN 10000 ELSE 1 END)) AS loud FROM waves)"""),
)
def k16(spark: SparkSession, sf_dir: str) -> DataFrame:
    gain = F.when(F.col("clip") % 2 == 0, 10000.0).otherwise(1.0)
    loud = fx.waves(spark, sf_dir).select("clip", F.transform("orig", lambda x: x * gain).alias("x"))
    peak = lambda a: F.round(F.array_max(a), 8)
    return loud.select("clip", peak(k.normalize_waveform("x")).alias("always"), peak(k.normalize_waveform("x", only_if_loud=True)).alias("if_loud"))


@query(
    "K17_finite_clip",
    with_ctes(["waves"], "SELECT clip, round(list_sum(list_transform(range(1, 65), lambda i: CASE WHEN i = 3 THEN 0 WHEN i = 5 THEN 1 WHEN i = 7 THEN -1 ELSE least(greatest(orig[i] * 5, -1), 1) END)), 6) AS total FROM waves"),
)
def k17(spark: SparkSession, sf_dir: str) -> DataFrame:
    def broken(x: Column, i: Column) -> Column:
        return (
            F.when(i == 2, F.lit(float("nan"))).when(i == 4, F.lit(float("inf"))).when(i == 6, F.lit(float("-inf"))).otherwise(x * 5)
        )

    clipped = k.finite_clip(F.transform("orig", broken))
    return fx.waves(spark, sf_dir).select("clip", F.round(F.aggregate(clipped, F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query(
    "K18_mcd_dist",
    with_ctes(["waves"], f"SELECT label AS pair, round(avg(10.0::DOUBLE / ln(10.0::DOUBLE) * sqrt(2 * {_GAP.format(a='orig', b='noise')})), 6) AS mcd FROM waves GROUP BY label"),
)
def k18(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = fx.waves(spark, sf_dir).withColumnRenamed("label", "pair")
    return k.mcd_dist(frames, ["pair"], "orig", "noise").withColumn("mcd", F.round("mcd", 6))


@query(
    "K1_wer_spaced_norm",
    with_ctes(["turns"], "SELECT conv_id, turn, len(r) AS ref_words, round(w, 6) AS wer FROM (" + _wer_sql("turns", "conv_id, turn").replace(
        _WORDS.replace('{x}', 'ref'), f"list_filter(string_split(trim(regexp_replace(lower(translate(ref, '{_PUNCT}', repeat(' ', 32))), '\\s+', ' ', 'g')), ' '), lambda w: w <> '')").replace(
        _WORDS.replace('{x}', 'hyp'), f"list_filter(string_split(trim(regexp_replace(lower(translate(hyp, '{_PUNCT}', repeat(' ', 32))), '\\s+', ' ', 'g')), ' '), lambda w: w <> '')") + ")"),
)
def k1_spaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.turns(spark, sf_dir).select(
        "conv_id", "turn", F.size(words(norm_en_space("ref"))).cast("bigint").alias("ref_words"),
        F.round(k.fidelity_wer("ref", "hyp"), 6).alias("wer"),
    )
