"""Queries for summaries, bootstrap intervals and reports."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from timbre.functions.expr import unit_hash
from timbre.functions.metrics import cer
from timbre.operators import bootstrap as b, reports as r, summary as s
from timbre.plans import fixtures as fx
from timbre.plans.fixtures import with_ctes
from timbre.plans.queries_metrics import _wer_sql, turn_wer
from timbre.plans.registry import query
from timbre.schema import CLEAN, PROTECTIONS

_MX = ["metrics"]


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    doubles = [f.name for f in df.schema.fields if f.dataType.typeName() == "double"]
    return df.withColumns({c: F.round(c, digits) for c in doubles})


def _means(columns: dict[str, str]) -> str:
    return ", ".join(f"round(avg({c}), 6) AS avg_{c}, count({c}) AS {n}_pairs" for c, n in columns.items())


def _extremes(columns: list[str]) -> str:
    return ", ".join(f"round({f}({c}), 6) AS {f}_{c}" for c in columns for f in ("min", "max"))


@query("A1_metric_means", with_ctes(_MX, f"SELECT model, {_means(s.GENERATION_MEANS)} FROM metrics GROUP BY model"))
def a1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fx.metrics(spark, sf_dir).groupBy("model").agg(*s.metric_means(s.GENERATION_MEANS)))


@query("A2_metric_extremes", with_ctes(_MX, f"SELECT dataset, {_extremes(s.EXTREMES['fidelity'])} FROM metrics GROUP BY dataset"))
def a2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fx.metrics(spark, sf_dir).groupBy("dataset").agg(*s.metric_extremes(s.EXTREMES["fidelity"])))


@query("A3_rate_mean", with_ctes(_MX, "SELECT speaker_id, round(avg(sva::INT), 6) AS avg_sva, round(avg(emotion_match::INT), 6) AS emotion_match_rate FROM metrics GROUP BY speaker_id"))
def a3(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = [s.rate_mean("sva").alias("avg_sva"), s.rate_mean("emotion_match").alias("emotion_match_rate")]
    return rounded(fx.metrics(spark, sf_dir).groupBy("speaker_id").agg(*rates))


_RTF = """CASE WHEN coalesce(sum({d}), 0) > 0 THEN round(sum({d}), 6) ELSE 0.0::DOUBLE END AS total_audio_duration_sec,
  CASE WHEN coalesce(sum({d}), 0) > 0 THEN round({t} / sum({d}), 6) END AS rtf, {t} AS synthesis_time_sec"""


@query(
    "A4_rtf",
    with_ctes(_MX, f"SELECT model, protection, {_RTF.format(d='d', t='round(max(synthesis_time_sec) * 100, 6)')} FROM (SELECT *, CASE WHEN protection <> 'em' THEN generated_duration_sec END AS d FROM metrics) GROUP BY model, protection"),
)
def a4(spark: SparkSession, sf_dir: str) -> DataFrame:
    silent = fx.metrics(spark, sf_dir).withColumn("d", F.when(F.col("protection") != "em", F.col("generated_duration_sec")))
    spent = F.round(F.max("synthesis_time_sec") * 100, 6)
    return rounded(silent.groupBy("model", "protection").agg(*s.rtf(spent, "d")))


@query(
    "A5_fidelity_summary",
    with_ctes(_MX, f"""SELECT protection, count(m) AS num_pairs, count(*) - count(m) AS num_missing,
        CASE WHEN count(m) = 0 THEN '{s.NO_MATCHES}' END AS error, round(avg(CASE WHEN m IS NOT NULL THEN snr_db END), 6) AS avg_snr_db,
        {', '.join(f"round(avg(CASE WHEN m IS NOT NULL THEN {c} END), 6) AS avg_{c}, count(CASE WHEN m IS NOT NULL THEN {c} END) AS {n}_pairs" for c, n in s.FIDELITY_MEANS.items())},
        round(avg(CASE WHEN m IS NOT NULL THEN dnsmos_sig END), 6) AS avg_dnsmos_sig, round(avg(CASE WHEN m IS NOT NULL THEN dnsmos_bak END), 6) AS avg_dnsmos_bak,
        {', '.join(f"round({f}(CASE WHEN m IS NOT NULL THEN {c} END), 6) AS {f}_{c}" for c in s.EXTREMES['fidelity'] for f in ('min', 'max'))}
      FROM (SELECT *, CASE WHEN protection = 'gr' OR event_id % 9 = 0 THEN NULL ELSE protected_path END AS m FROM metrics) GROUP BY protection"""),
)
def a5(spark: SparkSession, sf_dir: str) -> DataFrame:
    missing = (F.col("protection") == "gr") | (F.col("event_id") % 9 == 0)
    rows = fx.metrics(spark, sf_dir).withColumn("m", F.when(~missing, F.col("protected_path")))
    return rounded(s.fidelity_summary(rows, ["protection"], "m"))


_GENERATION = f"""count(*) AS evaluated_pairs, {_means(s.GENERATION_MEANS)}, round(avg(dnsmos_sig), 6) AS avg_dnsmos_sig, round(avg(dnsmos_bak), 6) AS avg_dnsmos_bak,
  {_extremes(s.EXTREMES['generation'])}, round(avg(sva::INT), 6) AS avg_sva, count(sva) AS sva_pairs, round(avg(emotion_match::INT), 6) AS emotion_match_rate,
  count(emotion_match) AS emotion_pairs"""


@query("A6_generation_summary", with_ctes(_MX, f"SELECT model, {_GENERATION}, {_RTF.format(d='generated_duration_sec', t='5000.0::DOUBLE')} FROM metrics GROUP BY model"))
def a6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(s.generation_summary(fx.metrics(spark, sf_dir), ["model"], synthesis_time=5000.0))


@query("A6_generation_summary_overall", with_ctes(_MX, f"SELECT {_GENERATION}, {_RTF.format(d='generated_duration_sec', t='NULL::DOUBLE')} FROM metrics"))
def a6_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(s.generation_summary(fx.metrics(spark, sf_dir), strict=True))


_SEEDED = b.bootstrap_config({"enabled": True, "num_samples": 1000, "confidence_level": 0.95, "seed": 7})


@query(
    "A7_interval_facts",
    with_ctes(_MX, """SELECT model, metric, count(v) AS n, round(avg(v), 6) AS avg, 0.95::DOUBLE AS confidence_level, 1000 AS num_resamples,
      true AS ordered, true AS close_to_normal, true AS spread_fits
    FROM (SELECT model, unnest(['wer', 'sim']) AS metric, unnest([wer, sim]) AS v FROM metrics) WHERE v IS NOT NULL AND NOT isinf(v) AND NOT isnan(v) GROUP BY ALL"""),
)
def a7_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # what SQL can confirm of an interval: its order, and its width against the standard error
    metrics = fx.metrics(spark, sf_dir)
    ci = b.bootstrap_ci(metrics, ["model"], ["wer", "sim"], b.BootstrapConfig(1000, 0.95, 7))
    spread = metrics.groupBy("model").agg(F.struct(F.stddev_samp("wer").alias("wer"), F.stddev_samp("sim").alias("sim")).alias("_s"))
    error = F.when(F.col("metric") == "wer", F.col("_s.wer")).otherwise(F.col("_s.sim")) / F.sqrt("n")
    half = (F.col("upper") - F.col("lower")) / 2
    return ci.join(spread, "model").select(
        "model", "metric", "n", F.round("avg", 6).alias("avg"), "confidence_level", "num_resamples",
        F.col("avg").between(F.col("lower"), F.col("upper")).alias("ordered"),
        half.between(1.96 * error * 0.85, 1.96 * error * 1.15).alias("close_to_normal"),
        F.col("std").between(error * 0.85, error * 1.15).alias("spread_fits"),
    )


@query("A7_bootstrap_ci")
def a7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.bootstrap_ci(fx.metrics(spark, sf_dir), ["model"], ["wer", "sim", "mcd", "snr_db", "speechmos_mos"], _SEEDED)


# the draws as a pure function of (row, resample), so that SQL can repeat them
_FEW = b.BootstrapConfig(num_resamples=40, confidence_level=0.9)


def _uniform(key: Column, resample: Column) -> Column:
    return unit_hash(F.concat_ws("|", key.cast("string"), resample.cast("string"))) / float(1 << 32)


def _weight_sql() -> str:
    terms, cumulative, probability = [], 0.0, math.exp(-1.0)
    for k in range(12):
        cumulative += probability
        terms.append(f"(u >= {cumulative!r}::DOUBLE)::INT")
        probability /= k + 1
    return " + ".join(terms)


_HASHED = f"""
  w AS (SELECT model, resample, value, {_weight_sql()} AS w FROM (
    SELECT model, resample, sim AS value, ('0x' || md5(event_id || '|' || resample)[1:8])::UBIGINT::DOUBLE / 4294967296.0::DOUBLE AS u
    FROM metrics, (SELECT unnest(range(0, 40)) AS resample) WHERE sim IS NOT NULL)),
  means AS (SELECT model, resample, sum(w * value) / sum(w) AS mean FROM w GROUP BY model, resample)
"""


@query(
    "A7_bootstrap_hashed_weights",
    with_ctes(_MX, f"""SELECT model, round(quantile_cont(mean, 0.05), 6) AS lower, round(quantile_cont(mean, 0.95), 6) AS upper, 0.9::DOUBLE AS confidence_level,
      40 AS num_resamples, round(stddev_samp(mean), 6) AS std FROM means GROUP BY model""").replace("\nSELECT model, round(quantile_cont", f",\n{_HASHED}\nSELECT model, round(quantile_cont"),
)
def a7_hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = fx.metrics(spark, sf_dir).select("model", "event_id", F.col("sim").alias("value")).filter("value is not null")
    means = b.hashed_resample_means(values, ["model"], "event_id", _uniform, _FEW)
    return rounded(b.interval(means, ["model"], "mean", _FEW))


_POISSON = b.BootstrapConfig(num_resamples=200, confidence_level=0.95, seed=5)


def _poisson_sql() -> str:
    terms, cumulative, probability = [], 0.0, math.exp(-1.0)
    for k in range(12):
        cumulative += probability
        terms.append(f"(u >= {cumulative!r}::DOUBLE)::INT")
        probability /= k + 1
    first, one = fx.mix_sql("p1", "fanned", "w", "xor({}, t)")
    turn, two = fx.mix_sql("p0", "turns", "t", "{}")
    second, last = fx.mix_sql("p2", one, "w", "{}")
    return f""",
  turns AS (SELECT unnest(range(200)) AS resample, unnest(range(200)) AS t),
  {turn}
  fanned AS (SELECT model, value, metric, resample, t, ('0x' || substr(md5('5|' || event_id), 1, 8))::BIGINT AS w
    FROM (SELECT model, event_id, unnest(['sim', 'wer']) AS metric, unnest([sim, wer]) AS value FROM metrics), {two} WHERE value IS NOT NULL),
  {first}
  {second}
  drawn AS (SELECT model, metric, resample, value, {' + '.join(terms)} AS weight FROM (SELECT *, w / 4294967296.0::DOUBLE AS u FROM {last})),
  means AS (SELECT model, metric, resample, sum(weight * value) / sum(weight) AS mean FROM drawn GROUP BY ALL HAVING sum(weight) > 0)
  SELECT model, metric, round(quantile_cont(mean, 0.025), 6) AS lower, round(quantile_cont(mean, 0.975), 6) AS upper, 0.95::DOUBLE AS confidence_level,
    200 AS num_resamples, round(stddev_samp(mean), 6) AS std FROM means GROUP BY model, metric"""


@query("A7_bootstrap_poisson", with_ctes(_MX, _poisson_sql()).replace("\n,\n  turns", ",\n  turns"))
def a7_poisson(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = fx.metrics(spark, sf_dir).select("model", "event_id", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in ("sim", "wer")])))
    means = b.poisson_resample_means(long, ["model", "metric"], "event_id", _POISSON)
    return rounded(b.interval(means, ["model", "metric"], "mean", _POISSON))


@query("A7_bootstrap_point", with_ctes(_MX, "SELECT model, metric, round(avg(value), 6) AS avg, count(*) AS n FROM (SELECT model, unnest(['wer', 'snr_db']) AS metric, unnest([wer, snr_db]) AS value FROM metrics) WHERE value IS NOT NULL AND isfinite(value) GROUP BY model, metric"))
def a7_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    few = b.BootstrapConfig(num_resamples=10, seed=1)
    return rounded(b.bootstrap_ci(fx.metrics(spark, sf_dir), ["model"], ["wer", "snr_db"], few)).select("model", "metric", "avg", "n")


# settings are read from a table of runs: every status is one configuration
@query(
    "A8_bootstrap_config",
    """SELECT o_orderstatus AS status, count(*) AS orders, CASE o_orderstatus WHEN 'F' THEN 200 WHEN 'O' THEN 300 ELSE 1000 END AS num_resamples,
      CASE o_orderstatus WHEN 'F' THEN 0.9::DOUBLE ELSE 0.95::DOUBLE END AS confidence_level FROM orders GROUP BY o_orderstatus""",
)
def a8(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = {
        "F": {"enabled": True, "num_samples": 200, "num_resamples": 5, "confidence_level": 0.9},
        "O": {"enabled": True, "num_resamples": 300},
        "P": {"enabled": True},
    }
    parsed = {k: b.bootstrap_config(v) for k, v in given.items()}
    status = F.col("o_orderstatus")

    def choose(field: str) -> Column:
        out = F.lit(getattr(parsed["P"], field))
        for k in ("F", "O"):
            out = F.when(status == k, F.lit(getattr(parsed[k], field))).otherwise(out)
        return out

    counted = fx.table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("orders"))
    return counted.select(status.alias("status"), "orders", choose("num_resamples").alias("num_resamples"), choose("confidence_level").alias("confidence_level"))


@query("A9_attack_success_rate", with_ctes(_MX, "SELECT model, count(*) AS pairs, round(avg(sim), 6) AS sim, round(avg(CASE WHEN sva THEN 1 ELSE 0 END), 6) AS asr FROM metrics GROUP BY model"))
def a9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(s.attack_success_rate(fx.metrics(spark, sf_dir), "sva", "sim", ["model"]))


@query("A10_gt_vs_syn_wer", with_ctes(_MX, "SELECT 0.0::DOUBLE AS wer_gt, round(sum(CASE WHEN event_id % 2 = 1 THEN coalesce(wer, 0) ELSE 0 END) / (count(*) // 2), 6) AS wer_syn FROM metrics"))
def a10(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = fx.metrics(spark, sf_dir).withColumn("wer", F.coalesce("wer", F.lit(0.0)))
    return rounded(s.gt_vs_syn_wer(filled, "event_id", "wer"))


@query(
    "A12_summary_by",
    with_ctes(_MX, f"""SELECT model, dataset, protection, grouping(dataset, model, protection) AS grouping_level, count(*) AS evaluated_pairs, {_means(s.GENERATION_MEANS)},
      round(avg(sva::INT), 6) AS avg_sva, count(sva) AS sva_pairs, round(avg(emotion_match::INT), 6) AS emotion_match_rate, count(emotion_match) AS emotion_pairs,
      {_RTF.format(d='generated_duration_sec', t='round(sum(synthesis_time_sec), 6)')}
      FROM metrics GROUP BY GROUPING SETS ((model, dataset, protection), (model, protection), (model), ())"""),
)
def a12(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = [["model", "dataset", "protection"], ["model", "protection"], ["model"], []]
    return rounded(s.summary_by(fx.metrics(spark, sf_dir), sets, F.round(F.sum("synthesis_time_sec"), 6)))


# --- reports ---------------------------------------------------------------------------------------
_BOARD = "SELECT speaker_id AS model, round(avg(sim), 6) AS sim, round(avg(wer), 6) AS wer, round(avg(speechmos_mos), 6) AS mos, round(avg(mcd), 6) AS mcd, round(avg(sva::INT), 6) AS sva FROM metrics GROUP BY speaker_id"


def _board(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(
        fx.metrics(spark, sf_dir).groupBy(F.col("speaker_id").alias("model")).agg(
            F.avg("sim").alias("sim"), F.avg("wer").alias("wer"), F.avg("speechmos_mos").alias("mos"), F.avg("mcd").alias("mcd"), s.rate_mean("sva").alias("sva")
        )
    )


@query(
    "R1_leaderboard",
    with_ctes(_MX, f"""SELECT *, row_number() OVER (ORDER BY sim DESC, model) AS rank, row_number() OVER (ORDER BY sim DESC, model) <= 3 AS medal,
      round_even(sim / max(sim) OVER () * 100, 1) AS bar FROM ({_BOARD})"""),
)
def r1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.leaderboard(_board(spark, sf_dir))


@query(
    "R2_best_per_column",
    with_ctes(_MX, f"SELECT model, {', '.join(f'coalesce({c} = {f}({c}) OVER (), false) AS best_{c}' for c, f in (('sim', 'max'), ('wer', 'min'), ('mos', 'max'), ('mcd', 'min'), ('sva', 'max')))} FROM ({_BOARD})"),
)
def r2(spark: SparkSession, sf_dir: str) -> DataFrame:
    directions = {"sim": "max", "wer": "min", "mos": "max", "mcd": "min", "sva": "max"}
    flagged = r.best_per_column(_board(spark, sf_dir), directions)
    return flagged.select("model", *[f"best_{c}" for c in directions])


_MATRIX = "SELECT dataset, " + ", ".join(f"round(avg(CASE WHEN protection = '{p}' THEN sim END), 6) AS {p}" for p in [CLEAN, *PROTECTIONS]) + " FROM metrics WHERE NOT (dataset = 'ds4' AND protection = 'ek') GROUP BY dataset"


def _matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    # one cell was never evaluated
    run = ~((F.col("dataset") == "ds4") & (F.col("protection") == "ek"))
    scored = fx.metrics(spark, sf_dir).withColumn("sim", F.when(run, F.col("sim")))
    return rounded(r.robustness_matrix(scored, by="dataset"))


@query("R3_robustness_matrix", with_ctes(_MX, _MATRIX))
def r3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matrix(spark, sf_dir)


_LONG = f"SELECT dataset, clean, unnest({PROTECTIONS!r}) AS method, unnest([{', '.join(PROTECTIONS)}]) AS score, unnest(range(0, {len(PROTECTIONS)})) AS place FROM ({_MATRIX})"


@query(
    "R4_strongest_protection",
    with_ctes(_MX, f"SELECT dataset, any_value(clean) AS clean, first(method ORDER BY score, place) FILTER (WHERE score IS NOT NULL) AS method, min(score) AS score, round(any_value(clean) - min(score), 6) AS \"drop\" FROM ({_LONG}) GROUP BY dataset"),
)
def r4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(r.strongest_protection(_matrix(spark, sf_dir), "dataset"))


@query("R5_most_protected_model", with_ctes(_MX, f"SELECT method, first(dataset ORDER BY score, dataset) AS model, min(score) AS score FROM ({_LONG}) WHERE score IS NOT NULL GROUP BY method"))
def r5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.most_protected_model(_matrix(spark, sf_dir), "dataset")


_NAMES = ["LibriTTS", "VCTK", "Multi-spk", "BG-clean", "BG-noise", "Halluc.", "Long", "AISHELL", "French", "Bilingual"]


@query(
    "R6_cross_dataset_matrix",
    with_ctes(_MX, "SELECT model, " + ", ".join(f"round(avg(CASE WHEN dataset = 'ds{i}' THEN sim END), 6) AS \"{n}\"" for i, n in enumerate(_NAMES)) + " FROM metrics GROUP BY model"),
)
def r6(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = F.element_at(F.array(*[F.lit(n) for n in r.DATASET_ORDER]), F.substring("dataset", 3, 2).cast("int") + 1)
    matrix = r.cross_dataset_matrix(fx.metrics(spark, sf_dir).withColumn("dataset", named))
    return matrix.select("model", *[F.round(F.col(f"`{n}`"), 6).alias(n) for n in r.DATASET_ORDER])


@query(
    "R6_scores_by_dimension",
    with_ctes(_MX, """SELECT model, CASE WHEN place = 0 THEN 'Baseline' WHEN place <= 5 THEN 'Input Robustness' ELSE 'Generation Robustness' END AS dimension,
      count(DISTINCT place) AS datasets, round(avg(sim), 6) AS sim FROM (SELECT model, sim, dataset[3:]::INT AS place FROM metrics) GROUP BY ALL"""),
)
def r6_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = F.element_at(F.array(*[F.lit(n) for n in r.DATASET_ORDER]), F.substring("dataset", 3, 2).cast("int") + 1)
    scored = fx.metrics(spark, sf_dir).select("model", "sim", named.alias("dataset"))
    return scored.groupBy("model", r.dataset_dimension(F.col("dataset")).alias("dimension")).agg(
        F.countDistinct("dataset").alias("datasets"), F.round(F.avg("sim"), 6).alias("sim")
    )


@query(
    "R7_heat_scale",
    with_ctes(_MX, """SELECT event_id, round(t, 6) AS heat, round_even(t * 100, 0)::INT AS heat_percent, t > 0.52 AS heat_flip
      FROM (SELECT event_id, CASE WHEN sim IS NOT NULL THEN least(greatest(sim / 0.78::DOUBLE, 0), 1) END AS t FROM metrics)"""),
)
def r7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fx.metrics(spark, sf_dir).select("event_id", *[c.alias(n) for n, c in r.heat_scale("sim").items()]))


@query(
    "R8_coverage_matrix",
    with_ctes(_MX, """, runs AS (SELECT model, dataset, protection FROM metrics WHERE NOT (model = 'click' AND dataset = 'ds4'))
      SELECT m.model, d.dataset, p.protection, count(r.model) AS runs, count(r.model) > 0 AS covered FROM (SELECT DISTINCT model FROM runs) m, (SELECT DISTINCT dataset FROM runs) d,
        (SELECT DISTINCT protection FROM runs) p LEFT JOIN runs r ON r.model = m.model AND r.dataset = d.dataset AND r.protection = p.protection GROUP BY ALL""").replace("\n, runs AS", ", runs AS"),
)
def r8(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = ~((F.col("model") == "click") & (F.col("dataset") == "ds4"))
    return r.coverage_matrix(fx.metrics(spark, sf_dir), ran=run)


@query(
    "R9_corpus_stats",
    "WITH speakers AS (" + fx.CTES["speakers"] + ") SELECT region AS dataset, count(*) AS pairs, count(DISTINCT speaker) AS speakers, count(DISTINCT segment) AS languages, round(avg(balance), 6) AS mean_seconds FROM speakers GROUP BY ROLLUP (region)",
)
def r9(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = r.corpus_stats(fx.speakers(spark, sf_dir), "region", "speaker", "segment", "balance")
    return rounded(stats.withColumnRenamed("region", "dataset"))


@query(
    "R9_corpus_sketches",
    "WITH speakers AS (" + fx.CTES["speakers"] + ") SELECT region AS dataset, count(*) AS pairs, count(DISTINCT speaker) AS speakers, count(DISTINCT segment) AS languages, round(avg(balance), 6) AS mean_seconds, true AS speakers_close, true AS languages_close FROM speakers GROUP BY ROLLUP (region)",
)
def r9_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the estimates beside the exact counts, within four standard errors of them
    speakers = fx.speakers(spark, sf_dir)
    columns = ("region", "speaker", "segment", "balance")
    exact, sketched = r.corpus_stats(speakers, *columns), r.corpus_sketches(speakers, *columns)
    kept = sketched.select(F.col("region").alias("_region"), F.col("pairs").alias("_pairs"), F.col("speakers").alias("_speakers"), F.col("languages").alias("_languages"), F.col("mean_seconds").alias("_mean"))
    close = lambda c: (F.abs(F.col(f"_{c}") - F.col(c)) <= 4 * 1.04 / 64 * F.col(c)).alias(f"{c}_close")
    both = exact.join(kept, exact["region"].eqNullSafe(kept["_region"]))
    return both.select(F.col("region").alias("dataset"), F.col("_pairs").alias("pairs"), "speakers", "languages", F.round("_mean", 6).alias("mean_seconds"), close("speakers"), close("languages"))


@query(
    "R10_long_to_wide_metrics",
    with_ctes(_MX, """SELECT model, unnest(['sim', 'wer', 'wer_ci_lower', 'wer_ci_upper']) AS metric, unnest([round(avg(sim), 6), round(avg(wer), 6), round(min(wer), 6), round(max(wer), 6)]) AS value FROM metrics GROUP BY model"""),
)
def r10(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = rounded(fx.metrics(spark, sf_dir).groupBy("model").agg(F.avg("sim").alias("sim"), F.avg("wer").alias("wer"), F.min("wer").alias("lower"), F.max("wer").alias("upper")))
    nested = wide.select("model", "sim", "wer", F.struct("lower", "upper").alias("wer_ci"))
    return r.wide_to_long(nested, ["model"], ["sim", "wer", "wer_ci"])


@query(
    "R10_wide_from_long",
    with_ctes(_MX, "SELECT model, protection, round(avg(sim), 6) AS sim, round(avg(wer), 6) AS wer FROM metrics GROUP BY model, protection"),
)
def r10_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = rounded(fx.metrics(spark, sf_dir).groupBy("model", "protection").agg(F.avg("sim").alias("sim"), F.avg("wer").alias("wer")))
    keys = ["model", "protection"]
    return r.long_to_wide(r.wide_to_long(wide, keys, ["sim", "wer"]), keys, ["sim", "wer"])


@query(
    "R11_compare_runs",
    with_ctes(_MX, """SELECT model, max(CASE WHEN protection = 'clean' THEN sim END) AS sim_clean, max(CASE WHEN protection = 'sp' THEN sim END) AS sim_sp, max(CASE WHEN protection = 'em' THEN sim END) AS sim_em,
      round(max(CASE WHEN protection = 'sp' THEN sim END) - max(CASE WHEN protection = 'clean' THEN sim END), 6) AS sim_sp_delta, round(max(CASE WHEN protection = 'em' THEN sim END) - max(CASE WHEN protection = 'clean' THEN sim END), 6) AS sim_em_delta
      FROM (SELECT model, protection, round(avg(sim), 6) AS sim FROM metrics GROUP BY model, protection) GROUP BY model"""),
)
def r11(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = rounded(fx.metrics(spark, sf_dir).groupBy("model", "protection").agg(F.avg("sim").alias("sim")))
    return rounded(r.compare_runs(cells, "model", "protection", ["clean", "sp", "em"], ["sim"]))


# --- the flagship: turn pairs -> error rates -> summary with intervals -> ranking -------------------
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = turn_wer(fx.turns(spark, sf_dir)).withColumn("cer", cer("ref", "hyp"))
    board = scored.groupBy("hyp_role").agg(
        F.count(F.lit(1)).alias("pairs"), *s.metric_means({"wer": "wer", "cer": "cer"})
    )
    ci = b.bootstrap_ci(scored, ["hyp_role"], ["wer"], b.BootstrapConfig(num_resamples=200, seed=11))
    with_ci = b.attach_intervals(board, ci, ["hyp_role"], {"wer": "avg_wer"})
    return r.leaderboard(with_ci, "hyp_role", "avg_wer")


@query("flagship_turn_error_report")
def flagship_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagship(spark, sf_dir).select("hyp_role", "pairs", "avg_wer", "avg_cer", "rank", "avg_wer_ci.lower", "avg_wer_ci.upper")


_ALPHABET = """alphabet AS (SELECT string_agg(c, '' ORDER BY c) AS chars, string_agg(chr(n::INT), '' ORDER BY c) AS codes
  FROM (SELECT c, row_number() OVER (ORDER BY c) AS n FROM (SELECT DISTINCT unnest(string_split(text, '')) AS c FROM conversations)))"""


@query(
    "flagship_turn_error_summary",
    with_ctes(["turns"], f""", {_ALPHABET}, scored AS (SELECT hyp_role, w, CASE WHEN ref = '' THEN NULL ELSE levenshtein(translate(ref, chars, codes), translate(hyp, chars, codes))::DOUBLE / length(ref) END AS cer
        FROM ({_wer_sql('turns', 'hyp_role, ref, hyp')}), alphabet)
      SELECT hyp_role, count(*) AS pairs, round(avg(w), 6) AS avg_wer, round(avg(cer), 6) AS avg_cer, row_number() OVER (ORDER BY avg(w) DESC, hyp_role) AS rank FROM scored GROUP BY hyp_role""").replace("\n, alphabet", ", alphabet"),
)
def flagship_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = turn_wer(fx.turns(spark, sf_dir)).withColumn("cer", cer("ref", "hyp"))
    board = scored.groupBy("hyp_role").agg(F.count(F.lit(1)).alias("pairs"), *s.metric_means({"wer": "wer", "cer": "cer"}))
    ranked = r.leaderboard(board, "hyp_role", "avg_wer")
    return rounded(ranked).select("hyp_role", "pairs", "avg_wer", "avg_cer", "rank")
