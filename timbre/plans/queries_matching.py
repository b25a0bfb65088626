"""Queries for the matching joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from timbre.operators import matching as mt
from timbre.operators.claims import resolve_generated
from timbre.operators.manifest import clone_filename
from timbre.plans import fixtures as fx
from timbre.plans.fixtures import with_ctes
from timbre.plans.registry import query
from timbre.sources.filelists import rewrite_filelist

_S = ["legacy", "manifest", "samples"]
_G = [*_S, "generated"]
_STEM = "regexp_replace(string_split({p}, '/')[-1], '\\.[^.]+$', '')"


@query(
    "P1_clone_filename",
    with_ctes(_S, f"""SELECT "index", speaker_id || '/' || CASE WHEN doc_id % 3 = 0 THEN {_STEM.format(p='prompt_path')} || '_to_' || {_STEM.format(p='target_path')}
      WHEN doc_id % 3 = 1 THEN {_STEM.format(p='prompt_path')} WHEN doc_id % 2 = 0 THEN {_STEM.format(p='target_path')} ELSE 'sample_' || "index" END || '_cloned.wav' AS output FROM samples"""),
)
def p1(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.col("doc_id")
    prompt = F.when(doc % 3 != 2, F.col("prompt_path"))
    target = F.when((doc % 3 == 0) | ((doc % 3 == 2) & (doc % 2 == 0)), F.col("target_path"))
    return fx.samples(spark, sf_dir).select(
        "index", F.concat_ws("/", "speaker_id", clone_filename(prompt, target, "index")).alias("output")
    )


_DIRECT = f"""
  SELECT s."index", s.doc_id, min_by(g.path, c.priority) AS clone_path, min(c.priority) AS priority
  FROM samples s, LATERAL (VALUES
      (1, {_STEM.format(p='s.prompt_path')} || '_to_' || {_STEM.format(p='s.target_path')} || '_cloned.wav'),
      (2, {_STEM.format(p='s.prompt_path')} || '_cloned.wav'),
      (3, {_STEM.format(p='s.target_path')} || '_cloned.wav')) c(priority, name)
  JOIN generated g ON g.parent = string_split(s.target_path, '/')[-2] AND g.name = c.name
  GROUP BY s."index", s.doc_id
"""


@query(
    "P2_locate_clone",
    with_ctes(_G, f"""SELECT s."index", d.clone_path, d.priority, string_split(s.target_path, '/')[-2] IN (SELECT parent FROM generated) AS speaker_dir_exists
      FROM samples s LEFT JOIN ({_DIRECT}) d USING ("index")"""),
)
def p2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.locate_clone(fx.samples(spark, sf_dir), fx.generated(spark, sf_dir))


# Forty target names shared by all samples, and files under prefixes and numbers of those names.
# The SQL walks the samples one by one and lets each take its first free file.
_CLAIMS = """
  s AS MATERIALIZED (SELECT "index" AS i, speaker_id AS t, 'take' || (doc_id % 40) AS b FROM samples),
  f AS MATERIALIZED (SELECT name, path, row_number() OVER (ORDER BY string_split(path, '/')) AS place FROM (
    SELECT name, min_by(path, string_split(path, '/')) AS path FROM (SELECT name, 'gen/' || source || '/' || name AS path FROM (
      SELECT source, CASE doc_id % 3 WHEN 0 THEN 'take' || (doc_id % 40) || '_cloned_' || doc_id WHEN 1 THEN 'take' || (doc_id % 40) || '_' || (doc_id % 200) || '_x'
        ELSE source || '_' || (doc_id % 500) END || '.wav' AS name FROM documents)) GROUP BY name)),
  w AS (SELECT i, unnest(range(0, 6)) AS level, unnest([b || '_cloned', t || '_' || t || '_' || i, t || '_' || b || '_' || i, b || '_' || t || '_' || i, b || '_' || i, t || '_' || i]) AS stem FROM s),
  e AS (SELECT i, level, place, path FROM w JOIN f ON f.name = stem || '.wav' UNION ALL SELECT i, level + 6, place, path FROM w JOIN f ON starts_with(f.name, stem)),
  c AS MATERIALIZED (SELECT s.i, list(path ORDER BY level, place) AS paths FROM s LEFT JOIN e USING (i) GROUP BY s.i),
  walk AS (SELECT -1::BIGINT AS i, []::VARCHAR[] AS taken, NULL::VARCHAR AS pick
    UNION ALL SELECT i, CASE WHEN p IS NULL THEN taken ELSE list_append(taken, p) END, p
      FROM (SELECT c.i, walk.taken, list_filter(c.paths, lambda x: NOT list_contains(walk.taken, x))[1] AS p FROM walk JOIN c ON c.i = walk.i + 1))
"""


@query(
    "P3_resolve_generated",
    with_ctes(_S, f"-- claims\n, {_CLAIMS} SELECT i AS \"index\", pick AS path FROM walk WHERE pick IS NOT NULL").replace("WITH ", "WITH RECURSIVE ", 1),
)
def p3(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.col("doc_id")
    number = lambda n: (doc % n).cast("string")
    take = F.concat(F.lit("take"), number(40))
    rows = fx.samples(spark, sf_dir).select(
        "index", "speaker_id", F.concat(F.lit("data/"), "speaker_id", F.lit("/"), take, F.lit(".wav")).alias("target_path")
    )
    name = (
        F.when(doc % 3 == 0, F.concat(take, F.lit("_cloned_"), doc.cast("string")))
        .when(doc % 3 == 1, F.concat(take, F.lit("_"), number(200), F.lit("_x")))
        .otherwise(F.concat("source", F.lit("_"), number(500)))
    )
    files = fx.table(spark, sf_dir, "documents").select("source", F.concat(name, F.lit(".wav")).alias("name"))
    inventory = files.select("name", F.concat_ws("/", F.lit("gen"), "source", "name").alias("path"))
    return resolve_generated(rows, inventory).select("index", "path")


@query(
    "P4_collect_pairs",
    with_ctes(_G, f"""SELECT s."index", CASE WHEN s.doc_id % 7 = 0 THEN NULL ELSE d.clone_path END AS clone_path,
        CASE WHEN s.doc_id % 7 = 0 THEN 'no_ground_truth' WHEN d.clone_path IS NULL THEN 'no_clone' ELSE 'paired' END AS status
      FROM samples s LEFT JOIN ({_DIRECT}) d USING ("index")"""),
)
def p4(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.samples(spark, sf_dir)
    truth = rows.filter(F.col("doc_id") % 7 != 0).select(F.col("target_path").alias("path"))
    # a target shared by two samples must not come back through the other one
    rows = rows.withColumn("target_path", F.when(F.col("doc_id") % 7 != 0, F.col("target_path")).otherwise("gone/x.wav"))
    pairs = mt.collect_pairs(rows, fx.generated(spark, sf_dir), ground_truth=truth, fallback=False)
    return pairs.select("index", "clone_path", "status")


# Samples without a direct hit take, in their order, the first free file of their names; a direct hit
# closes its file to later samples. The SQL walks them one by one.
_PAIRED = f"""
  direct AS MATERIALIZED ({_DIRECT}),
  listed AS MATERIALIZED (SELECT name, path, row_number() OVER (ORDER BY string_split(path, '/')) AS place
    FROM (SELECT name, min_by(path, string_split(path, '/')) AS path FROM generated GROUP BY name)),
  closed AS (SELECT clone_path AS path, min("index") AS holder FROM direct GROUP BY clone_path),
  asking AS MATERIALIZED (SELECT "index" AS i, row_number() OVER (ORDER BY "index") AS turn, speaker_id AS t,
      {_STEM.format(p='target_path')} AS b, string_split(target_path, '/')[-2] AS p
    FROM samples WHERE "index" NOT IN (SELECT "index" FROM direct) AND string_split(target_path, '/')[-2] IN (SELECT parent FROM generated)),
  wishes AS (SELECT i, unnest(range(0, 6)) AS level,
      unnest([b || '_cloned', t || '_' || p || '_' || i, t || '_' || b || '_' || i, b || '_' || t || '_' || i, b || '_' || i, t || '_' || i]) AS stem FROM asking),
  edges AS (SELECT i, level, place, path FROM wishes JOIN listed ON name = stem || '.wav' UNION ALL SELECT i, level + 6, place, path FROM wishes JOIN listed ON starts_with(name, stem)),
  choices AS MATERIALIZED (SELECT a.i, a.turn, list(e.path ORDER BY level, place) FILTER (holder IS NULL OR holder > a.i) AS paths
    FROM asking a LEFT JOIN edges e USING (i) LEFT JOIN closed USING (path) GROUP BY a.i, a.turn),
  walk AS (SELECT 0::BIGINT AS turn, -1::BIGINT AS i, []::VARCHAR[] AS taken, NULL::VARCHAR AS pick
    UNION ALL SELECT turn, i, CASE WHEN p IS NULL THEN taken ELSE list_append(taken, p) END, p
      FROM (SELECT c.turn, c.i, walk.taken, list_filter(c.paths, lambda x: NOT list_contains(walk.taken, x))[1] AS p FROM walk JOIN choices c ON c.turn = walk.turn + 1))
"""


@query(
    "P4_collect_pairs_with_claims",
    with_ctes(_G, f"""-- claims
, {_PAIRED} SELECT s."index", coalesce(d.clone_path, w.pick) AS clone_path,
      CASE WHEN d.clone_path IS NOT NULL THEN 'direct' WHEN w.pick IS NOT NULL THEN 'claimed' END AS rule,
      CASE WHEN coalesce(d.clone_path, w.pick) IS NULL THEN 'no_clone' ELSE 'paired' END AS status
    FROM samples s LEFT JOIN direct d USING ("index") LEFT JOIN walk w ON w.i = s."index\"""").replace("WITH ", "WITH RECURSIVE ", 1),
)
def p4_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = fx.samples(spark, sf_dir).select("index", "speaker_id", "prompt_path", "target_path")
    return mt.collect_pairs(wanted, fx.generated(spark, sf_dir)).select("index", "clone_path", "rule", "status")


# Protected copies of the documents: by stem, with a mark, by numeric suffix (twice), by number.
_PROTECTED = """
  SELECT unnest(CASE doc_id % 5
    WHEN 0 THEN ['prot/' || source || '/s_' || doc_id || '_0.wav']
    WHEN 1 THEN ['prot/' || source || '/s_' || doc_id || '_0_Spec_protected.wav']
    WHEN 2 THEN ['prot/b/x_' || doc_id || '_0.wav', 'prot/a/y_' || doc_id || '_0.wav']
    WHEN 3 THEN ['prot/0_SPEC_' || doc_id || '.wav'] ELSE [] END) AS path
  FROM documents
"""


def _protected(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = fx.table(spark, sf_dir, "documents").select("doc_id", "source")
    doc = F.col("doc_id").cast("string")

    def path(*parts: object) -> Column:
        return F.concat(F.lit("prot/"), *[F.lit(p) if isinstance(p, str) else p for p in parts])

    rest = F.col("doc_id") % 5
    files = (
        F.when(rest == 0, F.array(path(F.col("source"), "/s_", doc, "_0.wav")))
        .when(rest == 1, F.array(path(F.col("source"), "/s_", doc, "_0_Spec_protected.wav")))
        .when(rest == 2, F.array(path("b/x_", doc, "_0.wav"), path("a/y_", doc, "_0.wav")))
        .when(rest == 3, F.array(path("0_SPEC_", doc, ".wav")))
        .otherwise(F.array().cast("array<string>"))
    )
    originals = docs.select(F.col("doc_id").alias("index"), F.concat(F.lit("orig/s_"), doc, F.lit("_0.wav")).alias("path"))
    return originals, docs.select(F.explode(files).alias("path"))


_MATCHED = f"""
  prot AS ({_PROTECTED}),
  nums AS (SELECT path, row_number() OVER (ORDER BY regexp_extract(path, '0_SPEC_([0-9]+)', 1)::BIGINT) - 1 AS i FROM prot WHERE path LIKE 'prot/0_SPEC_%'),
  matched AS (
    SELECT d.doc_id AS "index", 'orig/s_' || d.doc_id || '_0.wav' AS original,
      CASE d.doc_id % 5 WHEN 0 THEN 'prot/' || source || '/s_' || doc_id || '_0.wav' WHEN 1 THEN 'prot/' || source || '/s_' || doc_id || '_0_Spec_protected.wav'
        WHEN 2 THEN 'prot/a/y_' || doc_id || '_0.wav' ELSE nums.path END AS protected,
      CASE WHEN d.doc_id % 5 <= 1 THEN 'stem' WHEN d.doc_id % 5 = 2 THEN 'suffix' WHEN nums.path IS NOT NULL THEN 'order' END AS rule,
      CASE WHEN d.doc_id % 5 = 2 THEN 2 ELSE 0 END::BIGINT AS candidates
    FROM documents d LEFT JOIN nums ON nums.i = d.doc_id)
"""


@query(
    "P5_match_protected",
    f"""WITH {_MATCHED} SELECT *, CASE WHEN protected IS NULL THEN NULL ELSE string_split(protected, '/')[-1] <> string_split(original, '/')[-1] END AS name_mismatch FROM matched""",
)
def p5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.match_protected(*_protected(spark, sf_dir))


@query(
    "P6_override_by_basename",
    with_ctes(_S, """SELECT s."index", coalesce(o.path, s.target_path) AS resolved_path, coalesce(o.n - 1, 0)::BIGINT AS duplicates FROM samples s
      LEFT JOIN (SELECT 'utt' || doc_id || '.wav' AS name, CASE WHEN doc_id % 4 = 0 THEN 'orig/a/' ELSE 'orig/b/' END || 'utt' || doc_id || '.wav' AS path,
          CASE WHEN doc_id % 4 = 0 THEN 2 ELSE 1 END AS n FROM documents WHERE doc_id % 3 <> 0) o
      ON o.name = string_split(s.target_path, '/')[-1]"""),
)
def p6(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.col("doc_id")
    name = F.concat(F.lit("utt"), doc.cast("string"), F.lit(".wav"))
    both = F.when(doc % 4 == 0, F.array(F.lit("orig/b/"), F.lit("orig/a/"))).otherwise(F.array(F.lit("orig/b/")))
    files = fx.table(spark, sf_dir, "documents").filter(doc % 3 != 0).select(name.alias("name"), F.explode(both).alias("dir"))
    inventory = files.select("name", F.concat("dir", "name").alias("path"))
    return mt.override_by_basename(fx.samples(spark, sf_dir), "target_path", inventory).select("index", "resolved_path", "duplicates")


@query(
    "P7_override_prompts",
    with_ctes(_S, """SELECT "index", CASE doc_id % 4 WHEN 0 THEN 'safe/' || speaker_id || '/utt' || doc_id || '.wav' WHEN 1 THEN 'safe/utt' || doc_id || '.wav'
        WHEN 2 THEN 'safe/' || speaker_id || '/utt' || doc_id || '.wav' ELSE prompt_path END AS prompt_path, doc_id % 4 = 3 AS prompt_missing FROM samples"""),
)
def p7(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.col("doc_id")
    name = F.concat(F.lit("utt"), doc.cast("string"), F.lit(".wav"))
    own, flat = F.concat(F.lit("safe/"), "source", F.lit("/"), name), F.concat(F.lit("safe/"), name)
    spots = F.when(doc % 4 == 0, F.array(own)).when(doc % 4 == 1, F.array(flat)).when(doc % 4 == 2, F.array(flat, own)).otherwise(F.array().cast("array<string>"))
    files = fx.table(spark, sf_dir, "documents").select(F.explode(spots).alias("path"))
    return mt.override_prompts(fx.samples(spark, sf_dir), files, "safe", strict=False).select("index", "prompt_path", "prompt_missing")


@query("P8_latest_run", with_ctes(["runs"], "SELECT model, max(run) AS latest FROM runs WHERE regexp_full_match(run, '[0-9]{8}-[0-9]{6}') GROUP BY model"))
def p8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.latest_run(fx.runs(spark, sf_dir), "model", "run")


@query("P8_latest_run_any_name", with_ctes(["runs"], "SELECT model, max(run) AS latest FROM runs WHERE run NOT LIKE '.%' GROUP BY model"))
def p8_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.latest_run(fx.runs(spark, sf_dir), "model", "run", mtime="o_orderkey")


# Utterances are documents; five models generated some of them under different names.
_MODELS = ["m0", "m1", "m2", "m3", "m4"]
_ACROSS = """
  SELECT m.model, d.source AS parent, CASE m.i
      WHEN 0 THEN 'utt' || doc_id || '_cloned.wav'
      WHEN 1 THEN 'ref_to_utt' || doc_id || '_cloned.wav'
      WHEN 2 THEN 'a_to_b_to_utt' || doc_id || '_cloned.mp3'
      WHEN 3 THEN 'utt' || doc_id || '_cloned.v2.flac' END AS name, d.doc_id, m.i
  FROM documents d, (SELECT unnest(range(0, 4)) AS i, 'm' || unnest(range(0, 4)) AS model) m
  WHERE (d.doc_id + m.i) % 6 <> 0
"""


def _utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.col("doc_id").cast("string")
    return fx.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("utterance"),
        F.col("source").alias("speaker_id"),
        F.concat(F.lit("utt"), doc, F.lit("_cloned.wav")).alias("gen_basename"),
        F.concat(F.lit("vault/"), "source", F.lit("/utt"), doc, F.lit(".wav")).alias("ground_truth_path"),
    )


def _across(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.col("doc_id").cast("string")
    clone = F.concat(F.lit("utt"), doc, F.lit("_cloned"))
    names = [
        F.concat(clone, F.lit(".wav")),
        F.concat(F.lit("ref_to_"), clone, F.lit(".wav")),
        F.concat(F.lit("a_to_b_to_"), clone, F.lit(".mp3")),
        F.concat(clone, F.lit(".v2.flac")),
    ]
    rows = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(f"m{i}").alias("model"), n.alias("name")) for i, n in enumerate(names)])
    files = fx.table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("parent"), F.inline(rows))
    return files.filter((F.col("doc_id") + F.col("i")) % 6 != 0).select(
        "model", "parent", "name", F.concat_ws("/", "model", "parent", "name").alias("path")
    )


@query("P9_resolve_across_models", f"SELECT doc_id AS utterance, model, model || '/' || parent || '/' || name AS path, (i + 1)::INTEGER AS rule FROM ({_ACROSS})")
def p9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.resolve_across_models(_utterances(spark, sf_dir), _across(spark, sf_dir))


@query(
    "P9_missing_across_models",
    f"SELECT d.doc_id AS utterance, m.model FROM documents d, (SELECT unnest({_MODELS!r}) AS model) m ANTI JOIN ({_ACROSS}) a ON a.doc_id = d.doc_id AND a.model = m.model",
)
def p9_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    utterances = _utterances(spark, sf_dir)
    models = spark.createDataFrame([(m,) for m in _MODELS], "model string")
    return mt.missing_across_models(utterances, mt.resolve_across_models(utterances, _across(spark, sf_dir)), models)


_REFERENCES = """
  SELECT doc_id AS utterance, CASE doc_id % 4 WHEN 0 THEN 'vault/' || source || '/utt' || doc_id || '.wav' WHEN 1 THEN 'ref/' || source || '/utt' || doc_id || '.flac'
    WHEN 2 THEN 'ref/' || source || '/utt' || doc_id || '.flac' END AS reference_path, CASE doc_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 1 END AS reference_rule FROM documents
"""


def _references(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.col("doc_id")
    name = F.concat(F.lit("utt"), doc.cast("string"))

    def at(root: str, ending: str) -> Column:
        return F.concat(F.lit(f"{root}/"), F.col("source"), F.lit("/"), name, F.lit(ending))

    spots = (
        F.when(doc % 4 == 0, F.array(at("vault", ".wav"), at("ref", ".wav")))
        .when(doc % 4 == 1, F.array(at("ref", ".flac")))
        .when(doc % 4 == 2, F.array(at("ref", ".mp3"), at("ref", ".flac")))
        .otherwise(F.array().cast("array<string>"))
    )
    files = fx.table(spark, sf_dir, "documents").select(F.col("source").alias("parent"), F.explode(spots).alias("path"))
    return files.select("parent", "path", F.substring_index("path", "/", -1).alias("name"))


@query("P10_resolve_reference", _REFERENCES)
def p10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mt.resolve_reference(_utterances(spark, sf_dir), _references(spark, sf_dir))
    return found.select("utterance", "reference_path", "reference_rule")


@query(
    "P11_target_stem",
    with_ctes(["generated"], f"""SELECT path, regexp_replace(CASE WHEN contains(s, '_to_') THEN substr(s, strpos(s, '_to_') + 4) ELSE s END, '_cloned$', '') AS target
      FROM (SELECT path, {_STEM.format(p='name')} AS s FROM generated)"""),
)
def p11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.generated(spark, sf_dir).select("path", mt.target_stem(F.regexp_replace("name", r"\.wav$", "")).alias("target"))


@query(
    "P12_pair_by_index",
    """SELECT doc_id AS line_no, 'gt/' || doc_id || '.wav' AS path, source AS speaker, 'syn/0_' || CASE WHEN doc_id % 50 = 0 THEN 'other' ELSE source END || '_' || doc_id || '.wav' AS synthesized_path,
      doc_id % 50 <> 0 AS speaker_agrees FROM documents""",
)
def p12(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.col("doc_id").cast("string")
    docs = fx.table(spark, sf_dir, "documents")
    listed = docs.select(F.col("doc_id").alias("line_no"), F.concat(F.lit("gt/"), doc, F.lit(".wav")).alias("path"), F.col("source").alias("speaker"))
    speaker = F.when(F.col("doc_id") % 50 == 0, "other").otherwise(F.col("source"))
    files = docs.select(F.concat(F.lit("syn/0_"), speaker, F.lit("_"), doc, F.lit(".wav")).alias("path"))
    return mt.pair_by_index(listed, files, strict=False)


_REWRITE = """
  SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'in/' WHEN 1 THEN 'in/' WHEN 2 THEN 'old/' ELSE 'raw/' END || CASE WHEN doc_id % 4 = 3 THEN 'z' ELSE 'u' END || doc_id || '.wav' AS p,
    source || '|' || upper(lang) || '|' || md5(text) || '|p|t|w' || CASE WHEN doc_id % 17 = 0 THEN '|x' ELSE '' END AS rest FROM documents
"""


@query(
    "P13_rewrite_filelist",
    f"""WITH l AS (SELECT *, rest[strpos(rest, '|') + 1:] AS sig, doc_id % 17 <> 0 AS good FROM ({_REWRITE})),
      known AS (SELECT 'in/u' || doc_id || '.wav' AS p, 'out/u' || doc_id || '_new.wav' AS n FROM documents WHERE doc_id % 4 <> 3),
      sigs AS (SELECT sig, arg_max(n, p) AS n FROM l JOIN known USING (p) WHERE good GROUP BY sig),
      r AS (SELECT l.*, coalesce(a.n, s.n, b.n) AS n FROM l LEFT JOIN known a ON a.p = l.p LEFT JOIN sigs s ON s.sig = l.sig
        LEFT JOIN known b ON string_split(b.p, '/')[2] = string_split(l.p, '/')[2])
    SELECT p || '|' || rest AS line, CASE WHEN good AND n IS NOT NULL THEN n || '|' || rest ELSE p || '|' || rest END AS new_line,
      good AND n IS NOT NULL AS updated FROM r""",
)
def p13(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc, key = F.col("doc_id"), F.col("doc_id").cast("string")
    folder = F.when(doc % 4 <= 1, "in/").when(doc % 4 == 2, "old/").otherwise("raw/")
    name = F.concat(F.when(doc % 4 == 3, "z").otherwise("u"), key, F.lit(".wav"))
    rest = F.concat_ws("|", "source", F.upper("lang"), F.md5("text"), F.lit("p"), F.lit("t"), F.lit("w"))
    docs = fx.table(spark, sf_dir, "documents")
    lines = docs.select(F.concat(folder, name, F.lit("|"), rest, F.when(doc % 17 == 0, "|x").otherwise("")).alias("line"))
    files = docs.filter(doc % 4 != 3).select(
        F.concat(F.lit("in/u"), key, F.lit(".wav")).alias("old_path"), F.concat(F.lit("out/u"), key, F.lit("_new.wav")).alias("new_path")
    )
    return rewrite_filelist(lines, files)


@query(
    "P14_attach_timings",
    """SELECT event_id, 'out/' || user_id || '.wav' AS clone_path, t.s AS synthesis_time_sec FROM events LEFT JOIN
      (SELECT c_custkey, c_acctbal AS s FROM customer WHERE c_custkey % 3 <> 0) t ON t.c_custkey = user_id""",
)
def p14(spark: SparkSession, sf_dir: str) -> DataFrame:
    def path(column: str) -> Column:
        return F.concat(F.lit("out/"), F.col(column).cast("string"), F.lit(".wav"))

    pairs = fx.table(spark, sf_dir, "events").select("event_id", path("user_id").alias("clone_path"))
    timings = fx.table(spark, sf_dir, "customer").filter(F.col("c_custkey") % 3 != 0)
    timed = timings.select(path("c_custkey").alias("generated_path"), F.col("c_acctbal").alias("synthesis_time_sec"))
    return mt.attach_timings(pairs, timed)


@query("P15_clean_vs_processed", f"""WITH {_MATCHED} SELECT "index", replace(original, 'orig/', 'clean/') AS original, protected FROM matched""")
def p15(spark: SparkSession, sf_dir: str) -> DataFrame:
    originals, files = _protected(spark, sf_dir)
    clean = originals.withColumn("path", F.replace("path", F.lit("orig/"), F.lit("clean/")))
    return mt.clean_vs_processed(originals, files, clean).select("index", "original", "protected")
